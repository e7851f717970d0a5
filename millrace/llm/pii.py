"""Personal information in free text, by a skip-chain conditional random field.

A document's nodes are the tokens of its capitalized runs (is it part of a person's name?) and its candidates for email
addresses, phone numbers, identity numbers and street addresses (is it one?), a number that may be a phone or an identity
number being two nodes that exclude each other. Neighbours in a run share a chain potential; occurrences of one word, of one
number, address or email address anywhere in the document a skip potential, as do a name's words and the email addresses
spelt with them. Loopy message passing gives the marginals.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .leaves import string_leaves

BITS = 18
KINDS = ("name", "email", "phone", "id_number", "address")

# Words that tell what follows, used to label the training sample and to find candidates.
_U = r"A-ZÀ-ÖØ-ÞŁŚŻŠŽČĆĐŐŰİŞĞ"
_TITLE = r"(?:Mrs|Mr|Ms|Miss|Mx|Dr|Prof|Herrn|Herr|Frau|Mme|Mlle|Sr|Sra|Señor|Señora|M)"
_PARTICLE = r"(?:de la|de las|de los|del|de|da|dos|do|di|du|des|von der|von|van der|van den|van|zu|al|el|bin|ibn|ter|ten|der|la|le)"
_WORD = rf"(?:(?:O|D|L|d|l)['’])?[{_U}][\w'’]*(?:-[{_U}][\w'’]*)*"
_TOKEN = rf"(?:[{_U}]\.(?:-?[{_U}]\.)*|{_WORD})"
_JOINT = rf"(?:{_PARTICLE}|DE LA|DE|DEL|VON DER|VON|VAN DER|VAN|DI|DA|DU)"
_SEGMENT = rf"(?:{_JOINT} )?{_TOKEN}(?: (?:{_JOINT} )?{_TOKEN})*"
#: A surname, a comma and what goes before it; or tokens with nothing but spaces and particles between them.
RUN = re.compile(rf"(?<![\w@.'’/+#-])(?!(?:Mrs|Mr|Ms|Miss|Dr|Prof|Herrn|Herr|Frau|Mme|Mlle|Señora?)\b)((?:{_JOINT} )?{_WORD}, (?:[{_U}]\.(?:-?[{_U}]\.)*|{_WORD}(?<=\w\w))(?: [{_U}]\.)*(?! [{_U}])(?![\w@'’-])|{_SEGMENT})(?![\w@])")
_PAIR = re.compile(rf"[{_U}][\w'’.-]*,? (?:{_JOINT} )?[{_U}]")
_TOKENS = re.compile(rf"{_TOKEN}|[^\W\d_]+")
_EMAIL = re.compile(r"(?i)(?<![\w.+-])[a-zà-ÿ0-9][\w.+-]{0,63}(?: ?@ ?| ?[\[(] ?(?:at|@) ?[\])] ?)(?:[a-z0-9-]+(?:\.| ?[\[(] ?(?:dot|\.) ?[\])] ?))+[a-z]{2,24}(?![\w@-])|(?<![\w.+-])[a-z0-9][\w.+-]{1,63} at (?:[a-z0-9-]+ dot )+[a-z]{2,24}\b")
_NUMBER = re.compile(rf"(?<![\w@#/.,+-])(?:\+ ?\d|\(\+?\d{{1,5}}\)|\d|[A-Z]{{1,8}}-?(?=\d)|[A-Z]{{2}} (?=\d\d \d\d \d\d\b))[\dA-Z]*(?:(?: ?[-./] ?| ?\(|\) ?-?| )[\dA-Z]*\d[\dA-Z]*)*(?:(?: |-)[A-Z](?!\w|\.\w))?(?![\w@])")
_DATE = re.compile(r"\d{1,2}[./-]\d{4}(?: ?- ?\d{1,2}[./-]\d{4})?|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}(?:[./-]\d{1,2})?|(?:19|20)\d\d ?[-/] ?(?:19|20)\d\d")
_FLAT = re.compile(r"(?i)\b(?:flat|apt\.?|apartment|unit|suite|room|floor|wohnung|piso) [\w-]{1,5}, ?$")
_DIGIT = re.compile(r"\d")
_MANY_DIGITS = re.compile(r"\d(?:[^\d\n]{0,3}\d){4}")
_EXT = re.compile(r" ?(?:ext\.?|x|Durchwahl|poste) ?\d{1,5}\b")
_STREET = r"(?i:street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|way|row|walk|terrace|ter|crescent|cres|close|place|pl|square|sq|boulevard|blvd|hill|gardens|gdns|mews|parade|highway|hwy|circle|alley|path|grove|park|quay|rise|view|yard|wharf|green|mount|parkway|pkwy|trail|loop)"
_NO = r"\d{1,5}(?: ?[-–/] ?\d{1,5})?[A-Za-z]?"
_ADDRESS_NUMBER_FIRST = re.compile(
    "|".join(
        [
            rf"(?<![\w.,:-]){_NO} (?:[NSEWnsew]\.? )?(?:[{_U}][\w'’-]*\.? ){{1,4}}{_STREET}\b\.?",
            rf"(?<![\w.:-]){_NO}(?: ?(?:bis|ter|BIS|TER))?,? (?i:rue|avenue|av\.|boulevard|bd\.?|place|chemin|allée|impasse|quai|route|cours|square|passage|ruelle|sentier|faubourg|esplanade|promenade) (?:(?i:de la|de l['’]|du|des|de|d['’]|aux|au|à la|le|la|les) ?)?[\w'’-]+(?: [{_U}][\w'’-]+){{0,3}}",
        ]
    )
)
_ADDRESS_NUMBER_LAST = re.compile(
    "|".join(
        [
            rf"(?<![\w-])(?i:calle|c/|plaza|plaça|paseo|avenida|avda\.?|av\.|camino|ronda|travesía|carrer|carretera|rua|via|viale|piazza|corso|largo|praça|travessa|vicolo|strada|ulica|ul\.|aleja) ?(?:(?i:de las|de los|de la|del|dei|della|de|das|dos|da|do|di|la|el|los|las) )*[\w'’-]+(?: (?:(?i:de|del|de la) )?[{_U}][\w'’-]+){{0,3}},? (?:n[.º°o]* ?)?{_NO}\b",
            rf"(?<![\w-])(?:(?:(?i:am|an der|an den|auf der|auf dem|im|in der|in den|zum|zur|unter den|unter der|hinter der|vor dem|obere[rs]?|untere[rs]?|alte[rs]?|neue[rs]?|große[rs]?|kleine[rs]?|lange|hohe[rs]?)) [{_U}][\w-]+|[{_U}][\w-]*(?i:stra(?:ß|ss)e|str\.?|gasse|weg|platz|allee|ring|ufer|damm|steig|steg|markt|graben|gatan|vägen|gade|vej|straat|laan|plein)|[{_U}][\w-]+ (?i:stra(?:ß|ss)e|str\.|gasse|weg|platz|allee|ring|ufer|damm)),? {_NO}\b",
        ]
    )
)
#: What any such address holds, quick to look for.
_NUMBER_THEN = re.compile(rf"\d[A-Za-z]?(?: ?(?:bis|ter|BIS|TER))?,? (?:[{_U}NSEWnsew]|(?i:rue|av|bo|bd|pl|ch|al|im|qu|ro|co|sq|pa|ru|se|fa|es|pr))")
_SPACE_NUMBER = re.compile(r" (?:n[.º°o]* ?)?\d")
_STREET_SIGNS = ("calle", "c/", "plaza", "plaça", "paseo", "avenida", "avda", "av.", "camino", "ronda", "travesía", "carrer", "rua ", "via", "piazza", "corso", "largo", "praça", "travessa", "vicolo", "strada", "ulica", "ul.", "aleja", "am ", "an de", "auf de", "im ", "in de", "zum ", "zur ", "unter", "hinter", "vor dem", "obere", "alte", "neue", "große", "kleine", "lange", "hohe", "straße", "strasse", "str.", "gasse", "weg", "platz", "allee", "ring", "ufer", "damm", "steig", "steg", "markt", "graben", "gatan", "vägen", "gade", "vej", "straat", "laan", "plein", "str ")
_STREET_SIGN = re.compile("|".join(map(re.escape, _STREET_SIGNS)))
_ID_LABEL = re.compile(r"(?i)(?:\bssn|\bsin|\bnino|\bdni(?:/nif)?|\bni (?:number|no)|\bnif|\bnie|\bnhs|\bpesel|\bcpf|\bcurp|\baadhaar|\bbsn|social (?:security|insurance)|sécurité sociale|soc\. ?sec|\bsozialvers\w*|\bversicherungs\w*|national (?:id|insurance|identity)|identity (?:card|number|no)|\bid (?:card|number|no)|citizen (?:number|no|id)|personal (?:id|number|code)|person(?:al)?nummer|passport|passeport|pasaporte|reisepass\w*|personalausweis\w*|\bausweis\w*|carte d['’]identité|documento|driv(?:er['’]?s?|ing) licen[cs]e|führerschein\w*|permis de conduire|\bdl ?#|tax (?:id|number)|steuer\w*|número de (?:identidad|afiliación)|codice fiscale)[^\n\d]{0,14}$")
_PHONE_LABEL = re.compile(r"(?i)(?:\btel(?:/fax|efon\w*|éfono|éphone)?|\btél|phone|mobile|\bmobil|\bmóvil|\bcell(?:ulare)?|\bfax|direct line|call (?:back )?(?:on|at)?|text me|\bunter|\bhandy|whats ?app|responde en|hotline|number (?:is|was)|\bring|\breach\w* (?:me |him |her |them )?(?:on|at)|contact(?:o)?)[^\n\d+(]{0,8}$")
_OTHER_LABEL = re.compile(r"(?i)(?:part (?:number|no)|requisition|\breq|\bpo\b|\border|ticket\w*|invoice|certificate|cert\b|version|release|\bv|\bunits|\bworth|budget|ratio|\bover|\bon a|account|serial|model|\bcase|\bref(?:erence)? no|\bbatch|\bsku|\bitem|\bisbn|\bissue|\band|\bpage|\bsection|\bin|\bof|\bfrom|\bto|\bsince|\byear)[\w .#:-]{0,6}$")
_PHONE = re.compile(
    r"\+\d[\d ()./-]{6,19}\d|\(\d{2,5}\) ?\d{3,4}[- ]?\d{3,5}|(?:1[-. ])?\d{3}[-. ]\d{3}[-. ]\d{4}|\d{3}-\d{4}|0\d{1,5}[ /-]\d{3,8}(?:[- ]\d{2,5}){0,3}|0\d(?:[. ]\d{2}){4}|0\d{9,10}|0\d{3,4} \d{3} ?\d{3}|00\d{2}[\d ]{7,14}|1[3-9]\d{9}|\d{3,4}[ -]\d{4}[ -]\d{4}|(?:\d{2}[ .-]){4}\d{2}|\d{5} \d{5,6}"
)
_MAIL_LABEL = re.compile(r"(?i)\b(?:e-?mail\w*|mail(?:to)?|correo\w*|courriel|contact\w*|kontakt\w*|reach\w*|write to|schreiben|escrib\w*)\b[^\n@]{0,20}$")
_NOT_MAIL = re.compile(r"(?i)(?:\bssh|\bscp|\bgit(?: clone)?|\bremote|\brepositor\w+|://)[^\n@]{0,12}$")
_ADDRESS_LABEL = re.compile(r"(?i)\b(?:address\w*|lives? (?:at|in)|living (?:at|in)|resid\w+ (?:at|in)|home|adress\w*|anschrift|wohn\w+(?: in)?|domicil\w+|direcci\w+|endereço|indirizzo|morada|vive en|habite)\b[^\n\d]{0,16}$")
_COUNTED = re.compile(r"(?i)\b(?:over|than|about|nearly|some|version|release|page|section|chapter|grade|level|of the|top|all|first|last|every)\s$")
_TOWN = re.compile(rf"(?:, ?| )(?:\d{{4,5}} |[A-Z]{{1,2}}\d[\dA-Z]? ?\d[A-Z]{{2}}\b)?[{_U}][\w'’-]+")
_ANNOUNCING = (
    rf"(?:\b{_TITLE}\.? |\bName: ?|\b(?:Reference|Referee|Referencia|Referenz|Référence|Referência|Contacto|Contact|Kontakt|Garant|Guarantor|Emergency contact|In case of emergency)\b[^:\n]{{0,20}}: ?(?:{_TITLE}\.? )?|\b(?:Mentored by|Reported to|[Ll]etter from|Spoke with|Ansprechpartner(?:in)? (?:ist|war)|signed by|interviewed by|supervised by|recommended by) (?:{_TITLE}\.? )?)"
)
_ANCHOR, _ANNOUNCED = re.compile(f"{_ANNOUNCING}$"), re.compile(_ANNOUNCING)
#: Two words in lower case, or initials and one, where names stand: behind announcing words, a title or "by", or alone at the head of a line.
_LOW_WORD = r"[^\W\d_][\w'’]+(?:-[^\W\d_][\w'’]+)*"
_LOW_NAME = rf"((?:(?:[^\W\d_]\. ?)+|[^\W\d_]{{3,}}(?:-[^\W\d_]+)? (?:[^\W\d_]\. )?)(?:{_PARTICLE} )?{_LOW_WORD}|{_LOW_WORD}, (?:[^\W\d_]\.|[^\W\d_]{{3,}}))(?![\w@+-]|\.\w)"
_LOW_NAMED = re.compile(_LOW_NAME)
#: Words that announce one, right before a letter in lower case; behind those of the group the name has to end a part of the sentence.
_LOW_SIGN = re.compile(rf"\b(?i:(by|from|par|por|neighbou?r|colleague|alongside)|(?:mrs|mr|ms|mx|dr|prof|herrn|herr|frau|mme|mlle|sra?|señora?|m)(?:\.| )|(?:name|reference|referee|referencia|referenz|référence|referência|contacto?|kontakt|garant|guarantor|in case of emergency)\b[^:\n]{{0,20}}:|spoke with|reported to|ansprechpartner(?:in)? (?:ist|war)) ?(?:(?i:{_TITLE})\.? )?(?=[^\W\d_{_U}])")
#: One of these words is in any text that holds such a sign: quick to look for.
_LOW_WORDS = frozenset(
    w + end for w in "by from par por neighbor neighbour colleague alongside mrs mr ms mx dr prof herrn herr frau mme mlle sr sra señor señora m name reference referee referencia referenz référence referência contact contacto kontakt garant guarantor case spoke reported ansprechpartner ansprechpartnerin".split() for end in ("", ".", ":")
)
_LOW_END = re.compile(r"[.,;:(]|$| (?:in|im|at|on|and|is|has) ")
_LOW_HEAD = re.compile(rf"\W{{0,3}}{_LOW_NAME}(?= ?$| ?[,;|(·]| [–—-] ?| is an? |:)")
_AFTER_TITLE = re.compile(r"^(?:, | – | - | is an? )(?:(?:Senior|Junior|Lead|Principal|Staff|Assistant|Chief|Head|Deputy|Trainee|Associate) )?[A-Z]\w+(?: [A-Z]\w+)*[.]? ?")
_ORG = frozenset(
    "college university universität université universidad universidade institute school academy polytechnic politechnika högskolan école escuela hochschule bank labs media group holdings partners gmbh ltd inc llc s.a foods energy retail logistics freight clinic works analytics insurance textiles board systems söhne daughters company corp health water hospital street road lane avenue prize award depot site team street".split()
)
_STOP = frozenset(
    "experience education skills summary projects languages references certificates profile contact name address phone mobile tel fax email e-mail ssn sin dni passport id nino reference the a an and our my we you they he she it in on at to for with by from of as is are was were call text moved set took spoke handed reported mentored january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split()
)


def _h(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def _shape(token: str) -> str:
    if len(token) <= 3 and token.endswith("."):
        return "I"
    s = "U" if token.isupper() else "C"
    return s + ("-" if "-" in token else "") + ("'" if "'" in token or "’" in token else "")


def _of_token(w: str, t: str) -> list[str]:
    stem = w.rsplit("-", 1)[-1]
    return ["b", f"w{w}", f"s2{stem[-2:]}", f"s3{stem[-3:]}", f"s4{stem[-4:]}", f"p3{w[:3]}", f"p4{w[:4]}", f"h{_shape(t)}", f"st{w in _STOP}"]


def _of_pair(side: str, w: str, t: str, other: str, other_t: str, comma: bool) -> list[str]:
    return [f"{side}{other}", f"{side}s{other[-3:]}", f"{side}h{_shape(other_t) if other_t else other}{_shape(t)}", f"{side}c{comma}"]


def _of_run(n: int, org: bool) -> list[str]:
    return [f"n{min(n, 6)}", f"o{org}", f"n{min(n, 6)}o{org}"]


def _of_left(l1: str, l2: str, k: int) -> list[str]:
    return [f"l1{l1}", f"l2{l2}", f"l1{l1}{min(k, 6)}"]


_AROUND = re.compile(r"[\w'’-]+|[^\w\s]")


def _around(left: str, right: str) -> tuple[str, str, str, str]:
    """The last word, and the last two, before a run; the first word, and the first two, behind it."""
    return *_before(left), *_after(right)


@lru_cache(maxsize=50_000)
def _before(left: str) -> tuple[str, str]:
    words = _AROUND.findall(left.lower())[-2:]
    return (words[-1], " ".join(words)) if words else ("^", "^")


@lru_cache(maxsize=50_000)
def _after(right: str) -> tuple[str, str]:
    words = _AROUND.findall(right.lower())[:2]
    return (words[0], " ".join(words)) if words else ("$", "$")


class Run:
    """A capitalized run: its tokens and their offsets, and for each token the groups of features that the run itself gives."""

    __slots__ = ("tokens", "offsets", "lower", "groups")

    def __init__(self, text: str):
        found = [(m.group(), m.start()) for m in _TOKENS.finditer(text)]
        self.tokens = [t for t, _ in found]
        self.offsets = [o for _, o in found]
        self.lower = [t.lower() for t in self.tokens]
        n = len(found)
        low, tok = ["^", *self.lower, "$"], ["", *self.tokens, ""]
        comma = [text[o + len(t) : o + len(t) + 1] == "," for t, o in found]
        org = not _ORG.isdisjoint(self.lower)
        self.groups = [
            (
                ("t", low[k + 1], tok[k + 1]),
                ("a", low[k + 1], tok[k + 1], low[k], tok[k], comma[k - 1] if k else False),
                ("z", low[k + 1], tok[k + 1], low[k + 2], tok[k + 2], comma[k]),
                ("zz", low[k + 3] if k + 2 < n else "$$"),
                ("r", min(n, 6), org),
            )
            for k in range(n)
        ]

    def with_context(self, left: str, right: str) -> list[tuple]:
        """For each token all its groups, those of the words around the run included."""
        l1, l2, r1, r2 = _around(left, right)
        return [(*g, ("l", l1, l2, min(k, 6)), ("rr", r1, r2)) for k, g in enumerate(self.groups)]


_GROUPS = {"t": _of_token, "r": _of_run, "l": _of_left, "zz": lambda w: [f"zz{w}"], "rr": lambda r1, r2: [f"r1{r1}", f"r2{r2}"]}


def _group(key: tuple) -> list[int]:
    """The hashed features of a group."""
    return [_h(x) for x in (_of_pair(*key) if len(key) == 6 else _GROUPS[key[0]](*key[1:]))]


@lru_cache(maxsize=10_000)
def _label(left: str) -> str:
    """What the words before a number say that it is."""
    if not any(c.isalpha() or c == "#" for c in left[-15:]):  # no label ends further away
        return "none"
    return "id" if _ID_LABEL.search(left) else "phone" if _PHONE_LABEL.search(left) else "other" if _OTHER_LABEL.search(left) else "none"


_SHAPES = {**dict.fromkeys(map(ord, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "A"), **dict.fromkeys(map(ord, "0123456789"), "#")}
_LOWS, _HASHES, _WORDS_BEFORE = re.compile("[a-z]+"), re.compile("#+"), re.compile(r"[^\W\d_]+|[^\w\s]")


def _candidate_features(kind: str, text: str, left: str, right: str) -> list[int]:
    shape = _LOWS.sub("a", text.translate(_SHAPES))
    words = _WORDS_BEFORE.findall(left)[-4:]
    label = _label(left)
    after = _AROUND.match(right.lstrip())
    f = [f"!{kind}", f"!{kind}s{shape}", f"!{kind}s{shape[:5]}", f"!{kind}t{_HASHES.sub('#', shape)}", f"!{kind}L{label}", f"!{kind}L{label}{shape[:3]}", f"!{kind}n{sum(c.isdigit() for c in text)}", *(f"!{kind}w{w.lower()}" for w in words), f"!{kind}l1{words[-1].lower() if words else '^'}", f"!{kind}r1{after.group().lower() if after else '$'}"]
    return [_h(x) for x in f]


def _named_number(text: str) -> bool:
    """Whether a number stands behind a word with a capital, or one of those that streets are named by in lower case."""
    for m in _SPACE_NUMBER.finditer(text):
        a = m.start()
        word = text[text.rfind(" ", 0, a) + 1 : a].rstrip(",")
        if word[:1].isupper() or word in ("alto", "bajo", "mayor", "nuevo", "nueva") or word[-1:] == ".":
            return True
    return False


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what may be an email address, phone number, identity number or street address. They don't overlap, but
    for a number without an identity label in the form of a phone number, which is a candidate for both."""
    taken: list[tuple[str, int, int]] = []
    if "@" in text or "(at" in text or "[at" in text or " at " in text and " dot " in text or "(AT" in text or "[AT" in text or " AT " in text and " DOT " in text:
        taken += [("email", m.start(), m.end()) for m in _EMAIL.finditer(text)]
    if not _DIGIT.search(text):
        return taken
    free = lambda a, b: all(b <= x or a >= y for _, x, y in taken)
    patterns = [_ADDRESS_NUMBER_FIRST] if _NUMBER_THEN.search(text) else []
    if _named_number(text) and _STREET_SIGN.search(text.lower()):
        patterns.append(_ADDRESS_NUMBER_LAST)
    for pattern in patterns:
        for m in pattern.finditer(text):
            if free(m.start(), m.end()):
                flat = _FLAT.search(text, max(0, m.start() - 20), m.start())
                taken.append(("address", flat.start() if flat else m.start(), m.end()))
    if not _MANY_DIGITS.search(text):
        return taken
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        s = m.group()
        if len(_DIGIT.findall(s)) < 5 or _DATE.fullmatch(s):
            continue
        phone = None if _label(text[max(0, a - 40) : a].rpartition("\n")[2]) == "id" else _PHONE.match(text, a)
        if not free(a, b):
            continue
        if phone and b - 3 <= phone.end() <= b:
            taken.append(("phone", a, phone.end()))
        taken.append(("id_number", a, b))
    return taken


_NOT_OF_VALUE = re.compile(r"[^\w]+")


def _value(kind: str, text: str) -> str:
    """What two occurrences of one value share, however they are written: the kind and the letters and digits."""
    return kind[0] + _NOT_OF_VALUE.sub("", text.lower())


_PART = re.compile(r"[^\W\d_]{4,}")


def _name_parts(kind: str, text: str) -> list[str]:
    """The words of an email address before the sign that may be parts of a name."""
    return _PART.findall(re.split(r"@|[\[(]| at ", text.lower(), maxsplit=1)[0]) if kind == "email" else []


class Model:
    """Weights of the field: unary ones by hashed feature, chain potentials of (left label, right label), and the skip potentials
    of equal words, of equal values, and of an email address and a name's word it is spelt with."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: float, equal: float = 0.0, spelt: float = 0.0):
        self.unary, self.chain, self.skip, self.equal, self.spelt = unary, chain, skip, equal, spelt
        self.weights: list[float] = []
        #: The most that messages can add to a token: two chain neighbours, two equal words and two addresses; and to a candidate: two equal values.
        self.reach = float(2 * np.abs(chain[1] - chain[0]).max() + 2 * abs(skip) + 2 * abs(spelt))
        self.reach_of_values = float(2 * abs(equal))

    def score(self, features: list[int]) -> float:
        w = self.weights = self.weights or self.unary.tolist()
        return sum([w[f] for f in features])


def propagate(unary: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray, sweeps: int = 8) -> np.ndarray:
    """Log odds of label 1 for each node, by loopy message passing.

    left, right: the two nodes of each edge; weight: (edges, 2, 2) log potentials by (left label, right label). Messages are
    log odds; all are renewed together in each sweep, damped by half, so that cycles settle.
    """
    if not len(left):
        return unary
    to_right, to_left = np.zeros(len(left)), np.zeros(len(left))
    n = len(unary)
    for _ in range(sweeps):
        belief = unary + np.bincount(right, to_right, n) + np.bincount(left, to_left, n)
        a, b = belief[left] - to_left, belief[right] - to_right
        new_right = np.logaddexp(weight[:, 0, 1], weight[:, 1, 1] + a) - np.logaddexp(weight[:, 0, 0], weight[:, 1, 0] + a)
        new_left = np.logaddexp(weight[:, 1, 0], weight[:, 1, 1] + b) - np.logaddexp(weight[:, 0, 0], weight[:, 0, 1] + b)
        to_right, to_left = (to_right + new_right) / 2, (to_left + new_left) / 2
    return unary + np.bincount(right, to_right, n) + np.bincount(left, to_left, n)


class _Cache:
    """Remembers what was asked for of late, in two generations of `most` entries; it bounds memory, not results."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value):
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value


def runs(text: str) -> Iterator[tuple[str, int, str, str]]:
    """(run, start, left context, right context) of the capitalized runs of two tokens or more."""
    if not _PAIR.search(text):
        return
    for m in RUN.finditer(text):
        run = m.group(1)
        if " " in run:
            a, b = m.span(1)
            yield run, a, text[max(0, a - 24) : a].rpartition("\n")[2], text[b : b + 16].partition("\n")[0]


def _capitalized(text: str) -> str:
    """text with each word but particles in capitals at its start, as long as before."""
    out = re.sub(r"(?<![\w'’])(?!(?:de|la|von|van|der|del)\b)[^\W\d_]|(?<=-)[^\W\d_]", lambda m: m.group().upper() if len(m.group().upper()) == 1 else m.group(), text)
    return out


def _low_run(text: str, a: int, b: int) -> tuple[str, int, str, str]:
    return _capitalized(text[a:b]), a, text[max(0, a - 24) : a].rpartition("\n")[2], text[b : b + 16].partition("\n")[0]


def low_runs(text: str) -> list[tuple[str, int, str, str]]:
    """The runs in lower case that may be names by where they stand, capitalized, as runs() gives them."""
    found = []
    for sign in _LOW_SIGN.finditer(text) if not _LOW_WORDS.isdisjoint(text.lower().split()) else ():
        m = _LOW_NAMED.match(text, sign.end())
        if m and m.group(1).islower() and (not sign.group(1) or _LOW_END.match(text, m.end())):
            found.append(m)
    if not text[:1].isupper() and (m := _LOW_HEAD.match(text)) and m.group(1).islower():
        found.append(m)
    return [_low_run(text, *m.span(1)) for m in found]


# ---------------------------------------------------------------------------------------------- training


@lru_cache(maxsize=100_000)
def _kind_of(column: str, path: str) -> str:
    return path.split("[")[0].split(".")[0] + "." + path.rsplit(".", 1)[-1].split("[")[0] if "." in path else path.split("[")[0]


#: Fields whose words are titles, companies, schools or skills.
_OTHER_KINDS = ("experience.title", "experience.company", "education.school", "education.degree", "skills.skill", "projects.technologies", "projects.name")


def _other_words(kind: str, text: str) -> set[str]:
    if kind not in _OTHER_KINDS:
        return set()
    words = {w.lower() for w in re.findall(_WORD, text)}
    return words if kind != "education.school" or not words & _ORG else set()  # schools are often named after people


def _is_name(docs: int, other: int) -> bool:
    """First names recur with many surnames; a word of other fields as well is one only if it is far more often announced."""
    return docs >= 3 and docs * 4 > other


def weak_labels(documents: Sequence[Sequence[tuple[str, str, str]]]) -> list[list[tuple[Run, list[tuple], list[int]]]]:
    """Labels (1 name, 0 none, -1 unknown) for the runs of documents, which are lists of (column, path, text).

    Certain are runs behind words that announce a person; words found there as first names, in at least three documents, then
    mark further runs; runs with a word of an organisation or of a title, company, school or skill field are none.
    """
    parsed, first, other = [], defaultdict(set), Counter()
    for d, doc in enumerate(documents):
        rows = []
        for column, path, text in doc:
            kind = _kind_of(column, path)
            other.update(_other_words(kind, text))
            for run, a, left, right in runs(text):
                r = Run(run)
                anchored = bool(_ANCHOR.search(left)) or (a == 0 and kind == "summary" and bool(_AFTER_TITLE.match(right)))
                rows.append((r, r.with_context(left, right), anchored))
                if anchored and len(r.tokens) <= 4 and not any(w in _ORG for w in r.lower):
                    for w in r.lower:
                        if len(w) > 2:
                            first[w].add(d)
        parsed.append(rows)
    names = {w for w, docs in first.items() if _is_name(len(docs), other[w])}
    labelled = []
    for rows in parsed:
        out = []
        for r, groups, anchored in rows:
            n = len(r.tokens)
            hits = [w in names or len(t) <= 3 and t.endswith(".") for w, t in zip(r.lower, r.tokens)]
            strong = any(w in names for w in r.lower)
            if any(w in _ORG for w in r.lower):
                y = [0] * n
            elif anchored and n <= 5:
                y = [1] * n
                for k in range(n):
                    if r.lower[k] in _STOP or (k > 1 and other[r.lower[k]] > 5 * (1 + len(first.get(r.lower[k], ())))):
                        y[k:] = [0] * (n - k)
                        break
            elif strong and n <= 4 and not any(w in _STOP or other[w] > 3 and w not in names for w in r.lower):
                y = [1] * n
            elif strong or any(hits):
                y = [-1] * n
            else:
                y = [0] * n
            out.append((r, groups, y))
        labelled.append(out)
    return labelled


def train(documents: Sequence[Sequence[tuple[str, str, str]]], epochs: int = 3, rate: float = 0.15) -> Model:
    """Fits the field to weakly labelled documents by pseudo-likelihood: each node given its neighbours, AdaGrad steps. The
    weights of all edges are learnt with the others."""
    features: list[np.ndarray] = []
    label: list[int] = []
    edges: list[tuple[int, int, int]] = []  # (kind of edge, node, neighbour), a row for each direction
    groups: dict[tuple, np.ndarray] = {}
    for rows, doc in zip(weak_labels(documents), documents):
        seen: dict[str, int] = {}
        values: dict[str, int] = {}
        for r, own, y in rows:
            for k, keys in enumerate(own):
                i = len(features)
                features.append(np.array([f for g in keys for f in (groups[g] if g in groups else groups.setdefault(g, _group(g)))], np.int32))
                label.append(y[k])
                if k:
                    edges += [(0, i, i - 1), (1, i - 1, i)]
                w = r.lower[k]
                if len(w) > 3:
                    if w in seen:
                        edges += [(2, i, seen[w]), (2, seen[w], i)]
                    seen[w] = i
        for _, _, text in doc:
            for kind, a, b in candidates(text):
                i = len(features)
                left, right = text[max(0, a - 40) : a].rpartition("\n")[2], text[b : b + 24]
                features.append(np.array(_candidate_features(kind, text[a:b], left, right), np.int32))
                label.append(_candidate_label(kind, text[a:b], left, right))
                v = _value(kind, text[a:b])
                if v in values:
                    edges += [(3, i, values[v]), (3, values[v], i)]
                values[v] = i
                edges += [e for w in _name_parts(kind, text[a:b]) if w in seen for e in ((4, i, seen[w]), (4, seen[w], i))]
    w = np.zeros(1 << BITS, np.float64)
    g2 = np.full(1 << BITS, 1e-8)
    pair, pair2 = np.zeros(5), np.full(5, 1e-8)  # left neighbour a name, right neighbour a name, equal word, equal value, spelt with
    y = np.array(label, np.int64)
    known = np.flatnonzero(y >= 0)
    side = np.zeros((len(y), 5))
    if edges:
        kind_, node, other = np.array(edges).T
        np.add.at(side, (node, kind_), np.where(y[other] == 1, 1.0, np.where(y[other] == 0, -1.0, 0.0)))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        rng.shuffle(known)
        for start in range(0, len(known), 256):
            part = known[start : start + 256]
            flat = np.concatenate([features[i] for i in part])
            at = np.repeat(np.arange(len(part)), [len(features[i]) for i in part])
            z = np.bincount(at, w[flat], len(part)) + side[part] @ pair
            err = y[part] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            grad = np.bincount(flat, err[at], 1 << BITS) - 1e-4 * w
            hit = np.unique(flat)
            g2[hit] += grad[hit] ** 2
            w[hit] += rate * grad[hit] / np.sqrt(g2[hit])
            gp = side[part].T @ err
            pair2 += gp**2
            pair = np.clip(pair + rate * gp / np.sqrt(pair2), -1.5, 1.5)
    both = float(pair[0] + pair[1]) / 2
    chain = np.array([[both, -both], [-both, both]]) / 2
    return Model(w.astype(np.float32), chain, *map(float, pair[2:]))


def _candidate_label(kind: str, text: str, left: str, right: str) -> int:
    """1, 0 or -1 (unknown) for a candidate, by the words around it."""
    if kind == "email":
        return 0 if _NOT_MAIL.search(left) else 1 if "@" in text or _MAIL_LABEL.search(left) else -1
    if kind == "address":
        return 1 if _ADDRESS_LABEL.search(left) else 0 if _COUNTED.search(left) or not _ORG.isdisjoint(re.findall(r"[^\W\d_]+", right.lower())[:1]) else 1 if _TOWN.match(right) else -1
    if kind == "phone":
        return 1 if _PHONE_LABEL.search(left) or text[0] == "+" else 0 if _OTHER_LABEL.search(left) else 1 if text.startswith("(") else -1
    return 1 if _ID_LABEL.search(left) else 0


# ---------------------------------------------------------------------------------------------- inference

_INITIAL = re.compile(rf"[{_U}]\.(?:-?[{_U}]\.)*")


def _leads(run: Run, k: int, end: int) -> bool:
    """Whether the token is a label or form of address before a name. "M." is one only if a first name and a surname follow."""
    if _INITIAL.fullmatch(run.tokens[k]):
        return run.tokens[k] == "M." and end - k > 2 and not _INITIAL.fullmatch(run.tokens[k + 1]) and run.tokens[k + 1][:1].isupper()
    return run.lower[k].rstrip(".") in _STOP or bool(re.fullmatch(_TITLE, run.tokens[k].rstrip(".")))


def _spans(run: Run, on: np.ndarray) -> list[tuple[int, int]]:
    """Token ranges of names: stretches of name tokens with a full word and one more token; titles and labels cut off."""
    out, k, n = [], 0, len(run.tokens)
    while k < n:
        if not on[k]:
            k += 1
            continue
        e = k
        while e < n and on[e]:
            e += 1
        a = k
        while a < e and _leads(run, a, e):
            a += 1
        joint = a
        while joint < e and run.tokens[joint].islower():
            joint += 1
        if joint > a and not any(run.offsets[i + 1] - run.offsets[i] - len(run.tokens[i]) > 1 for i in range(joint, e - 1)):
            a = joint  # "by", not a particle: without a comma a name doesn't start with one in lower case
        full = [t for t in run.tokens[a:e] if not _INITIAL.fullmatch(t) and t[:1].isupper()]
        if e - a >= 2 and full:
            out.append((a, e))
        k = e
    return out


def _surest(found: tuple[int, Run, list[float]]) -> float:
    """The log odds of a run's least sure word, particles aside."""
    return min((z for t, z in zip(found[1].tokens, found[2]) if not t.islower()), default=-99.0)


class Finder:
    """Finds the personal information of documents with a trained model; one a worker. It remembers scores of feature groups
    and what it found in lines, which depend on nothing else."""

    def __init__(self, model: Model):
        self.model = model
        self.groups = _Cache(200_000)
        self.runs = _Cache(50_000)
        self.around = _Cache(50_000)
        self.lines = _Cache(50_000)

    def _group(self, g: tuple) -> float:
        w = self.groups.get(g)
        return self.groups.put(g, self.model.score(_group(g))) if w is None else w

    def _scored(self, run: str, left: str, right: str) -> tuple[Run, list[float]]:
        """The run and its tokens' unary log odds. What the run itself gives is remembered by its text."""
        got = self.runs.get(run)
        if got is None:
            r = Run(run)
            got = self.runs.put(run, (r, [sum(map(self._group, g)) for g in r.groups]))
        r, base = got
        key = (left, right, len(base))
        around = self.around.get(key)
        if around is None:
            l1, l2, r1, r2 = _around(left, right)
            after = self._group(("rr", r1, r2))
            around = self.around.put(key, [after + self._group(("l", l1, l2, min(k, 6))) for k in range(len(base))])
        return r, list(map(add, base, around))

    def _line(self, line: str):
        """(candidates with their scores, values and parts of names, runs that may hold a name with their scores) of a line."""
        got = self.lines.get(line)
        if got is None:
            other = []
            for what, a, b in candidates(line):
                z = self.model.score(_candidate_features(what, line[a:b], line[max(0, a - 40) : a], line[b : b + 24]))
                if z > -self.model.reach_of_values:  # else no message could make it one
                    value, parts = _value(what, line[a:b]), _name_parts(what, line[a:b])
                    if what == "phone" and (x := _EXT.match(line, b)):
                        b = x.end()
                    other.append((what, a, b, z, value, parts))
            held = []
            for run, a, left, right in runs(line):
                r, s = self._scored(run, left, right)
                if max(s) >= -self.model.reach:
                    held.append((a, r, s))
            if low := low_runs(line):
                taken: list[tuple[int, int]] = []
                for a, r, s in sorted([(a, *self._scored(run, left, right)) for run, a, left, right in low], key=_surest, reverse=True):  # of overlapping ones the surest
                    b = a + r.offsets[-1] + len(r.tokens[-1])
                    if max(s) >= -self.model.reach and all(b <= p or a >= q for p, q in taken):
                        taken.append((a, b))
                        held.append((a, r, s))
            got = (other, held)
            if len(line) <= 400:
                self.lines.put(line, got)
        return got

    def find(self, documents: Sequence[Sequence[tuple[str, str, str]]]) -> list[list[tuple[int, str, int, int]]]:
        """For each document, (index of the text, kind, start, end) of each piece, in order."""
        unary: list[float] = []
        chain: list[int] = []  # the left node; the right one is the next
        skip: list[tuple[int, int]] = []
        equal: list[tuple[int, int]] = []
        spelt: list[tuple[int, int]] = []
        apart: list[tuple[int, int]] = []
        names, others = [], []
        found: list[list[tuple[int, str, int, int]]] = [[] for _ in documents]
        n = 0
        for d, doc in enumerate(documents):
            seen: dict[str, int] = {}
            values: dict[str, int] = {}
            mailed: dict[str, int] = {}
            linked: set[int] = set()
            for t, (column, path, text) in enumerate(doc):
                at = 0
                for line in text.split("\n") if "\n" in text else (text,):
                    other, own = self._line(line)
                    for what, a, b, z, value, parts in other:
                        unary.append(z)
                        if value in values:
                            equal.append((values[value], n))
                        values[value] = n
                        for w in parts:
                            if w in seen and seen[w] not in linked:
                                linked.add(seen[w])
                                spelt.append((seen[w], n))
                            mailed[w] = n
                        if others and what == "id_number" and others[-1][:3] == (d, t, at) and others[-1][4] == a:
                            apart.append((n - 1, n))
                        others.append((d, t, at, what, a, b, n))
                        n += 1
                    for a, r, s in own:
                        unary += s
                        m = len(s)
                        chain.extend(range(n, n + m - 1))
                        for k, w in enumerate(r.lower):
                            if len(w) > 3:
                                if w in seen:
                                    skip.append((seen[w], n + k))
                                seen[w] = n + k
                                if w in mailed:
                                    spelt.append((n + k, mailed.pop(w)))
                        names.append((d, t, at, a, r, n))
                        n += m
                    at += len(line) + 1
        if not n:
            return found
        m = self.model
        sorts = [(np.stack([np.array(chain, np.int64), np.array(chain, np.int64) + 1], 1), m.chain)]
        sorts += [(np.array(e, np.int64).reshape(-1, 2), np.array([[w, -w], [-w, w]]) / 2) for e, w in ((skip, m.skip), (equal, m.equal), (spelt, m.spelt))]
        sorts.append((np.array(apart, np.int64).reshape(-1, 2), np.array([[0.0, 0.0], [0.0, -20.0]])))
        ends = np.concatenate([e for e, _ in sorts])
        odds = propagate(np.array(unary), ends[:, 0], ends[:, 1], np.concatenate([np.broadcast_to(w, (len(e), 2, 2)) for e, w in sorts]))
        pieces: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
        on = odds > 0
        last = None
        for d, t, at, what, a, b, node in others:
            if not on[node]:
                continue
            if what == "id_number" and last == (d, t, at, a):
                continue  # taken as a phone number
            last = (d, t, at, a)
            found[d].append((t, what, at + a, at + b))
            pieces[d, t, at].append((a, b))
        for d, t, at, a, r, node in names:
            mine = on[node : node + len(r.tokens)]
            if mine.any():
                for i, e in _spans(r, mine):
                    x, y = a + r.offsets[i], a + r.offsets[e - 1] + len(r.tokens[e - 1])
                    if all(y <= p or x >= q for p, q in pieces.get((d, t, at), ())):
                        found[d].append((t, "name", at + x, at + y))
        for rows in found:
            rows.sort(key=lambda x: (x[0], x[2]))
        return found


def redacted(text: str, pieces: Sequence[tuple[str, int, int]]) -> str:
    """text with each (kind, start, end) replaced by its placeholder, such as [EMAIL]; all else is kept."""
    out, at = [], 0
    for kind, a, b in pieces:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _document(row: Sequence[str | None], columns: Sequence[str]) -> list[tuple[str, str, str]]:
    return [(c, path, text) for c, j in zip(columns, row) if j for path, text in string_leaves(j)]


def fit(resumes: DataFrame, columns: Sequence[str], key: str, sample: int = 1200) -> Model:
    """A model fitted on at most `sample` rows, those of the lowest hash of their key: the bound of the training set."""
    chosen = resumes.select(F.col(key).alias("_k")).orderBy(F.xxhash64(F.col("_k").cast("string")), "_k").limit(sample)  # keys only, at most `sample`
    rows = resumes.join(F.broadcast(chosen), F.col(key) == F.col("_k"), "left_semi").select(key, *columns).orderBy(key).collect()
    return train([_document(r[1:], columns) for r in rows])


def _found(resumes: DataFrame, key: str, columns: Sequence[str], model: Model | None, chunk: int, fields: str, rows_of) -> DataFrame:
    """A row for each item that rows_of(texts of a document, its pieces) gives; fields: their names and types."""
    model = model or fit(resumes, columns, key)
    kind = resumes.schema[key].dataType.simpleString()
    finder = [None]
    names = [f.split()[0] for f in fields.split(", ")]
    types = [pa.int32() if f.endswith(" int") else pa.string() for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder[0] = finder[0] or Finder(model)
        gc.disable()  # nothing here makes cycles, and what is remembered would be walked again and again
        for b in batches:
            texts = [b.column(i + 1).to_pylist() for i in range(len(columns))]
            for start in range(0, b.num_rows, chunk):
                docs = [_document(row, columns) for row in zip(*(t[start : start + chunk] for t in texts))]
                at, out = [], []
                for d, pieces in enumerate(finder[0].find(docs)):
                    own = rows_of(docs[d], pieces)
                    at += [start + d] * len(own)
                    out += own
                cols = list(zip(*out)) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, t) for c, t in zip(cols, types)]], [key, *names])
        gc.enable()

    return resumes.select(F.col(key), *columns).mapInArrow(run, f"`{key}` {kind}, {fields}")


COLUMNS = ("parsed_data_json", "processed_data_json")


def personal_information(resumes: DataFrame, key: str = "resume_id", columns: Sequence[str] = COLUMNS, model: Model | None = None, chunk: int = 400) -> DataFrame:
    """(key, json_column, path, kind, start_pos, end_pos): each piece of personal information in the string values of the JSON columns.

    kind: name, email, phone, id_number, address. Positions count code points from 0. Null, empty and unparsable JSON has none.
    Both columns of a row make one document. Texts are read whole; rows are independent, so repeated ones give the same.
    """

    def rows_of(doc, pieces):
        return [(doc[t][0], doc[t][1], what, x, y) for t, what, x, y in pieces]

    return _found(resumes, key, columns, model, chunk, "json_column string, path string, kind string, start_pos int, end_pos int", rows_of)


def redacted_texts(resumes: DataFrame, key: str = "resume_id", columns: Sequence[str] = COLUMNS, model: Model | None = None, chunk: int = 400) -> DataFrame:
    """(key, json_column, path, text): each string value that holds some, with a placeholder for every piece and all else kept."""

    def rows_of(doc, pieces):
        by_text: dict[int, list] = defaultdict(list)
        for t, what, x, y in pieces:
            by_text[t].append((what, x, y))
        return [(doc[t][0], doc[t][1], redacted(doc[t][2], own)) for t, own in by_text.items()]

    return _found(resumes, key, columns, model, chunk, "json_column string, path string, text string", rows_of)
