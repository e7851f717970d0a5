"""Template residue, filler, error pages and script notices among documents.

Messages of pages are mined into templates over the whole table by a fixed-depth prefix tree; each template is classified once
and its verdict joined back to the pages. Unfilled slots inside ordinary documents are looked for separately.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

# Wordings, in lower case with digits as '#', by what they show.
ERROR = [
    r"\b(?:http|error|fehler|erreur|ошибка|错误|エラー|오류)\s*[:#]*\s*#", r"^\W*#\s*[–—:-]", r"\bnot found\b|nicht gefunden|n'existe plus|introuvable|не найден|no (?:se ha )?encontrad[ao]|não encontrad[ao]|見つかりません|找不到|不存在|찾을 수 없|non trovat[ao]|niet gevonden|nie znaleziono|no existe|não existe|non esiste|n'existe pas|existiert nicht|nicht (?:mehr )?verfügbar|no (?:está )?disponible|indisponible|indisponível|недоступн|不可用|利用できません|δεν βρέθηκε|غير موجودة|नहीं मिला",
    r"\b(?:could|can) ?not be (?:found|loaded|rendered|opened|displayed|shown)\b|\bcan't be (?:displayed|shown|opened|found|loaded)\b|\bcouldn't be (?:found|loaded|rendered|opened|displayed)\b", r"\btimed out\b|\btime-?out\b|\bdid not answer\b|\bdoes not respond\b",
    r"\b(?:was|is) refused by\b|\brestricted to signed|\b(?:temporarily|currently) unavailable\b|\bno longer (?:available|exists|online)\b|\b(?:page|file|posting|link|session|preview|document|attachment|profile|vacancy you opened|search result) has expired\b",
    r"\b(?:cannot|can't|could not) start\b|\bwill not work\b|\bmoved or deleted\b|\bdoes not exist\b|\bdoesn't exist\b|\bsession has expired\b|\baccess (?:to .{1,60} )?(?:is |was |has been )?denied\b|\bis denied\b|\bfailed to (?:load|open|display|render|connect|start|process|fetch|parse)\b|\bunable to (?:load|open|display|find|show|render|process|connect)\b|\b(?:failed|returned|responded|ended) with (?:code|status|error)\b|\breturned (?:status|code|error)\b|\bempty or damaged\b|\bis (?:damaged|corrupted?)\b|\b(?:page|link|request|attachment|download|upload) failed\b|\bservice unavailable\b", r"\bsomething went wrong\b|\ba wrong turn\b|^\W*oops\b|\bdown for maintenance\b|\bunder maintenance\b|\bdatabase connection\b|\btoo many requests\b|\bverify that you are (?:a )?human\b|\baccess denied\b|\bforbidden\b|\bbad gateway\b|\binternal server error\b|\bservice unavailable\b|\bunexpected error\b|\bpage you asked for\b",
    r"traceback \(most recent|\b\w*(?:error|exception)\b: '|\bstack trace\b|\bsegmentation fault\b|\bnull ?pointer",
]
SCRIPT = [
    r"\b(?:enable|activate|turn on|switch on|switch|allow|permit|accept|needs?|requires?|blocks?|without|use a browser with|run|support)\b.{0,40}\b(?:javascript|js|scripts?|scripting|cookies)\b", r"\b(?:javascript|js|scripts?|scripting|cookies)\b.{0,40}\b(?:enabled?|disabled|activated?|required|must be|turned off|switched off|needed|allowed|blocked)\b",
    r"\bscript blocker\b|\bnoscript\b|\bchecking your browser\b", r"aktivieren .{0,20}javascript|javascript .{0,20}aktivier|activ\w+ (?:le |el |o )?javascript|active (?:le |el |o )?javascript|habilit\w+ (?:o |el )?javascript|attiv\w+ javascript|включите javascript|javascript ?を有効|スクリプトを有効|启用.{0,6}(?:javascript|脚本)|開啟.{0,6}javascript|자바스크립트|스크립트를|ενεργοποι\S+ .{0,12}javascript|جافا ?سكريبت|skru på javascript|zet javascript aan|włącz\w* javascript",
]
FILLER = [
    r"\blorem\b|\bipsum\b|\bdolor sit\b|\bconsectetur\b", r"\b(?:sample|dummy|placeholder|filler|example) (?:text|copy|paragraph|content|data)\b|\bdummy copy\b|\bplaceholder\b", r"\bblah blah\b|\basdf\b|\bqwer\b|\bblindtext\b|\bplatzhalter\b|\bfülltext\b|\bmustertext\b", r"\btext goes here\b|\bgoes here\b|\bgo here\b|\btype your text\b|\btext here\b|\breplace this text\b|\byour own text\b|\bhier könnte\b|\bihr text\b|\bthis space to\b|\bintentionally (?:filled|left)\b|\bnonsense words\b|\bbody copy\b|\bsupplied by client\b|\bmore text to come\b|\btext to (?:come|follow)\b|\bcoming soon\b",
    r"\bdescribe what you did\b|\bdescription of the (?:first|second|third|last) position\b|^\W*(?:heading|subheading|bullet|paragraph|title|item|line|skill) (?:one|two|three|four|#|text|here)\b|^\W*subheading\W*$|\bfirstname lastname\b|\bfirst name last name\b|\bany street\b|\bany town\b|\binsert content\b|\badd (?:your )?content\b|^\W*(?:job title|company(?: name)?|dates|month year|paragraph text)\W*$|\blines work best\b|\byour achievements\b",
    r"texte de remplissage|texto de (?:ejemplo|relleno|exemplo|preenchimento)|aquí va su|示例文本|占位|此处输入|tekst voorbeeld|vervang deze|testo di esempio|ダミー|サンプルテキスト|текст-заполнитель|пример текста|рыба-текст|예시 ?텍스트|exempeltext|tekst zastępczy|δείγμα κειμένου|يوضع النص|नमूना पाठ",
]
AUX = [
    r"\brefresh\b|\breload\b|\btry again\b|\bgo back\b|\bstart page\b|\bcheck the address\b|\btyped the address\b|\btyping errors\b|\bsite owner\b|\bour engineers\b|\bfew (?:seconds|minutes)\b|\bwait a moment\b|\bback soon\b|\bsign in\b|\blog in again\b|vuelva al inicio|vuelva a intentar|volte ao início|retour à (?:la page d'|l'|la )accueil|réessayez|zurück zur startseite|versuchen sie es|попробуйте (?:позже|снова)|再试|やり直し", r"^\W*(?:error id|ref|reference|quote|ray|ray id|request id|trace id|incident|code)\b[\w .:#-]*$", r"^\W*file \"[^\"]*\", line\b|^\W*at [\w.$]+\(|\bin your (?:browser|settings)\b|^\W*(?:updated|supported|modern) browsers?\b|^\W*(?:sorry|notice|attention)\W*$|\benable them\b",
]
#: What stands in the menus and at the ends of pages.
NAV = "home|jobs|about(?: us)?|careers|news|contact(?: us)?|menu|login|log in|logout|log out|sign in|help|search|sitemap|imprint|privacy(?: policy)?|terms(?: of use)?|impressum|datenschutz|cookie settings"
LINKS = [r"skip to (?:main )?content", r"back to (?:search )?(?:results?|overview|list|top|home)", rf"(?:{NAV})(?:(?: *[|·>/•-] *| +)(?:{NAV}))+"]
FURNITURE = [*LINKS, NAV, r"next|previous", r"© ?#?.{0,80}", r"\S.{0,80} (?:talent|careers?|jobs?) (?:portal|site|page|cent(?:er|re))", r".{1,80} [–|-] careers at .{1,80}", r"page # of #|[=\-_*~#· ]{3,}|#"]
#: Syllables that nonsense in the look of Latin is strung from.
_LATIN = re.compile(r"(?:am|at|aven|con|cras|cum|dol|dolor|duis|eros|est|et|fer|gra|in|ipsum|ipt|is|lor|lorem|mar|non|nul|null|or|orem|pell|quam|quis|quo|ris|sed|sit|sun|tem|tor|tur|ulm|ultr|um|ut|vel|vem|vit)+")
_KINDS = [(k, re.compile("|".join(p))) for k, p in (("error", ERROR), ("script", SCRIPT), ("filler", FILLER))]
_AUX, _FURNITURE = re.compile("|".join(AUX)), re.compile(rf"\W*(?:{'|'.join(FURNITURE)})\W*")
_EVIDENCE = {w for p in (*ERROR, *SCRIPT, *FILLER, *AUX, *FURNITURE) for w in re.findall(r"[^\W\d_]{2,}", re.sub(r"\\[a-zA-Z]", " ", p))}
#: A message that tells of somebody's work starts with a verb of the past; not so those of a fault, of a state, or in forms.
_TOLD = re.compile(r"(?i)^[\W\d_]*(?:(?!(?:signed|located|required|dated|based|attached|enclosed|need|red|bed|failed|expired|timed|denied|blocked|disconnected|aborted|forbidden|restricted|refused|redirected|rejected|interrupted|disabled|unauthori[sz]ed|(?:updated|supported) browsers?)\b)[a-z]+ed|wrote|built|led|ran|kept|taught|cut|set|held|made|drew|gave|took|found|won|spoke|sent|brought|put|rebuilt|rewrote)\b(?![,:])")
_LINE = re.compile(r"[^\n\r\f\v\x85\u2028\u2029]+")
_SENTENCE = re.compile(r"(?<=[.!?])(?<!\b[A-Za-z]\.)[\"'”’)]?\s+(?=\S)|(?<=[。！？])")
_PAGE_PARTS = re.compile(rf"(?i)(\b(?:{'|'.join(LINKS)})\b|(?<=(?:talent|career) portal)(?= )|(?<=\s)(?=© ?\d{{4}}))")
_UNSEEN = re.compile("[\u00ad\u180e\u200b\u200c\u2060\ufeff]")
_SPACE = re.compile("[\u00a0\u2002\u2003\u2007\u2009\u202f\u3000]")


def clean(text: str) -> str:
    """text without characters that would break up words."""
    return text if text.isascii() else _SPACE.sub(" ", _UNSEEN.sub("", text))


class TemplateTree:
    """A fixed-depth prefix tree of message templates: token count, the first tokens, then the templates of that leaf with counts.

    A template is a masked message in which parameters in a row are one. `add` gives it its message's count; `take` empties the tree, so that
    a worker that adds up its messages first sends each template once.
    """

    def __init__(self, depth: int = 4):
        self.depth, self.size = depth, 0
        self.root: dict = {}

    def add(self, template: str, n: int = 1) -> None:
        tokens = template.split(" ")
        node = self.root.setdefault(len(tokens), {})
        for t in tokens[: self.depth - 2]:
            node = node.setdefault(t, {})
        leaf = node.setdefault(None, {})
        if template not in leaf:
            self.size += 1
        leaf[template] = leaf.get(template, 0) + n

    def take(self) -> list[tuple[str, int]]:
        out: list[tuple[str, int]] = []
        stack = [self.root]
        while stack:
            node = stack.pop()
            out += node.get(None, {}).items()
            stack.extend(v for k, v in node.items() if k is not None)
        self.root, self.size = {}, 0
        return out


def _parameter(token: str) -> bool:
    return token.startswith("*") or "#" in token


def template_of(message: str) -> str:
    """The template of a message: its masked tokens, names in a row as one."""
    out: list[str] = []
    for t in masked(message):
        if out and t.startswith("*") and out[-1] == "*":
            out[-1] = t
        else:
            out.append(t)
    return " ".join(out)


def masked(message: str) -> list[str]:
    """The tokens of a message: numbers as '#', words with a capital behind the first, but for evidence, as '*'; lower case."""
    if message.isupper():
        message = message.lower()
    tokens = re.sub(r"[0-9]+(?:[a-f0-9]*[0-9])?", "#", message).split()
    return [t.lower() if i == 0 or not t[:1].isupper() or t.lower().strip("\"'().,:;!?|") in _EVIDENCE else "*" + t[len(t.rstrip(".,:;!?")) :] for i, t in enumerate(tokens)]


def classify(template: str) -> str:
    """'error', 'script', 'filler', 'aux' (goes with such messages), 'furniture' (a page title too) or 'content', of a template."""
    if _TOLD.search(template):
        return "content"
    for kind, pattern in _KINDS:
        if pattern.search(template):
            return kind
    if _FURNITURE.fullmatch(template):
        return "furniture"
    if _AUX.search(template):
        return "aux"
    words = re.findall(r"[^\W\d_]+", template)
    if len(words) >= 3 and (len(set(words)) == 1 or all(set(w) == {"x"} for w in words)):
        return "filler"
    if len(words) >= 4 and sum(bool(_LATIN.fullmatch(w)) for w in words) >= 0.7 * len(words):
        return "filler"
    if not words or _TITLE.fullmatch(template):
        return "furniture"
    return "content"


#: A page title: a word, then nothing but names.
_TITLE = re.compile(r"[^\W\d_][\w'’-]* \*")
#: What words of the wordings start with; of the short ones, which stand beside long ones, only those that may stand alone.
_STEMS = {w[:4] for w in _EVIDENCE if len(w) >= 4} - {"with", "your", "from", "this", "that", "there"} | {"js", "ref", "ray", "log", "xxx"}
_WORDS_OF = re.compile(r"[^\W\d_]+")


def may_be_residue(template: str) -> bool:
    """Whether a template may be other than content: quick, and true of all that classify() calls so. Wordings start their words with a
    stem of the lists; those of other scripts than the Latin one are all tried, as their words have no bounds."""
    if not template.isascii() and any(c > "\u036f" and not "\u2000" <= c <= "\u206f" for c in template):
        return classify(template) != "content"
    words = _WORDS_OF.findall(template)
    if not words or template.lstrip("*([\"' ").startswith("#") or not _STEMS.isdisjoint([w[:4] for w in words]) or _TITLE.fullmatch(template) or "©" in template or "error:" in template or "exception:" in template:
        return True
    return len(set(words)) == 1 or all(set(w) == {"x"} for w in words) or sum(bool(_LATIN.fullmatch(w)) for w in words) >= 0.7 * len(words)


def messages(text: str) -> Iterator[str]:
    """The messages of a text: lines and sentences, with page furniture cut off where it runs into them."""
    for m in _LINE.finditer(text):
        line = m.group()
        for part in _PAGE_PARTS.sub(r"\n\1\n", line).split("\n"):
            a = 0
            for cut in _SENTENCE.finditer(part):
                if (message := part[a : cut.start()].strip()):
                    yield message
                a = cut.end()
            if (message := part[a:].strip()):
                yield message


def open_templates(text: str) -> list[str]:
    """The templates of a text, none twice; none at all if one of them is content for certain."""
    out: dict[str, None] = {}
    for message in messages(text):
        template = template_of(message)
        if template not in out:
            if not may_be_residue(template):
                return []
            out[template] = None
    return list(out)


def of_page(kinds: Iterable[str]) -> str | None:
    """'error', 'script' or 'filler' if a page's messages are of such kinds, page furniture aside; None else."""
    kinds = set(kinds)
    return None if "content" in kinds else next((k for k in ("error", "script", "filler") if k in kinds), None)


def page_verdict(text: str) -> str | None:
    """What residue() says of a text that stands alone, slots aside."""
    return of_page(map(classify, open_templates(text)))


# The notations of slots. A name is what stands for the value to come.
_NAME = r"[^\W\d_][\w .,/$-]*"
_SLOTS = re.compile(
    "|".join(
        [
            r"\{\{[^{}\n]+\}\}", r"\{%[^%\n]+%\}", r"<%[^%\n]+%>", r"\$\{[^{}\n]+\}", r"\{[^{}\n/\\\"']+\}", rf"<<{_NAME}>>", rf"\[\[{_NAME}\]\]", rf"%%{_NAME}%%", rf"@@{_NAME}@@", rf"\*\|{_NAME}\|\*", rf"~~{_NAME}~~", rf"__{_NAME}__", rf"(?<![\w#&])#[^\W\d_][\w .-]*#(?!\w)", r"«[^«»\n]+»", r"【[^】\n]+】",
            r"&lt;[^&\n]+&gt;", r"(?<!\w)\$[A-Za-z_]{2,}\$(?!\w)", r"(?<![\w%])%[A-Za-z_]{3,}%(?!\w)", rf"(?<!\w)<{_NAME}>", r"\[[^\[\]\n]{2,}\]",
            r"\((?i:enter|insert|add|type|choose|your|ihr|ihre|votre|tu|su|seu|sua)\s+(?!(?:after|before|at|by|from|in|only|on|to)\b)[^\W\d][\w.-]*(?: [^\W\d][\w.-]*){0,4}\)", r"_{3,} ?\([^()\n]{2,}\)", r"\bTODO ?:", r"\bX{2,}(?= (?:years?|GmbH|Ltd|Inc|AG|Company|months?|%|people))|\bX{5,}\b", r"\b(?i:insert|enter|add) (?i:\w+ ){1,3}(?i:here)\b", r"(?i:click here to add|tap to add|name surname|month year|mr/mrs <)",
        ]
    )
)
#: Signs that also enclose prose and quotations: a slot between them has so many words at most, as the name of a value has.
_PROSE = {"[": 10, "{": 10, "<": 10, "«": 5, "【": 5, "&": 10, "_": 10}
_SIGNS = ("[", "{", "<", "«", "【", "~~", "%%", "__", "@@", "*|", "&lt;", "XX", "TODO")
_NAMED_SIGNS = re.compile(r"[$#%][A-Za-z_]")
_WORDS = (" here", "name surname", "month year", "to add", "(your ", "(enter ", "(insert ", "(add ", "(type ", "(choose ", "(ihr", "(votre ", "(tu ", "(su ", "(seu ", "(sua ")
#: What tells of a slot right before it: a verb of filling in, in the present, or a word for slots. In a clause of time or place, what becomes of it tells, right behind.
_NOUN = "(?:placeholder|token|tag|variable|marker|macro|(?:merge|template) field|slot|wildcard)s?"
_TOLD_BEFORE = re.compile(rf"(?i)\b(?:(?:fills?(?: in)?|renders?|rendering|substitut(?:es?|ing)|interpolat(?:es?|ing)|escapes?)(?: the| each| every| all)?|{_NOUN}(?:,? (?:like|such as|called|named|of the form))?)\b[ \"'`“‘(]*$")
_TOLD_AFTER = re.compile(rf"(?i)[\"'`”’)]* {_NOUN}\b")
_CLAUSE, _BECOMES = re.compile(r"(?i)\b(?:where|when|how|until|before|after|if)(?: the| a| an)?\b[ \"'`“‘(]*$"), re.compile(r"(?i)[\"'`”’)]* (?:is|are|gets?) (?:\w+ly |then |always )?(?:filled|rendered|resolved|substituted|replaced|expanded|populated|interpolated|parsed|escaped|inserted)\b")
_JOINED, _JOINS = re.compile(r"\x00[\"'`”’)]*(?:, and|, or|,| and| or)[ \"'`“‘(]*$"), re.compile(r"^[\"'`”’)]*(?:, and|, or|,| and| or)[ \"'`“‘(]*\x00")
#: Names with two underscores on each side that have a meaning in code.
_DUNDER = re.compile("__(?:init|main|new|call|repr|str|len|iter|next|enter|exit|eq|hash|dict|slots|all|doc|del|file|future|version|class|module|getattr|setattr|getitem|setitem|pycache)__")
_MARKUP = re.compile(r"(?i)</?(?:noscript|script|style|div|p|br|span|a|b|i|em|strong|ul|ol|li|table|tr|td|th|html|body|head|iframe|img|h\d|pre|code|input|form|main|nav|header|footer)\b")
_REDACTED = re.compile(r"(?i)\[(?:e-?mail|phone|tel|redacted|removed|url|link|address|name|id|id_number|masked|deleted|withheld|censored|pii|anonymi[sz]ed|geschwärzt|sic|internal|external|confidential|\W|\d|…|\.\.\.)[^\[\]a-z]{0,12}\]")


def _told(before: str, after: str) -> bool:
    """Whether a sentence only tells of the slot between these two parts of it: by what stands next to it and the slots joined to it."""
    before, after = _SLOTS.sub("\x00", before), _SLOTS.sub("\x00", after)
    while _JOINED.search(before):
        before = _JOINED.sub("", before)
    while _JOINS.match(after):
        after = _JOINS.sub("", after)
    return bool(_TOLD_BEFORE.search(before) or _TOLD_AFTER.match(after) or _CLAUSE.search(before) and _BECOMES.match(after))


def unfilled_slot(text: str) -> str | None:
    """The first slot in the text that waits for a value; None if there is none. Slots that a sentence only tells of, markup,
    citations, code, paths and redaction marks are none."""
    if not any(x in text for x in _SIGNS) and not _NAMED_SIGNS.search(text):
        low = text.lower()
        if not any(x in low for x in _WORDS):
            return None
    for m in _SLOTS.finditer(text):
        slot = m.group()
        a = max(text.rfind("\n", 0, m.start()), text.rfind("\r", 0, m.start()), text.rfind("\f", 0, m.start())) + 1
        b = min((x for x in (text.find("\n", m.end()), text.find("\r", m.end())) if x >= 0), default=len(text))
        cut = [x.end() for x in re.finditer(r"[.!?。]\s+", text[a : m.start()])]
        sentence = text[a + (cut[-1] if cut else 0) : b]
        if slot[0] in _PROSE and len(slot.split()) > _PROSE[slot[0]]:
            continue
        if _MARKUP.match(slot) or _DUNDER.fullmatch(slot) or _told(sentence[: m.start() - b + len(sentence)], text[m.end() : b]):
            continue
        if slot[0] == "[" and (_REDACTED.fullmatch(slot.replace(" ", "") if re.match(r"\[ ?\w \w ", slot) else slot) or re.search(r"(?i)\b(?:removed|redacted|masked|screening|withheld)\b", sentence)):
            continue
        if slot[0] == "{" and (text[m.start() - 1 : m.start()] == "/" or text[m.end() : m.end() + 1] == "/"):
            continue
        if slot[0] == "<" and re.search(r"@|://|\(at\)|\[at\]", slot):
            continue
        if slot[0] == "[" and re.search(r"@|\bat\b|\bdot\b", slot.lower()) and len(slot) < 7:
            continue
        return slot
    return None


def _parsed(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, slot, templates): a row for each document with an unfilled slot, or whose messages may all be residue."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, slots, templates = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t or t.isspace():
                    continue
                t = clean(t)
                slot, mine = unfilled_slot(t), open_templates(t)
                if slot or mine:
                    at.append(i)
                    slots.append(slot)
                    templates.append(mine)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(slots, pa.string()), pa.array(templates, pa.list_(pa.string()))], [key, "slot", "templates"])

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, slot string, templates array<string>")


def mined(pages: DataFrame, depth: int = 4, most: int = 50_000) -> DataFrame:
    """(template, n, kind): the templates of pages (templates array<string>) with the number of pages that have them, each classified once.

    A worker adds its messages up in a fixed-depth tree, emptied at `most` templates; the trees are merged by one aggregation.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TemplateTree(depth)
        send = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64()))], ["template", "n"]) if (rows := tree.take()) else None
        for b in batches:
            for mine in b.column(0).to_pylist():
                for t in mine:
                    tree.add(t)
            if tree.size >= most and (out := send()):
                yield out
        if out := send():
            yield out

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([classify(t) for t in b.column(0).to_pylist()], pa.string())], ["template", "n", "kind"])

    merged = pages.select("templates").mapInArrow(count, "template string, n long").groupBy("template").agg(F.sum("n").alias("n"))
    return merged.mapInArrow(judge, "template string, n long, kind string")


def residue(documents: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 8) -> DataFrame:
    """(key, kind, evidence): the documents that hold an unfilled slot (kind 'slot') or consist of 'filler', an 'error' message or a
    notice about scripts ('script').

    Whole texts are read, in one narrow pass that lets documents go at the first message that can't be residue. The templates of the
    others, a small part, are mined over the whole table and classified once each; verdicts are joined back by template (salted, as one
    may be in very many pages) and settle a page: every message must be residue or page furniture. A verdict depends on the template
    alone, so neither the order of rows nor their partitions change it. Null, empty and blank texts are no cases. Keys should be unique.
    """
    parsed = written(_parsed(documents, key, text), "pages")  # read twice: to mine and to judge
    pages = parsed.filter(F.size("templates") > 0)
    kinds = mined(pages).select("template", "kind", F.explode(F.array(*map(F.lit, range(salts)))).alias("salt"))
    told = pages.select(key, F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("salt"), F.explode("templates").alias("template")).join(kinds, ["template", "salt"])
    page = F.when(F.bool_or(F.col("kind") == "content"), None).when(F.bool_or(F.col("kind") == "error"), "error").when(F.bool_or(F.col("kind") == "script"), "script").when(F.bool_or(F.col("kind") == "filler"), "filler")
    judged = told.groupBy(key).agg(page.alias("kind"), F.min(F.when(F.col("kind").isin("error", "script", "filler"), F.col("template"))).alias("evidence")).filter("kind IS NOT NULL")
    both = parsed.select(key, "slot").join(judged, key, "left").filter("kind IS NOT NULL OR slot IS NOT NULL")
    return both.select(key, F.coalesce("kind", F.lit("slot")).alias("kind"), F.coalesce("evidence", "slot").alias("evidence"))


def without_residue(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """documents without those that residue() finds; null, empty and blank texts stay."""
    return documents.join(residue(documents, key, text).select(key).distinct(), key, "left_anti")
