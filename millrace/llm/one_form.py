"""One consistent form for text that looks the same but is made of other characters, by DuckDB inside Arrow partitions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .leaves import string_leaves

# Letters of other alphabets that look like Latin ones, each line as the letters and what they look like.
_CYRILLIC = ("АВЕЅІЈКМНОРСТУХҮԚԜҺаеорсухіјѕԁһԛԝ", "ABESIJKMHOPCTYXYQWhaeopcyxijsdhqw")
_GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορτυχϲϳ", "ABEZHIKMNOPTYXaikvoptuxcj")
_ARMENIAN = ("ՍՕԼհոսցօ", "UOLhnugo")
LOOK_ALIKES = {ord(a): b for pair in (_CYRILLIC, _GREEK, _ARMENIAN) for a, b in zip(*pair)}

#: Characters without a look that no spelling needs: soft hyphen, controls, word joiners, direction marks, fillers, tags.
INVISIBLE = r"[\x00-\x08\x0E-\x1F\x7F-\x84\x86-\x9F\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}]"
SPACES = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
#: Scripts whose spelling uses joiners between letters.
_JOINING = r"\p{Arabic}\p{Syriac}\p{Mongolian}\p{Nko}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Myanmar}\p{Tibetan}"
_EMOJI = r"\x{00A9}\x{00AE}\x{203C}-\x{3299}\x{FE0F}\x{20E3}\x{1F000}-\x{1FAFF}\x{E0020}-\x{E007F}"
_OTHER = r"\p{Cyrillic}\p{Greek}\p{Armenian}"
_WORD = r"[\p{L}\p{M}\p{N}]"


@lru_cache(maxsize=1)
def compatibility_letters() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to, longer): styled and wide letters and digits with their plain one, and joined ones with their plain several.

    From the Unicode data: letters, and digits, whose compatibility form is of the kind <font>, <wide>, <narrow> or <circle>;
    <compat> only where it joins several letters. Superscripts, fractions and signs (No., TM) stay: they look different.
    """
    one, other, longer = [], [], []
    for c in range(0xA0, 0x20000):
        char = chr(c)
        kind = unicodedata.decomposition(char).partition(" ")[0]
        if kind not in ("<font>", "<wide>", "<narrow>", "<circle>", "<compat>") or 0xFE70 <= c <= 0xFEFC:
            continue
        plain = unicodedata.normalize("NFKC", char)
        if not all(unicodedata.category(x)[0] in "LMN" for x in plain) or unicodedata.category(char) == "No" and kind != "<circle>" or "Roman".upper() in unicodedata.name(char, ""):
            continue
        if kind == "<circle>" and not (0x24B6 <= c <= 0x24E9):
            continue
        if len(plain) == 1 and kind != "<compat>":
            one.append(char)
            other.append(plain)
        elif len(plain) > 1 and unicodedata.category(char)[0] == "L" and (plain.isascii() or 0xFB00 <= c <= 0xFB4F):
            longer.append((char, plain))
    return "".join(one), "".join(other), tuple(longer)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def one_form_sql(column: str, source: str) -> str:
    """The embedded SQL: source's rows with a column one_form beside column."""
    wide, plain, longer = compatibility_letters()
    joined = "".join(a for a, _ in longer)
    spread = "t"
    for a, b in longer:
        spread = f"replace({spread}, {_quoted(a)}, {_quoted(b)})"
    mixed = rf"[{_OTHER}][\p{{M}}\p{{N}}]*\p{{Latin}}|\p{{Latin}}[\p{{M}}\p{{N}}]*[{_OTHER}]"
    like, latin = "".join(map(chr, LOOK_ALIKES)), "".join(LOOK_ALIKES.values())
    keep, zwj, zwnj = "\ue000", "\u200d", "\u200c"
    # each step is taken only for texts that hold what it changes; most texts hold nothing
    return f"""
    WITH a AS (SELECT *, CASE WHEN regexp_full_match({column}, '[\\x20-\\x7E\\n\\r\\t]*') THEN {column} ELSE nfc_normalize({column}) END AS t FROM {source}),
    b AS (SELECT * REPLACE (CASE WHEN regexp_matches(t, '{SPACES}') THEN regexp_replace(t, '{SPACES}', ' ', 'g') ELSE t END AS t) FROM a),
    c AS (SELECT * REPLACE (CASE WHEN regexp_matches(t, '{INVISIBLE}') THEN regexp_replace(t, '{INVISIBLE}', '', 'g') ELSE t END AS t) FROM b),
    d AS (SELECT * REPLACE (CASE WHEN regexp_matches(t, '[{wide}]') THEN translate(t, {_quoted(wide)}, {_quoted(plain)}) ELSE t END AS t) FROM c),
    e AS (SELECT * REPLACE (CASE WHEN regexp_matches(t, '[{joined}]') THEN {spread} ELSE t END AS t) FROM d),
    f AS (SELECT * REPLACE (CASE WHEN contains(t, '{zwj}') OR contains(t, '{zwnj}') THEN
            replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                regexp_replace(replace(t, '{keep}', '{keep}x'), '([{_EMOJI}]){zwj}([{_EMOJI}])', '\\1{keep}e\\2', 'g'),
                '([{_EMOJI}]){zwj}([{_EMOJI}])', '\\1{keep}e\\2', 'g'),
                '([{_JOINING}]){zwnj}([{_JOINING}])', '\\1{keep}n\\2', 'g'),
                '([{_JOINING}]){zwj}', '\\1{keep}e', 'g'),
                '[{zwj}{zwnj}]', '', 'g'), '{keep}e', '{zwj}'), '{keep}n', '{zwnj}'), '{keep}x', '{keep}')
          ELSE t END AS t) FROM e),
    g AS (SELECT * REPLACE (CASE WHEN regexp_matches(t, '[{like}]') AND regexp_matches(t, '{mixed}') THEN
            array_to_string(list_transform(regexp_extract_all(t, '{_WORD}+|[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w:
                CASE WHEN regexp_matches(w, '[{like}]') AND regexp_matches(w, '\\p{{Latin}}') AND NOT regexp_matches(translate(w, {_quoted(like)}, ''), '[{_OTHER}]')
                     THEN translate(w, {_quoted(like)}, {_quoted(latin)}) ELSE w END), '')
          ELSE t END AS t) FROM f)
    SELECT * EXCLUDE (t), CASE WHEN t = {column} THEN t ELSE nfc_normalize(t) END AS one_form FROM g
    """


@lru_cache(maxsize=1)
def _duck():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    con.execute("SET enable_progress_bar = false")
    return con


def one_form(table: pa.Table, column: str) -> pa.Table:
    """table with a column one_form. Null stays null, empty text empty; a text that is in the form already comes out equal."""
    con = _duck()
    con.register("arrow_partition", table)
    try:
        return con.sql(one_form_sql(column, "arrow_partition")).to_arrow_table()
    finally:
        con.unregister("arrow_partition")


def _odd(value: str) -> bool:
    # printable ASCII and line breaks are in the form by definition; DuckDB sees all else
    return not value.isascii() or any(not c.isprintable() and c not in "\n\r\t\x0b\x0c" for c in value) if not value.isprintable() else not value.isascii()


def consistent_values(resumes: DataFrame, key: str = "resume_id", column: str = "parsed_data_json") -> DataFrame:
    """(key, path, value, one_form): each string value of the JSON column that isn't in the consistent form, with that form.

    The form has composed accents (NFC), plain letters and digits instead of wide, styled or joined ones, plain spaces, no
    invisible characters but joiners within an emoji or a spelling that uses them, and no letter of another alphabet inside a
    Latin word, where all of the word's foreign letters look like Latin ones. Words wholly of another alphabet, line breaks,
    dashes and quotes stay. Null, empty and unparsable JSON has no values. Applying it twice changes nothing more.
    """
    kind = resumes.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, paths, values = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if text is None:
                    continue
                for path, value in string_leaves(text):
                    if _odd(value):
                        at.append(i)
                        paths.append(path)
                        values.append(value)
            keys = b.column(0).take(pa.array(at, pa.int32()))
            out = one_form(pa.table([keys, pa.array(paths, pa.string()), pa.array(values, pa.string())], [key, "path", "value"]), "value")
            out = out.filter(pa.compute.not_equal(out["value"], out["one_form"]))
            yield from out.select([key, "path", "value", "one_form"]).cast(pa.schema([(key, keys.type), ("path", pa.string()), ("value", pa.string()), ("one_form", pa.string())])).to_batches()

    import pyarrow.compute  # noqa: F401

    return resumes.select(F.col(key), F.col(column)).mapInArrow(run, f"`{key}` {kind}, path string, value string, one_form string")
