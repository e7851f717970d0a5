"""Several values packed in one field: one row per value, by placeholders for quoted spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

# Private-use characters frame the index of a span and mark cuts; those that a text holds itself are escaped first, so that nothing can collide.
_QUOTED, _KEPT, _END, _CUT, _OPENS = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
_MARK = r"(?:[-–—*•●▪‣◦·]|\(?\d{1,3}[.)])"
_DELIMITER = ",;|¦·•/\\t\\n\\r，、"
#: Where a quote may open a value: behind the start, a delimiter, a list mark or another value's quote, however many spaces follow.
_BEFORE_QUOTE = rf"((?:^|[{_DELIMITER}\[(]|[\"'](?=\s)|(?:[-–—*•●]|\d[.)])(?=\s))\s*)(?=[\"'])"
_CLOSE = rf"(?=\s*(?:$|[{_DELIMITER}\]])|\s+{_OPENS}?[\"'])"
_MARKS = rf"(?<!\\){_OPENS}"
#: What is put aside before splitting: quoted values, escaped characters, bracketed groups, thousands separators.
SPANS = "|".join(
    [
        rf'{_OPENS}"(?:[^"\\]|\\.|"")*"{_CLOSE}',
        rf"{_OPENS}'(?:[^'\\]|\\.|''|'(?=\w))*'{_CLOSE}",
        r"\\.",
        r"\([^()]*\)",
        r"(?<=\d),(?=\d{3}(?!\d))",
    ]
)
#: Delimiters of unmarked lists; a slash counts only between spaces, spaces only if two or more.
SPLIT = rf"\s*(?:[\n\r\t;|¦，、•·,{_CUT}]|\s/\s|\s{{2,}})\s*"
#: Parts that the joins by value are dealt into, as one value may be a hot key.
SALTS = 8
CONJUNCTIONS = ("and", "&", "und", "et", "y")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\ufeff]+|[\s\ufeff]+$", "")


def _placed(text: Column, spans: Column) -> Column:
    """text with each span replaced by a placeholder that holds its index."""
    parts = F.split(text, SPANS, -1)

    def one(part: Column, i: Column) -> Column:
        kind = F.when(F.get(spans, i).rlike(r"^[\"'].*[\"']$") & (F.length(F.get(spans, i)) >= 2), F.lit(_QUOTED)).otherwise(F.lit(_KEPT))
        return F.when(i < F.size(spans), F.concat(part, kind, i.cast("string"), F.lit(_END))).otherwise(part)

    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.transform(parts, one), ""))


def _restored(item: Column, spans: Column, json: Column) -> Column:
    """item with its placeholders looked up; a value that is one quoted span loses its quotes and escapes."""
    hole = f"[{_QUOTED}{_KEPT}](\\d+){_END}"
    parts, held = F.split(item, hole, -1), F.regexp_extract_all(item, F.lit(hole), F.lit(1))

    def span(i: Column) -> Column:
        s = F.get(spans, F.get(held, i).cast("int"))
        plain = F.regexp_replace(s, r"\\([\ue000-\ue004])", "$1")
        return F.when(s.startswith("\\") & (F.length(s) == 2), F.substring(s, 2, 1)).otherwise(plain)

    joined = F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(held), F.concat(p, span(i))).otherwise(p)), "")
    whole = F.get(spans, F.regexp_extract(item, hole, 1).try_cast("int"))
    quote = F.substring(whole, 1, 1)
    inner = F.substring(whole, F.lit(2), F.length(whole) - 2)
    plain = F.regexp_replace(F.replace(inner, F.concat(quote, quote), quote), r"\\(.)", "$1")
    decoded = F.when(json, F.coalesce(F.get(F.from_json(F.concat(F.lit("["), whole, F.lit("]")), "array<string>"), F.lit(0)), plain)).otherwise(plain)
    return F.when(~item.contains(_END), item).when(item.rlike(f"^{_QUOTED}\\d+{_END}$"), decoded).otherwise(joined)


def _marked(rows: DataFrame) -> DataFrame:
    """rows with the trimmed text, whether it is a JSON array, and _marked: the text with list marks replaced by cuts, if marked."""
    c = F.col
    rows = rows.withColumn("_trimmed", F.regexp_replace(_trim(F.replace("raw", F.lit("\r\n"), F.lit("\n"))), "[\ue000-\ue004]", r"\\$0"))
    rows = rows.withColumn("_json", c("_trimmed").rlike(r'(?s)^\[\s*".*"\s*\]$'))
    rows = rows.withColumn("_body", F.when(c("_json"), F.regexp_replace("_trimmed", r"^\[\s*|\s*\]$", "")).otherwise(c("_trimmed")))
    rows = rows.withColumn("_numbers", F.when(c("_body").rlike(r"^\(?1[.)]\s"), F.regexp_extract_all("_body", F.lit(r"(?:^|(?<=\s))\(?(\d{1,3})[.)]\s"), F.lit(1))))
    in_turn = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_numbers"), F.lit(1))), lambda i: i.cast("string"))
    bullet = r"[-–—*•●▪‣◦·]\s"
    bullets = c("_body").rlike(f"^{bullet}") & ~c("_body").rlike(rf"(?m)^(?![ \t]*{bullet})(?=.*\S)") & (c("_body").contains("\n") | ~c("_body").rlike(r"\s[•·]\s"))
    return rows.withColumn(
        "_marked",
        F.when(c("_numbers") == in_turn, F.regexp_replace("_body", r"(?:^|(?<=\s))\(?\d{1,3}[.)]\s+", _CUT)).when(bullets, F.regexp_replace("_body", rf"(?m)^[ \t]*{bullet}+", _CUT)),
    ).select("_key", "field_name", "_json", "_marked", F.coalesce("_marked", "_body").alias("_text"))


def split_values(df: DataFrame, key: str, fields: Sequence[str], conjunctions: Sequence[str] = CONJUNCTIONS) -> DataFrame:
    """(key, field_name, pos, item, n_values): one row per value of each field, pos from 0.

    A field may be a JSON array, a list with marks or numbers, quoted values, or values between delimiters, also mixed ones.
    Quoted spans (escapes included), escaped characters, bracketed groups and thousands separators are replaced by indexed
    placeholders, what remains is split, the spans are looked up again. Empty values are skipped, repeated ones kept; null,
    empty and blank fields have no rows. Keys should be unique.

    A conjunction ends a list ("a, b and c") but also stands within values ("health and safety"). The last value of a field
    that has no delimiter but commas is cut at one if both sides are values elsewhere in the whole table and the whole isn't
    (in a list of three or more, if one side is). The counts come from all rows by one shuffle of distinct values.
    """
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in fields]))
    rows = df.select(F.col(key).alias("_key"), named.alias("_f")).select("_key", "_f.field_name", "_f.raw").filter(F.col("raw").rlike(r"\S"))
    rows = _marked(rows)
    opened = F.when(F.col("_text").rlike("[\"']"), F.regexp_replace("_text", _BEFORE_QUOTE, f"$1{_OPENS}")).otherwise(F.col("_text"))
    rows = rows.withColumn("_opened", opened).withColumn("_spans", F.transform(F.regexp_extract_all("_opened", F.lit(SPANS), F.lit(0)), lambda x: F.regexp_replace(x, _MARKS, "")))
    return _finish(rows, key, conjunctions)


def _finish(rows: DataFrame, key: str, conjunctions: Sequence[str]) -> DataFrame:
    placed = F.regexp_replace(F.regexp_replace(_placed(F.col("_opened"), F.col("_spans")), _MARKS, ""), f"{_END}\\s+(?={_QUOTED})", f"{_END}{_CUT}")
    listed = F.when(F.col("_marked").isNotNull(), F.transform(F.split(F.col("_placed"), _CUT, -1), lambda x: F.regexp_replace(x, r"[\s,;]+$", ""))).otherwise(
        F.transform(F.split(F.col("_placed"), SPLIT, -1), lambda x: F.regexp_replace(x, rf"^{_MARK}\s+", ""))
    )
    rows = rows.withColumn("_placed", placed).withColumn("_items", F.filter(F.transform(listed, _trim), lambda x: x != ""))
    commas_only = F.col("_marked").isNull() & ~F.col("_json") & ~F.col("_placed").rlike(rf"[\n\t;|¦，、•·{_CUT}]|\s/\s|\S\s{{2,}}\S")
    restored = F.transform("_items", lambda x: _trim(_restored(x, F.col("_spans"), F.col("_json"))))
    plain = ~F.try_element_at("_items", F.lit(-1)).rlike(f"^{_QUOTED}\\d+{_END}$")
    rows = rows.select("_key", "field_name", F.filter(restored, lambda x: x != "").alias("_items"), (commas_only & plain).alias("_open"))
    word = "|".join(conjunctions)
    last = F.try_element_at("_items", F.lit(-1))
    oxford = F.col("_open") & (F.size("_items") > 1) & last.rlike(rf"^(?i:{word})\s+\S")
    rows = rows.withColumn("_items", F.when(oxford, F.concat(F.slice("_items", 1, F.size("_items") - 1), F.array(F.regexp_replace(last, rf"^(?i:{word})\s+", "")))).otherwise(F.col("_items")))
    rows = rows.withColumn("_unsure", F.col("_open") & ~oxford & last.rlike(rf"\S\s+(?i:{word})\s+\S"))
    rows = written(rows.select("_key", "field_name", "_items", "_unsure"), "split-values")  # read three times below
    # distinct unsure last values, and whether they stand in a list of three or more; every (prefix, suffix) of one around a conjunction
    sure = rows.select(F.explode(F.when(F.col("_unsure"), F.slice("_items", 1, F.size("_items") - 1)).otherwise(F.col("_items"))).alias("v"))
    known = sure.select(F.lower("v").alias("v")).distinct()
    rows = rows.withColumns({"_last": F.when(F.col("_unsure"), last), "_many": F.size("_items") > 1, "_salt": F.pmod(F.xxhash64("_key", "field_name"), F.lit(SALTS)).cast("int")})
    cuts = rows.filter("_unsure").select("_last", "_many").distinct().select("_last", "_many", F.posexplode(_cuts(F.col("_last"), word)).alias("_at", "_cut"))
    roles = [F.concat_ws(" ", "_cut.left", "_cut.by", "_cut.right"), F.col("_cut.left"), F.col("_cut.right")]
    asked = cuts.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("role"), F.lower(c).alias("v")) for i, c in enumerate(roles)])).alias("_q")).select("*", "_q.role", "_q.v").drop("_q")
    seen = asked.select("v").distinct().join(known, "v", "left_semi").withColumn("_seen", F.lit(True))  # distinct values on both sides
    told = asked.join(seen, "v", "left").groupBy("_last", "_many", "_at", "_cut").agg(*[F.coalesce(F.bool_or(F.when(F.col("role") == i, F.coalesce("_seen", F.lit(False)))), F.lit(False)).alias(f"_k{i}") for i in range(3)])
    good = told.filter(~F.col("_k0") & ((F.col("_k1") & F.col("_k2")) | (F.col("_many") & (F.col("_k1") | F.col("_k2")))))
    best = good.groupBy("_last", "_many").agg(F.min_by("_cut", F.struct((~(F.col("_k1") & F.col("_k2"))).alias("a"), F.col("_at"))).alias("_cut"))
    best = best.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))  # one last value may be in very many fields
    rows = rows.join(best, ["_last", "_many", "_salt"], "left")
    items = F.when(F.col("_cut").isNotNull(), F.concat(F.slice("_items", 1, F.size("_items") - 1), F.array("_cut.left", "_cut.right"))).otherwise(F.col("_items"))
    rows = rows.withColumn("_items", items)
    return rows.select(F.col("_key").alias(key), "field_name", F.size("_items").alias("n_values"), F.posexplode("_items").alias("pos", "item")).select(key, "field_name", "pos", "item", "n_values")


def _cuts(value: Column, word: str) -> Column:
    """array of (left, by, right) around each conjunction in value."""
    words = F.split(value, r"\s+", -1)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda i: (F.size(words) > 2) & F.get(words, i).rlike(rf"^(?i:{word})$"))
    return F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, F.lit(1), i), " ").alias("left"), F.get(words, i).alias("by"), F.array_join(F.slice(words, i + 2, F.size(words)), " ").alias("right")))
