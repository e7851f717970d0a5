"""Skills in text and sets of skills: extraction, normalization, coverage, gaps."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread_work

SPACES = r"[ \t\n\x0B\f\r]+"


def words_for_matching(text: Column) -> Column:
    """Lower-case words; what is neither letter, digit nor one of + # . - within a word parts them."""
    return F.filter(F.transform(F.split(F.lower(text), r"[^a-z0-9+#.-]+"), lambda w: F.regexp_replace(w, r"^[.-]+|[.-]+$", "")), lambda w: w != "")


def extracted(docs: DataFrame, key: str, text: str, surfaces: DataFrame, most_forms: int = 100_000) -> DataFrame:
    """(key, skill_id, canonical): the skills whose surface form comes in the text as whole words, each once a text."""
    return mentions(docs, key, text, surfaces, most_forms).select(key, "skill_id", "canonical").distinct()


def mentions(docs: DataFrame, key: str, text: str, surfaces: DataFrame, most_forms: int = 100_000) -> DataFrame:
    """(key, gram, skill_id, canonical): the surface forms that come in a text as whole words, a row each time.

    Runs of words, up to as many as the longest form has, are joined by equality with the forms: an equi-join on the form instead of
    trying each form on each text. Only runs whose first word starts a form are built, a hash lookup within the row, so that
    few of them reach the join. Forms are made of words by the same rule; the list must be small, more than most_forms are refused.
    """
    forms = surfaces.select(F.array_join(words_for_matching(F.col("surface")), " ").alias("gram"), "skill_id", "canonical").filter("gram <> ''")
    starts = forms.select(F.substring_index("gram", " ", 1).alias("w"), (F.length("gram") - F.length(F.replace("gram", F.lit(" "), F.lit(""))) + 1).alias("n")).groupBy("w").agg(F.max("n").alias("n")).limit(most_forms + 1).collect()
    if len(starts) > most_forms:
        raise ValueError(f"the taxonomy has more than {most_forms} first words")
    if not starts:
        return docs.select(key, F.lit("").alias("gram")).crossJoin(forms.select("skill_id", "canonical")).filter("false")
    by_length: dict[int, list[str]] = {}
    for w, n in starts:
        by_length.setdefault(n, []).append(w)
    longest = F.lit(0)
    for n, ws in sorted(by_length.items()):
        longest = F.when(F.col("_w.w").isin(ws), n).otherwise(longest)
    words = docs.select(F.col(key), words_for_matching(F.col(text)).alias("_ws"))
    known = [w for w, _ in starts]
    opens = F.filter(F.transform("_ws", lambda w, i: F.when(w.isin(known), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    at = words.select(key, "_ws", F.explode(opens).alias("_w")).withColumn("_n", longest)
    runs = F.transform(F.sequence(F.lit(1), F.least(F.col("_n"), F.size("_ws") - F.col("_w.i"))), lambda n: F.array_join(F.slice("_ws", F.col("_w.i") + 1, n), " "))
    grams = at.select(key, F.explode(runs).alias("gram"))
    return grams.join(forms, "gram").select(key, "gram", "skill_id", "canonical")


_WORD_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+#")


@lru_cache(maxsize=100_000)
def _behind(gram: str) -> re.Pattern:
    """What a text holds from a form's first word on: its words, what parts them, and an end that is no word."""
    words = "[.-]*[^a-z0-9+#.-][^a-z0-9+#]*".join(map(re.escape, gram.split(" ")))
    return re.compile(rf"({words})[.-]*(?![a-z0-9+#.-])")


def place(low: str, gram: str) -> tuple[int, int] | None:
    """(place, length) of a form's words where they first come in a lower-case text as whole words."""
    first, at = gram.split(" ", 1)[0], -1
    while (at := low.find(first, at + 1)) >= 0:
        before = at
        while before and low[before - 1] in ".-":
            before -= 1
        if (not before or low[before - 1] not in _WORD_SIGNS) and (m := _behind(gram).match(low, at)):
            return at, m.end(1) - at
    return None


def first_places(docs: DataFrame, key: str, text: str, surfaces: DataFrame, margin: int = 100) -> DataFrame:
    """(key, skill, at, n, text): where each skill is first named in a text, by any of its forms: the `margin` characters on each side of it, and
    the 0-based place and length of the form in them. A document meets all its forms in one row (at most as many as are listed), so
    that its text is read once for each by a plain search; Spark has no search from a place on."""
    named = mentions(docs.select(key, text), key, text, surfaces).groupBy(key).agg(F.collect_set(F.struct(F.lower("canonical").alias("skill"), "gram")).alias("_forms"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, (t, forms) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                low, best = t.lower(), {}
                for f in forms:
                    if (spot := place(low, f["gram"])) and spot < best.get(f["skill"], (len(low) + 1, 0)):
                        best[f["skill"]] = spot
                for skill, (p, n) in sorted(best.items()):
                    start = max(0, p - margin)
                    at.append(i)
                    rows.append((skill, p - start, n, t[start : p + n + margin]))
            cols = [pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *cols], [key, "skill", "at", "n", "text"])

    met = spread_work(docs.select(key, text), key).join(named, key).select(key, text, "_forms")
    return met.mapInArrow(run, f"`{key}` {kind}, skill string, at int, n int, text string")


def normalized(values: DataFrame, value: str, surfaces: DataFrame) -> DataFrame:
    """values with skill_id, canonical, confidence: an equal form (1.0); else the longest form of three characters or more that
    the value contains and that is at least half as long (0.8); else none (0.0). Distinct values are matched once."""
    clean = F.trim(F.regexp_replace(F.lower(F.col(value)), SPACES, " "))
    distinct = values.select(clean.alias("_v")).filter("_v <> ''").distinct()
    exact = distinct.join(surfaces, distinct["_v"] == surfaces["surface"]).select("_v", "skill_id", "canonical", F.lit(1.0).alias("confidence"))
    rest = distinct.join(exact, "_v", "left_anti")
    ws = rest.select("_v", F.split("_v", " ").alias("_ws"))
    windows = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_ws")), lambda i: F.transform(F.sequence(F.lit(1), F.size("_ws") - i + 1), lambda n: F.array_join(F.slice("_ws", i, n), " "))))
    parts = ws.select("_v", F.explode(F.array_distinct(windows)).alias("surface")).filter((F.length("surface") >= 3) & (F.length("surface") * 2 >= F.length("_v")))
    contained = parts.join(surfaces, "surface").groupBy("_v").agg(F.max_by(F.struct("skill_id", "canonical"), F.struct(F.length("surface"), -F.col("skill_id"))).alias("m")).select("_v", "m.skill_id", "m.canonical", F.lit(0.8).alias("confidence"))
    found = exact.unionByName(contained)
    return values.withColumn("_v", clean).join(found, "_v", "left").drop("_v").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def coverage(have: Column, want: Column) -> Column:
    """The share of distinct wanted values that are had; 0 if none is wanted."""
    want = F.array_distinct(want)
    return F.when(F.size(want) > 0, F.round(F.size(F.array_intersect(have, want)) / F.size(want), 6)).otherwise(F.lit(0.0))


def three_sets(matched_required: Column, matched_nice: Column, missing: Column) -> Column:
    """struct(required, nice, missing, conflicts): disjoint sets; a value in several stays in the first of them."""
    required = F.array_distinct(matched_required)
    nice = F.array_except(matched_nice, required)
    conflicts = F.size(F.array_intersect(required, missing)) + F.size(F.array_intersect(nice, missing)) + F.size(F.array_intersect(required, matched_nice))
    return F.struct(required.alias("required"), nice.alias("nice"), F.array_except(F.array_except(missing, required), nice).alias("missing"), conflicts.alias("conflicts"))
