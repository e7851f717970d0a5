"""Lexical and vector retrieval, rank fusion and two-tier scoring."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from .plugins import EncoderFactory, ScorerFactory, encoded, pair_scores

K1, B, FUSION = 1.5, 0.75, 60
#: Rows that one task may rank by itself.
IN_ONE_TASK = 100_000


def term_frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): the terms of each text. Counted by term within a document, so a map-side combine does most."""
    words = docs.select(F.col(key), T.tokens(F.col(text)).alias("ws")).select(key, F.size("ws").alias("length"), F.explode("ws").alias("term"))
    return words.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def document_frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df): the number of texts that hold a term. Repeats are dropped within the row, before the only shuffle."""
    return docs.select(F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, key: str, text: str, query: str, k1: float = K1, b: float = B, digits: int = 9) -> DataFrame:
    """(key, bm25) of every text against one query; a term repeated in the query counts each time. Texts without a match score 0.

    idf = ln((n - df + 0.5) / (df + 0.5) + 1). Narrow passes over the texts: only the words that the query has are kept, and the
    collection's statistics are one small row that is cross-joined back. Only those statistics are shuffled.
    """
    words = query_words(docs, key, text, query)
    return words.select(key, F.lit(0.0).alias("bm25")) if not _query_terms(query) else _bm25(words, key, query, k1, b, digits).select(key, "bm25")


def query_words(docs: DataFrame, key: str, text: str, query: str, *more: Column) -> DataFrame:
    """(key, length, ws, ...): the number of words of each text, and those of them that the query has too; what any score reads."""
    terms = [t for t, _ in _query_terms(query)]
    words = docs.select(F.col(key), F.coalesce(T.tokens(F.col(text)), F.array().cast("array<string>")).alias("all"), *more)
    return words.select(key, F.size("all").alias("length"), F.filter("all", lambda x: x.isin(terms)).alias("ws"), *[c for c in words.columns if c not in (key, "all")])


def _bm25(words: DataFrame, key: str, query: str, k1: float = K1, b: float = B, digits: int = 9) -> DataFrame:
    """words (of query_words) with bm25. One row of statistics is joined back; texts aren't shuffled."""
    terms = _query_terms(query)
    size = words.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    held = words.select(F.explode(F.array_distinct("ws")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))  # at most the query's terms
    df = held.agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))
    joined = words.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(df))
    norm = k1 * (1 - b + b * F.col("length") / F.when(F.col("mean") > 0, F.col("mean")).otherwise(F.lit(1.0)))
    times = F.create_map(*[F.lit(x) for t in terms for x in t])

    def add(total: Column, term: Column) -> Column:
        tf, n = F.size(F.filter("ws", lambda x: x == term)), F.col("df")[term]
        return total + times[term] * F.log((F.col("n") - n + 0.5) / (n + 0.5) + 1) * tf * (k1 + 1) / (tf + F.col("norm"))

    score = F.aggregate(F.array_distinct("ws"), F.lit(0.0), add)
    return joined.withColumn("norm", norm).withColumn("bm25", F.round(score, digits)).drop("norm", "n", "mean", "df")


def _coverage(query: str) -> Column:
    """The share of the query's distinct terms that ws holds; the stand-in where no encoder is given."""
    return F.round(F.size(F.array_distinct("ws")) / F.greatest(F.lit(len(_query_terms(query))), F.lit(1)), 9)


def bm25_many(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query: str, top: int = 10, k1: float = K1, b: float = B, digits: int = 6) -> DataFrame:
    """(query_key, key, score, pos): the best texts of each of many queries by BM25; a text without a match has no row.

    The words of the texts are filtered to those that any query asks, before anything is shuffled. They meet the queries by term,
    salted, as a term may be in a third of all texts; partial sums are taken on the way to (query, text), and each task limits
    its rows to the best of a query before the last shuffle.
    """
    asked = queries.select(F.col(query_key), F.explode(T.tokens(F.col(query))).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
    words = docs.select(F.col(key), F.coalesce(T.tokens(F.col(text)), F.array().cast("array<string>")).alias("ws")).select(key, "ws", F.size("ws").alias("length"))
    size = words.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    tf = words.select(key, "length", F.explode("ws").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy(key, "term", "length").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(size)).select("term", "mean", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    wanted = asked.join(idf, "term").withColumn("_salt", F.explode(F.array(*map(F.lit, range(8)))))
    met = tf.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(8)).cast("int")).join(wanted, ["term", "_salt"])
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = met.groupBy(query_key, key).agg(F.round(F.sum(part), digits).alias("score"))
    best = Window.partitionBy(query_key).orderBy(F.col("score").desc(), F.col(key))
    return scored.withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= top)


def _query_terms(query: str) -> list[tuple[str, int]]:
    import re
    from collections import Counter

    return sorted(Counter(re.findall("[a-z0-9]+", query.lower())).items())


def both_scores(docs: DataFrame, key: str, text: str, query: str, encode: EncoderFactory | None = None) -> DataFrame:
    """(key, bm25, dense): every text is tokenized once; what is read again after it (lengths, the query's words, dense scores) is written
    once. dense is the cosine of the encoder's vectors, else the share of the query's terms."""
    more = () if encode is None else (F.round(cosine(encoded(F.col(text), encode), F.array(*[F.lit(float(v)) for v in encode()([query])[0]])), 9).alias("dense"),)
    words = written(query_words(docs, key, text, query, *more), "query-words")
    words = words if more else words.withColumn("dense", _coverage(query))
    return (_bm25(words, key, query) if _query_terms(query) else words.withColumn("bm25", F.lit(0.0))).select(key, "bm25", "dense")


def ranked(scores: DataFrame, score: str, key: str, name: str = "pos", partition: Sequence[str] = (), n: int | None = None) -> DataFrame:
    """scores with the 0-based position by score descending, then key.

    Without a partition a global position is needed: rows are range-partitioned and sorted, counted by partition (a few
    numbers reach the driver), and numbered with the offsets of their partitions. No task holds all rows, unless their number n
    is given and proves to be at most IN_ONE_TASK: then a plain window is cheaper, with the same result.
    """
    order = (F.col(score).desc(), F.col(key))
    if partition or n is not None and n <= IN_ONE_TASK:
        return scores.withColumn(name, F.row_number().over(Window.partitionBy(*(partition or [F.lit(0)])).orderBy(*order)) - 1)
    ordered = scores.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ordered.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33))
    numbered = written(numbered, "ranked")  # the counts and the rows must come from one and the same partitioning
    sizes = numbered.groupBy("_p").agg((F.max("_i") + 1).alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return numbered.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


def fused(scores: DataFrame, key: str, columns: Sequence[str], k: int = FUSION, n: int | None = None) -> DataFrame:
    """scores with rrf = sum of 1 / (k + position + 1) over the rankings by each column (descending, ties by key)."""
    out = scores
    for c in columns:
        out = ranked(out, c, key, f"_pos_{c}", n=n)
    total = sum((1.0 / (k + F.col(f"_pos_{c}") + 1) for c in columns), F.lit(0.0))
    return out.withColumn("rrf", F.round(total, 12)).drop(*[f"_pos_{c}" for c in columns])


def min_max(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the column scaled to [0, 1]; 0.5 where it is constant. Two partial aggregates make one row, that is joined back."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.when(F.col("_hi") - F.col("_lo") < 1e-9, F.lit(0.5)).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, F.round(scaled, 9)).drop("_lo", "_hi")


def hybrid_rank(docs: DataFrame, key: str, text: str, query: str, encode: EncoderFactory | None = None, score_pairs: ScorerFactory | None = None, top_k: int = 10) -> DataFrame:
    """(key, bm25, dense, rrf_norm, cross, final, rank, display, tier, rationale) of every text.

    Lexical and dense rankings are fused by reciprocal rank, scaled, and the top_k re-scored by a pair scorer; what
    isn't re-scored keeps the scaled fusion score, and both tiers are sorted together. encode gives the dense scores, score_pairs
    those of (query, text) pairs, through a logistic curve. Stand-ins without them: the share of query terms covered, and the same
    through a logistic curve.
    """
    both = written(both_scores(docs, key, text, query, encode), "scores")
    n = both.count()  # of a table just written: read from its footers
    scaled = min_max(min_max(min_max(fused(both, key, ["bm25", "dense"], n=n), "rrf", "rrf_norm"), "bm25", "_bm25"), "dense", "_dense")
    scaled = written(scaled, "fused")  # both the cut and the rest read it
    top = scaled.orderBy(F.col("rrf").desc(), F.col(key)).limit(top_k).select(key, "dense")
    if score_pairs is None:
        cross = top.select(key, F.round(1 / (1 + F.exp(-(6 * F.col("dense") - 3))), 9).alias("cross"))
    else:
        cross = docs.select(key, text).join(F.broadcast(top), key).select(key, F.round(pair_scores(query, F.col(text), score_pairs), 9).alias("cross"))
    scored = scaled.join(F.broadcast(cross), key, "left").withColumn("cross", F.coalesce("cross", F.lit(0.0)))  # at most top_k rows are broadcast
    two = F.when(F.col("cross") > 0, F.col("cross")).otherwise(F.col("rrf_norm"))
    placed = ranked(scored.withColumn("final", two), "final", key, "rank", n=n).withColumn("rank", F.col("rank") + 1)
    told = lambda label, c: F.format_string(label + " %.3f (BM25 %.2f, dense %.2f)", F.round(c, 3), F.round("_bm25", 2), F.round("_dense", 2))
    rationale = F.when(F.col("cross") > 0, told("pair score", F.col("cross"))).otherwise(told("fused score", F.col("rrf_norm")))
    return placed.select(key, "bm25", "dense", "rrf_norm", "cross", "final", "rank", F.round(F.col("final") * 100, 2).alias("display"), F.when(F.col("cross") > 0, "cross").otherwise("fusion").alias("tier"), rationale.alias("rationale"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers in double precision; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def nearest(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 5, at_least: float = -1.0, block: int = 2_000) -> DataFrame:
    """(query_key, key, score, pos): the k nearest vectors of each query by cosine, itself left out; ties by key.

    The queries are a stated set. They are broadcast in blocks of at most `block` (a bound of some MB), each block against all
    rows by matrix products over Arrow batches of unit vectors, so that no pair is a row. A task keeps the k best of a query;
    what is shuffled is k rows a query and task. Vectors without length score 0; null ones take no part.
    """
    id_type = vectors.schema[key].dataType.simpleString()
    n, out = queries.count(), None
    numbered = queries.select(F.col(key), F.col(vector).cast("array<double>").alias("_v"), F.pmod(F.xxhash64(key), F.lit(max(1, -(-2 * n // block)))).alias("_b")).filter("_v IS NOT NULL")
    for i in range(max(1, -(-2 * n // block))):
        rows = numbered.filter(F.col("_b") == i).orderBy(key).collect()  # one block of the stated queries, about half of `block`
        part = vectors.select(F.col(key), F.col(vector).cast("array<double>").alias("_v")).filter("_v IS NOT NULL").mapInArrow(_best_of(rows, k, at_least, key), f"query_key {id_type}, `{key}` {id_type}, score double")
        out = part if out is None else out.unionByName(part)
    best = Window.partitionBy("query_key").orderBy(F.col("score").desc(), F.col(key))
    return out.withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= k)


def _best_of(rows, k: int, at_least: float, key: str):
    """For Arrow batches of (key, vector), the k best of each query so far, given out at the end of a task."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    q = unit(np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1)) if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list] = [[] for _ in rows]
        schema = None
        for b in batches:
            schema = b.schema.field(0).type
            if not rows or not b.num_rows:
                continue
            keys = b.column(0).to_pylist()
            scores = np.round(q @ unit(np.array(b.column(1).to_pylist(), dtype=np.float64)).T, 6)
            m = min(k + 1, len(keys))
            least = -np.partition(-scores, m - 1, axis=1)[:, m - 1]
            for i, row in enumerate(rows):
                for j in np.flatnonzero(scores[i] >= max(least[i], at_least)):
                    if keys[j] != row[0]:
                        kept[i].append((-scores[i, j], keys[j]))
                kept[i] = sorted(kept[i])[:k]
        out = [(row[0], key_, -s) for row, best in zip(rows, kept) for s, key_ in best]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], schema), pa.array([o[1] for o in out], schema), pa.array([float(o[2]) + 0.0 for o in out])], ["query_key", key, "score"])

    return run
