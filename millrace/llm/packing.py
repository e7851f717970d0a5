"""Filling containers of fixed capacity, by shortest-pack-first packing of the length histogram."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a container, number of such containers), from the number of items of each length in 1..capacity.

    Lengths are placed longest first. Of the open patterns that have room for the length, the shortest (most room) is
    taken; as many of its containers as needed become a longer pattern, the others stay. New containers are opened only
    if no pattern has room. The work depends on the capacity, never on the number of items.
    """
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        left = counts.get(length, 0)
        while left > 0:
            room = next((r for r in range(capacity, length - 1, -1) if rooms.get(r)), None) if rooms else None
            if room is None:
                times = capacity // length  # equal items fill a fresh container together
                whole, rest = divmod(left, times)
                if whole:
                    rooms.setdefault(capacity - times * length, []).append(((length,) * times, whole))
                if rest:
                    rooms.setdefault(capacity - rest * length, []).append(((length,) * rest, 1))
                break
            pattern, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            used = min(n, left)
            if n > used:
                rooms.setdefault(room, []).append((pattern, n - used))
            rooms.setdefault(room - length, []).append(((*pattern, length), used))
            left -= used
    return [p for r in sorted(rooms) for p in rooms[r]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length, first rank) -> (first container, items of that length a container): how ranks of a length fall to patterns."""
    rows, start = [], 0
    next_rank: dict[int, int] = {}
    for pattern, n in patterns:
        for length in sorted(set(pattern)):
            each = pattern.count(length)
            rows.append((length, next_rank.get(length, 0), start, each))
            next_rank[length] = next_rank.get(length, 0) + n * each
        start += n
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else (np.empty(0, np.int64),) * 4


def pack(sizes: DataFrame, key: str, size: str, capacity: int = 1024, bucket_rows: int = 1_000_000) -> DataFrame:
    """(key, piece, n_tokens, container BIGINT): every item, or piece of an item, in a container of the capacity.

    An item larger than the capacity, and no other, is cut into full pieces and a rest. A full piece has a container to itself,
    numbered by partition and place behind the others, without a shuffle. Items of size 0 or null need no room: they go to containers by
    their key's hash (container 0 if there is no other). Keys should be unique; a repeated key is an item of its own each time. An
    empty table gives an empty one. sizes is read several times: hand over a written table.

    The rests are ranked within their length, and a length that more than bucket_rows items share within buckets of the key's
    hash, so that no task ranks more; ranks are shifted by the counts of the buckets before. To the driver come a count a
    length (fewer than the capacity) and a count a bucket of the frequent lengths (one in bucket_rows items at most).
    """
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    item = sizes.select(F.col(key), n.alias("_size"))
    rest = item.filter(F.col("_size") % capacity > 0).select(key, F.floor(F.col("_size") / capacity).cast("int").alias("piece"), (F.col("_size") % capacity).cast("int").alias("n_tokens"))
    histogram = {r[0]: r[1] for r in rest.groupBy("n_tokens").count().collect()}
    parts = np.ones(capacity, dtype=np.int64)
    for length, count in histogram.items():
        parts[length] = -(-count // bucket_rows)
    most = int(parts.max())
    by_length = F.element_at(F.lit(parts.tolist()), F.col("n_tokens") + 1)
    rest = rest.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece"), by_length).cast("int") if most > 1 else F.lit(0))
    offset = np.zeros((capacity, most), dtype=np.int64)
    if most > 1:
        frequent = [length for length in histogram if parts[length] > 1]
        counts = np.zeros((capacity, most), dtype=np.int64)
        for length, bucket, count in rest.filter(F.col("n_tokens").isin(frequent)).groupBy("n_tokens", "_bucket").count().collect():
            counts[length, bucket] = count
        offset = np.cumsum(counts, axis=1) - counts
    patterns = pack_histogram(histogram, capacity)
    total = sum(n for _, n in patterns)
    length, first, start, each = slots(patterns)
    code = length * (1 << 44) + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, bucket, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_tokens", "_bucket", "_rank"))
            rank = rank + offset[n, bucket]
            at = np.searchsorted(code, n * (1 << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(start[at] + (rank - first[at]) // each[at])], [key, "piece", "n_tokens", "container"])

    order = Window.partitionBy("n_tokens", "_bucket").orderBy(key, "piece")
    ranked = rest.withColumn("_rank", (F.row_number().over(order) - 1).cast("long")).select(key, "piece", "n_tokens", "_bucket", "_rank")
    kind = sizes.schema[key].dataType.simpleString()
    packed = ranked.mapInArrow(run, f"`{key}` {kind}, piece int, n_tokens int, container bigint")
    full = item.filter(F.col("_size") >= capacity).select(key, F.explode(F.sequence(F.lit(0), F.floor(F.col("_size") / capacity).cast("int") - 1)).alias("piece"))
    full = full.select(key, "piece", F.lit(capacity).alias("n_tokens"), (F.monotonically_increasing_id() + total).alias("container"))
    empty = item.filter("_size = 0").select(key, F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"), F.pmod(F.xxhash64(key), F.lit(max(1, total))).alias("container"))
    return packed.unionByName(full).unionByName(empty)


def pack_documents(documents: DataFrame, capacity: int = 1024, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, n_tokens, container) of documents, measured in tokens of a public vocabulary.

    The lengths are written once to the shared folder: both the histogram and the ranks read them.
    """
    from .bpe import lengths

    return pack(written(lengths(documents, vocabulary=vocabulary), "token-lengths"), "doc_id", "n_tokens", capacity)
