"""Cutting long texts into pieces at natural boundaries, by recursive bisection."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .leaves import string_leaves

#: Strength of the boundaries, the strongest first; a cut lies behind the match.
BOUNDARIES = [re.compile(p) for p in (r"(?:\r?\n[ \t]*){2,}", r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]", r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+[」』）]*", r"[;:]\s+|[；：、，]", r",\s+", r"\s+")]
#: Characters that no cut may separate from the one before: marks, joiners, variation selectors, skin tones.
_GLUED = re.compile(r"[\u0300-\u036f\u0483-\u0489\u064b-\u065f\u0900-\u0903\u093a-\u094f\u1ab0-\u1aff\u1dc0-\u1dff\u200c\u200d\u20d0-\u20ff\u3099\u309a\ufe00-\ufe0f\ufe20-\ufe2f\U0001f3fb-\U0001f3ff]")


def bisect_cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Inner cut positions, ascending, such that no part is longer than limit - overlap (the first: limit).

    Each part too long is cut at the strongest boundary in the middle half of it, of equal ones the one nearest to its
    midpoint; without any boundary there, over the whole part; without any at all, at the midpoint, moved off glued characters.
    """
    found: list[list[int]] = [[m.end() for m in p.finditer(text)] for p in BOUNDARIES]
    cuts: list[int] = []
    stack = [(0, len(text))]
    while stack:
        a, b = stack.pop()
        if b - a <= (limit if a == 0 else limit - overlap):
            continue
        c = _best(text, found, a, b)
        cuts.append(c)
        stack += [(c, b), (a, c)]
    return sorted(cuts)


def _best(text: str, found: list[list[int]], a: int, b: int) -> int:
    from bisect import bisect_left

    mid = (a + b) // 2
    for reach in ((b - a) // 4, (b - a) // 2):
        for ends in found:
            i = bisect_left(ends, mid)
            near = [e for e in ends[max(0, i - 1) : i + 1] if a < e < b and abs(e - mid) <= reach]
            if near:
                return min(near, key=lambda e: (abs(e - mid), e))
    for d in range((b - a) // 2):
        for c in (mid - d, mid + d):
            if a < c < b and not _GLUED.match(text[c]) and text[c - 1] != "\u200d" and text[c - 1 : c + 1] != "\r\n":
                return c
    return mid


def overlap_start(text: str, cut: int, low: int) -> int:
    """Where a piece that starts at cut begins to repeat the one before: at the first boundary of a word at or behind low."""
    m = re.compile(r"\s+").search(text, low, cut)
    if m and m.end() < cut:
        return m.end()
    while low < cut and (_GLUED.match(text[low]) or (low and text[low - 1] == "\u200d")):
        low += 1
    return low


def pieces(text: str, limit: int = 2000, overlap: int = 200) -> Iterator[tuple[int, int, int]]:
    """(start, new_from, end) of each piece: text[start:end] has at most limit characters; text[start:new_from] repeats the
    end of the piece before; the parts text[new_from:end] joined give the text. A text within the limit is one piece; an
    empty one has none."""
    if limit <= overlap or overlap < 0:
        raise ValueError("the limit must exceed the overlap, which can't be negative")
    if not text:
        return
    ends = [*(bisect_cuts(text, limit, overlap) if len(text) > limit else []), len(text)]
    a, before = 0, 0
    for b in ends:
        yield (overlap_start(text, a, max(before, a - overlap, b - limit)) if a and overlap else a), a, b
        before, a = a, b


def split_resumes(resumes: DataFrame, postings: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """(item_kind, item_key, path, piece, start_pos, new_from, piece_text) of each string value longer than limit.

    item_kind is 'resume' (values of parsed_data_json, by resume_id) or 'job_posting' (description, by job_id). Null, empty
    and short values and JSON that can't be parsed have no pieces; equal values under two keys have theirs each. Whole texts
    are cut, of any length.
    """
    schema = "item_kind string, item_key string, path string, piece int, start_pos int, new_from int, piece_text string"

    def run(kind: str, is_json: bool):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for path, value in string_leaves(text) if is_json else [("description", text or "")]:
                        if len(value) > limit:
                            rows += [(kind, key, path, i, s, n, value[s:e]) for i, (s, n, e) in enumerate(pieces(value, limit, overlap))]
                cols = list(zip(*rows)) if rows else [[]] * 7
                types = [pa.string()] * 3 + [pa.int32()] * 3 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [f.split()[0] for f in schema.split(", ")])

        return of

    # a text shorter than the limit can't hold a longer value: it never leaves the JVM (JSON escapes only lengthen)
    long = lambda df, key, text: df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).filter(F.length("t") > limit)
    a = long(resumes, "resume_id", "parsed_data_json").mapInArrow(run("resume", True), schema)
    b = long(postings, "job_id", "description").mapInArrow(run("job_posting", False), schema)
    return a.unionByName(b)
