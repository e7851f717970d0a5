"""String values of JSON columns, with their paths."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LONE = re.compile("[\ud800-\udfff]")


def string_leaves(text: str | None) -> Iterator[tuple[str, str]]:
    """(path, value) of each string value. Null and text that isn't JSON as a whole hold none, as an empty object.

    A path is written with dots and 0-based indexes. Half surrogates, which no UTF-8 text can hold, become U+FFFD: positions stay.
    """
    if not text:
        return
    try:
        top = json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return
    if not isinstance(top, (dict, list)):
        return
    stack: list[tuple[str, object]] = [("", top)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, str):
            yield path, (_LONE.sub("\ufffd", value) if not value.isascii() and _LONE.search(value) else value)
        elif isinstance(value, dict):
            dot = path + "." if path else ""
            stack.extend([(dot + k, v) for k, v in value.items() if v.__class__ in _DEEP][::-1])
        elif isinstance(value, list):
            stack.extend([(f"{path}[{i}]", v) for i, v in enumerate(value) if v.__class__ in _DEEP][::-1])


_DEEP = {str, dict, list}


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def arrow_schema(df: DataFrame, columns: list[str]) -> pa.Schema:
    """The Arrow schema of df's columns, as mapInArrow gives them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.select(*columns).schema)


def leaves(df: DataFrame, key: str, columns: list[str], longer_than: int = 0) -> DataFrame:
    """(key, json_column, path, value): one row for each string value longer than longer_than characters."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, names, paths, values, at = [], [], [], [], []
            for c in columns:
                for i, text in enumerate(b.column(c).to_pylist()):
                    if text is None or len(text) <= longer_than:
                        continue
                    for path, value in string_leaves(text):
                        if len(value) > longer_than:
                            at.append(i)
                            names.append(c)
                            paths.append(path)
                            values.append(value)
            keys = b.column(key).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(names, pa.string()), pa.array(paths, pa.string()), pa.array(values, pa.string())], ["key", "json_column", "path", "value"])

    return df.select(F.col(key), *columns).mapInArrow(run, f"key {kind}, json_column string, path string, value string")
