"""Rendering small results as text, and exporting tables."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("table", "tsv", "csv", "json")


def default_format(flag: str | None = None, terminal: bool | None = None) -> str:
    """The flag, else a table on a terminal and TSV on a pipe."""
    if flag is not None:
        if flag not in FORMATS:
            raise ValueError(f"unknown format {flag!r}")
        return flag
    return "table" if (sys.stdout.isatty() if terminal is None else terminal) else "tsv"


def cell(value: object) -> str:
    """A value as text: nothing for null, a length for bytes, lower-case booleans."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (bytes, bytearray)):
        return f"<{len(value)} bytes>"
    return str(value)


def _quoted(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n') else text


def render(headers: list[str], rows: Iterable[Iterable[object]], how: str) -> Iterator[str]:
    """Lines of text. TSV is joined by tabs as it is; JSON is one array of objects whose values are all text."""
    told = ([cell(v) for v in row] for row in rows)
    if how == "tsv":
        yield "\t".join(headers)
        for row in told:
            yield "\t".join(row)
    elif how == "csv":
        yield ",".join(map(_quoted, headers))
        for row in told:
            yield ",".join(map(_quoted, row))
    elif how == "json":
        yield "[" + ",".join(json.dumps(dict(zip(headers, row)), ensure_ascii=False) for row in told) + "]"
    elif how == "table":
        kept = list(told)
        widths = [max(len(x.encode()) for x in column) for column in zip(headers, *kept)] if headers else []
        pad = lambda row: " | ".join(x + " " * (w - len(x.encode())) for x, w in zip(row, widths)).rstrip()
        yield pad(headers)
        yield "-+-".join("-" * w for w in widths)
        for row in kept:
            yield pad(row)
    else:
        raise ValueError(f"unknown format {how!r}")


def show(frame: DataFrame, how: str) -> Iterator[str]:
    """A result as text; rows come partition by partition, and only a table keeps them to find its widths."""
    return render(frame.columns, (tuple(r) for r in frame.toLocalIterator()), how)


def export(views: dict[str, DataFrame], folder: str, how: str = "parquet", single: bool = False) -> list[str]:
    """Every table to `folder`/name: Parquet, CSV with a header, or JSON by line, written in parallel.

    With `single` each table is one part, and JSON one array: for tables that one task can hold.
    """
    paths = []
    for name, frame in views.items():
        path = f"{folder.rstrip('/')}/{name}"
        rows = frame.coalesce(1) if single else frame
        if how == "parquet":
            rows.write.mode("overwrite").parquet(path)
        elif how == "csv":
            rows.write.mode("overwrite").option("header", True).csv(path)
        elif how == "json" and not single:
            rows.write.mode("overwrite").json(path, ignoreNullFields=False)
        elif how == "json":
            told = F.to_json(F.struct(*[F.col(c) for c in frame.columns]), {"ignoreNullFields": "false"})
            array = frame.select(told.alias("value")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
            array.coalesce(1).write.mode("overwrite").text(path)
        else:
            raise ValueError(f"unknown format {how!r}")
        paths.append(path)
    return paths
