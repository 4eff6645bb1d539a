"""Which lines survive: rename resolution and the replay of hunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: Lines of a file told at a time.
LINES = 200_000


def _ends(edges: DataFrame, n: int) -> DataFrame:
    """(start, at) for edges (start, next), one for each start, `n` of them: what following them leads to.

    Pointers are doubled, each round from one written table to the next, until all are at an end. In a
    cycle there is none: after `n` steps or more such a pointer is at some place of its cycle.
    """
    now, steps = edges.select("start", F.col("next").alias("at")), 1
    while True:
        now = written(now, "pointers")
        further = now.select(F.col("start").alias("at"), F.col("at").alias("then"))
        ahead = now.join(further, "at", "left")
        if steps >= n or not ahead.filter("then is not null").limit(1).count():
            return now
        now, steps = ahead.select("start", F.coalesce("then", "at").alias("at")), 2 * steps


def resolve_aliases(renames: DataFrame) -> DataFrame:
    """(prev_path, path) pairs to (prev_path, canonical): renames followed to the end, however many.

    Of several renames of a path the greatest path wins unless `ord` orders them, the later first.
    A cycle ends before the first path seen again. Blind to time, as the replay is.
    """
    order = F.struct("ord", "path") if "ord" in renames.columns else F.struct("path")
    edges = renames.filter("prev_path is not null and prev_path <> path").groupBy("prev_path").agg(F.max(order).alias("m"))
    edges = written(edges.select(F.col("prev_path").alias("start"), F.col("m.path").alias("next")), "renames")
    ends = _ends(edges, edges.count())
    starts = edges.select(F.col("start").alias("at"))
    found = ends.join(starts, "at", "left_anti").select(F.col("start").alias("prev_path"), F.col("at").alias("canonical"))
    lost = written(ends.join(starts, "at", "left_semi"), "cycles")
    if not lost.limit(1).count():
        return found
    # every place of a cycle is where some pointer came to; what leads there ends at the place before its entry
    places = lost.select(F.col("at").alias("start")).distinct()
    before = edges.join(places, "start", "left_semi").select(F.col("next").alias("entry"), F.col("start").alias("canonical"))
    tails = edges.join(lost.select("start"), "start", "left_semi").join(places, "start", "left_anti")
    entries = _ends(tails, tails.count()).select("start", F.col("at").alias("entry")).unionAll(places.select("start", F.col("start").alias("entry")))
    return found.unionAll(entries.join(before, "entry").select(F.col("start").alias("prev_path"), "canonical"))


class Lines:
    """The lines of a file as runs of lines of one commit."""

    def __init__(self) -> None:
        self.runs: list[tuple[int, int]] = []  # (lines, mark)

    def apply(self, hunks: list[tuple[int, int, int]], mark: int) -> None:
        """One commit's hunks (old_start, old_len, new_len), left to right, each clamped to what is there."""
        out: list[tuple[int, int]] = []
        runs, k, left = self.runs, 0, self.runs[0][0] if self.runs else 0  # what is left of run k
        at = 0

        def advance(n: int, keep: bool) -> None:
            nonlocal k, left, at
            while n > 0 and k < len(runs):
                taken = min(n, left)
                if keep:
                    add(taken, runs[k][1])
                n, left, at = n - taken, left - taken, at + taken
                if not left:
                    k += 1
                    left = runs[k][0] if k < len(runs) else 0

        def add(n: int, of: int) -> None:
            if out and out[-1][1] == of:
                out[-1] = (out[-1][0] + n, of)
            elif n:
                out.append((n, of))

        for old_start, old_len, new_len in hunks:
            start = max(old_start, 1) - 1
            advance(start - at, True)
            add(new_len, mark)
            advance(start + old_len - at, False)
        if k < len(runs):
            add(left, runs[k][1])
            for n, of in runs[k + 1 :]:
                add(n, of)
        self.runs = out


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, authored_at, sha, bucket_key, old_start, old_len, new_len) in order: the lines that each path has in the end."""
    path, commit, lines, marks, hunks = None, None, Lines(), [], []
    names = ["path", "line_no", "birth_sha", "birth_bucket"]

    def told() -> Iterator[pa.RecordBatch]:
        counts, of = (np.array(c, np.int64) for c in zip(*lines.runs)) if lines.runs else (np.zeros(0, np.int64),) * 2
        shas, buckets = pa.array([s for s, _ in marks], pa.string()), pa.array([b for _, b in marks], pa.int64())
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        for start in range(0, total, LINES):
            numbers = np.arange(start, min(start + LINES, total))
            at = pa.array(of[np.searchsorted(ends, numbers, side="right")])
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(numbers), pa.string()), pa.array(numbers + 1, pa.int32()), shas.take(at), buckets.take(at)], names)

    for batch in batches:
        for where, at, sha, bucket, *hunk in zip(*(c.to_pylist() for c in batch.columns)):
            if (where, at, sha) != commit:
                if hunks:
                    lines.apply(hunks, len(marks) - 1)
                if where != path:
                    yield from told()
                    path, lines, marks = where, Lines(), []
                commit, hunks = (where, at, sha), []
                marks.append((sha, bucket))
            hunks.append(hunk)
    if hunks:
        lines.apply(hunks, len(marks) - 1)
    yield from told()


def line_births(hunks: DataFrame, commits: DataFrame, renames: bool = True) -> DataFrame:
    """(path, line_no, birth_sha, birth_bucket) of every line that survives all non-merge hunks.

    Hunks are replayed per resolved path by (authored_at, sha, old_start): paths are dealt to tasks, each
    task reads its hunks in order, and what it holds of a file is the runs of lines of one commit.
    """
    known = commits.filter("not is_merge").select("sha", "authored_at", "bucket_key")
    rows = hunks.select("sha", "path", "old_start", "old_len", "new_start", "new_len").join(known, "sha")
    if renames:
        aliases = resolve_aliases(hunks.select("prev_path", "path"))
        rows = rows.join(aliases.withColumnRenamed("prev_path", "path"), "path", "left").withColumn("path", F.coalesce("canonical", "path"))
    ordered = rows.repartition("path").sortWithinPartitions("path", "authored_at", "sha", "old_start", "new_start", "old_len", "new_len")
    ordered = ordered.select("path", "authored_at", "sha", "bucket_key", "old_start", "old_len", "new_len")
    return ordered.mapInArrow(_replay, "path string, line_no int, birth_sha string, birth_bucket long")
