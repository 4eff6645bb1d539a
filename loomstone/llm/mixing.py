"""Mixing sources to target weights with hash-threshold histograms.

Every row has a 60-bit hash. For each source the words are summed by hash bucket, the bucket in
which the budget runs out is found, and only that bucket is split further (12 + 12 + 36 bits), so no
row is ever sorted: a row is taken iff its hash is at most its source's threshold. Thresholds are
nested: a smaller budget takes a subset of what a larger one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach_small, materialize, rows_apart, table

#: Bits of the hash and of its first two histogram levels; the third level has the remaining bits.
HASH_BITS, LEVEL_BITS = 60, 12
_TOP, _MID = HASH_BITS - LEVEL_BITS, HASH_BITS - 2 * LEVEL_BITS


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of md5 over doc_id and text: the same in any engine, on any run."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """Rows (source, _k, source_size) to (…, target): shares by weight, capped, excess reshared.

    Resharing until no target is above its cap is water filling: the sources are capped in
    ascending order of cap / weight, and one level serves all the others. Sources are the rows
    here, never documents: one task puts them in order, which it can do for some millions.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int")).cast("long")
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("_left", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_level", F.col("_left") / F.col("_weights"))
        # the first row whose cap is not below the level ends the capping
        .withColumn("_final", F.min(F.when(F.col("cap") / F.col("weight") >= F.col("_level"), F.struct(F.col("_weights") * -1, F.col("_level")))).over(every))
    )
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("_final")["_level"]), F.col("cap").cast("double"))
    return rows.withColumn("target", target).select("source", "_k", "source_size", "weight", "target")


def _boundary(hist: DataFrame, bucket: str) -> DataFrame:
    """Of each source the bucket in which `_need` runs out, with what the buckets below it hold."""
    upto = Window.partitionBy("_k").orderBy(bucket)
    summed = hist.withColumn("_upto", F.sum("_sum").over(upto)).filter(F.col("_upto") > F.col("_need"))
    first = summed.groupBy("_k").agg(F.min(F.struct(bucket, (F.col("_need") - F.col("_upto") + F.col("_sum")).alias("_rest"))).alias("_b"))
    return first.select("_k", F.col(f"_b.{bucket}").alias(bucket), F.col("_b._rest").alias("_need"))


def mix_plan(narrow: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """One row per source: its size, target, whole repeats and hash threshold (null: nothing more).

    `narrow` has source, _k (non-null source key), size and _h, and is read several times.
    """
    sizes = narrow.groupBy("source", "_k").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, share, max_repeats)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))).otherwise(0).cast("long")
    plan = plan.withColumn("repeats", whole).withColumn("_need", F.col("target") - F.col("repeats") * F.col("source_size"))
    plan = materialize(plan, "mix-plan")
    needs = plan.filter("source_size > 0").select("_k", "_need")

    level = narrow.withColumn("_b1", F.shiftright("_h", _TOP))
    hist = level.groupBy("_k", "_b1").agg(F.sum("size").alias("_sum"))
    edge = materialize(_boundary(attach_small(hist, needs, ["_k"]).filter("_need is not null"), "_b1"), "mix-edge")

    inside = attach_small(level, edge.withColumnRenamed("_b1", "_at"), ["_k"]).filter("_b1 = _at")
    inside = inside.withColumn("_b2", F.shiftright("_h", _MID))
    hist = inside.groupBy("_k", "_need", "_b2").agg(F.sum("size").alias("_sum"))
    edge2 = materialize(_boundary(hist, "_b2"), "mix-edge")

    last = attach_small(narrow, edge2.withColumnRenamed("_b2", "_at"), ["_k"]).filter(F.shiftright("_h", _MID) == F.col("_at"))
    last = last.groupBy("_k", "_need", "_h").agg(F.sum("size").alias("_sum"))
    last = last.withColumn("_upto", F.sum("_sum").over(Window.partitionBy("_k").orderBy("_h")))
    over, short = F.col("_upto") - F.col("_need"), F.col("_need") - F.col("_upto") + F.col("_sum")
    last = last.filter((over <= 0) | ((short > 0) & (over < short))).groupBy("_k").agg(F.max("_h").alias("_last"))
    found = edge2.select("_k", (F.shiftleft(F.col("_b2"), _MID) - 1).alias("_below")).join(last, "_k", "left")
    found = found.select("_k", F.coalesce("_last", "_below").alias("threshold"))
    return materialize(plan.drop("_need").join(found, "_k", "left"), "mix-plan")


def _key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))


ADDED = ["size", "source_size", "target", "taken"]


def _taken(docs: DataFrame, names: list[str] | None, weights: tuple[int, ...], share: float, max_repeats: int) -> DataFrame:
    """The columns `names` of `docs` as one column `row` (without names: doc_id alone, and texts are read once), and the added ones."""
    parts = {"id": F.col("doc_id"), "source": F.col("source"), "size": size_of(F.col("text")), "_h": row_hash(F.col("doc_id"), F.col("text")), "_k": _key()}
    rows = rows_apart(docs, names or [], **parts)
    small = materialize(rows.drop("row"), "mix-rows")
    plan = mix_plan(small, weights, share, max_repeats).drop("source", "weight")
    joined = attach_small(rows.drop("id", "source") if names else small.drop("source"), plan, ["_k"])
    more = F.when(F.col("_h") <= F.col("threshold"), 1).otherwise(0)
    return joined.withColumn("taken", F.col("size") * (F.col("repeats") + more))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3, narrow: bool = False) -> DataFrame:
    """Every row of `docs` (doc_id, text, source, …) with size, source_size, target and taken.

    Null texts have size 0, and a text of any length the words it has; a null source is a source of its own,
    ordered last; rows that are equal in doc_id and text share a hash and are taken together, and so are ties
    of hash; an empty table gives an empty result. Columns of `docs` named like the added ones are
    replaced, all others stay. `narrow` keeps doc_id and the added columns only, and reads the texts once.
    """
    if narrow:
        return _taken(docs, None, weights, share, max_repeats).select(F.col("id").alias("doc_id"), *ADDED)
    names = [c for c in docs.columns if c not in ADDED]
    return _taken(docs, names, weights, share, max_repeats).select("row.*", *ADDED)


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with all its columns, whatever their names.

    Rows without words are never taken; null sources, ties and empty tables as in mix().
    """
    taken = _taken(docs, docs.columns, weights, share, max_repeats).filter("taken > 0")
    copies = F.sequence(F.lit(1).cast("long"), (F.col("taken") / F.col("size")).cast("long"))
    return taken.select("row", F.explode(copies).alias("copy")).select("row.*")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), narrow=True)


def mix_sql(relation: str = "documents", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, prefix: str = "") -> str:
    """The CTEs {prefix}d … {prefix}m of the same mix; the last has doc_id, size, source_size, target, taken."""
    p = prefix
    listed = ", ".join(map(str, weights))
    return rf"""{p}d AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM {relation}),
    {p}s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM {p}d GROUP BY source),
    {p}s1 AS (SELECT *, [{listed}][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} + 1)::INT]::BIGINT AS weight,
      source_size * {max_repeats} AS cap FROM {p}s0),
    {p}s2 AS (SELECT *, cap::DOUBLE / weight AS ratio,
      ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER w, 0)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER w, 0))::DOUBLE AS lvl
      FROM {p}s1 WINDOW w AS (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {p}s3 AS (SELECT *, row_number() OVER (ORDER BY ratio, source ASC NULLS LAST) AS n FROM {p}s2),
    {p}s4 AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, weight * (SELECT lvl FROM {p}s3 WHERE ratio >= lvl ORDER BY n LIMIT 1)), cap::DOUBLE) AS target FROM {p}s3),
    {p}s5 AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size)::BIGINT, {max_repeats}) ELSE 0 END AS reps FROM {p}s4),
    {p}h AS (SELECT source, h, sum(size)::BIGINT AS hs FROM {p}d GROUP BY source, h),
    {p}c AS (SELECT *, (sum(hs) OVER (PARTITION BY source ORDER BY h))::BIGINT AS upto FROM {p}h),
    {p}t AS (SELECT c.source, max(c.h) AS threshold FROM {p}c c JOIN {p}s5 s ON c.source IS NOT DISTINCT FROM s.source
      WHERE upto <= target - reps * source_size
        OR (upto - hs < target - reps * source_size AND upto - (target - reps * source_size) < (target - reps * source_size) - (upto - hs)) GROUP BY c.source),
    {p}m AS (SELECT d.*, s.source_size, s.target, (size * (reps + CASE WHEN d.h <= t.threshold THEN 1 ELSE 0 END))::BIGINT AS taken
      FROM {p}d d JOIN {p}s5 s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN {p}t t ON d.source IS NOT DISTINCT FROM t.source)"""


OP5_SQL = f"WITH {mix_sql()} SELECT doc_id, size, source_size, target, taken FROM m"
