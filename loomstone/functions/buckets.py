"""Bucket keys: the integer time axis of every metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZES = ("commit", "day", "week", "month", "tag")
#: Upper bounds of the number of commits for each size (fixed values).
AUTO = ((500, "commit"), (5_000, "day"), (50_000, "week"))


def parse_size(name: str | None) -> str | None:
    """The size of that name, in any case; None for any other (that is, choose by size of the history)."""
    name = (name or "").lower()
    return name if name in SIZES else None


def auto_size(commits: int) -> str:
    return next((size for below, size in AUTO if commits < below), "month")


def day_of(seconds: Column) -> Column:
    """The UTC day of unix seconds, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def seconds_of(stamp: Column) -> Column:
    """Unix seconds of a zoneless timestamp, whatever the session's time zone."""
    days = F.datediff(F.to_date(stamp), F.lit("1970-01-01").cast("date"))
    return (days.cast("long") * 86400 + F.hour(stamp) * 3600 + F.minute(stamp) * 60 + F.second(stamp)).cast("long")


def bucket_key(seconds: Column, size: str) -> Column:
    """Key of unix seconds: themselves, YYYYMMDD, ISO year and week, or YYYYMM."""
    day = day_of(seconds)
    if size == "commit":
        return seconds.cast("long")
    if size == "day":
        return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("long")
    if size == "week":
        return (F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day)).cast("long")
    if size == "month":
        return (F.year(day) * 100 + F.month(day)).cast("long")
    raise ValueError(f"no bucket key of one row for size {size!r}")


def tag_buckets(commits: DataFrame, tags: DataFrame, limit: int = 100_000) -> DataFrame:
    """`commits` with bucket_key as the 0-based number of the latest tag at or before it, -1 before the first.

    An as-of join: tags are numbered and give half-open intervals of time. Up to `limit` tags (counted
    here) these are broadcast; beyond, tags and commits are merged by a window per year, on top of
    the number of tags before that year.
    """
    if tags.count() <= limit:
        order = Window.orderBy("tagged_at")
        spans = tags.select("tagged_at").withColumn("n", F.row_number().over(order) - 1).withColumn("until", F.lead("tagged_at").over(order))
        spans = spans.filter(F.col("until").isNull() | (F.col("until") > F.col("tagged_at")))
        at = F.col("authored_at")
        inside = (at >= F.col("tagged_at")) & (F.col("until").isNull() | (at < F.col("until")))
        joined = commits.drop("bucket_key").join(F.broadcast(spans), inside, "left")
        return joined.withColumn("bucket_key", F.coalesce("n", F.lit(-1)).cast("long")).drop("n", "tagged_at", "until")
    year = lambda c: F.year(day_of(F.col(c)))
    per_year = tags.groupBy(year("tagged_at").alias("_y")).agg(F.count("*").alias("c"))
    before = per_year.withColumn("_before", F.sum("c").over(Window.orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)))
    marks = tags.select(year("tagged_at").alias("_y"), F.col("tagged_at").alias("_at"), F.lit(1).alias("_tag"), F.lit(None).cast("string").alias("sha"))
    rows = marks.unionByName(commits.select(year("authored_at").alias("_y"), F.col("authored_at").alias("_at"), F.lit(0).alias("_tag"), "sha"))
    upto = Window.partitionBy("_y").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("_n", F.sum("_tag").over(upto)).filter("_tag = 0")
    years = Window.orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)
    every = counted.select("_y").distinct().unionByName(per_year.select("_y")).distinct().join(per_year, "_y", "left")
    before = every.select("_y", F.coalesce(F.sum(F.coalesce("c", F.lit(0))).over(years), F.lit(0)).alias("_before"))
    keyed = counted.join(before, "_y").select("sha", (F.col("_n") + F.col("_before") - 1).alias("bucket_key"))
    return commits.drop("bucket_key").join(keyed, "sha")


def sample_flags(commits: DataFrame, order: str | None = None) -> DataFrame:
    """`commits` with is_sampled: no merge, and the next commit has another key (or there is none).

    With `order` the walk is that column, whose keys may come back to a former one; this needs the one
    global order, over commits alone. Without, the order is (authored_at, sha) and keys grow with
    it, so that the last commit of each key is sampled, found key by key.
    """
    if order:
        following = F.lead("bucket_key").over(Window.orderBy(order))
        last = following.isNull() | (following != F.col("bucket_key"))
        return commits.withColumn("is_sampled", ~F.col("is_merge") & last)
    latest = F.max(F.struct("authored_at", "sha")).over(Window.partitionBy("bucket_key"))
    return commits.withColumn("is_sampled", ~F.col("is_merge") & (F.struct("authored_at", "sha") == latest))
