"""Canned extractions over the model's tables, and the metrics that only raw SQL reached."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import day_of
from .metrics import Views


def author_tenure(views: Views, as_of: int) -> DataFrame:
    """Per author name: non-merge commits, first and last of them, and whole days between and since."""
    names = views["authors"].select(F.col("id").alias("author_id"), F.col("canonical_name").alias("author"))
    rows = views["commits"].filter("not is_merge").select("author_id", "authored_at").join(names, "author_id")
    rows = rows.groupBy("author").agg(F.count("*").alias("commits"), F.min("authored_at").alias("first_ts"), F.max("authored_at").alias("last_ts"))
    active = F.datediff(day_of(F.col("last_ts")), day_of(F.col("first_ts")))
    since = F.datediff(day_of(F.lit(as_of)), day_of(F.col("last_ts")))
    return rows.withColumns({"active_days": active.cast("long"), "days_since_last": since.cast("long")}).orderBy(F.desc("commits"), "author")


def head_paths(views: Views) -> DataFrame:
    """Paths in the latest sampled snapshot."""
    latest = views["commits"].filter("is_sampled").agg(F.max(F.struct("authored_at", "sha")).alias("m")).select(F.col("m.sha").alias("sha"))
    return views["file_stats"].join(F.broadcast(latest), "sha", "left_semi").select("path").distinct()


def ownership(views: Views, share: float = 0.8, lines: int = 50, top: int = 50) -> DataFrame:
    """Files of the latest snapshot whose lines one author bore for the most part."""
    names = views["authors"].select(F.col("id").alias("author_id"), F.col("canonical_name").alias("author"))
    who = views["commits"].select(F.col("sha").alias("birth_sha"), "author_id").join(names, "author_id").select("birth_sha", "author")
    per_commit = views["line_births"].groupBy("path", "birth_sha").agg(F.count("*").alias("n")).join(head_paths(views), "path", "left_semi")
    per_file = per_commit.join(who, "birth_sha").groupBy("path", "author").agg(F.sum("n").alias("births"))
    rows = per_file.withColumn("tot", F.sum("births").over(Window.partitionBy("path")))
    part = F.col("births").cast("double") / F.col("tot")
    rows = rows.filter((part > share) & (F.col("tot") >= lines)).orderBy(F.desc("tot"), "path").limit(top)
    return rows.select("path", "author", "births", F.round(F.col("births").cast("double") / F.col("tot"), 3).alias("share"))


def birth_death(views: Views, top: int = 30) -> DataFrame:
    """Lines born and died per bucket, most deaths first."""
    born = views["line_births"].groupBy(F.col("birth_bucket").alias("bucket")).agg(F.count("*").alias("b"))
    deleted = views["file_churn"].groupBy("sha").agg(F.sum("deleted").alias("deleted"))
    died = deleted.join(views["commits"].select("sha", "bucket_key"), "sha").groupBy(F.col("bucket_key").alias("bucket")).agg(F.sum("deleted").alias("d"))
    rows = born.join(died, "bucket", "full_outer").select("bucket", F.coalesce("b", F.lit(0)).alias("born"), F.coalesce("d", F.lit(0)).alias("died"))
    return rows.withColumn("net", F.col("born") - F.col("died")).orderBy(F.desc("died"), "bucket").limit(top)


def long_lived(views: Views, top: int = 20, anywhere: bool = False) -> DataFrame:
    """Files of the latest snapshot, or of `anywhere` in the history, by lines that survive from the first bucket."""
    first = views["line_births"].agg(F.min("birth_bucket").alias("birth_bucket"))
    rows = views["line_births"].join(F.broadcast(first), "birth_bucket", "left_semi")
    rows = rows if anywhere else rows.join(head_paths(views), "path", "left_semi")
    rows = rows.groupBy("path").agg(F.min("birth_bucket").alias("earliest"), F.count("*").alias("lines_from_that_day"))
    return rows.orderBy(F.desc("lines_from_that_day"), "path").limit(top)


def tag_gaps(views: Views) -> DataFrame:
    """Gaps between successive tags by size."""
    gap = F.col("tagged_at") - F.lag("tagged_at").over(Window.orderBy("tagged_at"))
    rows = views["tags"].filter("tagged_at is not null").select(gap.alias("gap")).filter("gap is not null")
    size = F.when(F.col("gap") < 3600, "under_1h").when(F.col("gap") < 86400, "under_1d").when(F.col("gap") < 604800, "under_1w").otherwise("over_1w")
    return rows.groupBy(size.alias("gap_bucket")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gap_bucket")


def summary(views: Views) -> DataFrame:
    """One row of counts over the tables: each is scanned once."""
    commits = views["commits"].agg(
        F.count("*").alias("commits"), F.count_if("is_merge").alias("merges"), F.countDistinct("author_id").alias("authors"),
        F.min("authored_at").alias("first_commit_unix"), F.max("authored_at").alias("last_commit_unix"),
    )
    for name, alias in (("tags", "tags"), ("authors", "canonical_authors"), ("hunks", "hunk_rows"), ("line_births", "line_births_rows")):
        commits = commits.join(views[name].agg(F.count("*").alias(alias)))
    return commits


def languages_now(views: Views) -> DataFrame:
    """Code by language at the commits of the latest sampled bucket."""
    latest = views["commits"].filter("is_sampled").agg(F.max("bucket_key").alias("bucket_key"))
    shas = views["commits"].select("sha", "bucket_key").join(F.broadcast(latest), "bucket_key", "left_semi").select("sha")
    rows = views["file_stats"].join(shas, "sha", "left_semi").groupBy("language").agg(F.sum("code").alias("code"))
    return rows.orderBy(F.desc("code"), "language")


def dead_periods(views: Views, days: int = 30) -> DataFrame:
    """Spans of `days` or more without a commit: gaps between the distinct days that have one."""
    active = views["commits"].select(F.floor(F.col("authored_at") / 86400).alias("day")).distinct()
    rows = active.withColumn("prev", F.lag("day").over(Window.orderBy("day"))).filter(F.col("day") - F.col("prev") >= days)
    return rows.select((F.col("prev") * 86400).alias("from_ts"), (F.col("day") * 86400).alias("to_ts"), (F.col("day") - F.col("prev")).alias("days")).orderBy("from_ts")


def yearly(views: Views) -> DataFrame:
    """Commits and contributors per year."""
    year = F.year(day_of(F.col("authored_at"))).cast("long")
    rows = views["commits"].groupBy(year.alias("year")).agg(F.count("*").alias("commits"), F.countDistinct("author_id").alias("contributors"))
    return rows.orderBy("year")


def module_years(views: Views) -> DataFrame:
    """Net lines per module and year."""
    years = views["commits"].select("sha", F.year(day_of(F.col("authored_at"))).cast("long").alias("year"))
    rows = views["file_churn"].withColumn("module", F.substring_index("path", "/", 1)).join(years, "sha").groupBy("year", "module")
    return rows.agg((F.sum("added") - F.sum("deleted")).alias("net")).orderBy("year", "module")


#: Upper bounds in days of the five age tiers (fixed values).
TIERS = ((90, "fresh"), (365, "young"), (1095, "mature"), (1825, "old"))


def age_tiers(views: Views, as_of: int) -> DataFrame:
    """Files by days since their last change."""
    last = views["file_churn"].select("sha", "path").join(views["commits"].select("sha", "authored_at"), "sha").groupBy("path").agg(F.max("authored_at").alias("t"))
    days = (F.lit(as_of) - F.col("t")) / 86400
    tier = F.lit("ancient")
    for below, name in reversed(TIERS):
        tier = F.when(days < below, name).otherwise(tier)
    return last.groupBy(tier.alias("tier")).agg(F.count("*").alias("files")).orderBy("tier")


def function_cohorts(views: Views) -> DataFrame:
    """Functions by the bucket in which each (path, name, start_line) first appears."""
    buckets = views["commits"].select("sha", "bucket_key")
    first = views["funcs"].join(buckets, "sha").groupBy("path", "name", "start_line").agg(F.min("bucket_key").alias("birth_bucket"))
    return first.groupBy("birth_bucket").agg(F.count("*").alias("functions")).orderBy("birth_bucket")


def test_split(views: Views) -> DataFrame:
    """Lines of functions per bucket and kind."""
    rows = views["funcs"].join(views["commits"].select("sha", "bucket_key"), "sha").groupBy(F.col("bucket_key").alias("bucket"), "kind")
    return rows.agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines")).orderBy("bucket", "kind")


def comment_density(views: Views) -> DataFrame:
    """Comment lines over comment and code lines, per bucket and language."""
    rows = views["file_stats"].join(views["commits"].select("sha", "bucket_key"), "sha").groupBy(F.col("bucket_key").alias("bucket"), "language")
    rows = rows.agg(F.sum("code").alias("code"), F.sum("comments").alias("comments"))
    return rows.withColumn("density", F.try_divide(F.col("comments").cast("double"), (F.col("code") + F.col("comments")).cast("double"))).orderBy("bucket", "language")


def co_authors(views: Views) -> DataFrame:
    """Trailers by role: how many, on how many commits, by how many people."""
    rows = views["commit_trailers"].groupBy("role")
    return rows.agg(F.count("*").alias("trailers"), F.countDistinct("sha").alias("commits"), F.countDistinct("author_id").alias("people")).orderBy("role")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that only one of two tables has."""
    return a.subtract(b).unionAll(b.subtract(a))


def unseen(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Commits to append: those whose sha is not indexed yet."""
    return incoming.join(known.select("sha"), "sha", "left_anti")
