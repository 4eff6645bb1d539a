"""The metrics: each takes the model's tables by name and returns a DataFrame.

Ties are always broken by the remaining columns, so that results are the same on every run.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import module_of
from .filters import NONE, Filters

Views = Mapping[str, DataFrame]
WEEK_DAYS, SECONDS = 7, 86400
#: Deletions that a half-life fit needs at least.
FIT_DEATHS = 100


def _commits(views: Views, filters: Filters) -> DataFrame:
    return filters.commits(views["commits"], views.get("authors"))


def _plain(views: Views, filters: Filters) -> DataFrame:
    return _commits(views, filters).filter("not is_merge").select("sha", "author_id", "authored_at", "bucket_key")


def classify(views: Views, filters: Filters = NONE, rates: bool = False) -> DataFrame:
    """Per bucket: commits, fixes, feats, reverts, breaking and untyped; with `rates` their shares too."""
    counts = {
        "fixes": F.col("msg_type") == "fix",
        "feats": F.col("msg_type") == "feat",
        "reverts": F.col("is_revert"),
        "breaking": F.col("is_breaking"),
        "untyped": F.col("msg_type").isNull(),
    }
    rows = _commits(views, filters).filter("not is_merge").groupBy(F.col("bucket_key").alias("bucket"))
    rows = rows.agg(F.count("*").alias("commits"), *[F.count_if(c).alias(name) for name, c in counts.items()])
    if rates:
        rows = rows.withColumns({f"{name}_rate": F.col(name) / F.col("commits") for name in counts})
    return rows.orderBy("bucket")


def age(views: Views, as_of: int, filters: Filters = NONE) -> DataFrame:
    """Files by days since they first changed, in steps of a week (rounded half to even, not cut)."""
    churn = views["file_churn"].filter(filters.paths()).select("sha", "path")
    first = churn.join(views["commits"].select("sha", "authored_at"), "sha").groupBy("path").agg(F.min("authored_at").alias("first"))
    weeks = F.rint((F.lit(as_of) - F.col("first")) / SECONDS / WEEK_DAYS).cast("long")
    return first.groupBy((weeks * WEEK_DAYS).alias("age_days_bucket")).agg(F.count("*").alias("files")).orderBy("age_days_bucket")


def _churned(views: Views, filters: Filters) -> DataFrame:
    return views["file_churn"].filter(filters.paths()).join(_plain(views, filters), "sha")


def churn(views: Views, by: str = "module", depth: int = 1, filters: Filters = NONE) -> DataFrame:
    """Lines added and deleted per bucket and module, language (unknown where no snapshot is) or author name."""
    rows = _churned(views, filters)
    if by == "module":
        name, rows = "module", rows.withColumn("_by", module_of(F.col("path"), depth))
    elif by in ("lang", "language"):
        name, stats = "language", views["file_stats"].select("sha", "path", "language")
        rows = rows.join(stats, ["sha", "path"], "left").filter(filters.language()).withColumn("_by", F.coalesce("language", F.lit("unknown")))
    elif by == "author":
        name = "author"
        rows = rows.join(views["authors"].select(F.col("id").alias("author_id"), F.col("canonical_name").alias("_by")), "author_id")
    else:
        raise ValueError(f"churn has no axis {by!r}")
    sums = rows.groupBy(F.col("bucket_key").alias("bucket"), F.col("_by").alias(name)).agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    return sums.orderBy("bucket", F.desc("added"), name)


def burndown(views: Views, by: str = "language", filters: Filters = NONE) -> DataFrame:
    """Lines of code per bucket and language at its sampled commits, or running net lines per author."""
    if by == "language":
        sampled = _commits(views, filters).filter("is_sampled").select("sha", "bucket_key")
        stats = views["file_stats"].filter(filters.paths() & filters.language()).select("sha", "language", "code")
        rows = stats.join(sampled, "sha").groupBy(F.col("bucket_key").alias("bucket"), "language")
        return rows.agg(F.sum("code").alias("loc")).orderBy("bucket", F.desc("loc"), "language")
    if by == "author":
        authors = views["authors"].select(F.col("id").alias("author_id"), F.col("canonical_name").alias("author"))
        net = _churned(views, filters).join(authors, "author_id").groupBy(F.col("bucket_key").alias("bucket"), "author")
        net = net.agg((F.sum("added") - F.sum("deleted")).alias("net"))
        running = Window.partitionBy("author").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        return net.select("bucket", "author", F.sum("net").over(running).alias("loc")).orderBy("bucket", F.desc("loc"), "author")
    raise ValueError(f"burndown has no axis {by!r}")


def _hot(views: Views, filters: Filters) -> DataFrame:
    """Churn of the functions in each path's latest snapshot; a hunk counts where its new side begins."""
    commits = _commits(views, filters).select("sha", "bucket_key", "authored_at")
    stats = views["file_stats"].filter(filters.language()).join(commits.join(views["commits"].filter("is_sampled").select("sha"), "sha", "left_semi"), "sha")
    latest = Window.partitionBy("path").orderBy(F.desc("bucket_key"), F.desc("authored_at"), F.desc("sha"))
    stats = stats.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").select("sha", "path", "language")
    defined = views["funcs"].join(stats, ["sha", "path"]).select("path", "language", F.col("name").alias("func"), "kind", "start_line", "end_line")
    touched = views["hunks"].filter(filters.paths()).join(_plain(views, filters).select("sha"), "sha", "left_semi").select("path", "old_len", "new_len", "new_start")
    rows = touched.join(defined, "path").filter(F.col("new_start").between(F.col("start_line"), F.col("end_line")))
    rows = rows.join(commits.groupBy().agg(F.max("bucket_key").alias("bucket")))
    rows = rows.groupBy("bucket", "path", "func", "kind", "language")
    return rows.agg(F.sum("new_len").alias("added"), F.sum("old_len").alias("deleted"), F.sum(F.col("new_len") + F.col("old_len")).alias("churn"))


def hotspot(views: Views, language: str, top: int = 30, filters: Filters = NONE) -> DataFrame:
    """The `top` functions of a language (or comma list of them) by churn."""
    if not language:
        raise ValueError("hotspot needs a language")
    rows = _hot(views, Filters(filters.since, filters.until, filters.author, filters.path, language))
    return rows.orderBy(F.desc("churn"), "path", "func", "kind").limit(top)


def hotspot_sweep(views: Views, top: int = 30, filters: Filters = NONE) -> DataFrame:
    """The `top` functions of every language, in one pass."""
    order = Window.partitionBy("language").orderBy(F.desc("churn"), "path", "func", "kind")
    return _hot(views, filters).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def coupling(views: Views, top: int = 50, max_files: int = 50, filters: Filters = NONE) -> DataFrame:
    """Pairs of paths by the commits that change both; commits of more than `max_files` files don't count.

    The cap is on the commit's files before any path filter. It bounds the pairs of a commit, and the
    count and the pairing use one partitioning by sha.
    """
    files = views["file_churn"].select("sha", "path").join(_plain(views, filters).select("sha"), "sha", "left_semi")
    size = F.count("*").over(Window.partitionBy("sha"))
    small = files.withColumn("_n", size).filter(F.col("_n").between(2, max_files)).filter(filters.paths())
    listed = small.groupBy("sha").agg(F.sort_array(F.collect_list("path")).alias("p"))
    pairs = F.expr("flatten(transform(p, (a, i) -> transform(slice(p, i + 2, size(p)), b -> struct(a as path_a, b as path_b))))")
    rows = listed.select(F.explode(pairs).alias("pair")).select("pair.path_a", "pair.path_b").filter("path_a < path_b")
    return rows.groupBy("path_a", "path_b").agg(F.count("*").alias("co_commits")).orderBy(F.desc("co_commits"), "path_a", "path_b").limit(top)


def cohort(views: Views, filters: Filters = NONE, ages: bool = False) -> DataFrame:
    """Surviving lines by birth bucket, for every sampled bucket from birth on: a constant series.

    Births are counted before they meet the buckets, so that the theta join is of buckets with buckets.
    With `ages` each row also tells how many sampled buckets the cohort has lived.
    """
    births = views["line_births"].filter(filters.paths())
    if filters.since or filters.until:
        births = births.join(Filters(filters.since, filters.until).commits(views["commits"]).select(F.col("sha").alias("birth_sha")), "birth_sha", "left_semi")
    alive = births.groupBy(F.col("birth_bucket").alias("cohort")).agg(F.count("*").alias("alive_lines"))
    buckets = views["commits"].filter("is_sampled").select(F.col("bucket_key").alias("bucket")).distinct()
    joined = buckets.join(alive, F.col("cohort") <= F.col("bucket"))
    if ages:
        joined = joined.withColumn("age", F.dense_rank().over(Window.partitionBy("cohort").orderBy("bucket")) - 1)
    return joined.select("bucket", "cohort", "alive_lines", *(["age"] if ages else [])).orderBy("bucket", "cohort")


def survival(views: Views, filters: Filters = NONE) -> DataFrame:
    """Per birth bucket: lines born, alive, dead and the share alive. Filters on commits hit births alone."""
    born = views["hunks"].filter(filters.paths() & (F.col("new_len") > 0)).join(_plain(views, filters), "sha")
    born = born.groupBy(F.col("bucket_key").alias("birth_bucket")).agg(F.sum("new_len").alias("born"))
    alive = views["line_births"].filter(filters.paths()).groupBy("birth_bucket").agg(F.count("*").alias("_alive"))
    rows = born.join(alive, "birth_bucket", "left").withColumn("alive", F.coalesce("_alive", F.lit(0)))
    share = F.try_divide(F.col("alive").cast("double"), F.col("born").cast("double"))
    return rows.select("birth_bucket", "born", "alive", (F.col("born") - F.col("alive")).alias("dead"), share.alias("survival")).orderBy("birth_bucket")


def survival_fit(views: Views, filters: Filters = NONE, in_days: bool = False) -> DataFrame:
    """One row (metric, value, reason): the half-life of an exponential fit of survival on age.

    Age is in units of the bucket key, as the difference of keys; `in_days` takes months' keys apart.
    """
    rows = survival(views, filters)
    latest = rows.agg(F.max("birth_bucket").alias("_last"))
    rows = rows.join(F.broadcast(latest))
    days = lambda c: F.datediff(F.make_date(F.floor(F.col(c) / 100).cast("int"), (F.col(c) % 100).cast("int"), F.lit(1)), F.lit("1970-01-01").cast("date"))
    lived = (days("_last") - days("birth_bucket")) if in_days else F.col("_last") - F.col("birth_bucket")
    used = (F.col("survival") > 0) & (F.col("survival") < 1)
    x, y = F.when(used, lived.cast("double")), F.when(used, F.ln("survival"))
    fit = rows.agg(
        F.coalesce(F.sum("dead"), F.lit(0)).alias("deaths"), F.count(x).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.coalesce(F.max(x) - F.min(x), F.lit(0.0)).alias("spread"),
    )
    few = (F.col("deaths") < FIT_DEATHS) | (F.col("n") < 2)
    bad = few | (F.col("spread") == 0) | (F.col("slope") >= 0)
    reason = (
        F.when(few, F.concat(F.lit("insufficient data: "), F.col("deaths").cast("string"), F.lit(f" deletion events (need >= {FIT_DEATHS})")))
        .when(F.col("spread") == 0, "degenerate fit (all ages equal)")
        .when(F.col("slope") >= 0, "positive slope (survival not decaying)")
        .otherwise(F.concat(F.lit("ok (n="), F.col("n").cast("string"), F.lit(", deaths="), F.col("deaths").cast("string"), F.lit(")")))
    )
    value = F.when(bad, F.lit("")).otherwise(F.format_string("%.3f", F.lit(0.6931471805599453) / -F.col("slope")))
    return fit.select(F.lit("half_life").alias("metric"), value.alias("value"), reason.alias("reason"))
