"""The model's tables bound to a star schema of orders: an order is a commit, a line item changes a file."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.buckets import bucket_key, sample_flags, seconds_of
from ..shared import written


class Indexed(Mapping):
    """Tables by name, each written to the shared folder when it is first asked for, and read from there afterwards."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self._tables, self._written = tables, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._written:
            self._written[name] = written(self._tables[name], name)
        return self._written[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)


_INDEXES: dict[tuple, Indexed] = {}


def bound_views(spark: SparkSession, sf_dir: str, size: str = "month") -> Mapping:
    """The twelve tables of a star schema as an index: built once a session, as a repository is indexed once and asked often."""
    key = (spark.sparkContext.applicationId, spark.sparkContext.startTime, sf_dir, size)
    if key not in _INDEXES:
        _INDEXES[key] = Indexed(bind(spark, sf_dir, size))
    return _INDEXES[key]


def bind(spark: SparkSession, sf_dir: str, size: str = "month") -> dict[str, DataFrame]:
    """The twelve tables as plans over the star schema."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sha = lambda column: F.lpad(F.col(column).cast("string"), 10, "0")
    orders, items = read("orders"), read("lineitem")

    priority = F.col("o_orderpriority")
    kinds = {"1-URGENT": "fix", "2-HIGH": "feat", "3-MEDIUM": "revert", "5-LOW": "chore"}
    msg_type = F.lit(None).cast("string")
    for key, kind in kinds.items():
        msg_type = F.when(priority == key, F.lit(kind)).otherwise(msg_type)
    commits = orders.select(
        sha("o_orderkey").alias("sha"), F.col("o_custkey").alias("author_id"), F.col("o_custkey").alias("committer_id"),
        seconds_of(F.col("o_orderdate")).alias("authored_at"), (F.col("o_orderstatus") == "P").alias("is_merge"), msg_type.alias("msg_type"),
        ((priority == "2-HIGH") & (F.col("o_totalprice") > 400000)).alias("is_breaking"), (priority == "3-MEDIUM").alias("is_revert"),
        F.lit(False).alias("ignored_blame"),
    )
    commits = sample_flags(commits.withColumn("bucket_key", bucket_key(F.col("authored_at"), size)))

    parts = read("part").select("p_partkey", F.replace(F.concat_ws("/", "p_type", "p_brand", "p_name"), F.lit(" "), F.lit("_")).alias("path"))
    changes = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        sha("l_orderkey").alias("sha"), "path", "l_linenumber", "l_linestatus",
        F.col("l_quantity").cast("int").alias("new_len"), F.round(F.col("l_discount") * 100).cast("int").alias("old_len"),
    )
    file_churn = changes.groupBy("sha", "path").agg(F.sum("new_len").alias("added"), F.sum("old_len").alias("deleted"))
    sampled = commits.filter("is_sampled").select("sha")
    file_stats = file_churn.join(sampled, "sha").select(
        "sha", "path", F.substring_index("path", "/", 1).alias("language"), F.col("added").alias("code"), F.col("deleted").alias("comments"), F.lit(1).alias("blanks")
    )
    place = (F.col("l_linenumber") * 10).cast("int")
    hunks = changes.select("sha", "path", F.lit(None).cast("string").alias("prev_path"), place.alias("old_start"), "old_len", place.alias("new_start"), "new_len")
    number = F.explode(F.array(*[F.lit(k) for k in range(4)]))
    funcs = file_stats.select("sha", "path", number.alias("k")).select(
        "sha", "path", F.concat(F.lit("f"), F.col("k").cast("string")).alias("name"),
        F.element_at(F.array(F.lit("fn"), F.lit("fn"), F.lit("method"), F.lit("test")), F.col("k") + 1).alias("kind"),
        (F.col("k") * 20).alias("start_line"), (F.col("k") * 20 + 19).alias("end_line"),
    )
    alive = changes.filter("l_linestatus = 'O' and new_len > 0").select("path", "new_len", F.col("sha").alias("birth_sha"))
    births = commits.select(F.col("sha").alias("birth_sha"), F.col("bucket_key").alias("birth_bucket"))
    line_births = alive.join(births, "birth_sha").select("path", F.explode(F.sequence(F.lit(1), F.col("new_len"))).alias("line_no"), "birth_sha", "birth_bucket")

    customers = read("customer")
    authors = customers.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical_name"),
        F.concat(F.lower("c_mktsegment"), F.lit("@example.com")).alias("canonical_email"),
    )
    before = F.lag("sha").over(Window.partitionBy("author_id").orderBy("authored_at", "sha"))
    parents = commits.select("sha", before.alias("parent_sha"), F.lit(0).alias("parent_idx")).filter("parent_sha is not null")
    role = F.when(F.col("l_returnflag") == "R", "signoff").otherwise("coauthor")
    return {
        "meta": spark.range(1).select(F.lit("bucket_size").alias("key"), F.lit(size).alias("value")).union(
            commits.agg(F.lit("indexed_head_sha"), F.max_by("sha", F.struct("authored_at", "sha")))
        ),
        "authors": authors,
        "author_aliases": authors.select(F.col("id").alias("author_id"), F.col("canonical_name").alias("raw_name"), F.col("canonical_email").alias("raw_email")),
        "commits": commits,
        "commit_parents": parents,
        "commit_trailers": items.select(sha("l_orderkey").alias("sha"), F.col("l_suppkey").alias("author_id"), role.alias("role")),
        "tags": orders.filter("o_orderkey % 500 = 0").select(
            F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("name"), sha("o_orderkey").alias("sha"), seconds_of(F.col("o_orderdate")).alias("tagged_at")
        ),
        "hunks": hunks,
        "file_churn": file_churn,
        "file_stats": file_stats,
        "funcs": funcs,
        "line_births": line_births,
    }


#: The same tables for the SQL engine that checks the queries.
BOUND_SQL = """commits0 AS (SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS sha, o_custkey AS author_id, o_custkey AS committer_id,
    epoch(o_orderdate)::BIGINT AS authored_at, o_orderstatus = 'P' AS is_merge, (year(o_orderdate) * 100 + month(o_orderdate))::BIGINT AS bucket_key,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'fix' WHEN '2-HIGH' THEN 'feat' WHEN '3-MEDIUM' THEN 'revert' WHEN '5-LOW' THEN 'chore' END AS msg_type,
    o_orderpriority = '2-HIGH' AND o_totalprice > 400000 AS is_breaking, o_orderpriority = '3-MEDIUM' AS is_revert, false AS ignored_blame FROM orders),
  commits AS (SELECT *, NOT is_merge AND coalesce(lead(bucket_key) OVER (ORDER BY authored_at, sha) <> bucket_key, true) AS is_sampled FROM commits0),
  changes AS (SELECT lpad(l_orderkey::VARCHAR, 10, '0') AS sha, replace(p_type || '/' || p_brand || '/' || p_name, ' ', '_') AS path, l_linenumber, l_linestatus,
    l_quantity::INT AS new_len, round(l_discount * 100)::INT AS old_len FROM lineitem JOIN part ON l_partkey = p_partkey),
  file_churn AS (SELECT sha, path, sum(new_len)::BIGINT AS added, sum(old_len)::BIGINT AS deleted FROM changes GROUP BY sha, path),
  file_stats AS (SELECT f.sha, path, split_part(path, '/', 1) AS language, added AS code, deleted AS comments, 1 AS blanks
    FROM file_churn f JOIN commits c ON c.sha = f.sha WHERE c.is_sampled),
  hunks AS (SELECT sha, path, NULL::VARCHAR AS prev_path, l_linenumber * 10 AS old_start, old_len, l_linenumber * 10 AS new_start, new_len FROM changes),
  funcs AS (SELECT sha, path, 'f' || k AS name, CASE k WHEN 2 THEN 'method' WHEN 3 THEN 'test' ELSE 'fn' END AS kind, k * 20 AS start_line, k * 20 + 19 AS end_line
    FROM file_stats, (SELECT unnest([0, 1, 2, 3])::INT AS k)),
  line_births AS (SELECT path, unnest(range(1, new_len + 1))::INT AS line_no, h.sha AS birth_sha, c.bucket_key AS birth_bucket
    FROM changes h JOIN commits c ON c.sha = h.sha WHERE l_linestatus = 'O'),
  authors AS (SELECT c_custkey AS id, c_name AS canonical_name, lower(c_mktsegment) || '@example.com' AS canonical_email FROM customer),
  commit_parents AS (SELECT sha, parent_sha, 0 AS parent_idx FROM (SELECT sha, lag(sha) OVER (PARTITION BY author_id ORDER BY authored_at, sha) AS parent_sha FROM commits)
    WHERE parent_sha IS NOT NULL),
  commit_trailers AS (SELECT lpad(l_orderkey::VARCHAR, 10, '0') AS sha, l_suppkey AS author_id, CASE WHEN l_returnflag = 'R' THEN 'signoff' ELSE 'coauthor' END AS role FROM lineitem),
  tags AS (SELECT 'v' || o_orderkey AS name, lpad(o_orderkey::VARCHAR, 10, '0') AS sha, epoch(o_orderdate)::BIGINT AS tagged_at FROM orders WHERE o_orderkey % 500 = 0)"""
