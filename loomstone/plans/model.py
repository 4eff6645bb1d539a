"""The twelve tables of a repository's history."""

from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType


def _table(**columns: str) -> StructType:
    kinds = {"s": StringType, "l": LongType, "i": IntegerType, "b": BooleanType}
    return StructType([StructField(name, kinds[k.rstrip("?")](), True) for name, k in columns.items()])


SCHEMA_VERSION = "1"
TABLES = {
    "meta": _table(key="s", value="s"),
    "authors": _table(id="l", canonical_name="s", canonical_email="s"),
    "author_aliases": _table(author_id="l", raw_name="s", raw_email="s"),
    "commits": _table(
        sha="s", author_id="l", committer_id="l", authored_at="l", is_merge="b", is_sampled="b", bucket_key="l",
        msg_type="s?", is_breaking="b", is_revert="b", ignored_blame="b",
    ),
    "commit_parents": _table(sha="s", parent_sha="s", parent_idx="i"),
    "commit_trailers": _table(sha="s", author_id="l", role="s"),
    "tags": _table(name="s", sha="s", tagged_at="l"),
    "hunks": _table(sha="s", path="s", prev_path="s?", old_start="i", old_len="i", new_start="i", new_len="i"),
    "file_churn": _table(sha="s", path="s", added="i", deleted="i"),
    "file_stats": _table(sha="s", path="s", language="s", code="i", comments="i", blanks="i"),
    "funcs": _table(sha="s", path="s", name="s", kind="s", start_line="i", end_line="i"),
    "line_births": _table(path="s", line_no="i", birth_sha="s", birth_bucket="l"),
}
