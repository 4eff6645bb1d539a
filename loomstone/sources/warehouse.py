"""The tables of an index as Parquet, with a version."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession

from ..plans.model import SCHEMA_VERSION, TABLES


def warehouse_path(repo: str, base: str | None = None) -> str:
    """A folder for a repository's tables: its name and a hash of its path."""
    base = base or os.path.join(os.environ.get("XDG_DATA_HOME", os.path.expanduser("~/.local/share")), "loomstone")
    return os.path.join(base, f"{os.path.basename(repo)}-{hashlib.sha256(repo.encode()).hexdigest()[:12]}")


def save(views: dict[str, DataFrame], path: str) -> None:
    """Write every table (all twelve are replaced)."""
    for name, schema in TABLES.items():
        frame = views[name].select(*[views[name][f.name].cast(f.dataType).alias(f.name) for f in schema])
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def update(views: dict[str, DataFrame], added: dict[str, DataFrame], path: str) -> None:
    """Bring the tables at `path` up to date: rows `added` join those of their table, all other tables are replaced.

    Everything is written beside the tables first, and then moved: what is asked meanwhile is the old index.
    """
    spark = next(iter(views.values())).sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = f"{path}/_update"
    files.delete(place(beside), True)
    save({name: added.get(name, frame) for name, frame in views.items()}, beside)
    for name in TABLES:
        target = place(f"{path}/{name}")
        if name in added:
            for status in files.globStatus(place(f"{beside}/{name}/part-*")):
                files.rename(status.getPath(), place(target, status.getPath().getName()))
        else:
            files.delete(target, True)
            files.rename(place(f"{beside}/{name}"), target)
    files.delete(place(beside), True)


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables at `path`; those of another version are refused, never deleted."""
    views = {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in TABLES.items()}
    version = views["meta"].filter("key = 'schema_version'").first()
    if version is None or version["value"] != SCHEMA_VERSION:
        raise ValueError(f"the tables at {path} are not of version {SCHEMA_VERSION}: reindex")
    return views


def register(views: dict[str, DataFrame]) -> None:
    """Make the tables known to SQL by their names."""
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
