"""A git repository as the model's tables.

The driver lists revisions; tasks read commits, diffs and blobs of their share with the git command,
so the repository has to be at the same path on every executor (a clone on a shared disk).
"""

from __future__ import annotations

import os
import re
import subprocess
import tomllib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import buckets as B
from ..functions import lines as L
from ..functions import parse as P
from ..operators import extractions as X
from ..operators import fold
from ..plans.model import SCHEMA_VERSION, TABLES
from ..shared import written
from .scan import scan

_RAW = re.compile(r"^:(\d+) (\d+) ([0-9a-f]+) ([0-9a-f]+) ([A-Z])\d*\t(.*)$")
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_LINK = "160000"
SETTINGS = ".loomstone.toml"


def git(repo: str, *args: str, stdin: bytes | None = None) -> bytes:
    run = subprocess.run(["git", "-C", repo, "-c", "core.quotePath=false", *args], input=stdin, capture_output=True)
    if run.returncode:
        raise ValueError(f"git {args[0]}: {run.stderr.decode(errors='replace').strip()}")
    return run.stdout


def open_repository(path: str) -> str:
    """The top folder of the work tree around `path`; bare and detached repositories are refused."""
    top = git(path, "rev-parse", "--show-toplevel").decode().strip() if not _bare(path) else ""
    if not top:
        raise ValueError("a bare repository has no work tree")
    try:
        git(top, "symbolic-ref", "-q", "HEAD")
    except ValueError:
        raise ValueError("HEAD is detached") from None
    return top


def _bare(path: str) -> bool:
    return git(path, "rev-parse", "--is-bare-repository").strip() == b"true"


def is_shallow(repo: str) -> bool:
    return git(repo, "rev-parse", "--is-shallow-repository").strip() == b"true"


def revisions(spark: SparkSession, repo: str, *chosen: str) -> DataFrame:
    """walk and sha of the chosen revisions, oldest first: names alone, what they hold is read by tasks."""
    table = pa.table({"sha": pa.array(git(repo, "rev-list", "--reverse", *chosen).decode().split(), pa.string())})
    return spark.createDataFrame(table.add_column(0, "walk", pa.array(range(table.num_rows), pa.int64())))


def _dealt(revisions: DataFrame, parts: int) -> DataFrame:
    return revisions.select("walk", "sha").repartitionByRange(parts, "walk")


def walk(repo: str, listed: DataFrame, parts: int = 64) -> DataFrame:
    """walk, sha, parents, raw and mapped identities, committer time and message of the `listed` revisions."""
    fields = ["%H", "%P", "%an", "%ae", "%aN", "%aE", "%cn", "%ce", "%cN", "%cE", "%ct", "%B"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            wanted = "\n".join(batch.column(1).to_pylist()).encode()
            told = git(repo, "log", "--no-walk=unsorted", "--stdin", "-z", "--format=" + "%x01".join(fields), stdin=wanted)
            rows = [r.decode("utf-8", "replace").split("\x01", len(fields) - 1) for r in told.split(b"\x00") if r]
            places = dict(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()))
            columns = list(zip(*rows))
            arrays = [pa.array([places[s] for s in columns[0]], pa.int64()), pa.array(columns[0]), pa.array([p.split() for p in columns[1]], pa.list_(pa.string()))]
            arrays += [pa.array(c) for c in columns[2:10]] + [pa.array(map(int, columns[10]), pa.int64()), pa.array(columns[11])]
            yield pa.RecordBatch.from_arrays(arrays, _WALK_NAMES)

    schema = "walk long, sha string, parents array<string>, an string, ae string, man string, mae string, cn string, ce string, mcn string, mce string, at long, message string"
    return _dealt(listed, parts).mapInArrow(read, schema)


_WALK_NAMES = ["walk", "sha", "parents", "an", "ae", "man", "mae", "cn", "ce", "mcn", "mce", "at", "message"]


def parse_patch(text: str) -> Iterator[tuple[str, str, str | None, int, int, list[tuple[int, int, int, int]]]]:
    """(sha, path, previous path, added, deleted, hunks) of each file in the output of a raw and patch diff."""
    sha, raws, sections = "", [], []

    def files() -> Iterator[tuple]:
        for (old_mode, new_mode, status, names), lines in zip(raws, sections):
            if _LINK in (old_mode, new_mode) or any(x.startswith("Binary files ") for x in lines):
                continue
            path, previous = names[-1], names[0] if status == "R" else None
            found = [tuple(int(x) if x is not None else 1 for x in m.groups()) for m in map(_HUNK.match, lines) if m]
            added, deleted = sum(h[3] for h in found), sum(h[1] for h in found)
            if status == "A":
                hunks = [(0, 0, 1, added)] if added else []
            elif status == "D":
                hunks = [(1, deleted, 0, 0)] if deleted else []
            else:  # git tells the line before an empty side
                hunks = [(a + (b == 0), b, c + (d == 0), d) for a, b, c, d in found]
                if previous and not hunks:
                    hunks = [(0, 0, 0, 0)]
            yield sha, path, previous, added, deleted, hunks

    for line in text.split("\n"):
        if raw := _RAW.match(line) if not sections else None:
            if raw.group(5) != "T":
                raws.append((raw.group(1), raw.group(2), raw.group(5), raw.group(6).split("\t")))
        elif line.startswith("diff --git "):
            sections.append([])
        elif re.fullmatch(r"[0-9a-f]{40,64}", line):
            yield from files()
            sha, raws, sections = line, [], []
        elif sections and line[:1] in ("@", "B"):
            sections[-1].append(line)
    yield from files()


def diffs(repo: str, listed: DataFrame, parts: int = 64) -> DataFrame:
    """One row per changed file of each of the `listed` revisions, with its hunks."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = ["--stdin", "--root", "-r", "--raw", "-p", "-M50%", "-U0", "--diff-algorithm=histogram", "--no-ext-diff", "--no-textconv", "--no-color", "--full-index"]
        for batch in batches:
            if not batch.num_rows:
                continue
            told = git(repo, "diff-tree", *flags, stdin=("\n".join(batch.column(1).to_pylist()) + "\n").encode())
            rows = list(parse_patch(told.decode("utf-8", "replace")))
            columns = list(zip(*rows)) if rows else [()] * 6
            hunk = pa.list_(pa.struct([(n, pa.int32()) for n in ("old_start", "old_len", "new_start", "new_len")]))
            hunks = [[dict(zip(("old_start", "old_len", "new_start", "new_len"), h)) for h in hs] for hs in columns[5]]
            arrays = [pa.array(c, t) for c, t in zip(columns[:5], (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(hunks, hunk)], ["sha", "path", "prev_path", "added", "deleted", "hunks"])

    schema = "sha string, path string, prev_path string, added int, deleted int, hunks array<struct<old_start:int,old_len:int,new_start:int,new_len:int>>"
    return _dealt(listed, parts).mapInArrow(read, schema)


def snapshots(repo: str, sampled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """file_stats and funcs at the sampled commits; each blob is parsed once for each extension."""
    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sha in batch.column(0).to_pylist():
                for line in git(repo, "ls-tree", "-r", "-z", sha).decode("utf-8", "replace").split("\x00"):
                    head, _, path = line.partition("\t")
                    if head and head.split()[1] == "blob" and not head.startswith("120000"):
                        rows.append((sha, path, head.split()[2]))
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["sha", "path", "oid"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for oid, path, tested in zip(*(c.to_pylist() for c in batch.columns)):
                blob = git(repo, "cat-file", "blob", oid)
                if len(blob) > L.MAX_BLOB or b"\x00" in blob[: L.SNIFFED]:
                    continue
                found = scan(blob.decode("utf-8", "replace"), path, tested)
                out.append((oid, path, tested, found.language, found.code, found.comments, found.blanks, [vars(f) for f in found.functions]))
            columns = list(zip(*out)) if out else [()] * 8
            function = pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            types = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.int32(), function]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["oid", "sample", "tested", "language", "code", "comments", "blanks", "functions"])

    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = sampled.select("sha").mapInArrow(trees, "sha string, path string, oid string")
    files = files.filter(L.language_of(F.col("path")).isNotNull()).withColumns({"ext": extension, "tested": L.is_test_path(F.col("path"))})
    unique = files.groupBy("oid", "ext", "tested").agg(F.min("path").alias("sample")).select("oid", "sample", "tested")
    schema = "oid string, sample string, tested boolean, language string, code int, comments int, blanks int, functions array<struct<name:string,kind:string,start:int,end:int>>"
    parsed = unique.mapInArrow(read, schema).withColumn("ext", F.lower(F.regexp_extract("sample", r"\.([^./]+)$", 1))).drop("sample")
    found = files.join(parsed, ["oid", "ext", "tested"])
    stats = found.select("sha", "path", "language", "code", "comments", "blanks")
    funcs = found.select("sha", "path", F.explode("functions").alias("f"))
    return stats, funcs.select("sha", "path", "f.name", "f.kind", F.col("f.start").alias("start_line"), F.col("f.end").alias("end_line"))


def tag_rows(spark: SparkSession, repo: str) -> DataFrame:
    """Tags with the commit they lead to: the tagger's time, else the committer's, else 0."""
    told = git(repo, "for-each-ref", "refs/tags", "--format=%(refname:short)%09%(*objectname)%09%(objectname)%09%(taggerdate:unix)%09%(committerdate:unix)").decode()
    rows = []
    for line in told.splitlines():
        name, peeled, own, tagger, committer = line.split("\t")
        rows.append((name, peeled or own, int(tagger or committer or 0)))
    return spark.createDataFrame(rows, TABLES["tags"])


def config(repo: str, name: str) -> dict:
    """A TOML file of the repository; missing or malformed, it is empty."""
    try:
        with open(os.path.join(repo, name), "rb") as f:
            return tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError):
        return {}


#: Files whose change may change what was read of older commits.
IDENTITIES = (".mailmap", ".git-blame-ignore-revs")
#: Tables that only ever grow.
APPENDED = ("commit_parents", "commit_trailers", "hunks", "file_churn")


def _size(size: str | None, options: dict, commits: int, tags: DataFrame) -> str:
    """`size` beats the repository's default_bucket, which beats the choice by size; tag needs a tag."""
    size = B.parse_size(size) or B.parse_size(options.get("default_bucket")) or B.auto_size(commits)
    return "month" if size == "tag" and not tags.limit(1).count() else size


def can_update(spark: SparkSession, path: str, known: Mapping[str, DataFrame], size: str | None = None, settings: str = SETTINGS) -> bool:
    """Whether index() of `known` tables reads only what is new: same bucket, identities and settings, and no indexed commit or diff has gone."""
    repo = open_repository(path)
    meta = {r["key"]: r["value"] for r in known["meta"].collect()}
    every = revisions(spark, repo, "--all", "HEAD")
    lost = X.unseen(known["commits"].select("sha"), every)
    lost = lost.unionAll(X.unseen(known["file_churn"].select("sha").distinct(), revisions(spark, repo, "HEAD")))
    if not meta.get("indexed_head_sha") or lost.limit(1).count():
        return False
    if git(repo, "diff", "--name-only", meta["indexed_head_sha"], "--", settings, *IDENTITIES).strip():
        return False
    return meta.get("bucket_size") == _size(size, config(repo, settings), every.count(), tag_rows(spark, repo)).capitalize()


def index(spark: SparkSession, path: str, size: str | None = None, settings: str = SETTINGS, known: Mapping[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The twelve tables of a repository, and of those that only grow the new rows.

    With the tables `known` of an earlier index (for which can_update() holds) only commits, diffs and
    snapshots that these lack are read; ids of authors stay, new ones follow.
    """
    repo = open_repository(path)
    options = config(repo, settings)
    every = revisions(spark, repo, "--all", "HEAD")
    tags = tag_rows(spark, repo)
    size = _size(size, options, every.count(), tags)
    old = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()} if known is None else known
    # written, not cached: a cached plan would stand in for the same plan over what is indexed by then
    commits = written(walk(repo, every if known is None else X.unseen(every, known["commits"])), "walk")

    aliases = [(a["canonical_name"], a["canonical_email"], r["name"], r["email"]) for a in options.get("alias", []) for r in a.get("raw", [])]
    named_as = spark.createDataFrame(aliases, "to_name string, to_email string, name string, email string")
    trailing = P.trailers(commits.select("walk", "sha", "message"))
    authored = commits.select("walk", F.lit(0).alias("n"), "sha", F.lit("author").alias("role"), F.col("an").alias("name"), F.col("ae").alias("email"), F.col("man").alias("m"), F.col("mae").alias("e"))
    committed = commits.select("walk", F.lit(1), "sha", F.lit("committer"), "cn", "ce", "mcn", "mce")
    others = trailing.select("walk", F.lit(2), "sha", "role", "name", "email", F.col("name").alias("m"), F.col("email").alias("e"))
    people = authored.union(committed).union(others).join(named_as, ["name", "email"], "left")
    people = people.withColumns({"canonical_name": F.coalesce("to_name", "m"), "canonical_email": F.coalesce("to_email", "e")})
    canonical = ["canonical_name", "canonical_email"]
    first = people.groupBy(*canonical).agg(F.min(F.struct("walk", "n")).alias("seen")).join(old["authors"], canonical, "left_anti")
    ids = F.row_number().over(Window.orderBy("seen", *canonical)) + (old["authors"].agg(F.max("id")).first()[0] or 0)
    authors = written(old["authors"].unionByName(first.withColumn("id", ids.cast("long")).select("id", *canonical)), "authors")
    named = people.join(authors, canonical)
    raw = named.groupBy(F.col("name").alias("raw_name"), F.col("email").alias("raw_email")).agg(F.min_by("id", F.struct("walk", "n")).alias("author_id"))
    raw = old["author_aliases"].unionByName(raw.join(old["author_aliases"], ["raw_name", "raw_email"], "left_anti"))
    of_role = lambda role, column: named.filter(F.col("role") == role).select("sha", F.col("id").alias(column))

    ignored: DataFrame = spark.createDataFrame([], "sha string")
    if os.path.exists(listed := os.path.join(repo, ".git-blame-ignore-revs")):
        with open(listed, encoding="utf-8", errors="replace") as f:
            ignored = P.ignored_revisions(spark.createDataFrame([(x,) for x in f.read().split("\n")], "value string"))
    rows = commits.withColumns({"t": P.commit_type(F.col("message")), "authored_at": F.col("at"), "is_merge": F.size("parents") > 1})
    rows = rows.join(ignored.distinct().withColumn("ignored_blame", F.lit(True)), "sha", "left").withColumn("ignored_blame", F.coalesce("ignored_blame", F.lit(False)))
    rows = rows.join(of_role("author", "author_id"), "sha").join(of_role("committer", "committer_id"), "sha")
    told = ["sha", "author_id", "committer_id", "authored_at", "is_merge", "msg_type", "is_breaking", "is_revert", "ignored_blame"]
    rows = rows.select("walk", *told[:5], "t.msg_type", "t.is_breaking", "t.is_revert", told[-1])
    rows = rows.unionByName(old["commits"].select(*told).join(every, "sha"))
    rows = B.tag_buckets(rows, tags) if size == "tag" else rows.withColumn("bucket_key", B.bucket_key(F.col("authored_at"), size))
    table = written(B.sample_flags(rows, "walk").select(*TABLES["commits"].names), "commits")

    told = old["file_churn"].select("sha").unionAll(old["hunks"].select("sha")).distinct()
    changed = written(diffs(repo, X.unseen(revisions(spark, repo, "--no-merges", "HEAD"), told)), "diffs")
    sampled = table.filter("is_sampled").select("sha")
    stats, funcs = snapshots(repo, sampled.join(old["commits"].filter("is_sampled"), "sha", "left_anti"))
    kept = lambda name: old[name].join(sampled, "sha", "left_semi")
    added = {
        "commit_parents": commits.select("sha", F.posexplode("parents").alias("parent_idx", "parent_sha")).select("sha", "parent_sha", "parent_idx"),
        "commit_trailers": named.filter("n = 2").select("sha", F.col("id").alias("author_id"), "role"),
        "hunks": changed.select("sha", "path", "prev_path", F.explode("hunks").alias("h")).select("sha", "path", "prev_path", "h.*"),
        "file_churn": changed.select("sha", "path", "added", "deleted"),
    }
    tables = {name: old[name].unionByName(more) for name, more in added.items()}
    last = every.orderBy(F.desc("walk")).limit(1).select(F.lit("indexed_head_sha"), "sha")
    tables |= {
        "meta": spark.createDataFrame([("schema_version", SCHEMA_VERSION), ("bucket_size", size.capitalize())], TABLES["meta"]).union(last),
        "authors": authors,
        "author_aliases": raw.select("author_id", "raw_name", "raw_email"),
        "commits": table,
        "tags": tags,
        "file_stats": kept("file_stats").unionByName(stats),
        "funcs": kept("funcs").unionByName(funcs),
        "line_births": fold.line_births(tables["hunks"], table),
    }
    return tables, added
