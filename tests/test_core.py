import random

import pytest
from pyspark.sql import functions as F

from loomstone.functions import buckets as B
from loomstone.functions import lines as L
from loomstone.functions import parse as P
from loomstone.operators import extractions as X
from loomstone.operators import fold
from loomstone.operators import metrics as M
from loomstone.operators.filters import Filters, day_start
from loomstone.plans.model import TABLES
from loomstone.sources.bindings import bound_views


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "day, size, key",
    [
        ("2025-03-15", "day", 20250315), ("2025-03-15", "month", 202503), ("2025-03-15", "week", 202511),
        ("2025-12-29", "week", 202601), ("2024-12-31", "week", 202501), ("1970-01-01", "commit", 0),
    ],
)
def test_bucket_keys(spark, day, size, key):
    assert one(spark, B.bucket_key(F.lit(day_start(day)), size)) == key


def test_sizes():
    assert [B.auto_size(n) for n in (0, 499, 500, 4999, 5000, 49999, 50000)] == ["commit", "commit", "day", "day", "week", "week", "month"]
    assert B.parse_size("Week") == "week" and B.parse_size("auto") is None


@pytest.mark.parametrize("limit", [100, 0])
def test_tag_buckets(spark, limit):
    stamps = [50, 100, 150, 200, 350, 40_000_000, 90_000_000]
    commits = spark.createDataFrame([(str(t), t) for t in stamps], "sha string, authored_at long")
    for tags, want in (([100, 200, 300, 300, 50_000_000], [-1, 0, 0, 1, 3, 3, 4]), ([], [-1] * 7)):
        frame = spark.createDataFrame([(t,) for t in tags], "tagged_at long")
        found = {r["sha"]: r["bucket_key"] for r in B.tag_buckets(commits, frame, limit).collect()}
        assert [found[str(t)] for t in stamps] == want


def test_sampling(spark):
    rows = [(1, "a", 10, 1, False), (2, "b", 11, 1, False), (3, "c", 12, 2, True), (4, "d", 13, 3, False), (5, "e", 13, 3, False)]
    commits = spark.createDataFrame(rows, "walk long, sha string, authored_at long, bucket_key long, is_merge boolean")
    for order in (None, "walk"):
        assert [r["sha"] for r in B.sample_flags(commits, order).filter("is_sampled").orderBy("sha").collect()] == ["b", "e"]


@pytest.mark.parametrize(
    "message, want",
    [
        ("feat: add\n\nbody", ("feat", False, False)), ("refactor(core)!: x", ("refactor", True, False)), ("fix(auth): y", ("fix", False, False)),
        ("revert: z", ("revert", False, True)), ('Revert "feat: z"', (None, False, True)), ("wip stuff", (None, False, False)),
        ("123: x", (None, False, False)), ("WIP: x", ("wip", False, False)), ("", (None, False, False)), ("a(b: c", (None, False, False)),
    ],
)
def test_commit_types(spark, message, want):
    assert tuple(one(spark, P.commit_type(F.lit(message)))) == want


def test_trailers(spark):
    message = 'Signed-off-by: subject <s@x>\n\nCo-authored-by: Bob <bob@x.com>\nSIGNED-OFF-BY: "Doe, John" <j@x>\nco-authored-by: Zoë <z@x>\nSigned-off-by: No Mail\nSigned-off-by: Bad <oops\nSigned-off-by: <only@x>'
    rows = P.trailers(spark.createDataFrame([(message,)], "message string")).select("role", "name", "email").collect()
    assert sorted(map(tuple, rows)) == sorted([("coauthor", "Bob", "bob@x.com"), ("signoff", "Doe, John", "j@x"), ("coauthor", "Zoë", "z@x"), ("signoff", "No Mail", "")])


def test_ignored_revisions(spark):
    lines = spark.createDataFrame([("# note",), ("",), ("ABCDEF12 # upper",), ("xyz1",), ("abc",), ("  0123abcd 4567  ",)], "value string")
    assert sorted(r["sha"] for r in P.ignored_revisions(lines).collect()) == ["0123abcd", "4567", "abcdef12"]


def test_lines_and_blobs(spark):
    for text, n in (("", 0), ("a", 1), ("a\nb\nc\n", 3), ("a\nb\nc", 3), ("\n", 1)):
        assert one(spark, L.count_lines(F.lit(text))) == n
    for blob, ok in ((b"text", True), (b"a\x00b", False), (b"a" * 8192 + b"\x00", True), (b"a" * (2 * 1024 * 1024 + 1), False), (b"", True)):
        assert one(spark, L.readable(F.lit(blob))) == ok


def test_paths(spark):
    yes = ["tests/a.rs", "src/__tests__/x.js", "a/b.spec.ts", "x.test.tsx", "lib/foo_test.cc", "pkg/test_x.py", "TEST_y.cpp"]
    for path in yes + ["src/contest.py", "latest/x.rs"]:
        assert one(spark, L.is_test_path(F.lit(path))) == (path in yes)
    assert one(spark, L.language_of(F.lit("a/B.TSX"))) == "TSX" and one(spark, L.language_of(F.lit("Makefile"))) is None
    assert one(spark, L.module_of(F.lit("a/b/c"), 2)) == "a/b" and one(spark, L.module_of(F.lit("a"), 2)) == "a"
    with pytest.raises(ValueError):
        L.module_of(F.lit("a"), 0)


def test_filters(spark):
    assert day_start("2025-01-15") == 1736899200
    with pytest.raises(ValueError):
        Filters(since="nope")
    commits = spark.createDataFrame([("a", 1, day_start("2025-01-15")), ("b", 2, day_start("2025-01-16") - 1), ("c", 2, day_start("2025-01-16"))], "sha string, author_id long, authored_at long")
    authors = spark.createDataFrame([(1, "Ann", "a@x"), (2, "B\\ob", "BOB@y")], "id long, canonical_name string, canonical_email string")
    shas = lambda f: sorted(r["sha"] for r in f.commits(commits, authors).collect())
    assert shas(Filters(since="2025-01-15", until="2025-01-15")) == ["a", "b"]
    assert shas(Filters(author="BOB")) == ["b", "c"] and shas(Filters(author="b\\o")) == ["b", "c"] and shas(Filters(author="%x")) == ["a"]
    paths = spark.createDataFrame([("src/a",), ("sxc/b",), ("lib",)], "path string")
    assert [paths.filter(Filters(path=p).paths()).count() for p in ("src/", "s_c", "%b", None)] == [1, 2, 2, 3]
    langs = spark.createDataFrame([("Rust",), ("Go",), (None,)], "language string")
    assert [langs.filter(Filters(languages=x).language()).count() for x in (" rust, go", "", None)] == [2, 3, 3]


def test_aliases(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("s", "s"), (None, "n")]
    found = {r["prev_path"]: r["canonical"] for r in fold.resolve_aliases(spark.createDataFrame(edges, "prev_path string, path string")).collect()}
    assert found["a"] == found["b"] == "c" and found["x"] == "y" and "s" not in found


def splice(hunks_by_commit):
    lines = []
    for mark, hunks in hunks_by_commit:
        out, at = [], 0
        for old_start, old_len, new_len in sorted(hunks):
            start = max(old_start, 1) - 1
            out += lines[at : max(start, at)]
            out += [mark] * new_len
            at = max(at, min(start + old_len, len(lines)))
        lines = out + lines[at:]
    return lines


def test_fold(spark):
    rng = random.Random(2)
    files = {"three": [("A", [(1, 0, 3)])], "split": [("A", [(1, 0, 4)]), ("B", [(2, 1, 2)])], "gone": [("A", [(1, 0, 3)]), ("B", [(1, 3, 0)])]}
    for n in range(25):
        files[f"f{n}"] = [(f"c{k}", [(s, rng.randint(0, 3), rng.randint(0, 4)) for s in rng.sample(range(0, 12), rng.randint(1, 3))]) for k in range(rng.randint(1, 5))]
    hunks, commits = [], []
    for path, history in files.items():
        for k, (mark, parts) in enumerate(history):
            sha = f"{path}-{mark}"
            commits.append((sha, k, k * 10, False))
            hunks += [(sha, path, None, s, o, s, n) for s, o, n in parts]
    hunks = spark.createDataFrame(hunks, TABLES["hunks"])
    commits = spark.createDataFrame(commits, "sha string, authored_at long, bucket_key long, is_merge boolean")
    found = {}
    for r in fold.line_births(hunks, commits).orderBy("path", "line_no").collect():
        found.setdefault(r["path"], []).append(r["birth_sha"])
    for path, history in files.items():
        assert found.get(path, []) == [f"{path}-{m}" for m in splice(history)], path


def test_properties(spark):
    views = bound_views(spark, "/root/testdata/sf0.001")
    sums = views["hunks"].groupBy("sha", "path").agg(F.sum("new_len").alias("a"), F.sum("old_len").alias("d"))
    joined = sums.join(views["file_churn"], ["sha", "path"])
    assert joined.filter("a <> added or d <> deleted").count() == 0 and joined.count() == views["file_churn"].count()
    last = M.burndown(views, "author").groupBy("author").agg(F.max_by("loc", "bucket").alias("loc")).agg(F.sum("loc")).first()[0]
    plain = views["file_churn"].join(views["commits"].filter("not is_merge"), "sha").agg(F.sum(F.col("added") - F.col("deleted"))).first()[0]
    assert last == plain
    assert X.differences(views["file_stats"], views["file_stats"]).count() == 0
    for bad in (lambda: M.churn(views, "day"), lambda: M.burndown(views, "module"), lambda: M.hotspot(views, "")):
        with pytest.raises(ValueError):
            bad()


def test_fit_reasons(spark):
    commits = spark.createDataFrame([(f"c{k}", 1, k, False, 10 * k) for k in range(4)], "sha string, author_id long, authored_at long, is_merge boolean, bucket_key long")
    def fit(born, alive):
        hunks = spark.createDataFrame([(f"c{k}", "p", None, 1, 0, 1, n) for k, n in enumerate(born)], TABLES["hunks"])
        births = spark.createDataFrame([("p", i, f"c{k}", 10 * k) for k, n in enumerate(alive) for i in range(n)] or [("p", 1, "x", 999)], TABLES["line_births"])
        return tuple(M.survival_fit({"commits": commits, "hunks": hunks, "line_births": births}).first())
    assert fit([10, 10], [5, 9]) == ("half_life", "", "insufficient data: 6 deletion events (need >= 100)")
    name, value, reason = fit([800, 800, 800, 800], [100, 200, 400, 800])
    assert value == "10.000" and reason == "ok (n=3, deaths=1700)"
    assert fit([800, 800], [400, 100])[2].startswith("positive slope")
    assert fit([800], [400])[2].startswith("insufficient data: 400")
