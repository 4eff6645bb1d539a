import os
import subprocess

import pytest
from pyspark.sql import functions as F

from loomstone.operators import metrics as M
from loomstone.operators.extractions import summary
from loomstone.sources import git as G
from loomstone.sources import warehouse
from loomstone.sources.scan import scan


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    """A history of three people with a rename, a merge, a revert, a tag, a trailer and a binary file."""
    root = tmp_path_factory.mktemp("history")

    def run(*args, who="Alice", day=1):
        stamp = f"2025-01-{day:02d}T00:00:00Z"
        env = os.environ | {f"GIT_{r}_{k}": v for r in ("AUTHOR", "COMMITTER") for k, v in (("NAME", who), ("EMAIL", f"{who.lower()}@example.com"), ("DATE", stamp))}
        subprocess.run(["git", "-C", str(root), "-c", "commit.gpgsign=false", "-c", "tag.gpgsign=false", *args], check=True, env=env, capture_output=True)

    def commit(message, day, who="Alice", **files):
        for name, text in files.items():
            path = root / name.replace("__", "/").replace("_dot_", ".")
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(text) if isinstance(text, bytes) else path.write_text(text)
        run("add", "-A")
        run("commit", "-q", "-m", message, who=who, day=day)

    run("init", "-q", "-b", "main")
    commit("feat: start", 1, src__lib_dot_rs="fn a() {\n}\n", logo_dot_bin=b"\x00\x01")
    commit("feat(core): more", 2, src__lib_dot_rs="fn a() {\n}\n// note\n")
    commit("fix: both\n\nCo-authored-by: Bob <bob@example.com>", 3, src__lib_dot_rs="fn b() {\n}\n// note\n", util_dot_py="def test_x():\n    pass\n", who="Bob")
    (root / "src/core.rs").parent.mkdir(exist_ok=True)
    run("mv", "src/lib.rs", "src/core.rs")
    run("commit", "-q", "-m", "refactor!: rename", day=4)
    run("tag", "-a", "v0.1", "-m", "one", day=4)
    run("checkout", "-q", "-b", "side")
    commit("chore: branch", 5, util_dot_py="def test_x():\n    pass\n\n# end\n", who="Carol")
    run("checkout", "-q", "main")
    commit('Revert "x"', 6, other_dot_md="hello\n")
    run("merge", "-q", "--no-ff", "-m", "merge side", "side", day=7)
    return str(root)


@pytest.fixture(scope="module")
def views(spark, repository):
    return G.index(spark, repository)[0]


def test_tables(views):
    commits = views["commits"]
    assert commits.count() == 7 and commits.filter("is_merge").count() == 1 and commits.filter("is_sampled").count() == 6
    assert {r["msg_type"]: r["n"] for r in commits.filter("not is_merge").groupBy("msg_type").agg(F.count("*").alias("n")).collect()} == {"feat": 2, "fix": 1, "refactor": 1, "chore": 1, None: 1}
    assert commits.filter("is_breaking").count() == 1 and commits.filter("is_revert").count() == 1
    assert views["commit_parents"].count() == 7 and views["tags"].count() == 1
    assert views["commit_trailers"].count() == 1 and views["authors"].count() == 3
    renamed = views["hunks"].filter("prev_path is not null").collect()
    assert [tuple(r)[1:] for r in renamed] == [("src/core.rs", "src/lib.rs", 0, 0, 0, 0)]
    assert views["file_churn"].filter("path = 'logo.bin'").count() == 0


def test_churn_and_births(views):
    added, deleted = views["file_churn"].agg(F.sum("added"), F.sum("deleted")).first()
    assert (added, deleted) == (9, 1)
    assert views["line_births"].count() == 8
    content = views["hunks"].groupBy("sha", "path").agg(F.sum("new_len").alias("a"), F.sum("old_len").alias("d"))
    assert content.join(views["file_churn"], ["sha", "path"]).filter("a <> added or d <> deleted").count() == 0
    middle = views["hunks"].filter("old_len = 1 and new_len = 1").collect()
    assert [(r["old_start"], r["new_start"]) for r in middle] == [(1, 1)]
    grown = views["hunks"].filter("old_len = 0 and old_start > 0").collect()
    assert sorted((r["old_start"], r["new_start"], r["new_len"]) for r in grown) == [(3, 3, 1), (3, 3, 2)]


def test_snapshots(views):
    stats = {(r["path"], r["language"]): (r["code"], r["comments"], r["blanks"]) for r in views["file_stats"].collect()}
    assert stats["src/core.rs", "Rust"] == (2, 1, 0) and stats["util.py", "Python"] in ((2, 0, 0), (2, 1, 1))
    kinds = {(r["path"], r["name"], r["kind"], r["start_line"], r["end_line"]) for r in views["funcs"].collect()}
    assert ("src/core.rs", "b", "fn", 1, 2) in kinds and ("util.py", "test_x", "test", 1, 2) in kinds


def test_metrics_and_warehouse(spark, views, tmp_path):
    warehouse.save(views, str(tmp_path))
    loaded = warehouse.load(spark, str(tmp_path))
    assert summary(loaded).first()["commits"] == 7
    for metric in (M.classify(loaded), M.churn(loaded), M.churn(loaded, "author"), M.burndown(loaded), M.burndown(loaded, "author"), M.cohort(loaded), M.survival(loaded), M.age(loaded, 1740000000), M.survival_fit(loaded)):
        assert metric.count() >= 1
    assert M.hotspot(loaded, "rust").first()["func"] == "b"
    warehouse.register(loaded)
    assert spark.sql("SELECT count(*) FROM commits").first()[0] == 7


def test_refusals(tmp_path):
    subprocess.run(["git", "init", "-q", "--bare", str(tmp_path)], check=True)
    with pytest.raises(ValueError):
        G.open_repository(str(tmp_path))


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("a.rs", "// c\nfn a() {\n  let x = \"// no\"; // tail\n}\n\n/* b\n c */\n", (3, 3, 1)),
        ("a.py", '"""Doc"""\n# c\nimport x\n\nx = 1\n', (3, 1, 1)),
        ("a.go", "package m\n\n// c\nfunc A() {\n}\n", (3, 1, 1)),
        ("a.cpp", "/* a\n b */\nint f() { return 1; } // x\n\n", (1, 2, 1)),
        ("a.rs", "", (0, 0, 0)),
    ],
)
def test_line_classes(path, text, want):
    found = scan(text, path)
    assert (found.code, found.comments, found.blanks) == want


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("a.rs", "fn a() {}\nimpl S {\n  pub fn m(&self) {\n    fn inner() {}\n  }\n}\n#[test]\nfn t() {}\n#[cfg(test)]\nmod tests {\n  fn h() {}\n}\n", [("a", "fn", 1, 1), ("m", "method", 3, 5), ("t", "test", 8, 8), ("h", "test", 11, 11)]),
        ("a.py", "class A:\n    def m(self):\n        return 1\n\ndef test_x():\n    pass\n", [("m", "method", 2, 3), ("test_x", "test", 5, 6)]),
        ("a.go", "func Add(a int) int {\n\treturn a\n}\nfunc (l *L) Log() {\n}\nfunc TestX(t *T) {}\n", [("Add", "fn", 1, 3), ("Log", "method", 4, 5), ("TestX", "test", 6, 6)]),
        ("a.c", "int main(void) {\n  if (x) { y(); }\n}\nstatic void\nfoo(int a)\n{\n}\n", [("main", "fn", 1, 3), ("foo", "fn", 4, 7)]),
        ("a.ts", "class A {\n  log(x) {\n  }\n}\nfunction add(a, b) { return a; }\n", [("log", "method", 2, 3), ("add", "fn", 5, 5)]),
        ("a.vim", "let x = 1\nfunction! s:Go(a) abort\n  return 1\nendfunction\n\nfu Foo#bar()\nendf\n", [("s:Go", "fn", 2, 4), ("Foo#bar", "fn", 6, 7)]),
        ("a.ml", "open List\nlet rec len l =\n  let n = 1 in\n  n\n\nand other = 2\nmodule M = struct\n  let f x =\n    x\n  let g = 1\nend\n", [("len", "fn", 2, 4), ("other", "fn", 6, 6), ("f", "fn", 8, 9), ("g", "fn", 10, 10)]),
        ("a.hs", "module M where\nimport X\nsize :: [a] -> Int\nsize [] = 0\nsize (_:xs) = 1 + n\n  where n = size xs\nlimit = 3\ndata T = A\nabs' x\n  | x < 0 = -x\n  | otherwise = x\n", [("size", "fn", 4, 4), ("size", "fn", 5, 6), ("abs'", "fn", 9, 11)]),
        ("a.txt", "x", None),
    ],
)
def test_functions(path, text, want):
    found = scan(text, path)
    assert (found and [(f.name, f.kind, f.start, f.end) for f in found.functions]) == want
