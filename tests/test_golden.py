"""The golden history: thirty commits in thirty days by three people, and what is true of them."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from loomstone.cli import bring_up_to_date
from loomstone.operators import extractions as X
from loomstone.operators import metrics as M
from loomstone.plans.model import TABLES
from loomstone.sources import git as G
from loomstone.sources import warehouse


class History:
    def __init__(self, root):
        self.root = root
        self.run("init", "-q", "-b", "main")

    def run(self, *args, who="Alice", day=1, hour=0):
        stamp = f"2025-01-{day:02d}T{hour:02d}:00:00Z" if day < 32 else f"2025-02-{day - 31:02d}T{hour:02d}:00:00Z"
        env = os.environ | {f"GIT_{r}_{k}": v for r in ("AUTHOR", "COMMITTER") for k, v in (("NAME", who), ("EMAIL", f"{who.lower()}@example.com"), ("DATE", stamp))}
        done = subprocess.run(["git", "-C", str(self.root), "-c", "commit.gpgsign=false", "-c", "tag.gpgsign=false", *args], check=True, env=env, capture_output=True)
        return done.stdout.decode().strip()

    def commit(self, day, who, message, **files):
        for name, text in files.items():
            path = self.root / name.replace("__", "/").replace("_dot_", ".")
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
        self.run("add", "-A")
        self.run("commit", "-q", "--allow-empty", "-m", message, who=who, day=day)


def golden(root):
    h = History(root)
    h.commit(1, "Alice", "feat: add rust module", src__lib_dot_rs="pub fn one() {}\n// end\n")
    h.commit(2, "Alice", "feat(core): more", src__lib_dot_rs="pub fn one() {}\n// end\npub fn two() {}\n")
    h.commit(3, "Alice", "fix: typo", src__lib_dot_rs="pub fn uno() {}\n// end\npub fn two() {}\n")
    h.commit(4, "Bob", "feat: python", src__util_dot_py="def a():\n    return 1\n")
    h.commit(5, "Bob", "feat: js", web__app_dot_js="function go() {}\n")
    h.commit(6, "Bob", "feat(ui): ts", web__config_dot_ts="export const x = 1;\n")
    h.commit(7, "Carol", "feat: go", svc__main_dot_go="package main\nfunc main() {}\n")
    h.commit(8, "Carol", "feat: c", native__core_dot_c="int core(void) { return 0; }\n")
    h.commit(9, "Carol", "feat: cpp", native__wrap_dot_cpp="int wrap() { return 0; }\n")
    h.commit(10, "Alice", "feat: paired change\n\nCo-authored-by: Bob <bob@example.com>", src__lib_dot_rs="pub fn pair() {}\n// end\npub fn two() {}\npub fn four() {}\n")
    h.commit(11, "Alice", "feat!: breaking rename API", src__lib_dot_rs="pub fn first() {}\npub fn second() {}\n")
    broken = h.run("rev-parse", "HEAD")
    h.run("mv", "src/lib.rs", "src/core.rs")
    h.commit(12, "Alice", "refactor: rename lib -> core")
    h.run("tag", "-a", "v0.1", "-m", "v0.1", day=12, hour=12)
    (root / ".git-blame-ignore-revs").write_text(f"# reformatting\n{broken}\n")
    h.commit(13, "Alice", "chore: ignore-revs")
    h.commit(14, "Bob", "chore(js): tidy", web__app_dot_js="function go() {\n}\n")
    tidy = h.run("rev-parse", "HEAD")
    h.run("checkout", "-q", "-b", "feature-x")
    h.commit(15, "Carol", "feat: branch work", native__wrap_dot_cpp="int wrap() { return 0; }\nint more() { return 1; }\n")
    h.run("checkout", "-q", "main")
    h.run("merge", "-q", "--no-ff", "-m", "merge feature-x", "feature-x", day=16)
    (root / "web/app.js").write_text("function go() {}\n")
    h.commit(17, "Bob", f'Revert "chore(js): tidy"\n\nThis reverts commit {tidy}.')
    for i in range(13):
        files = {"src__util_dot_py": f"def a():\n    return {i + 2}\n"}
        if i % 4 == 0:
            files["web__app_dot_js"] = f"function go() {{ return {i}; }}\n"
        h.commit(18 + i, ("Alice", "Carol")[i % 2], f"chore: {'multi-file' if i % 4 == 0 else 'filler'} {i}", **files)
    return h


@pytest.fixture(scope="module")
def history(tmp_path_factory):
    return golden(tmp_path_factory.mktemp("golden"))


@pytest.fixture(scope="module")
def folder(spark, history, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "wh")
    bring_up_to_date(spark, str(history.root), path, None, False)
    return path


def test_truths(spark, folder):
    v = warehouse.load(spark, folder)
    commits = v["commits"]
    kinds = {r["msg_type"]: r["n"] for r in commits.filter("not is_merge").groupBy("msg_type").agg(F.count("*").alias("n")).collect()}
    assert commits.count() == 30 and commits.filter("is_merge").count() == 1
    assert kinds == {"feat": 11, "chore": 15, "fix": 1, "refactor": 1, None: 1}
    assert [commits.filter(c).count() for c in ("is_breaking", "is_revert", "ignored_blame")] == [1, 1, 1]
    assert [v[t].count() for t in ("tags", "commit_trailers", "authors")] == [1, 1, 3]
    assert {r["key"]: r["value"] for r in v["meta"].collect()}["bucket_size"] == "Commit" and commits.filter("is_sampled").count() == 29
    added, deleted = v["file_churn"].agg(F.sum("added"), F.sum("deleted")).first()
    assert (v["file_churn"].count(), added, deleted) == (33, 39, 26)
    assert v["hunks"].count() == 34 and v["line_births"].count() == 13
    assert v["hunks"].filter("prev_path is not null").count() == 1
    assert [tuple(r) for r in M.coupling(v).collect()] == [("src/util.py", "web/app.js", 4)]
    for metric in (M.classify(v), M.age(v, 1740000000), M.churn(v), M.churn(v, "author"), M.churn(v, "language"), M.burndown(v), M.burndown(v, "author"), M.hotspot(v, "python"), M.cohort(v), M.survival(v)):
        assert metric.count() >= 1
    # what survives at HEAD, line by line, is what git's files hold
    lines = {r["path"]: r["n"] for r in v["line_births"].groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert lines["src/core.rs"] == 2 and lines["src/util.py"] == 2 and lines["web/app.js"] == 1 and "src/lib.rs" not in lines


def told(views):
    return {name: sorted(map(repr, (tuple(r) for r in views[name].select(*TABLES[name].names).collect()))) for name in TABLES}


def test_only_what_is_new_is_read(spark, history, folder, monkeypatch):
    """A second index after new commits reads these alone, and equals a rebuild; one that can't is a rebuild."""
    read = []
    walk, diffs = G.walk, G.diffs
    monkeypatch.setattr(G, "walk", lambda repo, listed, parts=64: read.append(listed.count()) or walk(repo, listed, parts))
    monkeypatch.setattr(G, "diffs", lambda repo, listed, parts=64: read.append(listed.count()) or diffs(repo, listed, parts))
    history.commit(32, "Dave", "feat: late\n\nSigned-off-by: Alice <alice@example.com>", src__util_dot_py="def a():\n    return 99\n\ndef b():\n    pass\n")
    bring_up_to_date(spark, str(history.root), folder, None, False)
    assert read == [1, 1]
    rebuilt = G.index(spark, str(history.root))[0]
    assert told(warehouse.load(spark, folder)) == told(rebuilt)
    assert X.unseen(rebuilt["commits"].select("sha"), warehouse.load(spark, folder)["commits"]).count() == 0

    read.clear()
    bring_up_to_date(spark, str(history.root), folder, None, False)
    assert read == [0, 0] and warehouse.load(spark, folder)["commits"].count() == 31
    (history.root / ".mailmap").write_text("Robert <bob@example.com> Bob <bob@example.com>\n")
    history.commit(33, "Alice", "chore: names")
    read.clear()
    bring_up_to_date(spark, str(history.root), folder, None, False)
    assert read[0] == 32 and warehouse.load(spark, folder)["authors"].filter("canonical_name = 'Robert'").count() == 1
