import json
import subprocess

import pytest

from loomstone.cli import main
from loomstone.sinks.render import cell, default_format, export, render


def test_render():
    rows = [("a", None, True), ('b"c,d', b"12", 1.5)]
    assert list(render(["x", "y", "z"], rows, "tsv")) == ["x\ty\tz", "a\t\ttrue", 'b"c,d\t<2 bytes>\t1.5']
    assert list(render(["x", "y", "z"], rows, "csv"))[2] == '"b""c,d",<2 bytes>,1.5'
    assert json.loads("".join(render(["x", "y"], [("a", None)], "json"))) == [{"x": "a", "y": ""}]
    assert list(render(["x", "yy"], [("é", "b")], "table")) == ["x  | yy", "---+---", "é | b"]
    assert cell("a\rb") == "a\rb" and default_format("csv") == "csv" and default_format(None, True) == "table" and default_format(None, False) == "tsv"
    with pytest.raises(ValueError):
        default_format("xml")


def test_export(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    for how in ("parquet", "csv", "json"):
        export({"t": frame}, f"{tmp_path}/{how}", how, single=True)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/parquet/t").collect())) == [(1, "a"), (2, None)]
    export({"t": frame}, f"{tmp_path}/lines", "json")
    lines = sorted(r["value"] for r in spark.read.text(f"{tmp_path}/lines/t").collect())
    assert [json.loads(x) for x in lines] == [{"x": 1, "y": "a"}, {"x": 2, "y": None}]
    assert json.loads(spark.read.text(f"{tmp_path}/json/t").first()["value"]) == [{"x": 1, "y": "a"}, {"x": 2, "y": None}]
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv/t").count() == 2


def test_commands(spark, tmp_path, capsys):
    repo = tmp_path / "repo"
    repo.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=Ann", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (repo / "a.py").write_text("def f():\n    return 1\n")
    git("add", "-A")
    git("commit", "-q", "-m", "feat: one")
    base = ["--repo", str(repo), "--warehouse", str(tmp_path / "wh")]
    assert main([*base, "index"], spark) == 0
    for command in (["classify"], ["churn", "--by", "author"], ["hotspot", "--lang", "python"], ["survival", "--fit", "EXP"], ["sql", "SELECT count(*) AS n FROM commits"], ["summary"]):
        assert main([*base, *command, "--format", "tsv"], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert "n" in out and "half_life" in out[-5] + out[-4] + out[-3] + out[-2] + out[-6] + out[-1]
    assert main([*base, "churn", "--by", "nothing"], spark) == 1
    assert main([*base, "hotspot"], spark) == 1
