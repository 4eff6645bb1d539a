import collections
import math
import re

import duckdb
from pyspark.sql import functions as F

from loomstone.llm import rules as R


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_base_counts(spark, small, odd_documents):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(900, "a b c d e f a b c d e f a b c d e"), (901, "a " * 30), (902, "a\n\na\n b\nb\n b"), (903, "a b c d")], docs.schema)
    for frame in (docs, more, odd_documents):
        for r in R.quality_rules(frame).collect():
            want = base(r["text"])
            assert tuple(r[c] for c in COUNTS) == want
            failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
            assert r["base_failed"] == failed and not (failed and r["kept"])


def test_ratio_by_hand(spark):
    texts = ["weave the cloth " * 30, "plain threads and yarn " * 30, "LOUD!!\nLOUD!! cloth\n" * 30, None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    grams = {r["doc_id"]: r["_grams"] for r in R.with_ngrams(docs, 64).collect()}
    good = [0, 1]
    raw = collections.Counter(b for g in grams.values() for b in g)
    kept = collections.Counter(b for i in good for b in grams[i])
    n_raw, n_kept = 64 + sum(raw.values()), 64 + sum(kept.values())
    judged = R.quality_rules(docs, buckets=64, threshold=-0.3, is_trusted=(F.col("n_dup_lines") == 0) & (F.col("n_words") > 0))
    for r in judged.collect():
        want = [math.log((1 + kept[b]) / n_kept) - math.log((1 + raw[b]) / n_raw) for b in grams[r["doc_id"]]]
        llr = sum(want) / len(want) if want else 0.0
        assert abs(r["llr"] - llr) < 1e-6 and r["kept"] == (not r["base_failed"] and llr >= -0.3)
        assert len(grams[r["doc_id"]]) == 2 * len(re.findall(r"\w+|[^\w\s]+", r["text"] or ""))


def test_trusted_target(spark):
    """It passes the base rules, is long enough, repeats nothing and has few symbols."""
    plain = " ".join(f"word{i}" for i in range(60))
    texts = [plain, plain[:300], plain + "\nline\nline", " ".join([plain[:60]] * 2) + plain, plain + " ###", plain * 4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in R.base_counts(docs).filter(R.trusted()).collect()] == [0]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "weft and warp " * 9, 7, "x", "y", 1.5)], "doc_id long, text string, row int, _grams string, trusted string, llr double")
    found = R.quality_rules(docs)
    assert found.columns == ["doc_id", "text", "row", "_grams", "trusted", *R.ADDED]
    row = found.first()
    assert (row["row"], row["_grams"], row["trusted"], row["n_words"]) == (7, "x", "y", 27)
    assert R.quality_rules(docs, without_text=True).columns == ["doc_id", "row", "_grams", "trusted", *R.ADDED]


def test_verdicts(spark):
    path = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{path}/labels.parquet'").fetchall())
    rows = [(labels[r["doc_id"]], r["kept"]) for r in R.op2_rules(spark, path).collect() if r["doc_id"] in labels]
    good = [k for q, k in rows if q]
    bad = [k for q, k in rows if not q]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.1


def test_empty(no_documents):
    assert R.quality_rules(no_documents).count() == 0


def test_native_plan(spark, small):
    plan = R.op2_rules(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
