import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from loomstone.llm import quality as Q
from loomstone.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def auc(scores, labels):
    ranks = np.empty(len(scores))
    ranks[np.argsort(scores, kind="stable")] = np.arange(1, len(scores) + 1)
    good = labels == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def joined(spark, frame, label, path):
    rows = frame.join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").select("doc_id", "held_out", "score", "predicted", label).collect()
    return rows, np.array([r["score"] for r in rows]), np.array([r[label] for r in rows]), np.array([r["held_out"] for r in rows])


def test_quality(spark):
    rows, scores, labels, held = joined(spark, Q.op8_quality(spark, SF), "quality", SF)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert auc(scores[held], labels[held]) > 0.99 and ((scores[held] >= 0.5) == labels[held]).mean() > 0.98


def test_rules_compile(spark, odd_documents, no_documents):
    names = list(Q.STATISTICS)
    rng = np.random.default_rng(0)
    x = rng.random((400, len(names)))
    model = Q.train(x, (x[:, 2] > 0.5) & (x[:, 5] < 0.7), names)
    assert 0 < len(model.rules) < 60 and all(len(r) <= Q.DEPTH for _, r in model.rules)
    assert ((model.probabilities(x, names) > 0.5) == ((x[:, 2] > 0.5) & (x[:, 5] < 0.7))).mean() > 0.97
    scored = Q.score(odd_documents, model).collect()
    again = model.probabilities(np.array([[r[n] for n in names] for r in scored]), names)
    assert np.allclose([r["score"] for r in scored], again) and len(scored) == 12
    assert Q.score(no_documents, model).count() == 0
    flat = Q.train(np.zeros((0, len(names))), np.zeros(0), names)
    assert flat.rules == [] and 0 < Q.score(odd_documents, flat).first()["score"] < 1


def test_lasso_is_optimal():
    rng = np.random.default_rng(1)
    r = (rng.random((300, 6)) > 0.5).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * r[:, 0] - 1.5 * r[:, 1])))).astype(float)
    w, b = Q.lasso_logistic(r, y, 0.02, 4000)
    gradient = r.T @ (1 / (1 + np.exp(-(r @ w + b))) - y) / len(y)
    assert np.all(np.abs(gradient[w == 0]) <= 0.02 + 1e-4) and np.allclose(gradient[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-4)


def test_toxicity(spark):
    rows, scores, labels, held = joined(spark, T.op10_toxicity(spark, SF), "toxic", SF)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert auc(scores[held], labels[held]) > 0.95
    called = scores[held] >= 0.3
    assert called[labels[held] == 1].mean() > 0.7 and called[labels[held] == 0].mean() < 0.02


def test_unseen_spellings(spark, odd_documents, no_documents):
    rng = np.random.default_rng(2)
    plain = [f"w{rng.integers(0, 500)}od" for _ in range(500)]
    texts, labels = [], []
    for i in range(300):
        words = list(rng.choice(plain, 40))
        if i % 5 == 0:
            words[rng.integers(0, 40)] = rng.choice(["scoundrel", "scoundrels", "rapscallion"])
        texts.append(" ".join(words))
        labels.append(int(i % 5 == 0))
    model = T.train_calibrated(texts, labels)
    scorer = T.Scorer(model)
    for word in ("scoundrelly", "scoundrul", "rapscalions"):
        assert scorer.probability(" ".join(plain[:30]) + " " + word) > 0.3 > scorer.probability(" ".join(plain[:30]))
    scored = T.score(odd_documents, model).collect()
    assert len(scored) == 12 and all(0 <= r["score"] <= 1 for r in scored)
    kept = T.without_toxic(odd_documents, model)
    assert kept.columns == odd_documents.columns and kept.count() == sum(r["score"] < 0.3 for r in scored)
    assert T.score(no_documents, model).count() == 0
    assert 0 < T.Scorer(T.train([], [])).probability(None) < 1


def test_parts_do_not_matter(monkeypatch):
    model = T.Model(np.random.default_rng(0).normal(size=T.BUCKETS), -1.0)
    text = "word after word of text " * 40
    whole = T.Scorer(model).margin(text)
    monkeypatch.setattr(T, "PART", 24 * 7)
    assert abs(T.Scorer(model).margin(text) - whole) < 1e-9


def test_no_word_is_cut(monkeypatch):
    model = T.Model(np.random.default_rng(0).normal(size=T.BUCKETS), -1.0)
    for text in ("word after scoundrels, of text " * 40, "weft\u3000warp\u3002" * 60, "a " + "z" * 500 + " end", "z" * 333):
        monkeypatch.setattr(T, "PART", 1 << 20)
        whole = T.Scorer(model).margin(text)
        for size in (1, 50, 97):
            monkeypatch.setattr(T, "PART", size)
            assert "".join(T.text_parts(text)) == text and abs(T.Scorer(model).margin(text) - whole) < 1e-9


def test_whole_runs_are_read():
    """Words joined by other than ASCII blanks, and whatever stands after character 40 of an unbroken run."""
    words = ["plain", "scoundrel", "naïve", "woven"]
    for joint in "\U0001f600\u00a0\u3000\u3002\u2014\u200b\u00bb":
        assert T.tokens(joint.join(words)) == [w.encode() for w in words]
    assert T.tokens("हिन्दी ภาษาไทย") == ["हिन्दी".encode(), "ภาษาไทย".encode()]
    run = "".join(chr(0x4E00 + i * 7) for i in range(333))
    read = [p.decode() for p in T.tokens(run)]
    assert all(any(run[i : i + 10] in p for p in read) for i in range(len(run) - 9)) and all(p in run for p in read)
    assert T.tokens("x" * 40) == [b"x" * 40]
    model = T.Model(np.zeros(T.BUCKETS), 0.0)
    for i in T.gram_ids(b"scoundrel")[1:]:
        model.weights[i] = 5.0
    scorer = T.Scorer(model)
    for at in (5, 60, 997):
        assert scorer.margin("qz" * (at // 2) + "scoundrel" + "qz" * 500) > scorer.margin("qz" * 600) + 0.5


def test_sample_is_bounded(spark):
    """By rows alone: one text of a doc_id, however often it stands; labels without a document take no place."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert T.labelled_sample(docs, labels, "toxic", F.lit(True), 100).count() == 100
    many = spark.range(200_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))
    many = many.unionAll(spark.createDataFrame([(6, "z" * 300_000), (7, None)], "doc_id long, text string"))
    marks = spark.createDataFrame([(5, 0, 1), (5, 1, 0), (6, 1, 0), (7, 1, 1), (None, 1, 1)] + [(k, 0, 0) for k in range(100, 400)], "doc_id long, quality int, toxic int")
    sample = {r["doc_id"]: (r["text"], r["label"]) for r in T.labelled_sample(many, marks, "toxic", F.lit(True), 2).collect()}
    assert set(sample) == {5, 6} and sample[6] == ("z" * 300_000, 0) and sample[5][1] == 1
    assert 0 < T.Scorer(T.fit(many, marks.filter("doc_id > 6"))).probability("a text") < 1
    assert Q.fit(many, marks).rules == []


def test_folds_in_tasks_equal_folds_here(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = sorted(T.labelled_sample(docs, labels, "toxic", F.lit(True), 400).collect())
    want = T.train_calibrated([r["text"] for r in rows], [r["label"] for r in rows])
    got = T.fit(docs, labels, rows=400)
    assert np.array_equal(got.weights, want.weights) and got.bias == want.bias


def test_plain_softmax():
    """The collapsed model against the plain one: mean of n-gram vectors of a window, times the softmax's head."""
    rng = np.random.default_rng(3)
    vectors, head, bias = rng.normal(size=(T.BUCKETS, T.DIM)), rng.normal(size=(T.DIM, 2)), rng.normal(size=2)
    scorer = T.Scorer(T.Model(vectors @ (head[:, 1] - head[:, 0]), bias[1] - bias[0]))
    for text in ("Loom's weft, warp and   shuttle!", "one", "naïve\u00a0weavers " * 30):
        bags = [np.mean([vectors[i] for i in T.gram_ids(w)], 0) for w in T.tokens(text)]
        bags += [np.zeros(T.DIM)] * (T.WINDOW - len(bags))
        odds = [sum(bags[i : i + T.WINDOW]) / T.WINDOW @ head + bias for i in range(len(bags) - T.WINDOW + 1)]
        want = max(np.exp(o[1]) / np.exp(o).sum() for o in odds)
        assert abs(scorer.probability(text) - want) < 1e-5


def test_plain_statistics(spark, odd_documents):
    """The query's scores against statistics counted in Python and rules weighed in numpy."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").limit(300).unionByName(odd_documents.select("doc_id", "text"))
    model, names = Q.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels, ~Q.held_out(F.col("doc_id"))), list(Q.STATISTICS)
    per = lambda a, b: a / b if b else 0.0
    for r in Q.score(docs, model).collect():
        text = r["text"] or ""
        words, lines, dense = re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n"), re.sub(r"[\x20\x09-\x0D]", "", text)
        count = lambda chars: sum(c in chars for c in dense)  # noqa: B023, E731
        want = {
            "log_words": np.log1p(len(words)), "word_length": per(len(dense), len(words)), "upper": per(count(Q._UPPER), len(dense)),
            "digits": per(count("0123456789"), len(dense)), "marks": per(count(Q._MARKS), len(dense)), "bangs": per(count("!"), len(dense)),
            "bars": per(count("|"), len(words)), "stops": per(count(".,;:!?"), len(words)), "distinct_words": per(len(set(words)), len(words)),
            "repeated_next": per(sum(a == b for a, b in zip(words, words[1:])), len(words)), "distinct_lines": per(len(set(lines)), len(lines)),
            "line_words": np.log1p(per(len(words), len(lines))),
        }
        assert set(want) == set(names) and all(abs(r[n] - want[n]) < 1e-9 for n in names)
        total = model.bias + sum(w for w, rule in model.rules if all((r[n] > cut) == above for n, above, cut in rule))
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-9


def test_clashing_columns(spark):
    names = ["_words", "_dense", "_lines", "_hashes", "_solid", "_after", "row", "upper", "score"]
    docs = spark.createDataFrame([(1, "Weft and warp.", *range(9))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    model = Q.RuleEnsemble([(1.0, (("log_words", True, 0.5),))], -1.0)
    found = Q.score(docs, model)
    assert found.columns == ["doc_id", "text", *names[:7], *Q.STATISTICS, "score"]
    assert tuple(found.first())[2:9] == tuple(range(7)) and found.first()["score"] == 0.5
