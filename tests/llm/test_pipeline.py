import collections

import duckdb
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from loomstone.llm import toxicity as T
from loomstone.llm.mixing import mix_sql
from loomstone.llm.simhash import near_duplicates, simhash
from loomstone.llm.suffixes import LENGTH

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage on what the one before it kept, against a plain version of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = C.toxicity(spark, docs, SF).cache()
    model = T.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~T.held_out(F.col("doc_id")))
    scorer = T.Scorer(model)
    want = {r["doc_id"] for r in docs.collect() if scorer.probability(r["text"]) < T.THRESHOLD}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == columns

    unique = C.near_duplicates(spark, kept, SF).cache()
    assert {r["doc_id"] for r in unique.collect()} == {r["component_id"] for r in near_duplicates(kept).collect()} and unique.columns == columns

    cut = C.repeated_spans(spark, unique, SF).cache()
    texts = [r["text"].encode() for r in unique.collect()]
    counts = collections.Counter(b[i : i + LENGTH] for b in texts for i in range(len(b) - LENGTH + 1))
    after = {r["doc_id"]: r["text"] for r in cut.collect()}
    for r in unique.collect():
        b = r["text"].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - LENGTH + 1):
            if counts[b[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\x01" * LENGTH
        assert after[r["doc_id"]] == bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    assert cut.columns == columns

    mixed = C.mixture(spark, cut, SF).cache()
    con = duckdb.connect()
    con.register("frame", cut.toPandas())
    con.execute("CREATE TABLE documents AS SELECT * FROM frame")
    taken = con.execute(f"WITH {mix_sql()} SELECT doc_id, taken // size FROM m WHERE taken > 0").fetchall()
    assert sorted(taken) == sorted(collections.Counter(r["doc_id"] for r in mixed.collect()).items()) and mixed.columns == columns

    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(encoder.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert sum(r["length"] for r in C.packing(spark, mixed, SF).collect()) == tokens


def test_odd_rows_in_every_stage(spark, odd_documents, no_documents):
    """Stage by stage on nulls, repeats, ties and long texts, on an empty table, and beside columns of the names used inside."""
    inside = "size source_size target taken repeats threshold _k _h _key _hash _n row key hash name n_bytes n_removed n_spans kept_sha256 fp root text_hash _salt _parts block payload score".split()
    more = odd_documents.drop("size").select("*", *[F.lit(i).alias(n) for i, n in enumerate(inside)])
    for docs in (odd_documents, no_documents, more):
        for name, stage in C.STAGES[:-1]:
            after = C.materialize(stage(spark, docs, SF), name)
            assert after.columns == docs.columns, name
            if docs is more:
                assert all(tuple(r[n] for n in inside) == tuple(range(len(inside))) for r in after.collect()), name
            if name == "repeated_spans":
                assert after.count() == docs.count()
            if docs is no_documents:
                assert after.count() == 0
            docs = after if docs is not more else docs
        pieces = C.STAGES[-1][1](spark, docs, SF)
        assert (pieces.count() == 0) == (docs.count() == 0)


def test_run(spark):
    pieces = C.run(spark, SF).collect()
    windows = collections.Counter()
    for p in pieces:
        windows[p["sequence_id"]] += p["length"]
    assert pieces and max(windows.values()) <= 2048
    assert 4 <= len(C.STAGES) <= 5 and C.ORACLE_SQL is None


def test_near_duplicates_take_few_jobs(spark):
    """Texts of which each links to the next alone are not followed in rounds that the driver plans one by one."""
    words = [f"w{i}" for i in range(3000)]
    chain = [(i, " ".join(words[: 3000 - 2 * i]), "en", "a", 1) for i in range(160)]
    docs = spark.createDataFrame(chain, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    prints = [simhash(r[1].encode()) for r in chain]
    linked = [[j for j in range(160) if (prints[i] ^ prints[j]).bit_count() <= 2] for i in range(160)]
    roots, before = list(range(160)), None
    while roots != before:
        before, roots = roots, [min(roots[j] for j in near) for near in linked]
    spark.sparkContext.setJobGroup("chain", "near_duplicates")
    try:
        kept = sorted(r["doc_id"] for r in C.near_duplicates(spark, docs, SF).select("doc_id").collect())
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert kept == sorted(set(roots)) and len(kept) < 100
    assert jobs <= 45
