import random
import re

import duckdb
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from loomstone.llm import common as C
from loomstone.llm import simhash as S


def brute_print(text):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(prints)]


def test_against_brute_force(spark, small):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    want = brute_components([(d, brute_print(t)) for d, t in rows])
    assert sorted(map(tuple, S.op7_simhash(spark, small).collect())) == sorted(want)


def test_odd_rows(odd_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    want = brute_components([(d, brute_print(t)) for d, t in rows])
    got = [(r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in S.near_duplicates(odd_documents).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_chain_of_links(spark):
    chain = [0]
    for bit in range(0, 60, 2):  # each two bits from the last, the ends far apart
        chain.append(chain[-1] ^ (3 << bit))
    prints = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in chain] + [((1 << 62) - 1 - 7,)], "fp long")
    found = {r["node"]: r["root"] for r in S.components(S.link_stars(prints)).collect()}
    assert {found.get(p, p) for p in chain} == {0}


def test_tables_and_verification(spark):
    """Balls within segments fetch more than is linked; crowded buckets lose no link; against all pairs."""
    rng = random.Random(4)
    prints = {0}
    for _ in range(12):
        seed = rng.getrandbits(64)
        for _ in range(25):
            prints.add(seed ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) % 2**64)
    half = rng.getrandbits(32) << 32  # many that share a segment or are a bit away from it
    for _ in range(120):
        low = rng.getrandbits(6)
        prints |= {half | low, half ^ (1 << rng.randrange(32, 64)) | low}
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    frame = spark.createDataFrame(signed, "fp long")
    root = {p: p for (p,) in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for i, (x,) in enumerate(signed):
        for (y,) in signed[:i]:
            if ((x ^ y) % 2**64).bit_count() <= 2:
                pairs += 1
                root[max(find(x), find(y))] = min(find(x), find(y))
    for bucket in (1, 10, 10_000):
        found = {r["node"]: r["root"] for r in S.components(S.link_stars(frame, bucket)).collect()}
        assert {p: found.get(p, p) for (p,) in signed} == {p: find(p) for (p,) in signed}
    candidates = S.fetched(S.segment_table(frame)).selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()
    assert S.verified(candidates).count() == pairs < candidates.count()


def test_hot_rows_are_spread(spark, monkeypatch):
    """Keys of more rows than a task takes, rows that all repeat, and columns named like those made inside."""
    monkeypatch.setattr(C, "HOT", 40)
    monkeypatch.setattr(S, "HOT", 40)
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "" if i % 3 == 0 else words if i % 3 == 1 else f"{words} {i}", "a", "b", 1, 2) for i in range(200)] + [(1, words, "a", "b", 1, 2)] * 90
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, hash string, row int, turn int").repartition(4)
    want = brute_components([(r[0], brute_print(r[1])) for r in rows])
    got = [(r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in S.near_duplicates(docs).collect()]
    assert sorted(got) == sorted(want)
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({w[2] for w in want})


def test_parts_do_not_matter(monkeypatch):
    text = ("weft and warp " * 400 + "x" * 900 + " end").encode()
    whole = S.simhash(text)
    monkeypatch.setattr(S, "PART", 64)
    assert S.simhash(text) == whole == brute_print(text.decode())


def test_one_of_each(odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    kept = S.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    kept = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = {}
    prints = [(d, brute_print(t)) for d, t in rows]
    for i, p in enumerate(prints):
        same = next((g for g in groups if any((p[1] ^ prints[k][1]).bit_count() <= 2 for k in groups[g])), i)
        groups.setdefault(same, []).append(i)
    assert len(kept) == len(groups)
    assert set(kept) <= set(rows)
    assert S.one_of_each(no_documents).count() == 0 and S.near_duplicates(no_documents).count() == 0


def test_long_chains_take_few_jobs(spark, monkeypatch):
    """Links are folded within tasks before stars are made: the driver plans one pair of steps where a task holds all; tasks that hold few links find the same."""
    rng = random.Random(8)
    nodes = [rng.getrandbits(64) - (1 << 63) for _ in range(900)]
    links = [*zip(nodes[:600], nodes[1:600]), *zip(nodes[600:], nodes[601:]), (nodes[0], nodes[400]), (nodes[7], nodes[7])]
    frame = spark.createDataFrame(rng.sample(links, len(links)), "a long, b long").repartition(3)
    want = {n: min(part) for part in (nodes[:600], nodes[600:]) for n in part if n != min(part)}
    spark.sparkContext.setJobGroup("chains", "components")
    try:
        found = S.components(frame).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chains"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["node"]: r["root"] for r in found} == want and len(found) == len(want)
    assert jobs <= 30
    monkeypatch.setattr(S, "LINKS", 200)
    assert {r["node"]: r["root"] for r in S.components(frame).collect()} == want


def test_runs_of_links(monkeypatch):
    """Runs keep what is reachable, whatever their length; no links give none."""
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in links[k : k + 90]], pa.int64()) for i in (0, 1)], ["u", "v"]) for k in range(0, 260, 90)]

    def reached(pairs):
        root = {n: n for n in range(300)}
        for _ in range(300):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    for run in (1, 7, 10_000):
        monkeypatch.setattr(S, "RUN", run)
        folded = [(r["u"], r["v"]) for batch in S._folded(iter(batches)) for r in batch.to_pylist()]
        assert reached(folded) == reached(links) and all(u > v for u, v in folded)
        assert run == 1 or len(folded) <= 260
    assert dict(folded) == {n: r for n, r in reached(links).items() if n != r}
    assert sum(batch.num_rows for batch in S._folded(iter([]))) == 0


def test_exploded_rows_are_not_broadcast(spark, tmp_path):
    """At Spark's own threshold: the planner counts 33 probes a segment as one, and the driver would build a table of them that grows with the input."""
    rng = random.Random(10)
    prints = [rng.getrandbits(62) for _ in range(2000)]
    prints += [p ^ 5 for p in prints[:50]]
    spark.createDataFrame([(p,) for p in prints], "fp long").write.parquet(f"{tmp_path}/prints")
    found = S.fetched(S.segment_table(spark.read.parquet(f"{tmp_path}/prints")))
    pairs = {frozenset(r) for r in S.verified(found).collect() if r["a"] != r["b"]}
    assert pairs >= {frozenset((p, p ^ 5)) for p in prints[:50]}
    found.collect()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    small = spark.range(300).select("id", F.col("id").alias("there"))
    attached = C.attach_small(spark.range(1000), small, ["id"], limit=100)
    assert sum(r["there"] is not None for r in attached.collect()) == 300 and attached.count() == 1000
    assert "BroadcastHashJoin" not in attached._jdf.queryExecution().executedPlan().toString()
