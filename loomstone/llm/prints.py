"""Document fingerprints from prefix polynomial hashes.

S[i] is the sum of code point j times R^j over j < i, modulo a Mersenne prime, for two bases R. The
arrays answer whether any two spans are equal, and longest common extensions follow by binary
search. A fingerprint samples both arrays at the multiples of a power of two (its grid), from the front and
from the back; the difference of neighbouring samples names the span between them, so that two
fingerprints tell which spans of their texts are equal, counted from either end.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, table

PRIME = (1 << 31) - 1
BASES = (1_000_003, 48_271)
#: A fingerprint has at most this many samples from the front, and as many from the back.
SAMPLES = 32
#: Documents go to this many ranges of doc_id for each shuffle partition, or to more: of about this many bytes of text each.
RANGES_PER_PARTITION, RANGE_BYTES = 2, 64 << 20


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME for 0 <= x < 2^62."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


class Powers:
    """R^0, R^1, … modulo PRIME for each base R, as long as needed so far."""

    def __init__(self, bases: tuple[int, ...] = BASES) -> None:
        self._bases, self._known = bases, np.ones((len(bases), 1), np.int64)

    def upto(self, n: int) -> np.ndarray:
        while self._known.shape[1] < n:
            size = self._known.shape[1]
            step = np.array([[pow(r, size, PRIME)] for r in self._bases], np.int64)
            self._known = np.concatenate([self._known, _fold(self._known * step)], axis=1)
        return self._known[:, :n]


_POWERS = Powers()
_INVERSES = Powers(tuple(pow(r, PRIME - 2, PRIME) for r in BASES))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def prefix_hashes(points: np.ndarray, powers: Powers = _POWERS) -> np.ndarray:
    """S[0 … n] for both bases."""
    terms = _fold((points + 1) * powers.upto(len(points)))
    out = np.zeros((len(BASES), len(points) + 1), np.int64)
    np.cumsum(terms, axis=1, out=out[:, 1:])  # below 2^62 for up to 2^31 code points
    return _fold(out)


def spans_equal(x: np.ndarray, a: int, y: np.ndarray, b: int, length: int, powers: Powers = _POWERS) -> bool:
    """Whether x's span [a, a + length) equals y's span [b, b + length), by their prefix arrays."""
    of_x, of_y = (x[:, a + length] - x[:, a]) % PRIME, (y[:, b + length] - y[:, b]) % PRIME
    shift = powers.upto(abs(a - b) + 1)[:, abs(a - b)]
    return bool(np.all(of_x * shift % PRIME == of_y) if b >= a else np.all(of_y * shift % PRIME == of_x))


def common_extension(x: np.ndarray, a: int, y: np.ndarray, b: int, powers: Powers = _POWERS) -> int:
    """The most code points that x from a on and y from b on have in common: doubled while equal, then searched."""
    low, most = 0, min(x.shape[1] - a, y.shape[1] - b) - 1
    high = min(1, most)
    while low < high and spans_equal(x, a, y, b, high, powers):
        low, high = high, min(2 * high, most)
    while low < high:
        middle = (low + high + 1) // 2
        if spans_equal(x, a, y, b, middle, powers):
            low = middle
        else:
            high = middle - 1
    return low


def joined_at(x: np.ndarray, keep: int, y: np.ndarray, take: int, at: np.ndarray, powers: Powers = _POWERS) -> np.ndarray:
    """Prefix hashes at the places `at` of x's first `keep` code points followed by y's first `take`."""
    inside = np.minimum(at, keep)
    beyond = np.clip(at - keep, 0, take)
    shift = powers.upto(keep + 1)[:, keep : keep + 1]
    return _fold(x[:, inside] + _fold(y[:, beyond] * shift))


def step_of(n: int, samples: int = SAMPLES) -> int:
    """The least power of two whose multiples up to n are `samples` at most."""
    step = 1
    while n // step > samples:
        step *= 2
    return step


def grid(n: int, samples: int = SAMPLES) -> np.ndarray:
    """The multiples of step_of(n), up to n."""
    step = step_of(n, samples)
    return np.arange(step, n + 1, step)


def render(n: int, front: np.ndarray, back: np.ndarray) -> str:
    """n, the samples from the front, and the hashes of the tails that end a multiple of the grid's step early."""
    told = lambda h: "".join(f"{a:08x}{b:08x}" for a, b in h.T.tolist())
    return f"{n:x}.{told(front)}.{told(back)}"


def fingerprint_at(n: int, at) -> str:
    """The fingerprint of a text of n code points; `at` gives its prefix hashes at places."""
    places = grid(n)
    if not len(places):
        return render(n, np.zeros((2, 0), np.int64), np.zeros((2, 0), np.int64))
    return render(n, at(places), _tails(n, at, places))


def _tails(n: int, at, places: np.ndarray) -> np.ndarray:
    """Hashes of the last 1, 2, … steps of the text, shifted to start at 0 so that they compare across texts."""
    whole, cut = at(np.array([n])), at(n - places)
    return _fold((whole - cut) % PRIME * _INVERSES.upto(n)[:, n - places])


def parse(fingerprint: str) -> tuple[int, np.ndarray, np.ndarray]:
    """The text's length, and the samples from the front and from the back, an array of both hashes each."""
    n, front, back = fingerprint.split(".")
    read = lambda s: np.frombuffer(bytes.fromhex(s), ">u4").astype(np.int64).reshape(-1, len(BASES)).T
    return int(n, 16), read(front), read(back)


def _spans(samples: np.ndarray, every: int, count: int, weight: np.ndarray) -> np.ndarray:
    """Names of the spans between every `every`-th sample: each sample less `weight` times the one before."""
    at = np.concatenate([np.zeros((len(BASES), 1), np.int64), samples[:, every - 1 : every * count : every]], axis=1)
    return (at[:, 1:] - weight * at[:, :-1]) % PRIME


def _covered(front: np.ndarray, back: np.ndarray, n: int, step: int) -> int:
    """Code points of a text of length n in the spans `front` from its start and `back` from its end."""
    a, b = front * step, n - (back + 1) * step
    shared = np.minimum(a[:, None], b[None, :]) + step - np.maximum(a[:, None], b[None, :])
    return (len(a) + len(b)) * step - int(np.maximum(shared, 0).sum())


def likeness(a: str, b: str) -> float:
    """How much of the longer text stands in spans that are equal in both, counted from the front or from the back: 0 to 1.

    The spans are those of the coarser grid: between a 32nd and a 16th of the longer text.
    """
    if a == b:
        return 1.0
    (n, front_a, back_a), (m, front_b, back_b) = parse(a), parse(b)
    if not n or not m:
        return 0.0
    step_a, step_b = step_of(n), step_of(m)
    step = max(step_a, step_b)
    count = min(n, m) // step
    if not count:
        return 0.0
    unit, jump = np.ones((len(BASES), 1), np.int64), _POWERS.upto(step + 1)[:, step : step + 1]
    same = []
    for x, y, weight in ((front_a, front_b, unit), (back_a, back_b, jump)):
        of_x, of_y = _spans(x, step // step_a, count, weight), _spans(y, step // step_b, count, weight)
        same.append(np.flatnonzero((of_x == of_y).all(axis=0)))
    common = min(_covered(*same, n, step), _covered(*same, m, step))
    return common / max(n, m)


def edited_prints(text: str, donor: str, x: np.ndarray, y: np.ndarray) -> tuple[str, str, int]:
    """Of `text` with its last third replaced by the first code points of `donor`: sha256, fingerprint, and the code points up to the first change."""
    n = len(text)
    cut = n // 3
    keep, take = n - cut, min(cut, len(donor))
    digest = hashlib.sha256((text[:keep] + donor[:take]).encode("utf-8", "surrogatepass")).hexdigest()
    same = keep + min(common_extension(x, keep, y, 0), take)
    return digest, fingerprint_at(keep + take, lambda at: joined_at(x, keep, y, take, at)), same


_FIELDS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("same_edited", pa.int64()), ("same_next", pa.int64()),
]


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_range, _lent, doc_id, text) in order; a row's next is the one after it in its range."""
    held = None
    out: list[tuple] = []
    schema = pa.schema(_FIELDS)
    for batch in batches:
        for place, lent, doc_id, text in rows_of(batch):
            if held is not None and held[0] != place:
                held = None
            if held is not None and lent and held[1]:
                continue  # a lent row only closes its range; of several equal ones the first does
            x = prefix_hashes(code_points(text))
            now = (place, lent, doc_id, text, x, fingerprint_at(len(text), lambda at, x=x: x[:, at]))
            if held is not None:
                digest, changed, same = edited_prints(held[3], text, held[4], x)
                following = common_extension(held[4], 0, x, 0)
                out.append((held[2], len(held[3]), digest, held[5], changed, likeness(held[5], changed), likeness(held[5], now[5]), same, following))
            held = now
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), _FIELDS)], schema=schema)
            out = []


def _place(bounds: list[int], hot: dict[int, int], nulls: int) -> Column:
    """The range of a row (doc_id, _tie), in descending order of both; nulls are last.

    `bounds` are the least ids of the ranges but the last, in descending order. The rows of a `hot` id have
    as many ranges of their own as it says, after those of the ids above it, and null ids have `nulls`.
    """
    shares = lambda n: (F.lit(n - 1) - F.floor((F.col("_tie") / 2.0**64 + 0.5) * n)).cast("int")
    part = lambda n: F.greatest(F.lit(0), F.least(shares(n), F.lit(n - 1)))
    base, offsets = F.lit(0), [0]
    for b in bounds:
        offsets.append(offsets[-1] + 1 + hot.get(b, 0))
    if bounds:  # how many bounds are above the id: looked up among every WIDE-th one, then among those between
        array = lambda numbers: F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")
        above = lambda numbers: F.size(F.filter(numbers, lambda c: c > F.col("doc_id")))
        wide = max(1, math.isqrt(len(bounds)))
        coarse = above(array(bounds[::wide]))
        start = F.greatest(coarse - 1, F.lit(0)) * wide
        base = start + above(F.slice(array(bounds), start + 1, F.lit(wide)))
    place = F.get(F.split(F.lit(",".join(map(str, offsets))), ",").cast("array<int>"), base.cast("int"))
    for v, n in hot.items():  # more than a range's share of all rows: fewer than there are ranges
        place = F.when(F.col("doc_id") == v, F.lit(offsets[bounds.index(v)] + 1) + part(n)).otherwise(place)
    return F.when(F.col("doc_id").isNull(), F.lit(offsets[-1] + 1) + part(max(1, nulls))).otherwise(place).cast("int")


def document_prints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every row of `docs` (doc_id, text) and of its edited text, with same_edited and same_next: the code points
    that the text has in common with its edited text and with the next one from the front, by common_extension().

    The next document is the one that follows in descending doc_id (null ids last; ties by text
    hash), and after the last comes the first. Rows are dealt to ranges of doc_id, those of an id (or of
    none) that fills ranges to ranges of text hash, and the first row of each range is lent to the range
    before it: only one row per range is known outside it. Null texts are empty; a text of any length
    is one row's arrays; repeated rows follow each other (rows equal in both share a range); a single row
    follows itself; further columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, nulls, size = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.sum(F.octet_length("text"))).first()
    ranges = ranges or max(RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // RANGE_BYTES))
    cuts = [int(c) for c in rows.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.25 / ranges)] if ranges > 1 else []
    hot = {c: times for c, times in Counter(cuts).items() if times > 1}
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    rows = rows.withColumn("_range", _place(sorted(set(cuts), reverse=True), hot, ranges * nulls // max(1, n)))
    lead = F.struct(F.col("doc_id").isNotNull().alias("set"), F.col("doc_id"), F.col("_tie"))
    firsts = {r["_range"]: r["f"] for r in rows.groupBy("_range").agg(F.max(lead).alias("f")).collect()}  # one row for each range
    filled = sorted(firsts)
    heads = [(k, firsts[k]["doc_id"], firsts[k]["_tie"], filled[i - 1]) for i, k in enumerate(filled)]
    rows = rows.join(F.broadcast(spark.createDataFrame(heads, "_range int, _fid long, _ftie long, _to int")), "_range")
    lent = F.when(F.col("doc_id").eqNullSafe(F.col("_fid")) & (F.col("_tie") == F.col("_ftie")), F.col("_to"))
    targets = F.array_compact(F.array(F.struct(F.col("_range").alias("to"), F.lit(False).alias("lent")), F.when(lent.isNotNull(), F.struct(lent.alias("to"), F.lit(True).alias("lent")))))
    dealt = rows.withColumn("_at", F.explode(targets)).select(F.col("_at.to").alias("_range"), F.col("_at.lent").alias("_lent"), "doc_id", "_tie", "text")
    ordered = dealt.repartition(max(1, len(filled)), "_range").sortWithinPartitions("_range", "_lent", F.col("doc_id").desc_nulls_last(), F.col("_tie").desc())
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_edited long, same_next long"
    return ordered.select("_range", "_lent", "doc_id", "text").mapInArrow(_follow, schema)


def op6_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_prints(table(spark, sf_dir, "documents"))
