"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio, in DataFrame functions alone.

Tokens are runs of letters and digits, or of other visible characters. Their unigrams and bigrams are
hashed into a fixed number of buckets; one multinomial is counted over the whole raw corpus, another
over its trusted part (documents that pass the base rules and repeat nothing), and a document's score is the
mean log ratio of its n-grams' buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, materialize, rows_apart, table, words_of

SYMBOLS = "#*$%&|<>"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"
#: Buckets of the hashed n-grams (a fixed bound on what is collected) and the least mean log ratio kept.
BUCKETS, THRESHOLD = 8192, -0.12
#: A document is trusted if it passes the base rules, has this many words, repeats nothing and marks up little.
TRUSTED_WORDS, TRUSTED_SYMBOLS = 50, 0.005
MIN_WORDS, MAX_REPEAT, WINDOW = 10, 20, 5
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]


def _with_repeats(rows: DataFrame) -> DataFrame:
    """`rows` with n_repeat_words, the words covered by a window (of _windows) found twice or more.

    Texts whose windows are all distinct go through with nulls; each array is a column of its own, so
    that it is made once.
    """
    unique = F.size(F.array_distinct("_windows")) == F.size("_windows")
    numbered = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_ordered", F.when(~unique, numbered))
    rows = rows.withColumn("_after", F.slice("_ordered", 2, F.size("_ordered")))
    # the places of a window and of its successor in hash order, where both are equal
    equal = F.zip_with("_ordered", "_after", lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    rows = rows.withColumn("_starts", F.sort_array(F.array_distinct(F.flatten(F.array_compact(equal)))))
    rows = rows.withColumn("_later", F.slice("_starts", 2, F.size("_starts")))
    gaps = F.zip_with("_starts", "_later", lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda n, gap: n + gap)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long")))


def base_counts(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (null text: the empty one)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACE_CHARS, "")) > 0)
    rows = docs.withColumns({"_words": F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)), "_lines": lines})
    starts = F.slice("_words", 1, F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0)))
    window = lambda h, i: F.xxhash64(h, *[F.get("_words", i + k) for k in range(1, WINDOW)])
    rows = _with_repeats(rows.withColumn("_windows", F.transform(starts, window)))
    return rows.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def with_ngrams(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """`rows` with _grams: the buckets of the token unigrams and bigrams of their text.

    The last token also pairs with the end. Each array is a column of its own, so that it is made once.
    """
    tokens = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(TOKEN), F.lit(0))
    rows = rows.withColumn("_tokens", F.transform(tokens, lambda t: F.xxhash64(t)))
    rows = rows.withColumn("_next", F.slice("_tokens", 2, F.greatest(F.size("_tokens"), F.lit(1))))
    pairs = F.zip_with("_tokens", "_next", lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))
    singles = F.transform("_tokens", lambda a: F.pmod(a, F.lit(buckets)).cast("int"))
    return rows.withColumn("_grams", F.concat(singles, pairs)).drop("_tokens", "_next")


def log_ratios(rows: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log(trusted / raw) of each bucket, add-one smoothed, over all of `rows` (_grams, trusted)."""
    grams = rows.select("trusted", F.explode("_grams").alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("trusted").alias("good")).collect()
    raw, good = [1.0] * buckets, [1.0] * buckets
    for row in counts:  # at most `buckets` rows
        raw[row["bucket"]] += row["raw"]
        good[row["bucket"]] += row["good"]
    all_raw, all_good = sum(raw), sum(good)
    return [math.log(g / all_good) - math.log(r / all_raw) for g, r in zip(good, raw)]


def mean_ratio(ratios: list[float]) -> Column:
    """The mean log ratio of the buckets in _grams; 0 for a text without tokens."""
    known = F.split(F.lit(",".join(f"{x:.9g}" for x in ratios)), ",").cast("array<double>")
    total = F.aggregate("_grams", F.lit(0.0), lambda s, b: s + F.get(known, b))
    return F.coalesce(F.try_divide(total, F.size("_grams")), F.lit(0.0))


def trusted() -> Column:
    """Which rows of base_counts() make up the trusted target."""
    sparse = F.col("n_symbols") <= TRUSTED_SYMBOLS * F.col("word_chars")
    return ~base_failed() & (F.col("n_words") >= TRUSTED_WORDS) & (F.col("n_repeat_words") == 0) & (F.col("n_dup_lines") == 0) & sparse


def quality_rules(docs: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, is_trusted: Column | None = None, without_text: bool = False) -> DataFrame:
    """Every row of `docs` (text, …) with its base counts, base_failed, llr and kept.

    Null texts count as empty ones, and texts of fewer than ten words fail; a text of any length is one
    row's arrays, a few bytes for each of its own; repeated rows are judged alike, and a mean log ratio of
    just `threshold` is kept; an empty table gives an empty result; columns of `docs` named like the added
    ones are replaced, all others stay. With no trusted row at all the ratio is flat up to smoothing and
    the base rules decide. `is_trusted` may name another trusted target, over the columns of base_counts().

    Each text is read once: its counts and buckets are written to the shared folder, counted over all rows
    there, and judged by what was counted. `without_text` leaves the text column out of the result.
    """
    names = [c for c in docs.columns if c not in ADDED and not (without_text and c == "text")]
    rows = rows_apart(docs, names, text=F.col("text").cast("string"))
    counted = with_ngrams(base_counts(rows), buckets).drop("text")
    counted = counted.withColumn("base_failed", base_failed()).withColumn("trusted", trusted() if is_trusted is None else is_trusted)
    staged = materialize(counted, "rules", compression="zstd")
    judged = staged.withColumn("llr", mean_ratio(log_ratios(staged, buckets)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).select("row.*", *ADDED)


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), without_text=True)
