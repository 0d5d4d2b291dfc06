"""Quality rules: fixed measures of a text and a hashed n-gram likelihood ratio.

Everything here is DataFrame functions; no Python runs on executors.

Measures: words ``[^\\x20\\x09-\\x0D]+``, their code points, the characters
``#*$%&|<>``, repeated lines and words in repeated 3-word windows; a text fails
with under 50 words or if over half of its words stand in repeated windows.

Verdict of the rest: tokens are runs of letters, digits and ``_`` or runs of
other signs. Unigrams and bigrams are hashed into ``BUCKETS`` buckets. Two
smoothed multinomials over the buckets are counted: one of trusted texts (label
quality 1), one of the raw corpus (every document). A text's score is the mean
over its n-grams of log(p_trusted / p_raw); it is kept if the score is at least
``THRESHOLD``. The same threshold decides every document; nothing is drawn at
random. The trusted side is fitted on at most ``TRUSTED_MOST`` labelled texts,
those first in the order of a hash of their ids; the raw side covers all texts.
The weights (one double for each bucket) are all that reaches the driver.

Defined results: a null or empty text has no words and fails; without trusted
texts or without documents every score is 0; equal rows are judged alike, each
row by itself; extra columns are ignored by the measures and kept by the filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_id

BUCKETS = 10_000
#: Added to each bucket's count on either side.
SMOOTHING = 1.0
#: The lowest mean log ratio that is kept.
THRESHOLD = -0.25
#: Labelled texts that the trusted side is fitted on at most.
TRUSTED_MOST = 20_000
MIN_WORDS, REPEAT_PERCENT = 50, 50

_SPACE, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
_TOKEN = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def _windows(words: Column, n: Column) -> Column:
    """Hash of each 3-word window, by its first word's place."""
    return F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    )


def measures(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    and base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = rows.withColumn("_words", _words(body))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(_WORD))
    df = df.withColumn("_lines", lines).withColumn("_windows", _windows(F.col("_words"), F.size("_words")))
    df = df.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    # only texts with a repeat sort their windows (with places); a window that equals a neighbour in that order is repeated
    placed = F.when(F.col("_repeats"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_sorted", placed)
    near = lambda s, i: (F.get(F.col("_sorted"), i - 1)["h"].eqNullSafe(s["h"])) | (F.get(F.col("_sorted"), i + 1)["h"].eqNullSafe(s["h"]))
    df = df.withColumn("_places", F.array_sort(F.transform(F.filter("_sorted", near), lambda s: s["i"])))
    # windows at ascending places cover 3 words each, less what the window before covers
    new = lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(F.col("_places"), i - 1)))
    covered = F.aggregate(F.transform("_places", new), F.lit(0), lambda a, x: a + x)
    return df.select(
        *rows.columns,
        "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), 0)


def _grams(tokens: Column) -> tuple[Column, Column]:
    """Buckets of the unigrams and of the bigrams of an array of tokens."""
    single = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"))
    double = F.transform(tokens, lambda t, i: F.when(i > 0, F.pmod(F.xxhash64(F.get(tokens, i - 1), t), F.lit(BUCKETS)).cast("int")))
    return single, double


def bucket_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n): hashed unigram and bigram counts over all rows."""
    df = rows.select(_tokens(F.col(text)).alias("t"))
    # word and word before side by side, so that hashing runs in generated code
    pairs = df.select(F.posexplode(F.arrays_zip(F.col("t").alias("t"), F.concat(F.array(F.lit(None).cast("string")), F.col("t")).alias("p"))))
    pairs = pairs.select(F.col("col.t").alias("t"), F.col("col.p").alias("p")).where("t IS NOT NULL")
    one, two = F.pmod(F.xxhash64("t"), F.lit(BUCKETS)), F.when(F.col("p").isNotNull(), F.pmod(F.xxhash64("p", "t"), F.lit(BUCKETS)))
    grams = pairs.select(F.explode(F.array(one.cast("int"), two.cast("int"))).alias("bucket")).where("bucket IS NOT NULL")
    return grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def trusted(docs: DataFrame, labels: DataFrame, most: int = TRUSTED_MOST, key: str = "doc_id") -> DataFrame:
    """The rows of at most ``most`` documents labelled good."""
    ids = labels.where("quality = 1").select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct()
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(most)
    return docs.join(F.broadcast(ids), docs[key] == ids["_id"], "left_semi")  # `most` ids at most


def weights(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", most: int = TRUSTED_MOST) -> list[float]:
    """log(p_trusted / p_raw) by bucket; zeros if either side has no n-grams."""
    sides = []
    for rows in (trusted(docs, labels, most, key), docs):
        n = [0] * BUCKETS
        for bucket, k in bucket_counts(rows, text).collect():  # BUCKETS rows at most
            n[bucket] = k
        sides.append(n)
    totals = [sum(n) for n in sides]
    if not all(totals):
        return [0.0] * BUCKETS
    p, q = ([(k + SMOOTHING) / (total + SMOOTHING * BUCKETS) for k in n] for n, total in zip(sides, totals, strict=True))
    return [math.log(a / b) for a, b in zip(p, q, strict=True)]


def score(text: Column, weight: list[float]) -> Column:
    """Mean log ratio over a text's unigrams and bigrams; 0 without any."""
    table = F.lit(weight)
    tokens = _tokens(text)

    def add(acc: Column, t: Column) -> Column:
        one = F.get(table, F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"))
        two = F.when(acc["last"].isNull(), F.lit(0.0)).otherwise(F.get(table, F.pmod(F.xxhash64(acc["last"], t), F.lit(BUCKETS)).cast("int")))
        return F.struct((acc["sum"] + one + two).alias("sum"), t.alias("last"), (acc["n"] + 1).alias("n"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"))
    return F.aggregate(tokens, start, add, lambda acc: F.when(acc["n"] == 0, F.lit(0.0)).otherwise(acc["sum"] / (2 * acc["n"] - 1)))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, measures, base_failed, score, kept): one row per input row."""
    weight = weights(docs, labels, text, key)
    df = measures(docs.select(row_id(key).alias("doc_id"), F.col(text).alias("_text")), "_text")
    df = df.withColumn("score", score(F.col("_text"), weight)).drop("_text")
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that pass, columns as they came."""
    weight = weights(docs, labels, text, key)
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text].alias("_text"))
    df = measures(held, "_text").withColumn("_score", score(F.col("_text"), weight))
    # inline() and not where(): a filter would be pushed below and repeat the measures' expressions
    return df.select(F.inline(F.when(~F.col("base_failed") & (F.col("_score") >= threshold), F.array("_row"))))
