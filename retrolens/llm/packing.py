"""Packing by optimal length buckets.

One pass counts the lengths of all documents (words). A dynamic programme over
that global histogram chooses the bucket boundaries that waste the fewest
padded words for a given number of buckets; inside each bucket, batches of as
many rows form as keep rows times boundary within the token budget.

The histogram has a row for each distinct length, so the choice is optimal. It is
collected: D distinct lengths take D * D / 2 words of text at least, so 100 TB
hold a few million of them at the very most. The cost of a bucket is its upper
bound times its rows, a line in the bound, so each step of the programme is the
lower envelope of lines whose slopes and queries both go one way: it takes a time
in proportion to D for each bucket.

Rows of a bucket are numbered without collecting the bucket: they are dealt
into shards by hash, numbered within, and shifted by the sizes of the shards
before. So every batch but a bucket's last is full.

Defined results: null, empty and blank texts have length 0 and go to the first
bucket; equal rows are packed separately; a text longer than the budget has a
batch of its own; ties in length share a bucket; an empty table gives an empty
result. An id that is no integer is carried as null; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, row_id

BUCKETS, TOKEN_BUDGET = 16, 65_536
#: Rows of a shard, about.
SHARD_ROWS = 20_000


def length_of(text: str) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def best_boundaries(lengths: list[int], count: list[int], buckets: int) -> list[int]:
    """Upper bounds of the buckets with the least padding; ``lengths`` ascending
    and distinct, each with its number of rows."""
    n = len(lengths)
    if not n or buckets < 1:
        return []
    rows = [0]
    for c in count:
        rows.append(rows[-1] + c)
    k = min(buckets, n)
    # best[j]: least sum of bound times rows over the first j lengths; the words themselves are the same in any case
    best = [0, *(lengths[j] * rows[j + 1] for j in range(n))]
    choice = np.zeros((k, n + 1), np.int32)
    for b in range(1, k):
        new, line, slope, at, head = [0] * (n + 1), [], [], [], 0
        for j in range(b + 1, n + 1):
            # a last bucket that begins after i lengths costs line - slope * x at the bound x
            i = j - 1
            here, fall = best[i], rows[i]
            x = lengths[j - 1]
            while len(line) - head > 1 and (here - line[-2]) * (slope[-1] - slope[-2]) <= (line[-1] - line[-2]) * (fall - slope[-2]):
                line.pop()
                slope.pop()
                at.pop()
            line.append(here)
            slope.append(fall)
            at.append(i)
            while len(line) - head > 1 and line[head + 1] - slope[head + 1] * x < line[head] - slope[head] * x:
                head += 1
            new[j] = line[head] - slope[head] * x + x * rows[j]
            choice[b, j] = at[head]
        best = new
    bounds, j = [], n
    for b in range(k - 1, -1, -1):
        bounds.append(lengths[j - 1])
        j = int(choice[b, j])
    return bounds[::-1]


def histogram(lengths: DataFrame, length: str = "n") -> tuple[list[int], list[int]]:
    """The global histogram: distinct lengths and their rows."""
    got = lengths.groupBy(F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("rows")).toArrow().sort_by("length")
    return got.column("length").to_pylist(), got.column("rows").to_pylist()


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, bucket, bucket_words, batch, place, padding): one row
    per input row. bucket: from 0, ascending; bucket_words: its upper bound;
    batch: number within the bucket; place: row within the batch."""
    rows = cut(docs.select(row_id(key).alias("doc_id"), length_of(text).alias("n_words")))
    lengths, count = histogram(rows, "n_words")
    bounds = best_boundaries(lengths, count, buckets)
    n = sum(count)
    shards = max(1, -(-n // SHARD_ROWS))
    bucket, upper = F.lit(0), F.lit(bounds[0] if bounds else 0)
    for i, b in enumerate(bounds[:-1]):
        bucket = F.when(F.col("n_words") > b, F.lit(i + 1)).otherwise(bucket)
        upper = F.when(F.col("n_words") > b, F.lit(bounds[i + 1])).otherwise(upper)
    # later conditions are the outer ones, so the highest bound passed decides
    dealt = rows.withColumns({"bucket": bucket, "bucket_words": upper.cast("long"), "row": F.monotonically_increasing_id()})
    # rows is materialised, so row numbers are stable; they part even equal ids
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)))
    sizes = dealt.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "row")) - 1)
    placed = ranked.join(before.drop("size"), ["bucket", "shard"]).withColumn("at", F.col("rank") + F.coalesce("before", F.lit(0)))
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_words"), F.lit(1))))
    return placed.select(
        "doc_id", "n_words", "bucket", "bucket_words", F.floor(F.col("at") / per_batch).alias("batch"), (F.col("at") % per_batch).alias("place"), (F.col("bucket_words") - F.col("n_words")).alias("padding")
    )
