"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-cased and cut into words: runs of letters, digits and marks
(Unicode). A document overlaps an item if, on one alignment without gaps, some
window of ``WINDOW`` words agrees in all but ``MISSES`` words at most. Items
with fewer words than a window, but ``SHORTEST`` or more, must stand in the
document word for word; shorter ones overlap nothing.

The window is cut into four blocks. Two substituted words spoil at most two
blocks, so two blocks agree: the six fixed masks, each looking at two blocks
and ignoring the words between, meet every such window. Mask hashes of the
benchmark go into a bit filter with ``BITS_A_SEED`` bits for each, which is all
that is broadcast: 2 ** ``MOST_BITS`` bits (32 MB) at most. A larger benchmark is
dealt by its hashes into several filters, one pass over the documents each, so a
pass never lets more than one window in hundreds through by chance. Windows of
documents that pass are joined with the benchmark's mask hashes on equality, and
the words of both windows are compared: false hits go, substitutions within the
limit stay.

Defined results: null and empty texts overlap nothing, a null doc_id or item_id
is carried as null, items with equal texts count once (smallest id),
repeated documents give one row per (doc_id, item_id), and empty tables give an
empty result. An id that is no integer counts as null; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _MIX_A, _MULT, chunks, cut, few, mix, row_id, span_hashes

WINDOW, MISSES, SHORTEST = 13, 2, 5
#: Words of a window by block; any two blocks form a mask.
BLOCKS = ((0, 4), (4, 7), (7, 10), (10, 13))
MASKS = tuple(itertools.combinations(range(len(BLOCKS)), 2))
#: Size of the broadcast filter: bits for each mask hash, at least and at most 2 to the power of; probes for each hash.
BITS_A_SEED, LEAST_BITS, MOST_BITS, PROBES = 16, 16, 28, 3
#: Mask hashes of a benchmark that is short enough to be broadcast whole (some 10 MB).
FEW_SEEDS = 1 << 16
_BITS = 28
#: Copies of a benchmark too large to be broadcast, so that the hits of one hash are dealt over as many tasks.
DEAL = 16
_CHUNK_CHARS = 1 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@functools.lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it belongs to a word, and its lower case."""
    import unicodedata

    word, lower = np.zeros(sys.maxunicode + 1, bool), np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalnum():
            word[i] = True
            if len(low := c.lower()) == 1:
                lower[i] = ord(low)
        elif i > 127 and unicodedata.category(c)[0] == "M":
            word[i] = True
    return word, lower


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the offset of each text's first."""
    word, lower = _letters()
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = word[codes]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = span_hashes(mix((lower[codes].astype(np.uint64) + np.uint64(1)) * _MULT), starts, ends)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    begin = np.concatenate([[0], np.cumsum(lengths)])
    return hashes, np.searchsorted(starts, begin, "left")


def _mask_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """For each window of ``size`` words its mask hashes, a column for each mask."""
    n = len(words) - size + 1
    blocks = BLOCKS if size == WINDOW else ((0, size),)
    part = []
    for a, b in blocks:
        h = np.zeros(n, np.uint64)
        for i in range(a, b):
            h = (h + words[i : i + n]) * _MULT
        part.append(mix(h + np.uint64(size * 64 + a)))
    if size != WINDOW:
        return part[0][:, None]
    return np.stack([mix(part[i] * _MIX_A + part[j] + np.uint64(m)) for m, (i, j) in enumerate(MASKS)], axis=1)


def _starts(offsets: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that lie within one text: their first words and their texts."""
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(max(0, n - size + 1))
    ok = text_of[at] == text_of[at + size - 1] if len(at) else np.zeros(0, bool)
    return at[ok], text_of[at[ok]]


def _windows(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The words of the windows, padded to WINDOW columns."""
    out = np.zeros((len(at), WINDOW), np.uint64)
    for i in range(size):
        out[:, i] = words[at + i]
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a list array of longs."""
    flat = np.ascontiguousarray(rows).view(np.int64).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, rows.shape[1], dtype=np.int32)), pa.array(flat))


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
        for a, b in chunks(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), _CHUNK_CHARS):
            words, offsets = word_hashes(texts[a:b])
            counts = np.diff(offsets)
            for size in sorted({min(int(c), WINDOW) for c in counts if c >= SHORTEST}):
                at, text_of = _starts(offsets, size, len(words))
                fit = counts[text_of] == size if size < WINDOW else np.ones(len(at), bool)
                at, text_of = at[fit], text_of[fit]
                keys = _mask_hashes(words, size)[at]
                k = keys.shape[1]
                rows = np.repeat(np.arange(len(at)), k)
                flat = keys.reshape(-1)
                bits = np.stack([(flat * odd) >> np.uint64(64 - _BITS) for odd in _ODD[:PROBES]], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a).take(pa.array(text_of[rows])),
                        pa.array((at - offsets[text_of])[rows]),
                        pa.array(counts[text_of][rows]),
                        pa.array(np.full(len(rows), size, np.int32)),
                        pa.array(np.tile(np.arange(k, dtype=np.int32), len(at))),
                        pa.array(flat.view(np.int64)),
                        _lists(_windows(words, at, size)[rows]),
                        _lists(bits),
                    ],
                    names=["item_id", "item_at", "item_words", "size", "mask", "seed", "item_window", "bits"],
                )


def _document_batches(filter_: object, bits: int, sizes: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows of documents that the filter lets pass, with the seeds that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(filter_.value, np.uint64)
        for batch in batches:
            ids, marks, texts = batch.column(0), batch.column(2), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), _CHUNK_CHARS):
                words, offsets = word_hashes(texts[a:b])
                for size in sizes:
                    if len(words) < size:
                        continue
                    keys = _mask_hashes(words, size)
                    for mask in range(keys.shape[1]):
                        flat = np.ascontiguousarray(keys[:, mask])
                        hit = np.arange(len(flat))
                        for odd in _ODD[:PROBES]:
                            bit = (flat[hit] * odd) >> np.uint64(64 - bits)
                            hit = hit[(bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
                        if not len(hit):
                            continue
                        text_of = np.searchsorted(offsets, hit, "right") - 1
                        whole = hit + size <= offsets[text_of + 1]
                        hit, text_of = hit[whole], text_of[whole]
                        if len(hit):
                            yield pa.RecordBatch.from_arrays(
                                [
                                    ids.slice(a, b - a).take(pa.array(text_of)),
                                    marks.slice(a, b - a).take(pa.array(text_of)),
                                    pa.array(hit - offsets[text_of]),
                                    pa.array(np.full(len(hit), size, np.int32)),
                                    pa.array(np.full(len(hit), mask, np.int32)),
                                    pa.array(flat[hit].view(np.int64)),
                                    _lists(_windows(words, hit, size)),
                                ],
                                names=["doc_id", "doc_mark", "doc_at", "doc_size", "doc_mask", "doc_seed", "doc_window"],
                            )

    return run


def item_seeds(benchmark: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """The benchmark's side of the join: a row for each window and mask."""
    rows = benchmark.select(row_id(key).alias("item_id"), F.col(text).alias("text"))
    rows = rows.groupBy("text").agg(F.min("item_id").alias("item_id")).select("item_id", "text")
    return rows.mapInArrow(_item_batches, "item_id long, item_at long, item_words long, size int, mask int, seed long, item_window array<long>, bits array<long>")


def _met(docs: DataFrame, benchmark: DataFrame, text: str, key: str, item_text: str, item_key: str) -> DataFrame:
    """Every verified pair of a document's and an item's window; doc_mark tells
    texts under one doc_id apart."""
    spark = docs.sparkSession
    seeds = cut(item_seeds(benchmark, item_text, item_key))
    count, room = seeds.count(), (1 << MOST_BITS) // BITS_A_SEED
    slices = max(1, -(-count // room))
    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())  # WINDOW values at most
    rows = docs.select(row_id(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("doc_mark"))
    short = count // slices <= FEW_SEEDS
    met = None
    for i in range(slices):
        held = seeds.where(F.pmod(F.xxhash64("seed"), F.lit(slices)) == i) if slices > 1 else seeds
        bits = min(MOST_BITS, max(LEAST_BITS, (count // slices * BITS_A_SEED).bit_length()))
        shared = spark.sparkContext.broadcast(_bitmap(held, bits))
        hits = rows.mapInArrow(_document_batches(shared, bits, sizes), "doc_id long, doc_mark long, doc_at long, doc_size int, doc_mask int, doc_seed long, doc_window array<long>")
        found = _compared(hits, held.drop("bits"), short)
        met = found if met is None else met.unionByName(found)
    return met


def _bitmap(seeds: DataFrame, bits: int) -> bytes:
    """The filter of 2 ** bits bits."""
    bit = F.shiftright("bit", _BITS - bits)
    held = seeds.select(F.explode("bits").alias("bit")).groupBy(F.shiftright(bit, 6).alias("place")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftright(bit, {_BITS - bits}) & 63 AS INT))")).alias("part"))
    got = held.toArrow()  # no more rows than the filter has places, 64 MB at most
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[got.column("place").to_numpy()] = got.column("part").to_numpy().view(np.uint64)
    return bitmap.tobytes()


def _compared(hits: DataFrame, seeds: DataFrame, short: bool) -> DataFrame:
    """Hits joined with the benchmark's windows, those that agree. A benchmark
    that isn't short is dealt, since one hash may be hit by any number of windows."""
    same = [F.col("doc_window")[i] == F.col("item_window")[i] for i in range(WINDOW)]
    matches = functools.reduce(lambda x, y: x + y, [s.cast("int") for s in same])
    whole = [functools.reduce(lambda x, y: x & y, same[a:b]) for a, b in BLOCKS]
    first = functools.reduce(lambda so_far, m: F.when(whole[MASKS[m][0]] & whole[MASKS[m][1]], F.lit(m)).otherwise(so_far), reversed(range(len(MASKS))), F.lit(-1))
    long_ok = (matches >= WINDOW - MISSES) & (first == F.col("mask"))
    on = (F.col("doc_seed") == F.col("seed")) & (F.col("doc_size") == F.col("size")) & (F.col("doc_mask") == F.col("mask"))
    if short:
        seeds = F.broadcast(seeds)
    else:
        hits = hits.withColumn("_deal", F.pmod(F.xxhash64("doc_id", "doc_mark", "doc_at"), F.lit(DEAL)))
        seeds = seeds.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))
        on = on & (F.col("_deal") == F.col("_to"))
    met = hits.join(seeds, on & F.when(F.col("size") == WINDOW, long_ok).otherwise(matches == WINDOW))
    return met.select("doc_id", "doc_mark", "item_id", "item_words", F.col("doc_at"), (F.col("doc_at") + F.col("size")).alias("doc_end"), (matches - (F.lit(WINDOW) - F.col("size"))).alias("n"))


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """(doc_id, item_id, item_words, n_windows, first_word, end_word, best_match):
    one row for each document and item that overlap. first_word and end_word
    bound the agreeing words in the document; best_match is the most words that
    agree in one window."""
    met = _met(docs, benchmark, text, key, item_text, item_key)
    return met.groupBy("doc_id", "item_id", "item_words").agg(
        F.count(F.lit(1)).alias("n_windows"), F.min("doc_at").alias("first_word"), F.max("doc_end").alias("end_word"), F.max("n").cast("long").alias("best_match")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The documents that overlap no item, columns as they came."""
    bad = cut(_met(docs, benchmark, text, key, item_text, item_key).select(F.col("doc_id").alias("_hit"), "doc_mark").distinct())
    return docs.join(few(bad), row_id(docs[key]).eqNullSafe(bad["_hit"]) & (F.xxhash64(docs[text]) == bad["doc_mark"]), "left_anti")


def oracle_sql() -> str:
    """overlaps() of documents and benchmark, for DuckDB: alignments that share
    four words in a row (of a window with two misses at most, some four agree),
    then every window on them."""
    words = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}\\p{M}]+')"
    spread = lambda name, key: f"{name} AS (SELECT {key}, unnest(w) AS w, unnest(range(len(w))) AS pos, len(w) AS n FROM (SELECT {key}, {words} AS w FROM {name}_in))"
    fours = lambda name, key: f"{name}4 AS (SELECT {key}, pos, w || ' ' || lead(w) OVER k || ' ' || lead(w, 2) OVER k || ' ' || lead(w, 3) OVER k AS g FROM {name} WINDOW k AS (PARTITION BY {key} ORDER BY pos))"
    return f"""
WITH d_in AS (SELECT doc_id, text FROM documents), b_in AS (SELECT min(item_id) AS item_id, text FROM benchmark GROUP BY text),
{spread('d', 'doc_id')}, {spread('b', 'item_id')}, {fours('d', 'doc_id')}, {fours('b', 'item_id')},
lines AS (SELECT DISTINCT doc_id, item_id, d4.pos - b4.pos AS shift FROM d4 JOIN b4 USING (g)),
pairs AS (SELECT l.*, b.pos AS b_pos, d.pos AS d_pos, b.n, least(b.n, {WINDOW}) AS size, CAST(b.w = d.w AS INTEGER) AS same
  FROM lines l JOIN b ON b.item_id = l.item_id JOIN d ON d.doc_id = l.doc_id AND d.pos = b.pos + l.shift),
sums AS (SELECT *, sum(same) OVER k AS s, count(*) OVER k AS c FROM pairs WINDOW k AS (PARTITION BY doc_id, item_id, shift ORDER BY b_pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING))
SELECT doc_id, item_id, n AS item_words, count(*) AS n_windows, min(d_pos) AS first_word, max(d_pos + size) AS end_word, CAST(max(s) AS BIGINT) AS best_match
FROM sums WHERE c = size AND n >= {SHORTEST} AND s >= CASE WHEN size = {WINDOW} THEN {WINDOW - MISSES} ELSE size END GROUP BY ALL"""
