"""SimHash near-duplicates found through deletion-variant signatures.

Fingerprint: a text is lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+``
and 3-word shingles, repeats included (fewer words: the whole sequence as one
shingle; none: fingerprint zero). Bit i is 1 if it is set in over half of the
shingles' XXH64 (seed 42).

Two fingerprints link if they differ in at most two bits. Cut into two 32-bit
segments, one segment then differs in at most one bit, so both fingerprints
share an entry of that segment with one bit wildcarded. Distinct fingerprints
are indexed under their 64 one-wildcard entries, joined on equality and
verified. An entry that more than ``hot`` distinct fingerprints share is never
expanded into pairs: its members go through a second index on the whole
fingerprint with one bit flipped or none. Such a key holds at most 65 members
by construction, all of which link to each other, so a star replaces the pairs
and no link is lost.

Defined results: null or empty texts and texts of white space have fingerprint
zero and link like any other; equal rows stay separate rows with one component;
a null id, or one that is no integer, never names a component that has another
id; an empty table gives an empty result. Extra columns are ignored.

``one_per_group`` keeps one row of each component, whatever the ids: that of the
smallest (id, hash of the text), nulls last; of rows equal in both, that of the
smallest hash over all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, few, look_up, row_id

#: An index entry with more distinct fingerprints than this takes the second index.
HOT_ENTRY = 64
_PIECE = 1 << 20


def _shingle_counts(words: list[bytes]) -> tuple[np.ndarray, int]:
    """How many 3-word shingles of these words set each bit, and their number."""
    digest = xxhash.xxh64_intdigest
    hashes = [digest(b" ".join(t), 42) for t in zip(words, words[1:], words[2:])]
    flat = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(flat, axis=1, bitorder="little").sum(axis=0, dtype=np.int64), len(hashes)


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of one UTF-8 text, as an unsigned integer. A long text is
    worked through in pieces, the last two words carried over."""
    if not text:
        return 0
    counts, n, carry, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(text):
        end = min(len(text), at + _PIECE)
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = carry + text[at:end].lower().split()
        if len(words) > 2:
            got, k = _shingle_counts(words)
            counts += got
            n += k
        carry, at = words[-2:] if len(words) > 2 else words, end
    if not n:
        if not carry:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(carry), 42)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values.view(np.int64))], names=["doc_id", "mark", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, mark, fp): one row per input row; fp holds the 64 bits as a long,
    mark tells texts under one doc_id apart."""
    rows = docs.select(row_id(key).alias("doc_id"), F.col(text).cast("binary").alias("body"), F.xxhash64(text).alias("mark"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, mark long, fp long")


def _entries(fp: Column) -> Column:
    """The 64 one-wildcard entries: segment, wildcard place and the other 31 bits."""
    out = []
    for segment in (0, 1):
        half = F.shiftrightunsigned(fp, 32) if segment else fp.bitwiseAND(F.lit(0xFFFFFFFF))
        for bit in range(32):
            out.append(half.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit))).bitwiseOR(F.lit((segment << 37) | (bit << 32))))
    return F.array(*out)


def _first_shared(a: Column, b: Column) -> Column:
    """The first entry that two fingerprints within two bits share: each pair is
    taken there and nowhere else. Null for pairs further apart."""
    low = a.bitwiseXOR(b).bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(a.bitwiseXOR(b), 32)
    place = lambda half: F.when(half == 0, F.lit(0)).otherwise(F.bit_count(half - 1))
    return F.when(F.bit_count(a.bitwiseXOR(b)) > 2, F.lit(None).cast("int")).when(F.bit_count(low) <= 1, place(low)).otherwise(place(high) + 32)


def links(distinct: DataFrame, hot: int = HOT_ENTRY) -> DataFrame:
    """(a, b), a < b: links enough to connect all fingerprints of ``distinct``
    (column fp, without repeats) that are joined by links of at most two bits.

    Every pair of an entry of normal size is given; hot entries give stars."""
    entries = distinct.select("fp", F.explode(_entries(F.col("fp"))).alias("entry"))
    shared = cut(entries.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    slot = F.shiftright(F.col("entry"), 32).cast("int")  # segment * 32 + place of the wildcard
    taken = _first_shared(F.col("a"), F.col("b")) == slot
    pairs = shared.where(F.col("n") == 2).where(taken).select("a", "b")

    several = cut(entries.join(shared.where(F.col("n") > 2).select("entry", "n"), "entry"))
    left = several.where(F.col("n") <= hot).select("entry", F.col("fp").alias("a"))
    right = several.where(F.col("n") <= hot).select(F.col("entry").alias("entry_b"), F.col("fp").alias("b"))
    crowd = left.join(right, (F.col("entry") == F.col("entry_b")) & (F.col("a") < F.col("b")) & taken).select("a", "b")

    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    hubs = several.where(F.col("n") > hot).select("fp").distinct().select("fp", F.explode(flips).alias("middle"))
    stars = hubs.groupBy("middle").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)
    stars = stars.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a < b")
    return pairs.unionByName(crowd).unionByName(stars.distinct())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches,
    by alternating large-star and small-star steps until nothing changes."""
    state, seen = cut(edges.select("a", "b").where("a <> b").distinct()), None
    held = state.count()
    while True:
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).union(state.select("b", "a"))
        # the centre of a star has as many edges as the star has members
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = look_up(both, least, ["u"], "n", 2 * held).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # now u > v everywhere; small star: all smaller neighbours and u itself go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        state = cut(small.union(low.select("u", "m")).distinct())
        mark = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first()
        if mark == seen:
            break
        seen, held = mark, mark[0]
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(state.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", hot: int = HOT_ENTRY) -> DataFrame:
    """One row per input row: doc_id, mark (hash of the text), fp (long),
    component_id, component (the smallest fingerprint of the component)."""
    prints = cut(fingerprints(docs, text, key))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    member = cut(connected(links(distinct.select("fp"), hot)))
    named = member.join(distinct, member["node"] == distinct["fp"]).select("fp", "root", "first_id")
    named = named.join(named.groupBy("root").agg(F.min("first_id").alias("least_id")), "root").select("fp", "root", "least_id")
    class_of = cut(distinct.join(named, "fp", "left").select("fp", "n", F.coalesce("least_id", "first_id").alias("component_id"), F.coalesce("root", "fp").alias("component")))
    return look_up(prints, class_of, ["fp"], "n", prints.count()).select("doc_id", "mark", "fp", "component_id", "component")


def keep_first(docs: DataFrame, found: DataFrame, text: str, key: str) -> DataFrame:
    """``docs`` with one row of each component of ``found`` (doc_id, mark,
    component). Texts are shuffled only if a key list has more than FEW_ROWS
    rows."""
    held = cut(found.groupBy("component", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n")))
    first = held.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")).select("component", "first.doc_id", "first.mark")
    same = [F.col("a.component") == F.col("b.component"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.mark") == F.col("b.mark")]
    on = same[0] & same[1] & same[2]
    drop = cut(held.alias("a").join(first.alias("b"), on, "left_anti").select(F.col("doc_id").alias("_drop_id"), F.col("mark").alias("_drop_mark")))
    again = cut(held.where("n > 1").alias("a").join(first.alias("b"), on, "left_semi").select(F.col("doc_id").alias("_drop_id"), F.col("mark").alias("_drop_mark")))
    at = row_id(docs[key]).eqNullSafe(F.col("_drop_id")) & (F.xxhash64(docs[text]) == F.col("_drop_mark"))
    left = docs.join(few(drop), at, "left_anti")
    if again.isEmpty():
        return left
    whole = [docs[c] for c in docs.columns]
    one = docs.join(few(again), at, "left_semi")
    one = one.groupBy(row_id(docs[key]).alias("_id"), F.xxhash64(docs[text]).alias("_mark")).agg(F.min_by(F.struct(*whole), F.xxhash64(F.to_json(F.struct(*whole)))).alias("_row"))
    return left.join(few(again), at, "left_anti").union(one.select("_row.*"))


def one_per_group(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with one of each component left; columns as they came."""
    return keep_first(docs, near_duplicates(docs, text, key), text, key)
