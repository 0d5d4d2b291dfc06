"""Near copies by the Jaccard similarity of their five-word shingles: the form
of the SimHash operator (``simhash``) for pipeline stages, with the same index
of one-wildcard segment variants over another sketch.

A text is lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; its set
of shingles holds each run of ``WORDS`` words once (fewer words: the whole
sequence as one shingle). Two texts link if their sets' Jaccard similarity is at
least ``LEAST_PERCENT`` hundredths.

Why not the bits of a SimHash: at a similarity of 0.8 two of its bits differ with
probability arccos(0.889) / pi = 0.15, ten of 64. Ten bits take six segments of
ten or eleven bits, entries that a thousandth of all texts share; and wider
fingerprints with segments long enough for a large corpus (32 bits) meet in one
segment of thirty. The sketch is made of MinHash values instead, of which two
texts share a share equal to their similarity.

``SEGMENTS`` segments of ``PLACES`` values each are cut; each segment is indexed
under its ``PLACES`` variants with one value left out, so texts meet if some
segment differs in at most one value. At 0.8 no segment does so with probability
(1 - 0.8 ** 6 - 6 * 0.2 * 0.8 ** 5) ** 12, 3 in a million; less above. Of each
value 16 mixed bits are kept: equal values stay equal, and of others one in 65,536
is taken for equal, which adds candidates and loses none. Every
candidate is verified on the whole shingle sets, so no pair below the limit
links. Texts with one set count once.

Entries are made from the sketches whenever they are needed. They are counted
first; of the others' rows, nearly all are then left out by a bit filter of the
entries that several sets share, before anything is joined. The filter takes 32 MB at
most (``FILTER_BITS``); beyond some 100 million such entries it leaves out ever
less, and the join is as right without it.

Only components are wanted, so an entry isn't expanded into pairs at first: its
members are verified against ``LEADERS`` of them. Entries whose members are one component
by then are done. In the others, members of different components are verified
pair by pair where the entry holds ``hot`` sets at most. The members of larger
ones are taken together and joined by a prefix filter, which misses no pair: two
sets of similarity t share a shingle that is, in an order from the rarest on, among
the first (1 - t) / (1 + t) * size + 1 of the smaller set and the first
(1 - t) * size + 1 of the larger, at places that leave enough others to share; only
pairs from different components are met there.

Loose copies of one text that don't link are still compared with each other, in
an entry as in the prefix filter. Their rows bear ``PARITY`` bits, each the parity of
the number of shingles that fall on it; two sets differ by as many shingles, at
least, as bits, so pairs whose bits differ too much make no row. They tell little
of sets of over 2 * ``PARITY`` shingles, whose pairs are left to the marks.

Defined results: null and empty texts and texts of white space have the empty
set and link to each other only; equal rows count as copies; a null id, or one
that is no integer, never names a component that has another id; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, FEW_ROWS, byte_words, chunks, cut, few, look_up, mix, row_id, span_hashes
from .simhash import connected, keep_first

WORDS, LEAST_PERCENT = 5, 80
SEGMENTS, PLACES = 12, 6
#: An entry with more distinct sets than this isn't expanded into pairs.
HOT_ENTRY = 64
#: Buckets by which shingles' occurrences are counted, to put them in order.
OFTEN = 1 << 16
#: Sets that one task counts the shingles of, about: it hands on OFTEN numbers.
SETS_A_TASK = 20_000
#: Members of an entry that all others are verified against at first.
LEADERS = 4
#: Size of the filter of shared entries: bits for an entry, the most in all (as a power of two), and in a row of its table.
ENTRY_BITS, FILTER_BITS, PAGE_BITS = 16, 28, 15
#: Bits that stand for a set's shingles before it is verified.
MARKS = 4096
#: Bits, a multiple of 64, by which pairs of an entry or of a shingle are bounded where they are met.
PARITY = 512
#: Sketches whose entries are made at once.
SKETCHES = 4096

_SEEDS = mix(np.arange(1, 2 * SEGMENTS * PLACES + 1, dtype=np.uint64))
_FACTORS, _SHIFTS = _SEEDS[: SEGMENTS * PLACES] | np.uint64(1), _SEEDS[SEGMENTS * PLACES :]
_PLACES = mix(np.arange(1001, 1001 + WORDS, dtype=np.uint64)) | np.uint64(1)
_VALUE_PLACES = mix(np.arange(2001, 2001 + PLACES, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    texts = [t or b"" for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return [np.empty(0, np.uint64) for _ in texts]
    starts, ends, at = byte_words(data, bounds)
    words = span_hashes(BYTE_VALUE[data], starts, ends)
    runs = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        runs += words[k : k + len(runs)] * _PLACES[k]
    runs = mix(runs)
    out = []
    for s, e in zip(at[:-1], at[1:]):
        if e - s >= WORDS:
            out.append(np.unique(runs[s : e - WORDS + 1]))
        else:
            whole = np.uint64(e - s) + np.sum(words[s:e] * _PLACES[: e - s], dtype=np.uint64)
            out.append(mix(np.array([whole])) if e > s else np.empty(0, np.uint64))
    return out


def _set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    sums = np.array([np.sum(mix(x), dtype=np.uint64) for x in sets], dtype=np.uint64)
    return mix(sums + np.array([len(x) for x in sets], dtype=np.uint64)).view(np.int64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of MinHash values, 16 mixed bits of each, for each set. No set may be empty."""
    flat, at = np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets[:-1]])
    values = np.empty((len(sets), SEGMENTS * PLACES), np.uint16)
    for i in range(SEGMENTS * PLACES):
        values[:, i] = mix(np.minimum.reduceat(flat * _FACTORS[i] + _SHIFTS[i], at)) & np.uint64(0xFFFF)
    return values


def variants(values: np.ndarray) -> np.ndarray:
    """A row of entries for each sketch: every segment with each of its values left out."""
    entries = np.empty(values.shape, np.uint64)
    for s in range(SEGMENTS):
        terms = [values[:, s * PLACES + k].astype(np.uint64) * _VALUE_PLACES[k] for k in range(PLACES)]
        whole = np.sum(terms, axis=0, dtype=np.uint64)
        for k, term in enumerate(terms):
            entries[:, s * PLACES + k] = mix(whole - term + np.uint64(s * PLACES + k))
    return entries.view(np.int64)


def _runs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    texts = [x.as_py() for x in batch.column(column)]
    for s, e in chunks(np.array([len(t or b"") for t in texts], dtype=np.int64)):
        yield s, e, shingle_sets(texts[s:e])


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).view(np.int64)))


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s, e, sets in _runs(batch, 1):
            full = [x for x in sets if len(x)]
            found = iter(sketches(full) if full else ())
            held = pa.array([next(found).tobytes() if len(x) else b"" for x in sets], pa.binary())
            cols = [batch.column(0)[s:e], batch.column(2)[s:e], pa.array(_set_hashes(sets)), pa.array([len(x) for x in sets], pa.int64()), held]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "mark", "node", "size", "sketch"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches (node, size, sketch), less the empty sets, with their entries."""
    for batch in batches:
        full = batch.filter(pc.greater(pc.binary_length(batch.column(2)), 0))
        for at in range(0, full.num_rows, SKETCHES):
            part = full.slice(at, SKETCHES)
            values = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16)
            yield part, variants(values.reshape(-1, SEGMENTS * PLACES))


def _entry_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, entries in _entries(batches):
        yield pa.RecordBatch.from_arrays([pa.array(entries.ravel())], names=["entry"])


def _likely(held: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (node, size, entry) of the entries that the broadcast filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint8)
        for part, entries in _entries(batches):
            hit = np.ones(entries.shape, bool)
            for shift in (0, 32):
                at = (entries >> shift) & (8 * len(bits) - 1)
                hit &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            of = pa.array(np.nonzero(hit)[0])
            yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(entries[hit])], names=["node", "size", "entry"])

    return run


def _filter(entries: DataFrame, n: int) -> bytes:
    """A bit filter of ``n`` distinct ``entries``, two bits each. It is put together
    page by page, so the driver gets as many bytes as it has."""
    power = max(PAGE_BITS, min(FILTER_BITS, (max(1, n) * ENTRY_BITS - 1).bit_length()))
    bit = F.explode(F.array(*[F.shiftright("entry", shift).bitwiseAND(F.lit((1 << power) - 1)) for shift in (0, 32)]))
    paged = entries.select(bit.alias("bit")).select(F.shiftright("bit", PAGE_BITS).alias("page"), F.col("bit").bitwiseAND(F.lit((1 << PAGE_BITS) - 1)).alias("place"))
    got = paged.repartition("page").groupBy("page").agg(F.bitmap_construct_agg("place").alias("bits")).toArrow()
    out = bytearray(1 << (power - 3))
    size = 1 << (PAGE_BITS - 3)
    for page, bits in zip(got.column("page").to_pylist(), got.column("bits").to_pylist()):
        out[page * size : (page + 1) * size] = bits
    return bytes(out)


def _marks(shingles: np.ndarray) -> bytes:
    """MARKS bits, those set that some shingle falls on."""
    held = np.zeros(MARKS, bool)
    held[shingles & np.uint64(MARKS - 1)] = True
    return np.packbits(held).tobytes()


def _parity(shingles: np.ndarray) -> np.ndarray:
    """PARITY bits as longs, those set that an odd number of shingles falls on."""
    odd = np.bincount((shingles.view(np.uint64) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _near() -> Column:
    """Whether sets (size, parity) and (size_b, parity_b) may link: each bit in which
    they differ stands for a shingle, at least, that one of them lacks."""
    both = F.col("size") + F.col("size_b")
    apart = sum((F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY // 64)), F.lit(0))
    return _alike() & ((both - apart) * (100 + LEAST_PERCENT) >= both * (2 * LEAST_PERCENT))


def _alike() -> Column:
    """Whether the sizes allow the similarity."""
    return F.least("size", "size_b") * 100 >= F.greatest("size", "size_b") * LEAST_PERCENT


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, n_a, marks_a, n_b, marks_b) that may link: a bit of one set
    that the other lacks stands for a shingle, at least, that it lacks."""
    for batch in batches:
        for at in range(0, batch.num_rows, SKETCHES):
            part = batch.slice(at, SKETCHES)
            x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint64).reshape(part.num_rows, -1) for k in (3, 5))
            n_a, n_b = part.column(2).to_numpy(), part.column(4).to_numpy()
            alone_a, alone_b = (np.bitwise_count(z).sum(axis=1, dtype=np.int64) for z in (x & ~y, y & ~x))
            common = np.minimum(n_a - alone_a, n_b - alone_b)
            links = pa.array(common * 100 >= (n_a + n_b - common) * LEAST_PERCENT)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(links), part.column(1).filter(links)], names=["a", "b"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of (node, body), each node once in a task."""
    seen: set[int] = set()
    for batch in batches:
        nodes, fresh = batch.column(0).to_pylist(), []
        for i, node in enumerate(nodes):
            if node not in seen:
                seen.add(node)
                fresh.append(i)
        batch = batch.take(pa.array(fresh, pa.int64()))
        for s, e, sets in _runs(batch, 1):
            marks = pa.array([_marks(x) for x in sets], pa.binary())
            cols = [batch.column(0)[s:e], pa.array([len(x) for x in sets], pa.int64()), marks, _lists([_parity(x) for x in sets]), _lists(sets)]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "n", "marks", "parity", "shingles"])


def _sets(nodes: DataFrame, rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """(node, n, marks, parity, shingles) of distinct ``nodes``. Sets are shuffled only where whole
    rows, id and text, are repeated."""
    wanted = cut(nodes.join(distinct, "node").select("node", F.col("at.doc_id").alias("_id"), F.col("at.mark").alias("_mark")))
    texts = rows.join(few(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("node", "body")
    made = cut(texts.mapInArrow(_set_batches, "node long, n long, marks binary, parity array<long>, shingles array<long>"))
    if made.count() == wanted.count():
        return made
    again = few(cut(made.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")))
    once = made.join(again, "node", "left_semi").dropDuplicates(["node"])
    return cut(made.join(again, "node", "left_anti").unionByName(once))


def _named(pairs: DataFrame, sets: DataFrame, n: str) -> DataFrame:
    """``sets``, of which those that column ``n`` of ``pairs`` doesn't name need not be there."""
    names = cut(pairs.select(F.col(n).alias("node")).distinct())
    return sets.join(F.broadcast(names), "node", "left_semi") if names.count() <= FEW_ROWS else sets


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. Whole sets are met only for those that their marks let pass."""
    left, right = (sets.select(F.col("node").alias(n), F.col("n").alias(f"n_{n}"), F.col("marks").alias(f"marks_{n}")) for n in ("a", "b"))
    met = pairs.join(right, "b").join(left, "a").select("a", "b", "n_a", "marks_a", "n_b", "marks_b")
    pairs = cut(met.mapInArrow(_possible, "a long, b long"))
    left, right = (_named(pairs, sets, n).select(F.col("node").alias(n), F.col("shingles").alias(x)) for n, x in (("a", "x"), ("b", "y")))
    common = F.size(F.array_intersect("x", "y"))
    links = common * 100 >= (F.size("x") + F.size("y") - common) * LEAST_PERCENT
    return cut(pairs.join(right, "b").join(left, "a").where(links).select("a", "b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) once each, a < b, whose sizes allow the similarity."""
    return cut(pairs.where(_alike()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _apart(shared: DataFrame, member: DataFrame) -> DataFrame:
    """``shared`` (entry, n, node, size) with component ``c`` of each node, less
    the entries whose members are all of one component."""
    held = shared.drop("c").join(member, "node", "left").withColumn("c", F.coalesce("root", "node")).drop("root")
    several = held.groupBy("entry").agg(F.min("c").alias("_least"), F.max("c").alias("_most"), F.first("n").alias("n")).where("_least < _most").select("entry", "n")
    return cut(look_up(held.drop("n"), cut(several), ["entry"], "n", shared.count()))


def _stars(shared: DataFrame) -> DataFrame:
    """Each member of an entry with the entry's LEADERS members of least hash, by
    a hash of their own each."""
    least = [F.min(F.struct(F.xxhash64("node", F.lit(k)), "node", "size")).alias(f"l{k}") for k in range(LEADERS)]
    lead = shared.groupBy("entry").agg(*least, F.first("n").alias("n"))
    some = F.array_distinct(F.array(*[F.struct(F.col(f"l{k}.node").alias("b"), F.col(f"l{k}.size").alias("size_b")) for k in range(LEADERS)]))
    lead = cut(lead.select("entry", "n", some.alias("some")))
    met = look_up(shared.select("entry", F.col("node").alias("a"), "size"), lead, ["entry"], "n", shared.count())
    return met.select("a", "size", F.explode("some").alias("x")).select("a", "size", "x.b", "x.size_b").where("a <> b")


def _pairs(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of an entry from different components that may link."""
    held = cut(shared.join(sets.select("node", "parity"), "node").select("entry", "node", "size", "c", "parity"))
    other = held.select("entry", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("c").alias("c_b"), F.col("parity").alias("parity_b"))
    return held.join(other, "entry").where((F.col("c") < F.col("c_b")) & _near()).select(F.col("node").alias("a"), "size", "b", "size_b")


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task's sets fall into each bucket."""
    counts = np.zeros(OFTEN, np.int64)
    for batch in batches:
        counts += np.bincount(batch.column(0).flatten().to_numpy() & (OFTEN - 1), minlength=OFTEN)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])


def _prefixes(often: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each set (node, c, shingles), the shingles of which similar sets share
    one: its first, in an order by how often a shingle's bucket occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(often.value, np.int64)
        for batch in batches:
            whole = [x.values.to_numpy() for x in batch.column(2)]
            for s, e in chunks(np.array([x.nbytes for x in whole], np.int64)):
                sets = whole[s:e]
                size = np.array([len(x) for x in sets], np.int64)
                take = size + size * -LEAST_PERCENT // 100 + 1
                first = [x[np.lexsort((x, counts[x & (OFTEN - 1)]))[:k]] for x, k in zip(sets, take)]
                of = np.repeat(np.arange(len(sets)), take)
                place = np.arange(len(of)) - np.repeat(np.cumsum(take) - take, take)
                node, c, parity = (x.take(pa.array(of)) for x in (batch.column(0)[s:e], batch.column(1)[s:e], _lists([_parity(x) for x in sets])))
                yield pa.RecordBatch.from_arrays([node, c, pa.array(size[of]), pa.array(place), pa.array(np.concatenate(first)), parity], names=["node", "c", "size", "place", "shingle", "parity"])

    return run


def _prefix_pairs(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of ``crowd`` (node, c) from different components that may link: they
    share one of their rarest shingles, at places that leave enough others."""
    whole = cut(crowd.join(sets, "node").select("node", "c", "shingles"))
    parts = -(-whole.count() // SETS_A_TASK) or 1
    found = whole.select("shingles").coalesce(parts).mapInArrow(_bucket_counts, "bucket long, n long")
    got = found.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # OFTEN rows at most
    counts = np.zeros(OFTEN, np.int64)
    counts[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    often = crowd.sparkSession.sparkContext.broadcast(counts.tobytes())
    kept = cut(whole.mapInArrow(_prefixes(often), "node long, c long, size long, place long, shingle long, parity array<long>"))
    # sets of similarity t share t / (1 + t) of their summed sizes; what lies before the places isn't shared
    early = (F.col("size") - F.col("place")) * (100 + LEAST_PERCENT) >= F.col("size") * (2 * LEAST_PERCENT)
    several = kept.groupBy("shingle").agg(F.min("c").alias("_least"), F.max("c").alias("_most"), F.max(early).alias("_early")).where("_least < _most and _early").select("shingle")
    kept = cut(kept.join(several, "shingle", "left_semi"))
    other = kept.select("shingle", F.col("node").alias("b"), F.col("c").alias("c_b"), F.col("size").alias("size_b"), F.col("place").alias("place_b"), F.col("parity").alias("parity_b"))
    room = F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b"))
    enough = room * (100 + LEAST_PERCENT) >= (F.col("size") + F.col("size_b")) * LEAST_PERCENT
    smaller = (F.col("size") < F.col("size_b")) | ((F.col("size") == F.col("size_b")) & (F.col("node") < F.col("b")))
    met = kept.where(early).join(other, "shingle").where((F.col("c") != F.col("c_b")) & smaller & enough & _near())
    first = F.col("node") < F.col("b")
    return met.select(F.least("node", "b").alias("a"), F.when(first, F.col("size")).otherwise(F.col("size_b")).alias("size"), F.greatest("node", "b").alias("b"), F.when(first, F.col("size_b")).otherwise(F.col("size")).alias("size_b"))


def _members(distinct: DataFrame, rows: DataFrame, hot: int) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches."""
    signs = distinct.select("node", "size", "sketch")
    counted = cut(signs.mapInArrow(_entry_batches, "entry long").groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    keys, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = distinct.sparkSession.sparkContext.broadcast(_filter(counted, keys))
    entries = signs.mapInArrow(_likely(held), "node long, size long, entry long")
    shared = cut(look_up(entries, counted, ["entry"], "n", total).withColumn("c", F.col("node")))
    sets = _sets(shared.select("node").distinct(), rows, distinct)
    edges = _verified(_ordered(_stars(shared)), sets)
    member = cut(connected(edges))
    shared = _apart(shared, member)
    if shared.isEmpty():
        return member
    more = _pairs(shared.where(F.col("n") <= hot), sets)
    crowd = cut(shared.where(F.col("n") > hot).select("node", "c").distinct())
    if not crowd.isEmpty():
        more = more.unionByName(_prefix_pairs(crowd, sets))
    found = _verified(_ordered(more), sets)
    return member if found.isEmpty() else cut(connected(edges.unionByName(found)))


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", hot: int = HOT_ENTRY) -> DataFrame:
    """One row per input row: doc_id, mark (hash of the text), node (hash of the
    shingle set), component_id, component (the smallest node of the component)."""
    rows = docs.select(row_id(key).alias("doc_id"), F.col(text).cast("binary").alias("body"), F.xxhash64(text).alias("mark"))
    signed = cut(rows.mapInArrow(_sign_batches, "doc_id long, mark long, node long, size long, sketch binary"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "mark")).alias("at")
    distinct = cut(signed.groupBy("node").agg(F.min("doc_id").alias("first_id"), least, F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("sketch").alias("sketch")))
    member = _members(distinct.select("node", "at", "size", "sketch"), rows, hot)
    named = member.join(distinct, "node").select("node", "root", "first_id")
    named = named.join(named.groupBy("root").agg(F.min("first_id").alias("least_id")), "root").select("node", "root", "least_id")
    class_of = cut(distinct.join(named, "node", "left").select("node", "n", F.coalesce("least_id", "first_id").alias("component_id"), F.coalesce("root", "node").alias("component")))
    return look_up(signed.select("doc_id", "mark", "node"), class_of, ["node"], "n", signed.count()).select("doc_id", "mark", "node", "component_id", "component")


def one_per_group(docs: DataFrame, text: str = "text", key: str = "doc_id", hot: int = HOT_ENTRY) -> DataFrame:
    """The documents with one of each component left, as ``simhash.keep_first``
    chooses it; columns as they came."""
    return keep_first(docs, near_copies(docs, text, key, hot), text, key)
