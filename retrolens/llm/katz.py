"""Language-model scoring by a Katz backoff bigram model.

Tokens: A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+`` and one end token per
document; the first token's history is the begin mark. Counts come from the
training documents only.

    P(w | h) = disc2(c(h w)) / c(h)      if the pair was seen in training
             = alpha(h) * P(w)           if not, but h was seen
             = P(w)                      if h was not seen either
    P(w)     = disc1(c(w)) / N           for training tokens, the rest of the
                                         mass for the one class of unknown words

disc(r) is Katz's Good-Turing discounted count for r <= ``K`` (with fallback to
an absolute discount where counts of counts are too few for it), and r less a
small constant above, so that every history keeps some mass to back off with.
alpha(h) is what h's seen words leave over, divided by the unigram mass of the
words not seen after h: the distribution after each history sums to one.

How it scales. Words are 64-bit hashes, hot ones (at most ``HOT_WORDS``, by
proof: each has more than 1/HOT_WORDS of all tokens) short ranks that are
broadcast. A batch of documents asks once for each of its distinct pairs; the
requests are packed into a compressed blob per bucket and shuffled, counted
there, and answered with counts in the order asked. Buckets go by the second
word, and by the pair for hot words, so no bucket holds all of a hot word. The
pair counts, the histories' weights and the unigram counts are written as
partitioned tables in the shared folder, and each token is evaluated from the
answers, recursively: pair, else weight and unigram, else unknown class. The
documents are read three times in one order: an input that isn't a plain scan of
files is written to a table first. Sums of hashes guard it.

Defined results: a null text is empty and has the end token alone; a null id
counts as held out; equal rows are documents of their own; without training
tokens every probability is that of the unknown class, 1; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _MIX_A, BYTE_VALUE, byte_words, chunks, cut, mix, release, row_id, shared_dir, span_hashes

#: Counts up to K are discounted by Good-Turing.
K = 5
HOT_WORDS = 1 << 17
#: Text bytes of a batch, and tokens that a bucket is to hold about.
BATCH_BYTES, BUCKET_TOKENS = 1 << 23, 2_000_000
END, BEGIN = np.uint64(0x7E57_E4D0_0000_0001), np.uint64(1 << 62)
_RARE = np.uint64(1 << 63)


# ---- compressed blobs of number arrays ----


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with the bytes of equal weight side by side, compressed."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.num, len(a)))], np.int64)
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + body)


_KINDS = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.int32, np.uint32, np.int64, np.uint64, np.float64)}


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 + 16 * n, []
    for i in range(n):
        kind, size = _KINDS[int(head[2 * i])], int(head[2 * i + 1])
        part = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(part.T).reshape(-1).view(kind))
        at += size * kind.itemsize
    return out


# ---- discounts ----


@dataclass(frozen=True)
class Discount:
    """Discounted counts: by_count[r] for r <= K, r - above beyond."""

    by_count: tuple[float, ...]
    above: float

    def __call__(self, r: np.ndarray) -> np.ndarray:
        small = np.array(self.by_count)
        return np.where(r <= K, small[np.minimum(r, K)], r - self.above)


def good_turing(seen: list[int]) -> Discount:
    """From the numbers of types seen 1 .. K+1 times."""
    n = [0, *seen]
    values: list[float] = []
    if all(n[1:]):
        tail = (K + 1) * n[K + 1] / n[1]
        values = [r * (((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)) if tail != 1 else 0.0 for r in range(1, K + 1)]
    if not values or any(not 0 < v < r for r, v in enumerate(values, 1)):
        d = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] + n[2] else 0.5
        values = [r - d for r in range(1, K + 1)]
    return Discount((0.0, *values), min(0.5, max(0.001, K - values[-1])))


# ---- batches of documents as tokens ----


def _batches(source: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(token hashes, tokens of each document, training flags, ids) of runs of
    documents with about ``limit`` bytes."""
    ids, flags, hashes, counts, held = [], [], [], [], 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        words, per_doc = np.concatenate(hashes), np.concatenate(counts)
        of = np.repeat(np.arange(len(per_doc)), per_doc)
        tokens = np.full(len(words) + len(per_doc), END)
        tokens[np.arange(len(words)) + of] = words
        return tokens, per_doc + 1, np.concatenate(flags), pa.concat_arrays(ids)

    for batch in source:
        body = batch.column(1).cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = body.buffers()
        bounds = np.frombuffer(offsets, np.int64)[body.offset : body.offset + len(body) + 1]
        raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        for a, b in chunks(np.diff(bounds) + 16):
            part = raw[bounds[a] : bounds[b]]
            starts, ends, before = byte_words(part, bounds[a : b + 1] - bounds[a])
            hashes.append(span_hashes(BYTE_VALUE[part], starts, ends))
            counts.append(np.diff(before))
            ids.append(batch.column(0).slice(a, b - a))
            flags.append(batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool))
            held += int(bounds[b] - bounds[a]) + 16 * (b - a)
            if held >= limit:
                yield out()
                ids, flags, hashes, counts, held = [], [], [], [], 0
    if held:
        yield out()


def _word_counts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tokens, per_doc, train, _ in _batches(source):
        word, of, n = np.unique(tokens, return_inverse=True, return_counts=True)
        trained = np.bincount(of[np.repeat(train, per_doc)], minlength=len(word))
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(trained.astype(np.int64))], names=["word", "n", "trained"])
        del tokens, word, of, n, trained
        release()


@dataclass(frozen=True)
class Plan:
    """What every task knows: hot words in order of their hashes, with training
    counts, and the number of buckets."""

    hot: np.ndarray
    hot_counts: np.ndarray
    buckets: int


def _coded(words: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Rank of a hot word, marked hash of another."""
    at = np.searchsorted(hot, words)
    at[at == len(hot)] = 0
    found = hot[at] == words if len(hot) else np.zeros(len(words), bool)
    return np.where(found, at.astype(np.uint64), words | _RARE)


def _pairs(tokens: np.ndarray, per_doc: np.ndarray, plan: Plan) -> tuple[np.ndarray, ...]:
    """Distinct (word, history) pairs of a batch, sorted by bucket, word and
    history: bucket, word code, history code, and each token's pair."""
    word, of = np.unique(tokens, return_inverse=True)
    codes = np.append(_coded(word, plan.hot), BEGIN)
    order = np.argsort(codes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes = codes[order]
    w = place[of]
    h = np.empty(len(tokens), np.int64)
    h[1:] = w[:-1]
    h[np.concatenate([[0], np.cumsum(per_doc)[:-1]])] = place[len(word)]
    key, pair_of = np.unique(w * len(codes) + h, return_inverse=True)
    w_code, h_code = codes[key // len(codes)], codes[key % len(codes)]
    deal = mix(w_code + _MIX_A)
    deal = np.where(w_code < _RARE, mix(deal + h_code), deal)
    bucket = (deal % np.uint64(plan.buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return bucket[order], w_code[order], h_code[order], place[pair_of]


def _mark(w: np.ndarray, h: np.ndarray) -> int:
    """A sum of hashes of pairs, as a signed number."""
    return int(np.sum(mix(w + mix(h)), dtype=np.uint64).view(np.int64))


def _batch_id(number: int) -> int:
    return (TaskContext.get().partitionId() << 24) | number


def _requests(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = shared.value
        for number, (tokens, per_doc, train, _) in enumerate(_batches(source)):
            bucket, w, h, pair_of = _pairs(tokens, per_doc, plan)
            trained = np.bincount(pair_of[np.repeat(train, per_doc)], minlength=len(w)).astype(np.uint32)
            cuts = np.searchsorted(bucket, np.arange(plan.buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cuts)):
                s = slice(cuts[b], cuts[b + 1])
                first = np.flatnonzero(np.diff(w[s], prepend=~w[s][:1]))
                run_ = np.diff(np.append(first, cuts[b + 1] - cuts[b])).astype(np.uint32)
                rows.append((int(b), _batch_id(number), pack(np.diff(w[s][first], prepend=np.uint64(0)), run_, h[s], trained[s])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "batch", "blob"])
            del tokens, bucket, w, h, pair_of, trained, rows
            release()

    return run


def _asked(blob: bytes) -> tuple[np.ndarray, ...]:
    steps, run_, h, trained = unpack(blob)
    return np.repeat(np.cumsum(steps, dtype=np.uint64), run_), h, trained, run_


ANSWER = "kind string, a long, b long, mark long, blob binary"


def _answers(shared: object, p_discount: Discount, total: int, history_buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Count the pairs of a bucket and answer every batch that asked."""

    def run(group: pa.Table) -> pa.Table:
        release()
        plan: Plan = shared.value
        batches = group.column("batch").to_pylist()
        parts = [_asked(x.as_py()) for x in group.column("blob")]
        w, h, trained = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((h, w))
        ws, hs = w[order], h[order]
        new = np.ones(len(ws), bool)
        new[1:] = (ws[1:] != ws[:-1]) | (hs[1:] != hs[:-1])
        first = np.flatnonzero(new)
        count = np.add.reduceat(trained[order].astype(np.int64), first)
        pair = np.empty(len(w), np.int64)
        pair[order] = np.cumsum(new) - 1
        pw, ph = ws[first], hs[first]
        del order, ws, hs, new, w, h, trained
        # training counts of the words: known of hot ones, all here of others
        word_first = np.flatnonzero(np.diff(pw, prepend=~pw[:1]))
        runs = np.diff(np.append(word_first, len(pw)))
        own = np.add.reduceat(count, word_first)
        hot = pw[word_first] < _RARE
        own[hot] = plan.hot_counts[pw[word_first][hot].astype(np.int64)]
        of_word = np.repeat(own, runs)
        rows = []
        at = 0
        for batch, (bw, bh, _, run_) in zip(batches, parts, strict=True):
            mine = pair[at : at + len(bw)]
            at += len(bw)
            c = count[mine].astype(np.uint64)
            lead = np.concatenate([[0], np.cumsum(run_)[:-1]]).astype(np.int64)
            rows.append(("answer", batch, int(group.column("bucket")[0].as_py()), _mark(bw, bh), pack(run_, of_word[mine[lead]].astype(np.uint64), c, bh[c == 0])))
        del parts, pair
        seen = count > 0
        pw, ph, count, of_word = pw[seen], ph[seen], count[seen], of_word[seen]
        bucket = int(group.column("bucket")[0].as_py())
        rows.append(("pairs", bucket, len(pw), 0, pack(pw, ph, count.astype(np.uint64))))
        for r, n in enumerate(np.bincount(np.minimum(count, K + 2), minlength=K + 3)[1 : K + 2]):
            rows.append(("seen", r, int(n), 0, b""))
        if len(ph):
            order = np.argsort(ph, kind="stable")
            ph, count, mass = ph[order], count[order], p_discount(of_word[order]) / total
            first = np.flatnonzero(np.diff(ph, prepend=~ph[:1]))
            sums = [np.add.reduceat((count == r).astype(np.int64), first) for r in range(1, K + 1)]
            sums += [np.add.reduceat((count > K).astype(np.int64), first), np.add.reduceat(count, first)]
            mass, ph = np.add.reduceat(mass, first), ph[first]
            deal = (mix(ph + _MIX_A) % np.uint64(history_buckets)).astype(np.int64)
            order = np.argsort(deal, kind="stable")
            cuts = np.searchsorted(deal[order], np.arange(history_buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                s = order[cuts[b] : cuts[b + 1]]
                rows.append(("history", int(b), len(s), 0, pack(ph[s], mass[s], *[x[s].astype(np.uint64) for x in sums])))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "a", "b", "mark", "blob"])

    return run


def _weights(discount: Discount) -> Callable[[pa.Table], pa.Table]:
    """Exact backoff weights of the histories of a bucket."""

    def run(group: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in group.column("blob")]
        columns = [np.concatenate([p[i] for p in parts]) for i in range(len(parts[0]))]
        order = np.argsort(columns[0], kind="stable")
        h = columns[0][order]
        first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        mass = np.add.reduceat(columns[1][order], first)
        sums = [np.add.reduceat(c[order].astype(np.int64), first) for c in columns[2:]]
        left = sum((r - discount.by_count[r]) * sums[r - 1] for r in range(1, K + 1)) + discount.above * sums[K]
        alpha = left / sums[K + 1] / (1 - mass)
        return pa.Table.from_arrays([pa.array(h[first].view(np.int64)), pa.array(sums[K + 1]), pa.array(alpha)], names=["history", "n", "alpha"])

    return run


def _posts(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The batches again: each token's pair and the documents' sizes."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = shared.value
        for number, (tokens, per_doc, train, ids) in enumerate(_batches(source)):
            _, w, h, pair_of = _pairs(tokens, per_doc, plan)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            blob = pack(pair_of.astype(np.uint32), per_doc.astype(np.int64), train.astype(np.uint8), known.astype(np.uint8), ids.fill_null(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([_batch_id(number)], pa.int64()), pa.array([_mark(w, h)], pa.int64()), pa.array([blob], pa.binary())], names=["batch", "mark", "blob"])
            del tokens, w, h, pair_of, blob
            release()

    return run


SCORED = "batch long, place long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, part double, rare array<long>"


def _evaluate(shared: object, alphas: object, words: Discount, pairs: Discount, total: int, types: int, documents: int, unknown: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores of a batch's documents from its answers; the weights of rare
    histories are left to a join."""

    def run(post: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        if len(post) != 1 or sum(answers.column("mark").to_pylist()) % (1 << 64) != post.column("mark")[0].as_py() % (1 << 64):
            raise ValueError("the documents came in another order when read again; write them to a table first")
        pair_of, per_doc, train, known_id, ids = unpack(post.column("blob")[0].as_py())
        own, count, zero_h = [], [], []
        for i in np.argsort(answers.column("b").to_numpy()):
            run_, c1, c, bh = unpack(answers.column("blob")[int(i)].as_py())
            own.append(np.repeat(c1, run_))
            count.append(c)
            zero_h.append(bh)
        own, count, zero_h = np.concatenate(own).astype(np.int64), np.concatenate(count).astype(np.int64), np.concatenate(zero_h)
        # by distinct pair: unigram terms, and what pairs seen in training give
        p1 = np.log10(np.where(own > 0, words(own) / max(total, 1), unknown))
        base = np.log10((own + 0.1) / (total + 0.1 * (types + 1)))
        seen = count > 0
        direct = np.where(seen, np.log10(np.where(seen, pairs(count), 1.0)), p1)
        back = np.zeros(len(own))
        is_rare = np.zeros(len(own), bool)
        if len(zero_h):
            hot = alphas.value
            slot = np.where(zero_h == BEGIN, np.uint64(len(hot) - 1), zero_h)
            is_hot = zero_h < _RARE
            back_zero = np.zeros(len(zero_h))
            back_zero[is_hot] = hot[slot[is_hot].astype(np.int64)]
            back[~seen] = back_zero
            is_rare[~seen] = ~is_hot
        firsts = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
        word_count = own[pair_of]
        before = np.empty(len(pair_of), np.int64)
        before[1:] = word_count[:-1]
        before[firsts] = documents
        token_seen = seen[pair_of]
        score = direct[pair_of] - np.where(token_seen, np.log10(np.maximum(before, 1)), 0.0) + back[pair_of]
        # rare histories seen in training: their weights come by a join
        ask = np.flatnonzero(is_rare[pair_of] & (before > 0))
        codes = np.zeros(len(own), np.uint64)
        codes[~seen] = zero_h
        rare = codes[pair_of[ask]].view(np.int64)
        at = np.searchsorted(ask, np.append(firsts, len(pair_of))).astype(np.int32)
        n = len(per_doc)
        return pa.Table.from_arrays(
            [
                pa.array(np.full(n, post.column("batch")[0].as_py(), np.int64)),
                pa.array(np.arange(n)),
                pa.array(ids, mask=known_id == 0),
                pa.array(train == 0),
                pa.array(per_doc),
                pa.array(np.add.reduceat((word_count > 0).astype(np.int64), firsts)),
                pa.array(np.add.reduceat(base[pair_of], firsts)),
                pa.array(np.add.reduceat(score, firsts)),
                pa.ListArray.from_arrays(pa.array(at), pa.array(rare)),
            ],
            names=[x.split()[0] for x in SCORED.split(", ")],
        )

    return run


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 10; true for null."""
    return F.coalesce(F.crc32(row_id(key).cast("string").cast("binary")) % 10 == 0, F.lit(True))


@dataclass(frozen=True)
class Model:
    """Where the tables lie, and the sums over the corpus."""

    place: str
    tokens: int
    types: int
    documents: int
    words: Discount
    pairs: Discount
    unknown: float

    def pairs_table(self, spark: SparkSession) -> DataFrame:
        """Pages (a: bucket, b: pairs, blob) of word code, history code and count."""
        return spark.read.parquet(f"{self.place}/counts").where("kind = 'pairs'")

    def histories(self, spark: SparkSession) -> DataFrame:
        """(history, n, alpha)."""
        return spark.read.parquet(f"{self.place}/histories")

    def word_table(self, spark: SparkSession) -> DataFrame:
        """(word, n, trained): hash, count in all and in training documents."""
        return spark.read.parquet(f"{self.place}/words")


def _plain_scan(docs: DataFrame) -> bool:
    """Whether the rows come straight from files, in the same order each time."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    return all(re.match(r"[\s:+-]*(Project|Filter|Relation)\b", line) for line in plan.splitlines() if line.strip())


def score_corpus(docs: DataFrame, text: str = "text", key: str = "doc_id", place: str | None = None, batch_words: int = BUCKET_TOKENS) -> tuple[DataFrame, Model]:
    """Learn from the training documents and score all. Returns (doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score), a row per
    input row, and the model."""
    spark = docs.sparkSession
    place = place or f"{shared_dir(spark)}/katz-{uuid.uuid4().hex}"
    if not _plain_scan(docs):
        docs = cut(docs.select(key, text))
    rows = docs.select(row_id(key).alias("doc_id"), F.col(text).cast("binary").alias("body"), (~held_out(F.col(key))).alias("train"))

    counted = rows.mapInArrow(_word_counts, "word long, n long, trained long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))
    counted.write.parquet(f"{place}/words")
    words = spark.read.parquet(f"{place}/words")
    small = [F.count(F.when(F.col("trained") == r, 1)).alias(f"r{r}") for r in range(1, K + 2)]
    got = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum("trained"), F.lit(0)).alias("tokens"), F.count(F.when(F.col("trained") > 0, 1)).alias("types"),
        F.coalesce(F.max(F.when(F.col("word") == int(END), F.col("trained"))), F.lit(0)).alias("documents"), *small,
    ).first()
    total, types, documents = got["tokens"], got["types"], got["documents"]
    seen = [got[f"r{r}"] for r in range(1, K + 2)]
    one = good_turing(seen)
    kept = sum((r - one.by_count[r]) * seen[r - 1] for r in range(1, K + 1)) + one.above * (types - sum(seen[:K]))
    unknown = kept / total if total else 1.0

    # each of these has more than 1/HOT_WORDS of the tokens, so there are fewer than HOT_WORDS
    hot = words.where(F.col("n") * HOT_WORDS > got["all"]).select("word", "trained").collect()
    hot_hash, hot_count = np.array([r[0] for r in hot], np.int64).view(np.uint64), np.array([r[1] for r in hot], np.int64)
    order = np.argsort(hot_hash)
    buckets = max(spark.sparkContext.defaultParallelism, -(-got["all"] // batch_words), 1)
    plan = spark.sparkContext.broadcast(Plan(hot_hash[order], hot_count[order], buckets))

    asked = rows.mapInArrow(_requests(plan), "bucket long, batch long, blob binary")
    answered = asked.groupBy("bucket").applyInArrow(_answers(plan, one, max(total, 1), buckets), ANSWER)
    answered.write.partitionBy("kind").parquet(f"{place}/counts")
    # an empty table writes no kind at all
    counts = spark.read.schema(ANSWER).parquet(f"{place}/counts")
    pair_seen = np.zeros(K + 1, np.int64)
    for r in counts.where("kind = 'seen'").groupBy("a").agg(F.sum("b").alias("n")).collect():  # K + 1 rows
        pair_seen[r.a] = r.n
    two = good_turing(pair_seen.tolist())

    weights = counts.where("kind = 'history'").groupBy("a").applyInArrow(_weights(two), "history long, n long, alpha double")
    weights.write.parquet(f"{place}/histories")
    weights = spark.read.parquet(f"{place}/histories")
    logs = np.zeros(len(hot) + 1)
    for code, alpha in weights.where(F.col("history") >= 0).select("history", F.log10("alpha")).collect():  # hot words and the begin mark
        logs[len(hot) if code == int(BEGIN) else code] = alpha
    alphas = spark.sparkContext.broadcast(logs)

    posts = rows.mapInArrow(_posts(plan), "batch long, mark long, blob binary")
    answers = counts.where("kind = 'answer'").select(F.col("a").alias("batch"), "b", "mark", "blob")
    scored = cut(posts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_evaluate(plan, alphas, one, two, total, types, documents, unknown), SCORED))
    rare = scored.select("batch", "place", F.explode("rare").alias("history")).join(weights, "history")
    rare = rare.groupBy("batch", "place").agg(F.sum(F.log10("alpha")).alias("more"))
    whole = scored.join(rare, ["batch", "place"], "left")
    out = whole.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("score")
    )
    return out, Model(place, total, types, documents, one, two, unknown)
