"""The corpus operators against plain Python versions of what they promise."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from retrolens.llm import chat, common, decontaminate, katz, license_scan, packing, quality, simhash, token_count, url_filter, warc

DOC = "doc_id long, text string, score string, kept int, n_words int"


def docs_of(spark, rows, parts=3):
    """Documents with extra columns whose names clash with the operators'."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOC).repartition(parts)


def words(rng, n, vocabulary=300):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "one two"), (905, "one two"), (None, "no id here at all"), (906, "é ü\u00a0x \x1c y " * 30), (907, "a b c " * 4000)]


# ---- 7: SimHash ----


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_components(prints):
    """Smallest id reachable, by id; prints: (id, fp)."""
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {(i, f): least.get(find(f)) for i, f in prints}


def test_simhash_fingerprints_and_components(spark):
    rng = random.Random(1)
    base = words(rng, 400)
    rows = list(ODD)
    for i in range(60):
        w = list(base)
        for _ in range(i % 6):
            w[rng.randrange(400)] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(words(rng, 30))) for i in range(20)]
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    assert Counter((r.doc_id, r.fp & (2**64 - 1)) for r in got) == Counter(prints)
    want = plain_components(prints)
    assert all(r.component_id == want[r.doc_id, r.fp & (2**64 - 1)] for r in got)
    kept = [r for r in simhash.one_per_group(docs_of(spark, rows)).collect() if r.doc_id is not None]
    assert sorted(r.doc_id for r in kept) == sorted({c for c in want.values() if c is not None})
    assert set(kept[0].asDict()) == {"doc_id", "text", "score", "kept", "n_words"}


@pytest.mark.parametrize("hot", [2, 64])
def test_simhash_links_with_hot_entries(spark, hot):
    rng = random.Random(2)
    seed = rng.getrandbits(64)
    fps = {seed}
    for _ in range(300):
        fps.add(seed ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 5]))))
    fps |= {rng.getrandbits(64) for _ in range(50)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = simhash.connected(simhash.links(frame, hot)).collect()
    roots = {r.node: r.root for r in found}
    want = plain_components([(f - (1 << 64) if f >> 63 else f, f) for f in fps])
    groups = lambda m: Counter(frozenset(g) for g in m)
    by_got, by_want = defaultdict(set), defaultdict(set)
    for f in signed:
        by_got[roots.get(f, f)].add(f)
    for (i, _), c in want.items():
        by_want[c].add(i)
    assert groups(by_got.values()) == groups(by_want.values())


def test_simhash_long_text_in_pieces(monkeypatch):
    text = " ".join(words(random.Random(3), 500))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_PIECE", 37)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


# ---- 1: decontamination ----


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_overlap(doc, item):
    d, t = plain_words(doc), plain_words(item)
    size = min(13, len(t))
    if size < 5:
        return False
    need = 11 if size == 13 else size
    return any(sum(a == b for a, b in zip(d[i : i + size], t[j : j + size])) >= need for i in range(len(d) - size + 1) for j in range(len(t) - size + 1))


def test_decontamination_against_all_windows(spark):
    rng = random.Random(4)
    items = [(k, " ".join(words(rng, rng.choice([3, 6, 12, 13, 20, 40])))) for k in range(25)] + [(50, None), (51, "")]
    items.append((52, items[3][1].upper()))
    rows = list(ODD)
    for i in range(120):
        w = words(rng, rng.choice([0, 10, 60]))
        t = plain_words(rng.choice(items)[1])
        cutout = t[rng.randrange(3) :] if rng.random() < 0.5 else t
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            if cutout:
                cutout[rng.randrange(len(cutout))] = "other"
        at = rng.randrange(len(w) + 1)
        rows.append((i, ", ".join(w[:at] + cutout + w[at:])))
    benchmark = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs_of(spark, rows), benchmark).collect()}
    first = {}
    for k, t in items:
        first.setdefault(t, k)
    want = {(i, k) for i, d in rows for k, t in items if first[t] == k and plain_overlap(d, t)}
    assert got == want and len(want) > 20
    left = decontaminate.decontaminate(docs_of(spark, rows), benchmark).collect()
    bad = {i for i, _ in want}
    assert Counter(r.doc_id for r in left) == Counter(i for i, _ in rows if i not in bad)
    # a benchmark of several filters, too large to be broadcast
    with pytest.MonkeyPatch.context() as m:
        m.setattr(decontaminate, "MOST_BITS", 12)
        m.setattr(decontaminate, "LEAST_BITS", 8)
        m.setattr(decontaminate, "FEW_SEEDS", 10)
        assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs_of(spark, rows), benchmark).collect()} == want
    assert decontaminate.overlaps(docs_of(spark, rows).where("1 = 0"), benchmark).count() == 0
    empty = benchmark.where("1 = 0")
    assert decontaminate.overlaps(docs_of(spark, rows), empty).count() == 0
    assert decontaminate.decontaminate(docs_of(spark, rows), empty).count() == len(rows)


# ---- 2: licences ----


def test_license_scan(spark):
    known = dict(license_scan.KNOWN)
    mit, bsd, isc = known["MIT"], known["BSD-3-Clause"], known["ISC"]
    wrapped = "\n".join(re.findall(r".{1,70}(?: |$)", mit.replace("\n\n", " ")))
    rows = [
        (1, mit), (2, "Copyright (c) 2019 Someone\nAll rights reserved.\n" + mit.upper().replace(",", " ;")), (3, "MIT Licence\n\nCopyright (c) 2019 Some One\n" + mit.replace("sublicense", "sublicence")),
        (4, isc + " more"), (5, "Released under the MIT Licence!"), (6, "# MIT\n\n" + mit), (7, "Copyright (c) Jane Doe\n\n" + mit), (8, "Copyright 1999-2004 J. Doe, all rights reserved. " + " ".join(mit.split())),
        (9, "**BSD 3-Clause License**\n\nCopyright © 2001, The Authors\nAll rights reserved.\n\n" + bsd), (10, "/* Copyright Jane Doe */\n" + wrapped), (11, "some text\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0\nReleased under the MIT License"),
        (12, "copyright holders"), (13, "x" * 300_000 + "\n" + mit), *ODD,
    ]
    frame = spark.createDataFrame([(*r, "y", "z") for r in rows], "doc_id long, text string, license string, digest string")
    found = license_scan.scan(frame, license_scan.known_texts(spark), digests=license_scan.known_digests(spark))
    got = {r.doc_id: r.license for r in found.collect()}
    assert {i for i, x in got.items() if x == "MIT"} == {1, 2, 3, 6, 7, 8, 10} and got[9] == "BSD-3-Clause" and got[5] == "notice:MIT"
    assert all(got[i] is None for i in (4, 11, 12, 13, 900)) and found.count() == len(rows)
    notices = {r.doc_id: r.notices for r in found.collect()}
    assert notices[11] == "notice:CC-BY-NC-4.0,notice:MIT" and notices[5] == "notice:MIT" and notices[1] is None
    assert license_scan.scan(frame.where("1 = 0"), license_scan.known_texts(spark)).count() == 0
    # the same over a planted table by the SQL
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    want = con.execute(license_scan.oracle_sql()).fetchall()
    assert Counter(want) == Counter(tuple(r) for r in found.collect())


def test_long_licenses_by_their_digests(spark):
    """The texts as a Debian system holds them, where there is one."""
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
    places = {n: Path("/usr/share/common-licenses", f) for f, n in names.items()}
    rows = [(i, "\n\n" + p.read_text().replace("Copyright (C) 2007", "Copyright 2008").upper()) for i, p in enumerate(places.values()) if p.exists()]
    if not rows:
        pytest.skip("no such texts here")
    got = license_scan.scan(docs_of(spark, rows), license_scan.known_texts(spark), digests=license_scan.known_digests(spark)).collect()
    assert [r.license for r in sorted(got)] == [n for n, p in places.items() if p.exists()]


# ---- 3: token counts ----


def test_token_counts_are_the_librarys(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["<|endoftext|>a<|endoftext|> b", "don't WE'LL 'S ''s 12 345\u00b2", "  \n\n  x \t y   ", "\x1c\x1d a\x85b \u200b \u3000z\u2028", "日本語テキスト 🙂🙂", "x" * 5000, "\x00\x01", " " * 3000 + "a"]
    rows = [*enumerate(texts), *[(i and i + 10_000, t) for i, t in ODD]]
    got = token_count.token_counts(docs_of(spark, rows), path).collect()
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_token_counts_of_long_texts_in_runs(monkeypatch):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        counter = token_count.WholeTokenCounter(f.read())
    text = "The quick brown fox isn't there, 123 times\n\n" * 50
    n = counter.count(text)
    monkeypatch.setattr(token_count, "_LONG_TEXT", 10)
    assert counter.count(text) == n


# ---- 4: Katz ----


def plain_katz(rows):
    """Scores by dictionaries; also every history's distribution sums to one."""
    texts = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    uni, bi = Counter(), Counter()
    for i, t in texts:
        if not held(i):
            uni.update(t)
            bi.update(zip([0, *t], t))
    n, v = sum(uni.values()), len(uni)
    hist = lambda c: [sum(x == r for x in c.values()) for r in range(1, katz.K + 2)]
    d1, d2 = katz.good_turing(hist(uni)), katz.good_turing(hist(bi))
    one = lambda d, r: float(d(np.array([r]))[0])
    p = {w: one(d1, c) / n for w, c in uni.items()}
    unknown = 1 - sum(p.values()) if n else 1.0
    seen, total = defaultdict(dict), Counter()
    for (h, w), c in bi.items():
        seen[h][w], total[h] = c, total[h] + c
    alpha = {h: (1 - sum(one(d2, c) for c in ws.values()) / total[h]) / (1 - sum(p[w] for w in ws)) for h, ws in seen.items()}

    def prob(h, w):
        if w in seen.get(h, {}):
            return one(d2, seen[h][w]) / total[h]
        return alpha.get(h, 1.0) * p.get(w, unknown)

    for h in list(seen)[:20]:
        assert math.isclose(sum(prob(h, w) for w in [*uni, "never"]), 1, rel_tol=1e-9)
    out = Counter()
    for i, t in texts:
        score = sum(math.log10(prob(h, w)) for h, w in zip([0, *t], t))
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        out[i, held(i), len(t), sum(uni[w] > 0 for w in t), n, round(base, 5), round(score, 5)] += 1
    return out


@pytest.mark.parametrize("batch,hot", [(1 << 24, 1 << 17), (3000, 40), (500, 1)])
def test_katz_scores(spark, monkeypatch, batch, hot):
    monkeypatch.setattr(katz, "HOT_WORDS", hot)
    monkeypatch.setattr(katz._batches, "__defaults__", (batch,))
    rng = random.Random(5)
    rows = [(i, " ".join("w" + str(int(rng.paretovariate(0.7))) for _ in range(rng.randrange(80)))) for i in range(300)] + ODD + [(3, "w1 w2 W1 new")]
    got, model = katz.score_corpus(docs_of(spark, rows), batch_words=900)
    found = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got.collect())
    assert found == plain_katz(rows)
    assert model.pairs_table(spark).count() > 1 and model.histories(spark).count() > 10


def test_katz_without_rows(spark):
    got, _ = katz.score_corpus(docs_of(spark, [(1, "a")]).where("doc_id = 2"))
    assert got.count() == 0
    got, _ = katz.score_corpus(docs_of(spark, [(None, "a b"), (None, None)]))
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got.collect()) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]


# ---- 5: quality rules ----


def plain_measures(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    return *n, n[0] < 50 or 100 * n[4] > 50 * n[0]


def plain_tokens(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]+", text or "")


def spark_hash(spark, *parts):
    from pyspark.sql import functions as F

    return spark.range(1).select(F.xxhash64(*map(F.lit, parts))).first()[0]


def test_quality_measures_and_filter(spark):
    rng = random.Random(6)
    rows = list(ODD)
    for i in range(60):
        w = words(rng, rng.randrange(200), rng.choice([5, 50, 5000]))
        rows.append((i, "".join(x + rng.choice([" ", "  ", "\n", "\t", " #%", "\r\n"]) for x in w)))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)] + [(5, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows)
    got = quality.judge(docs, labels).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *(r[c] for c in cols)) for r in got) == Counter((i, *plain_measures(t)) for i, t in rows)
    assert all(r.kept == (not r.base_failed and r.score >= quality.THRESHOLD) for r in got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality.judge(docs.where("1 = 0"), labels).count() == 0
    assert {r.score for r in quality.judge(docs, labels.where("1 = 0")).collect()} == {0.0}


def test_quality_score_is_the_likelihood_ratio(spark, monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 50)
    rows = [(1, "good words here good"), (2, "bad! bad! bad!"), (3, "good bad")]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    grams = {i: [spark_hash(spark, *g) % 50 for n in (1, 2) for g in zip(*(plain_tokens(t)[k:] for k in range(n)))] for i, t in rows}
    raw, good = Counter(x for g in grams.values() for x in g), Counter(grams[1])
    ratio = lambda b: math.log((good[b] + 1) / (sum(good.values()) + 50)) - math.log((raw[b] + 1) / (sum(raw.values()) + 50))
    for r in quality.judge(docs_of(spark, rows), labels).collect():
        assert math.isclose(r.score, sum(map(ratio, grams[r.doc_id])) / len(grams[r.doc_id]), rel_tol=1e-9)


# ---- 6: packing ----


def padding_of(bounds, lengths):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


def test_packing_boundaries_are_optimal():
    rng = random.Random(7)
    for turn in range(60):
        far = (1, 100, 3000)[turn % 3]
        lengths = [rng.choice([0, 1, 2, 5, 9, 30, 31, 90]) * far + rng.randrange(4 * far) for _ in range(rng.randrange(1, 16 if far > 1 else 40))]
        counts = sorted(Counter(lengths).items())
        top, count = (list(x) for x in zip(*counts))
        for k in (1, 2, 3, 5):
            bounds = packing.best_boundaries(top, count, k)
            assert len(bounds) <= k and bounds[-1] == max(lengths)
            best = min(padding_of([*c, max(lengths)], lengths) for m in range(k) for c in itertools.combinations(top, m))
            assert padding_of(bounds, lengths) == best
    assert packing.best_boundaries([], [], 4) == []


def test_packing_of_long_texts_is_optimal(spark):
    """Lengths far above a few thousand words, each of its own: the query's buckets against a plain programme."""
    rng = random.Random(17)
    lengths = [rng.choice([5, 4000, 20_000]) + rng.randrange(300) for _ in range(120)]
    rows = [(i, "w " * n) for i, n in enumerate(lengths)]
    got = packing.pack(docs_of(spark, rows), buckets=4).collect()
    tops = sorted(set(lengths))
    most = {(0, 0): 0}
    for b in range(1, 5):
        for j in range(1, len(tops) + 1):
            held = [most[b - 1, i] + sum(tops[j - 1] - n for n in lengths if (i == 0 or n > tops[i - 1]) and n <= tops[j - 1]) for i in range(j) if (b - 1, i) in most]
            if held:
                most[b, j] = min(held)
    assert sum(r.padding for r in got) == most[4, len(tops)]


def test_packing_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 20)
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, rng.choice([0, 3, 10, 60, 300, 3000])))) for i in range(200)] + ODD + [(5, "again")]
    got = packing.pack(docs_of(spark, rows), buckets=4, budget=500).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in rows)
    batches = defaultdict(list)
    for r in got:
        assert r.padding == r.bucket_words - r.n_words >= 0
        batches[r.bucket, r.batch].append(r)
    last = {b: max(k[1] for k in batches if k[0] == b) for b, _ in batches}
    for (bucket, batch), members in batches.items():
        most = max(1, 500 // max(1, members[0].bucket_words))
        assert sorted(m.place for m in members) == list(range(len(members)))
        assert len(members) == most if batch != last[bucket] else len(members) <= most
    assert packing.pack(docs_of(spark, rows).where("1 = 0")).count() == 0


# ---- 8: WARC ----


def test_warc_round_trip(spark, tmp_path):
    html = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>é"
    rows = [(1, "http://a/x", html), (2, "http://a/y", html), (3, None, html), (4, "u\r\nrl", None), (5, "http://b", ""), (6, "http://b", "only"), (7, "z", "x" * 200_000), (None, "n", "null id")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    place = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.capture_table(spark, place).collect()}
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(i or 0, last.get(h or "", 0))
    for i, _, h in rows:
        r, body = got[i], (h or "").encode()
        assert r.response.payload_bytes == len(body)
        assert r.response.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() == r.response.declared_digest
        first = i is None or last[h or ""] == i
        assert (r.response.kind, r.refers_to_page) == (("response", None) if first else ("revisit", last[h or ""]))
        assert r.request is not None and r.metadata.block.startswith(f"payload-bytes: {len(body)}")
    assert got[3].response.kind == "response" and got[3].response.block.endswith(html)
    assert all(r.consistent for r in got.values())
    small = warc.captures(pages, min_revisit_bytes=1).where("page_id IN (4, 5)")
    assert [r.last_id for r in small.collect()] == [None, None]
    empty = warc.write_archives(pages.where("1 = 0"), f"file://{tmp_path}/e")
    assert warc.capture_table(spark, empty).count() == 0


def test_warc_repeated_rows_and_broken_revisits(spark, tmp_path, monkeypatch):
    """Equal ids, payloads and even urls: a capture each, with requests of its own; files bounded by bytes."""
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)
    rows = [(1, "http://a/x", "same"), (1, "http://b/y", "same"), (1, "http://b/y", "same"), (2, "http://c", "same"), (2, "http://b", "same"), (None, "n", "same"), (None, "n", "same"), (3, "big", "z" * 900_000), (4, "big", "y" * 900_000)]
    rows += [(100 + i, "u", f"page {i} " * 1500) for i in range(60)]
    place = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    got = warc.capture_table(spark, place).collect()
    assert Counter((r.page_id, r.response.target) for r in got) == Counter((i, u) for i, u, _ in rows)
    assert len({r.response.record_id for r in got}) == len(rows)
    assert all(r.request.target == r.response.target and r.metadata is not None and r.consistent for r in got)
    assert all(r.refers_to_page == (2 if r.page_id == 1 else None) for r in got)
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").glob("part-*")]
    assert len(sizes) > 3 and sum(n > 250_000 for n in sizes) == 2  # the two large captures have a file each
    for p in (tmp_path / "w").glob("part-*"):
        p.write_bytes(gzip.compress(gzip.decompress(p.read_bytes()).replace(b"Content-Length: 4\r\n\r\nsame", b"Content-Length: 4\r\n\r\nsAme")))
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    broken = warc.capture_table(spark, place).collect()
    assert {r.page_id for r in broken if not r.consistent} == {1, 2, None}


# ---- 9: URLs ----


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else None


def test_url_rules_and_templates(spark):
    rng = random.Random(9)
    urls = [None, "", "no scheme/x", "http://", "HTTP://A.COM/en/1?x#y", "x://Example.COM/en/7", "https://b.example.com/en/71/2", "x://net/de/", "x://q.example.net/de/8", "x://xnet/de/", "x://org/es/?", "x://a://b/c", "x://ÀB.org?q/es/"]
    rows = list(enumerate(urls))
    for i in range(100, 900):
        rows.append((i, f"http://h{i % 3}.test/{rng.choice(['spam', 'news', 'blog'])}/{rng.randrange(10**6)}/{rng.choice('abcdefghijklmnopqrstuvwxyz') * 3}"))
    labels = spark.createDataFrame([(i, int("spam" not in u), 0) for i, u in rows if i >= 100 and i % 2], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(*r, "x") for r in rows] + [(4, urls[4], "x")], "page_id long, url string, host string")
    got = url_filter.judge(pages, labels).collect()
    assert len(got) == len(rows) + 1
    by_id = {r.page_id: r for r in got}
    for i, u in rows:
        r = by_id[i]
        assert (r.host, r.path) == plain_url(u)
        rule = plain_rule(r.host, r.path)
        assert r.rule == (rule[0] if rule else None)
        if rule:
            assert r.verdict == rule[1]
        elif i >= 100:
            assert r.verdict == ("block" if "spam" in u else "allow"), (u, r)
            assert r.template.endswith("/*") and r.template.split("/")[1] == "{n}"
    assert url_filter.judge(pages.where("1 = 0"), labels).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, labels.where("1 = 0")).collect() if r.page_id >= 100} == {"allow"}


# ---- 10: chat ----


def test_chat_formatting_round_trip(spark):
    rng = random.Random(10)
    bits = ["</s>", "[INST]", "[/INST]", " ", "é", "🙂", "\\", "[\\INST]", "<s>", "[ROLE]", "x\n", "", "["]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randrange(1, 8)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool [/ROLE]", None]), None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randrange(9)))))
    rows += [(3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (99, None, "assistant", "z" * 100_000), (99, 1, "user", "y")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, loss string").repartition(5)
    made = chat.format_conversations(frame)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    formatted = {r.conv_id: r for r in made.collect()}
    low = lambda x: (x is not None, x if x is not None else "")
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: ((r[1] is not None, r[1] or 0), low(r[2]), low(r[3])))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        spoken = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        want = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(spoken), hashlib.sha256(spoken.encode()).hexdigest(), len(formatted[conv].formatted))
        assert tuple(got[conv])[1:] == want
        assert [(a, b) for a, b, *_ in chat.parse(formatted[conv].formatted)] == [(r[2] or "", r[3] or "") for r in turns]
    assert chat.read_back(chat.format_conversations(frame.where("1 = 0"))).count() == 0


# ---- shared helpers ----


def test_byte_words_and_chunks():
    texts = [b"", b"a b", b"b", b" x", b"y ", b"", b"Abc\x0bdef"]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, before = common.byte_words(data, bounds)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [w for t in texts for w in t.split()]
    assert np.diff(before).tolist() == [len(t.split()) for t in texts]
    assert list(common.chunks(np.array([5, 1, 9, 1, 1]), 6)) == [(0, 2), (2, 3), (3, 5)]
    assert list(common.chunks(np.array([]), 6)) == []
