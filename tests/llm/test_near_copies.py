"""The pipeline's near-copy stage against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from retrolens.llm import near_copies, simhash

DOC = "doc_id long, text string, score string"


def plain_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def plain_components(rows):
    """Smallest id reachable over Jaccard of 0.8 or more, by place in ``rows``."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(rows))]


def edited_rows(groups=40):
    rng, rows = random.Random(7), [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE "), (905, "one two"), (None, "no id here at all")]
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        for c in range(4):
            copy = list(base)
            for _ in range((0, 1, 3, 9)[c]):
                copy[rng.randrange(200)] = f"x{rng.randrange(3000)}"
            rows.append((g * 4 + c, " ".join(copy)))
    return rows


@pytest.mark.parametrize("hot", [64, 2])
def test_near_copies_against_brute_force(spark, hot):
    rows = edited_rows(40 if hot == 64 else 12)
    got = near_copies.near_copies(spark.createDataFrame([(i, t, "x") for i, t in rows], DOC).repartition(3), hot=hot).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == sorted((i or -1, c or -1) for (i, _), c in zip(rows, plain_components(rows)))


def loose_family(n, edits, seed):
    """Copies of one text with random edits: most pairs lie about the limit."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    out = []
    for i in range(n):
        copy = list(base)
        for k in rng.sample(range(150), rng.randrange(*edits)):
            copy[k] = f"x{rng.randrange(100000)}"
        out.append((i, " ".join(copy)))
    return out


def test_members_of_crowded_entries_against_brute_force(spark):
    """No entry of this family is small, and some members link to few others."""
    rows = loose_family(70, (0, 9), 5) + [(1000 + i, t) for i, t in loose_family(30, (2, 6), 6)]
    got = near_copies.near_copies(spark.createDataFrame([(i, t, "x") for i, t in rows], DOC), hot=3).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, c) for (i, _), c in zip(rows, plain_components(rows)))


def test_prefix_pairs_miss_no_link(spark):
    """Alone, the prefix filter meets every pair of linked sets."""
    rows = loose_family(80, (0, 9), 7)
    sets = near_copies.shingle_sets([t.encode() for _, t in rows])
    frame = spark.createDataFrame([(i, [int(x) for x in s.view("int64")]) for i, s in enumerate(sets)], "node long, shingles array<long>")
    crowd = frame.select("node", frame["node"].alias("c"))
    met = {(r.a, r.b) for r in near_copies._prefix_pairs(crowd, frame).collect()}
    plain = [plain_set(t) for _, t in rows]
    near = {(a, b) for a, b in itertools.combinations(range(80), 2) if 5 * len(plain[a] & plain[b]) >= 4 * len(plain[a] | plain[b])}
    assert near and near <= met


def test_a_large_group_is_one_component(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :]), "x") for i, k in enumerate(rng.choices(range(200), k=300))]
    got = near_copies.near_copies(spark.createDataFrame(rows, DOC)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 300


def test_no_rows(spark):
    assert near_copies.one_per_group(spark.createDataFrame([], DOC)).count() == 0


@pytest.mark.parametrize("operator", [near_copies, simhash])
def test_one_row_of_each_group(spark, operator):
    """Repeated ids, null ids, ids that are no integers, equal rows and columns with clashing names."""
    text = " ".join(f"word{i}" for i in range(40))
    rows = [("1", text, "b", 1), ("1", text.upper(), "a", 2), ("2", text, "a", 3), ("x", "lone one", "a", 4), (None, "lone one", "a", 5), (None, "lone one", "a", 5), ("7", "other", "b", 6), ("7", "other", "a", 7), ("9", None, "a", 8), ("8", " ", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, component string, node int")
    got = operator.one_per_group(docs).collect()
    assert got == operator.one_per_group(docs.repartition(3)).collect() or sorted(r.node for r in got) == sorted(r.node for r in operator.one_per_group(docs.repartition(3)).collect())
    assert docs.columns == ["doc_id", "text", "component", "node"] == list(got[0].asDict())
    nodes = sorted(r.node for r in got)
    assert len(nodes) == 4 and nodes[0] in (1, 2) and nodes[1] in (4, 5) and nodes[2] in (6, 7) and nodes[3] == 9


def test_marks_let_every_link_pass_and_few_others():
    rows = loose_family(60, (0, 20), 8) + loose_family(20, (0, 3), 9) + [(0, "one"), (0, "two words"), (0, " ".join(f"v{i % 9000}" for i in range(30000)))]
    plain = [plain_set(t) for _, t in rows]
    sets = near_copies.shingle_sets([t.encode() for _, t in rows])
    pairs = list(itertools.combinations(range(len(rows)), 2))
    n, marks = [len(x) for x in sets], [near_copies._marks(x) for x in sets]
    batch = pa.RecordBatch.from_pydict({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "n_a": [n[a] for a, _ in pairs], "marks_a": [marks[a] for a, _ in pairs], "n_b": [n[b] for _, b in pairs], "marks_b": [marks[b] for _, b in pairs]})
    met = {(r["a"], r["b"]) for out in near_copies._possible(iter([batch])) for r in out.to_pylist()}
    near = {(a, b) for a, b in pairs if 5 * len(plain[a] & plain[b]) >= 4 * len(plain[a] | plain[b])}
    assert near and near <= met and len(met) < 2 * len(near)


def test_only_shared_entries_are_joined(spark, monkeypatch):
    """Texts without a near copy stay out of the join of entries."""
    rng, met = random.Random(4), []
    rows = [(i, " ".join(f"w{rng.randrange(100000)}" for _ in range(60))) for i in range(300)]
    rows += [(1000 + i, t + " more") for i, t in rows[:5]]
    real = near_copies.look_up
    monkeypatch.setattr(near_copies, "look_up", lambda r, t, on, *a: (met.append((r.count(), t.count())) if on == ["entry"] and not met else None, real(r, t, on, *a))[1])
    got = near_copies.near_copies(spark.createDataFrame([(i, t, "x") for i, t in rows], DOC)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i % 1000) for i, _ in rows}
    assert 0 < met[0][1] <= 5 * 72 and met[0][0] <= 4 * met[0][1] < 72 * len(rows) / 10


def test_the_filter_holds_every_entry(spark):
    rng = random.Random(6)
    entries = [rng.getrandbits(64) - (1 << 63) for _ in range(9000)]
    held = np.frombuffer(near_copies._filter(spark.createDataFrame([(e,) for e in entries], "entry long"), 9000), np.uint8)
    at = np.array(entries)[:, None] >> np.array([0, 32]) & (8 * len(held) - 1)
    assert (held[at >> 3] >> (at & 7) & 1).all() and np.bitwise_count(held).sum() <= 18000


def test_repeated_rows_have_one_set(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(base), "x")] * 30 + [(2, " ".join([*base[:50], "x", *base[51:]]), "x")] * 30 + [(3, "alone", "x")] * 3
    docs = spark.createDataFrame(rows, DOC).repartition(8)
    got = near_copies.near_copies(docs).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == {(1, 1): 30, (2, 1): 30, (3, 3): 3}


def linked(plain):
    return {(a, b) for a, b in itertools.combinations(range(len(plain)), 2) if 5 * len(plain[a] & plain[b]) >= 4 * len(plain[a] | plain[b])}


def test_parities_let_every_link_pass_and_few_others(spark):
    rows = loose_family(60, (0, 6), 8) + loose_family(30, (0, 3), 9) + [(0, "one"), (0, "two words"), (0, "two Words"), *((0, " ".join(f"v{i % 9000}" for i in range(k, 30000))) for k in (0, 900))]
    sets = near_copies.shingle_sets([t.encode() for _, t in rows])
    frame = spark.createDataFrame([(i, len(x), near_copies._parity(x).tolist()) for i, x in enumerate(sets)], "a long, size long, parity array<long>")
    met = {(r.a, r.b) for r in frame.crossJoin(frame.toDF("b", "size_b", "parity_b")).where("a < b").where(near_copies._near()).collect()}
    near = linked([plain_set(t) for _, t in rows])
    assert {(91, 92), (93, 94)} <= near <= met and len(met) < 2 * len(near)


@pytest.mark.parametrize("hot", [1000, 3])
def test_loose_copies_that_do_not_link_make_few_rows(spark, monkeypatch, hot):
    """Over half of a family's 19,900 pairs don't link. Few of them make rows where members that
    the leaders left apart meet: in entries, if none is hot, or by prefixes, if all are."""
    made = []
    for name in ("_pairs", "_prefix_pairs"):
        real = getattr(near_copies, name)
        monkeypatch.setattr(near_copies, name, lambda *a, real=real: (out := near_copies.cut(real(*a)), made.append({(min(r.a, r.b), max(r.a, r.b)) for r in out.collect()}))[0])
    rows = loose_family(200, (0, 5), 12)
    got = near_copies.near_copies(spark.createDataFrame([(i, t, "x") for i, t in rows], DOC), hot=hot).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, c) for (i, _), c in zip(rows, plain_components(rows)))
    assert 0 < sum(len(m) for m in made) < len(rows) / 2
