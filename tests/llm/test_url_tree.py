"""Branches that the URL filter's tree has to keep apart."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from retrolens.llm import url_filter


def judged(spark, urls, bad):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    return {r.path: r.verdict for r in url_filter.judge(pages, labels, rules=()).collect()}


def test_a_bad_branch_among_many(spark):
    urls = [f"http://h.test/{'casino' if k == 0 else chr(96 + k) * 3}/{page}" for k in range(22) for page in range(40)]
    got = judged(spark, urls, ["casino" in u for u in urls])
    assert {p for p, v in got.items() if v == "block"} == {p for p in got if "casino" in p} and len(got) == 22 * 40


def test_a_bad_branch_below_level_four(spark):
    urls = [f"http://h.test/a/b/c/d/{kind}/e/{page}" for kind in ("spam", "news", "blog") for page in range(40)]
    got = judged(spark, urls, ["spam" in u for u in urls])
    assert {p for p, v in got.items() if v == "block"} == {p for p in got if "/spam/" in p} and len(got) == 120


def plain_shape(segment):
    if re.fullmatch("[0-9]+", segment):
        return "{n}"
    if len(segment) >= 8 and re.fullmatch("[0-9a-fA-F-]+", segment) and re.search("[0-9]", segment):
        return "{x}"
    return re.sub("[0-9]+", "{n}", segment)


def plain_templates(pages, bad_of):
    """Each page's template and its purity, by recursion over the prefixes."""
    rows = {}
    for i, url in pages:
        host, path = re.match(r"(?s)[^:]*://([^/?#]*)([^?#]*)", url).groups()
        rows[i] = (host.lower(), tuple(plain_shape(x) for x in (path[1:] if path[:1] == "/" else path).split("/")))
    template = {}

    def grow(members, level, so_far):
        children = defaultdict(list)
        for i in members:
            if len(rows[i][1]) > level:
                children[rows[i][1][level]].append(i)
            else:
                template[i] = "/".join(so_far)
        labelled = {c: [bad_of[i] for i in m if i in bad_of] for c, m in children.items()}
        l, b = sum(map(len, labelled.values())), sum(map(sum, labelled.values()))
        rate, branches = b / max(l, 1), defaultdict(list)
        for c, m in children.items():
            n = len(labelled[c])
            differs = n and abs(sum(labelled[c]) / n - rate) > url_filter.Z * math.sqrt(rate * (1 - rate) / n)
            branches[c if len(children) == 1 or differs else "*"] += m
        for c, m in branches.items():
            grow(m, level + 1, [*so_far, c])

    for host in {h for h, _ in rows.values()}:
        grow([i for i in rows if rows[i][0] == host], 0, [])
    rate = sum(bad_of[i] for i in rows if i in bad_of) / max(1, sum(i in bad_of for i in rows))
    n, bad = Counter(), Counter()
    for i, t in template.items():
        if i in bad_of:
            n[rows[i][0], t] += 1
            bad[rows[i][0], t] += bad_of[i]
    return {i: (t, (bad[rows[i][0], t] + url_filter.PRIOR_WEIGHT * rate) / (n[rows[i][0], t] + url_filter.PRIOR_WEIGHT)) for i, t in template.items()}


@pytest.mark.parametrize("seed", [1])
def test_the_tree_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pages, bad = [], {}
    for i in range(1500):
        host = f"h{rng.randrange(2)}.test"
        section = f"s{chr(97 + rng.randrange(25))}{chr(97 + rng.randrange(2))}"
        deep = "/".join(rng.choice(["a", "b", "c", "7", "deadbeef01", ""]) for _ in range(rng.choice([0, 1, 3, 6])))
        pages.append((i, f"http://{host}/{section}/{deep}" if rng.random() < 0.97 else f"http://{host}/one/{'x/' * 8}{rng.randrange(2)}" + rng.choice(["", "y", "/z/z"])))
        if rng.random() < 0.6:
            bad[i] = int(rng.random() < (0.95 if section[1] in "be" or "/c/" in deep else 0.05))
    frame = spark.createDataFrame(pages, "page_id long, url string").repartition(3)
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, b in bad.items()], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_filter.judge(frame, labels, rules=()).collect()}
    want = plain_templates(pages, bad)
    assert {i: r.template for i, r in got.items()} == {i: t for i, (t, _) in want.items()}
    assert all(math.isclose(r.purity, want[i][1], rel_tol=1e-12) for i, r in got.items())
    blocked = {i for i, r in got.items() if r.verdict == "block"}
    assert blocked == {i for i, (_, p) in want.items() if p >= url_filter.REJECT} and 50 < len(blocked) < 1000
