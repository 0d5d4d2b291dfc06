"""Components over all of lineitem with real keys, against a plain union-find."""

import random

import pytest

from retrolens.plans import catalog


@pytest.mark.parametrize("name, by_order", [("g3_transitive_merge_all", False), ("g4_composite_merge_all", True)])
def test_components_of_all_rows(spark, tmp_path, name, by_order):
    rng = random.Random(5)
    rows = [(g := rng.randrange(60), g % 12 * 100 + rng.randrange(9), g % 12 * 10 + rng.randrange(4)) for _ in range(150)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    root = {k: k for _, p, s in rows for k in (f"p{p}", f"s{s}")}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def tie(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    last = {}
    for g, p, s in rows:
        tie(f"p{p}", f"s{s}")
        if by_order:
            tie(f"p{p}", last.setdefault(g, f"p{p}"))
    got = {tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).select("node", "root").collect()}
    assert got == {(k, find(k)) for k in root} and len({r for _, r in got}) > 1
