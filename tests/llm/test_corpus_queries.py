"""The registered corpus queries and the pipeline on the smallest tables."""

import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_near_copies import plain_components
from test_operators import plain_overlap

import corpus_pipeline
from retrolens.llm import quality, queries


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = Counter(tuple(r[c] for c in columns) for r in frame.collect())
    assert got
    if name in queries.ORACLE_SQL:
        want = oracle.execute(queries.ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        assert got == Counter(tuple(row[names.index(c)] for c in columns) for row in want.fetchall())


def test_one_query_for_each_operator():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 11))


def test_pipeline(spark, sf_dir, tmp_path):
    """The stages against plain versions, on documents with nulls, empty texts,
    repeated rows, near copies, benchmark passages and columns whose names the
    operators use themselves."""
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len((r.text or "").split()) < 400][:120]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    long = [(i, t) for i, t in rows if t and len(t.split()) > 80][:15]
    for k, (i, t) in enumerate(long):
        w = t.split(" ")
        if k % 3 == 0:
            w[rng.randrange(len(w))] = "changed"
        elif k % 3 == 1:
            w[50:50] = rng.choice(items)[1].split(" ")
        rows += [(10_000 + k, " ".join(w))] * (1 + k % 2)
    rows += [(20_000, None), (20_001, ""), (None, long[5][1] + " more"), (20_002, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", k, True, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, mark long, kept boolean, node long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    place = f"file://{tmp_path}"
    judged = quality.judge(docs.withColumn("doc_id", F.col("node")).drop("kept"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    fails = {r.doc_id for r in judged if r.base_failed}
    good = [(r.doc_id, r.text) for r in corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{place}/documents.parquet"), place).collect()]
    assert good and not Counter(good) - Counter(rows) and not {r for r in good} & {rows[k] for k in fails}
    groups = {}
    for (i, t), c in zip(good, plain_components(good)):
        groups.setdefault(c, []).append((i is None, i, t))
    first = [min(g, key=lambda r: (r[0], r[1] or 0))[1:] for g in groups.values()]
    left = sorted(i for i, t in first if not any(plain_overlap(t, item) for _, item in items))
    got = corpus_pipeline.run(spark, place).collect()
    assert sorted(r.doc_id for r in got) == left and 0 < len(left) < len(first) < len(set(good))
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in first}
    assert all(r.n_words == words[r.doc_id] and r.padding == r.bucket_words - r.n_words >= 0 for r in got)
    assert len({(r.bucket, r.batch, r.place) for r in got}) == len(got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "length_packing"]


def test_pipeline_without_documents(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("1 = 0").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
