"""The pipeline's stages, each judged on its own input, and the queries that have SQL."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from millrace.llm import queries
from millrace.llm.common import connected_components, materialise, read_table
from tests.conftest import same_rows
from tests.llm.test_operators import CLASH, DOC, ROWS, check_classes


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(name, spark, sf, duck):
    same_rows(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "packing"]


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = read_table(spark, sf, "documents")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, sf), name)
        seen[name] = before, docs
        assert name == "packing" or docs.columns == columns
    before, after = seen["toxicity"]
    labels = read_table(spark, sf, "labels")
    assert after.join(labels.where("toxic = 0"), "doc_id").count() >= 0.99 * before.join(labels.where("toxic = 0"), "doc_id").count()
    assert after.join(labels.where("toxic = 1"), "doc_id").count() <= 0.25 * before.join(labels.where("toxic = 1"), "doc_id").count()
    before, after = seen["exact_dedup"]
    fold = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = before.groupBy(fold.alias("t")).agg(F.max("doc_id").alias("doc_id"))
    assert sorted(r["doc_id"] for r in want.collect()) == sorted(r["doc_id"] for r in after.collect())
    before, after = seen["jaccard_join"]
    from millrace.llm.jaccard_join import near_classes

    rows = before.orderBy("doc_id").collect()
    classes = near_classes(before).collect()
    check_classes(classes, [r["doc_id"] for r in rows], [r["text"] for r in rows])
    assert sorted({r["class_id"] for r in classes}) == sorted(r["doc_id"] for r in after.collect())
    before, after = seen["mixing"]
    assert after.join(before, "doc_id", "left_anti").count() == 0 and after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    before, after = seen["packing"]
    assert after.where("piece = 0").count() == before.count()
    per = after.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert per.agg(F.max("n")).first()[0] <= 2048 and per.count() <= after.agg(F.sum("length")).first()[0] / 2048 + 2


def test_run_on_odd_documents(spark, tmp_path):
    spark.createDataFrame(ROWS, DOC).select("*", *[F.lit("x").alias(c) for c in CLASH]).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{tmp_path}/a/labels.parquet")
    assert P.run(spark, f"{tmp_path}/a").count() > 0
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert P.run(spark, f"{tmp_path}/b").count() == 0


def test_components(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [tuple(map(int, rng.integers(1000, 1200, 2))) for _ in range(120)] + [(7, 7), (None, 3)]
    least = {v: v for e in edges if None not in e and e[0] != e[1] for v in e}
    for _ in range(200):
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    got = connected_components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()
    assert {r["v"]: r["root"] for r in got} == least and len(got) == len(least)
