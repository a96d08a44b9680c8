import os

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def test_each_stage_does_its_part(spark):
    from seriate.llm import decontam, mixing, neardup, sharding, toxicity
    from seriate.llm.common import cut

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    outs, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        at = cut(stage(spark, at, SF), name)
        outs[name] = at
        if name != names[-1]:
            assert at.columns == docs.columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in outs.items()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = {r.doc_id: r.predicted for r in toxicity.op1(docs, labels).collect()}
    assert ids["toxicity"] == {k for k, v in scored.items() if not v}
    kept = {r.doc_id for r in neardup.classes(outs["toxicity"]).where("kept").collect()}
    assert ids["near_dedup"] == kept and len(kept) < len(ids["toxicity"])
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaks = {r.doc_id for r in decontam.hits(outs["near_dedup"], bench).collect()}
    assert ids["decontamination"] == kept - leaks
    want = {r.doc_id: r.taken // r.size for r in mixing.op5(outs["decontamination"]).collect() if r.size}
    got = {r.doc_id: r["count"] for r in outs["mixing"].groupBy("doc_id").count().collect()}
    assert all(got.get(k, 0) == n for k, n in want.items())
    assert outs["sharding"].count() == outs["mixing"].count()
    # The last stage's rows are those of sharding, with the texts and what else the documents have.
    out = corpus_pipeline.run(spark, SF)
    assert sorted(out.columns) == sorted({*sharding.RESULT, *docs.columns})
    assert sorted(map(tuple, out.select(*sharding.RESULT).collect())) == sorted(map(tuple, sharding.assign(outs["mixing"]).collect()))
    assert out.join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").where("not text <=> t").isEmpty()


def test_odd_rows_pass_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kinds = dict(docs.dtypes)
    odd = [(None, None, None, None, None), (None, "a b c d e f", "en", "web", 11), (10**9, "", "", "", 0), (10**9, None, None, None, None), (10**9 + 1, "same words here in this row", "en", "new", 27)] + [(10**9 + 1, "same words here in this row", "en", "new", 27)] * 2
    more = spark.createDataFrame(odd, ", ".join(f"{c} {kinds[c]}" for c in docs.columns))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs.limit(60).unionByName(more).selectExpr("*", "1 AS size", "2 AS k", "3 AS row", "4 AS n", "5 AS path", "6 AS doc").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    same = [r for r in out if r.doc_id == 10**9 + 1]
    assert out and len(same) <= 2 and all(r.k == 2 and r.n == 4 and r.size == 43 for r in same)
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_queries_and_their_sql(spark):
    from compare import connection, same

    from seriate.llm import queries

    con = connection(SF)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    for name, sql in queries.oracle_sql().items():
        same(queries.queries()[name](spark, SF), con, sql)
