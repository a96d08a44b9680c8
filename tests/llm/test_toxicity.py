import math
import os
import random
import zlib

import pytest
from samples import prose

from seriate.llm import textkit, toxicity
from seriate.llm.toxicity import Params

BAD = ["grolmbad", "vexnasty"]


def corpus(n=240):
    docs, labels = [], []
    for k in range(n):
        words = prose(k, 60).split()
        if k % 4 == 0:
            words[k % 50] = BAD[k % 8 // 4]
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 4 == 0)))
    return docs, labels


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_scores_equal_a_direct_computation(spark):
    """Features, log-count ratios, optimum and scores of a small corpus, from their definitions; ids are texts."""
    r, p = random.Random(2), Params(least_df=1, features=1 << 18, bits=16, steps=2000)
    rows = [(f"d{k}", "".join(r.choice("abc d") for _ in range(30)) + ("bad" if k % 3 == 0 else "")) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(k, int(t.endswith("bad"))) for k, t in rows], "doc_id string, toxic int")

    def bucket(gram):
        c, a, b = textkit.code_points([gram])
        return next(x[0] for x, _ in textkit.ngram_buckets(c, a, b, (len(gram),), p.bits))

    x = {k: {bucket(t[i : i + n]) for n in p.orders for i in range(len(t) - n + 1)} for k, t in rows}
    learn = [(k, t.endswith("bad")) for k, t in rows if zlib.crc32(k.encode()) % 5]
    pos, neg = sum(y for _, y in learn), sum(not y for _, y in learn)
    ratio = {}
    for b in set().union(*(x[k] for k, _ in learn)):
        has, lacks = (sum(b in x[k] for k, y in learn if y == z) for z in (True, False))
        ratio[b] = math.log((has + 0.5) / (lacks + 0.5)) - math.log((pos + 1) / (neg + 1))
    model = toxicity.fit(df, labels, p)
    assert sorted(model.buckets.tolist()) == sorted(ratio)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    margin = {k: model.intercept + sum(weight.get(b, 0.0) for b in x[k]) for k, _ in rows}
    # At the optimum the gradient of the regularised loss vanishes.
    pull = {k: 1 / (1 + math.exp(-margin[k])) - y for k, y in learn}
    assert abs(sum(pull.values())) < 0.02
    for b, w in weight.items():
        if abs(ratio[b]) > 1e-6:
            assert abs(ratio[b] * sum(v for k, v in pull.items() if b in x[k]) + p.l2 * w / ratio[b]) < 0.02
    got = {s.doc_id: s.score for s in toxicity.op1(df, labels, p).collect()}
    assert all(abs(got[k] - 1 / (1 + math.exp(-m))) < 1e-9 for k, m in margin.items())


def test_held_out_rows_are_told_apart(spark, docs_of):
    docs, labels = corpus()
    odd = [(1000, None), (1001, ""), (1002, prose(7, 30_000) + " grolmbad"), (1003, docs[0][1]), (1003, docs[0][1]), (None, "x")]
    rows = toxicity.op1(docs_of(docs + odd), labels_of(spark, labels)).collect()
    assert len(rows) == len(docs) + len(odd)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, r)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [k for k, *_ in docs if by[k].held_out]
    assert sum(by[k].predicted == int(k % 4 == 0) for k in held) / len(held) > 0.9
    assert by[1000].score == by[1001].score and by[1000].predicted == 0
    assert by[1003].score == by[0].score


def test_held_out_labels_teach_nothing(spark, docs_of):
    docs, labels = corpus(80)
    flipped = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in labels]
    a = toxicity.fit(docs_of(docs), labels_of(spark, labels))
    b = toxicity.fit(docs_of(docs), labels_of(spark, flipped))
    assert (a.weights == b.weights).all() and a.intercept == b.intercept


def test_one_class_no_labels_and_no_documents(spark, docs_of):
    docs, labels = corpus(20)
    for some in ([], [(k, 1, 0) for k, *_ in docs], [(k, 1, None) for k, *_ in docs]):
        got = toxicity.op1(docs_of(docs), labels_of(spark, some)).collect()
        assert len(got) == 20 and len({r.score for r in got}) == 1
    assert toxicity.op1(docs_of([]), labels_of(spark, labels)).count() == 0


def test_clean_rows_stay_as_they_are(spark, docs_of):
    docs, labels = corpus(120)
    df = docs_of(docs)
    model = toxicity.fit(df, labels_of(spark, labels), Params(features=500))
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert all((k in ids) == (k % 4 != 0) for k in range(120) if zlib.crc32(str(k).encode()) % 5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="driver tables are absent")
def test_held_out_accuracy_on_the_driver_tables(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.op1(spark.read.parquet(f"{d}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in got if r.toxic]
    assert sum(r.predicted for r in got if not r.toxic) <= 0.01 * len(got)
    assert sum(r.predicted for r in toxic) >= 0.65 * len(toxic)
