import random
import re

import numpy as np
import pytest
from samples import prose

from seriate.llm import graph, neardup


def shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower() if (t or "").isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(docs):
    sets = {k: shingles(t) for k, t in docs}
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), root(k), root(k) == k) for k in ids}


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for k in range(n):
        w[r.randrange(len(w))] = f"e{seed}x{k}"
    return " ".join(w)


def test_equals_brute_force(docs_of):
    docs = [(k, prose(k, 80)) for k in range(8)]
    docs += [(20 + k, edited(docs[k % 4][1], k % 6, k)) for k in range(40)]
    chain = prose(99, 120)
    for k in range(12):
        docs.append((100 + k, chain))
        chain = edited(chain, 2, 500 + k)
    docs += [(200, None), (201, ""), (202, " \n"), (203, "a b"), (204, "A  B"), (205, "a b c"), (206, docs[0][1].upper()), (207, "É x y z w"), (208, "é x y z w"), (209, prose(3, 30_000)), (210, prose(3, 30_001))]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.classes(docs_of(docs)).collect()}
    assert got == brute(docs)


def test_dense_crowd_is_settled_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 600)
    base = prose(1, 70)
    docs = [(k, edited(base, 1 + k % 7, k)) for k in range(60)] + [(100 + k, edited(edited(base, 5, 7), k % 3, 900 + k)) for k in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.classes(docs_of(docs)).collect()}
    assert got == brute(docs)


def test_repeated_rows_null_ids_and_no_documents(docs_of):
    a = prose(1, 50)
    rows = [(r.doc_id, r.component_id, r.kept) for r in neardup.classes(docs_of([(5, a), (5, a), (7, a), (None, a), (3, "")])).collect()]
    assert sorted(rows, key=str) == [(3, 3, True), (5, 5, True), (5, 5, True), (7, 5, False), (None, None, True)]
    kept = neardup.keep_one(docs_of([(5, a), (5, a), (7, a), (None, a), (3, "")]))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 5, None]
    assert neardup.classes(docs_of([])).count() == 0 and neardup.keep_one(docs_of([])).count() == 0


@pytest.mark.parametrize("edges", [[(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 40)] + [(100, 101)], [(k, 2 * k) for k in range(1, 50)], [(9, 3), (7, 7)], []])
def test_components(spark, edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    df = spark.createDataFrame([(min(e), max(e)) for e in edges if e[0] != e[1]], "a bigint, b bigint")
    assert {r.node: r.root for r in graph.components(df).collect()} == {k: root(k) for k in list(up)}


def test_tensored_tables_need_few_hashes():
    p = neardup.Params()
    miss = (1 - 0.75**p.rows) ** p.left
    assert 2 * miss < 5e-6 and (p.left + p.right) * p.rows <= 64
    a, b = np.array([3, 5], np.uint64), np.array([1, 2], np.uint64)
    h = np.arange(2000, dtype=np.uint64)
    assert neardup.minhash(h, a, b).tolist() == [1, 2]


def test_a_crowd_is_tied_together_by_a_row_a_member_without_a_join(spark):
    rest = spark.createDataFrame([(b, n) for b in range(3) for n in range(b, 50)] + [(7, 60)], "bucket bigint, node bigint")
    edges = neardup.spokes(rest)
    assert "Join" not in edges._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, edges.collect())) == sorted((b, n) for b in range(3) for n in range(b + 1, 50))
