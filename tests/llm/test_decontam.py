import random

import numpy as np
from samples import prose

from seriate.llm import decontam


def distance(p, t):
    """Least edits of p to a substring of t, and the earliest end."""
    row = list(range(len(p) + 1))
    best = (row[-1], 0)
    for j, y in enumerate(t, 1):
        old, row = row, [0]
        for i, x in enumerate(p, 1):
            row.append(min(old[i] + 1, row[-1] + 1, old[i - 1] + (x != y)))
        best = min(best, (row[-1], j))
    return best


def test_myers_is_the_edit_distance():
    r = random.Random(4)
    for _ in range(300):
        p = np.array([r.randrange(4) for _ in range(r.randrange(1, 90))], np.uint64)
        t = np.array([r.randrange(4) for _ in range(r.randrange(0, 60))], np.uint64)
        assert decontam.myers(p, t) == distance(p.tolist(), t.tolist())


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for k in range(n):
        at = r.randrange(len(w))
        kind = r.randrange(3)
        if kind == 0:
            w[at] = f"z{k}z{seed}"
        elif kind == 1:
            w.insert(at, f"y{k}y{seed}")
        else:
            del w[at]
    return " ".join(w)


def test_equals_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 60)
    items = [(k, prose(500 + k, 4 + 5 * k)) for k in range(9)] + [(20, None), (21, ""), (22, "one two"), (23, "Ein Satz, mit: Zeichen und ÉTÉ!")]
    docs = [(k, prose(k, 40)) for k in range(5)]
    for k in range(60):
        item = items[k % 9][1]
        docs.append((10 + k, f"{prose(900 + k, 15)} {edited(item, k // 6, k)} {prose(700 + k, 15)}"))
    docs += [(100, None), (101, ""), (102, items[5][1]), (103, items[5][1].upper() + "..."), (104, "ein satz mit zeichen und été"), (105, prose(5, 30_000) + " " + items[8][1]), (106, " ".join(items[6][1].split()[:-1])), (107, docs[12][1]), (107, docs[12][1])]
    got = {(r.doc_id, r.item_id): (r.distance, r.end_word) for r in decontam.hits(docs_of(docs), bench(spark, items)).collect()}
    want = {}
    for d, t in docs:
        tw = decontam.words([t])[0].tolist()
        for i, p in items:
            pw = decontam.words([p])[0].tolist()
            if not pw or len(tw) > 1000 and i != 8:
                continue
            e = decontam.budget(len(pw))
            found = distance(pw, tw)
            if found[0] <= e:
                want[d, i] = found
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert len(want) > 30 and any(v[0] > 3 for v in want.values())
    kept = decontam.keep_uncontaminated(docs_of(docs), bench(spark, items))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in {k for k, _ in want})
    assert kept.columns == docs_of(docs).columns


def test_nothing_on_either_side(spark, docs_of):
    assert decontam.hits(docs_of([]), bench(spark, [(1, prose(1, 20))])).count() == 0
    assert decontam.hits(docs_of([(1, prose(1, 20))]), bench(spark, [])).count() == 0
    assert decontam.keep_uncontaminated(docs_of([(1, "x")]), bench(spark, [])).count() == 1


def test_short_unspaced_and_split_items_of_any_id_type(spark, docs_of, monkeypatch):
    items = [("a", "One, two"), ("b", "我们今天去公园"), ("c", prose(1, 20)), ("c", prose(2, 20)), ("d", "x"), (None, prose(3, 9))]
    docs = [(1, "zero one two three"), (2, "昨天我们今天去公园散步"), (3, f"{prose(1, 20)} {prose(2, 20)}"), (4, "one and two"), (5, "x-y"), (6, prose(3, 9))]
    for most in (1_000_000, 5):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", most)
        df = spark.createDataFrame(items, "item_id string, text string")
        rows = decontam.hits(docs_of(docs).selectExpr("cast(doc_id as string) doc_id", "text", "1 AS i", "2 AS k"), df).collect()
        assert sorted((r.doc_id, str(r.item_id), r.distance) for r in rows) == [("1", "a", 0), ("2", "b", 0), ("3", "c", 0), ("5", "d", 0), ("6", "None", 0)]
    ints = spark.createDataFrame([(7, "zero one")], "item_id int, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.hits(docs_of(docs), ints).collect()] == [(1, 7)]


def test_stock_phrase_of_very_many_items(spark, docs_of):
    stock = "this is the stock phrase that all items share"
    items = [(k, f"{stock} {prose(k, 12)}") for k in range(2000)]
    docs = [(k, f"{stock} " * 3 + prose(k, 12)) for k in range(0, 40)] + [(100, stock)]
    got = {(r.doc_id, r.item_id) for r in decontam.hits(docs_of(docs), bench(spark, items)).collect()}
    assert got == {(k, k) for k in range(40)}


def test_budget_leaves_pieces_of_four_words():
    for m in range(4, 400):
        e = decontam.budget(m)
        cuts = np.linspace(0, m, e + 2).astype(int)
        assert np.diff(cuts).min() >= 4 and e <= m / 5


def test_repeated_item_ids_are_one_item(spark, docs_of):
    a, b = prose(1, 20), prose(2, 20)
    rows = decontam.hits(docs_of([(1, f"{a} {b}"), (2, edited(b, 1, 3))]), bench(spark, [(7, a), (7, b), (7, b)])).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 7), (2, 7)]
