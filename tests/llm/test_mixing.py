import numpy as np
import pytest

from seriate.llm import mixing


def shares(sizes, share=1.5, most=2.0):
    """Targets by resharing the excess until nobody is above."""
    order = sorted(sizes, key=lambda k: (k is None, k or ""))
    w = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(w[k] for k in open_)
        over = [k for k in open_ if unit * w[k] > most * sizes[k]]
        for k in over or open_:
            out[k] = most * sizes[k] if over else unit * w[k]
        if not over:
            break
        left -= sum(out[k] for k in over)
        open_ -= set(over)
    return out


@pytest.mark.parametrize("group", [8, 4096])
def test_targets_and_totals(docs_of, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP", group)
    r = np.random.default_rng(1)
    docs = [(k, " ".join(["w"] * int(r.integers(1, 80))), f"s{k % 5}" if k % 3 else "s0") for k in range(500)]
    docs += [(600 + k, "a b", None) for k in range(40)] + [(700, None, "s1"), (701, "", "s1"), (702, "x " * 5000, "big"), (703, "", "empty")]
    docs += [(704, "p q r", "s2")] * 3
    rows = mixing.op5(docs_of(docs)).collect()
    assert len(rows) == len(docs)
    size = {k: len((t or "").split()) for k, t, *_ in docs}
    source = {d[0]: d[2] for d in docs}
    total = {}
    for d in docs:
        total[d[2]] = total.get(d[2], 0) + size[d[0]]
    want, taken = shares(total), dict.fromkeys(total, 0)
    for x in rows:
        assert x.size == size[x.doc_id] and x.source_size == total[source[x.doc_id]]
        assert x.target == pytest.approx(want[source[x.doc_id]], rel=1e-9)
        assert 0 <= x.taken <= 2 * x.size and (x.size == 0 or x.taken % x.size == 0)
        taken[source[x.doc_id]] += x.taken
    for k in total:
        assert abs(taken[k] - want[k]) <= max([80] + [s for i, s in size.items() if source[i] == k and total[k] < 6000]) or k == "big"
    assert sorted(map(tuple, mixing.op5(docs_of(docs)).repartition(3).collect())) == sorted(map(tuple, rows))
    assert max(x.taken for x in rows if x.doc_id == 704) - min(x.taken for x in rows if x.doc_id == 704) <= 3


def test_repeated_and_null_ids_do_not_move_a_target(spark):
    rows = [(None, "a b c", "s0")] * 700 + [(None, f"x y z{k}", "s0") for k in range(300)] + [(f"d{k}", "p " * (k % 9 + 1), f"s{k % 3}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = mixing.op5(df).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x.target, []).append(x.taken)
    assert len(by) == 3 and all(abs(sum(v) - k) <= 5 for k, v in by.items())
    assert mixing.mix(df).selectExpr("count(*) AS n", "sum(size(split(trim(text), ' '))) AS w").first().w == sum(x.taken for x in got)


def test_rows_repeat_as_often_as_they_are_taken(docs_of):
    docs = [(k, "a b c d " * (k % 7 + 1), f"s{k % 4}") for k in range(120)] + [(200, "n m", None), (201, None, "s1")]
    df = docs_of(docs)
    want = {r.doc_id: r.taken // r.size if r.size else None for r in mixing.op5(df).collect()}
    got = mixing.mix(df)
    assert got.columns == df.columns
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert all(counts.get(k, 0) == n for k, n in want.items() if n is not None)


def test_pivot_keeps_words_and_is_unbiased():
    r = np.random.default_rng(2)
    words, share = r.integers(1, 50, 60).astype(float), np.full(60, 0.3)
    hits = np.zeros(60)
    for k in range(400):
        seeds = r.integers(0, 1 << 63, 60, np.uint64)
        out = mixing.pivot(words, share, seeds, False)
        assert ((out == 0) | (out == 1)).sum() >= 59 and abs(out @ words - share @ words) < 1e-6
        hits += mixing.pivot(words, share, seeds, True)
    assert abs(hits.mean() / 400 - 0.3) < 0.02 and (np.abs(hits / 400 - 0.3) < 0.12).all()


def test_no_documents(docs_of):
    assert mixing.op5(docs_of([])).count() == 0
    assert mixing.mix(docs_of([])).count() == 0
    assert [r.taken for r in mixing.op5(docs_of([(1, None, "a"), (2, "", "b")])).collect()] == [0, 0]
