import os
import zlib

import numpy as np
import pytest

from seriate.llm import langid

VOCAB = {"aa": ["lorin", "masta", "okin"], "bb": ["zugen", "wüst", "hopfe"], "cc": ["queti", "año", "rillo"], "dd": ["été", "oix", "çade"]}


def corpus(langs, n=40):
    r = np.random.default_rng(3)
    return [(1000 * i + k, " ".join(r.choice(VOCAB[c], 20)), "s", c) for i, c in enumerate(langs) for k in range(n)]


@pytest.mark.parametrize("langs", [["aa"], ["aa", "bb"], list(VOCAB)])
def test_held_out_languages(docs_of, langs):
    odd = [(90_000, None, "s", "aa"), (90_001, "", "s", "bb"), (90_002, "12 34 -- ½", "s", "aa"), (90_003, "lorin masta okin " * 40_000, "s", None)]
    got = {r.doc_id: r for r in langid.op7(docs_of(corpus(langs) + odd)).collect()}
    for k, _, _, lang in corpus(langs):
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert got[k].lang_pred == lang and 0 <= got[k].score <= 1
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (90_000, 90_001, 90_002))
    assert got[90_003].lang_pred == "aa"


def test_rare_languages_among_many_are_learnt(docs_of):
    r = np.random.default_rng(9)
    rows = [(100 * i + k, " ".join("".join(chr(0x4E00 + 30 * i + c) for c in r.integers(0, 25, 6)) for _ in range(12)), "s", f"l{i:02}") for i in range(30) for k in range(40 if i else 6)]
    p = langid.Params(most=300, least=5)
    got = {x.doc_id: x.lang_pred for x in langid.op7(docs_of(rows), p).collect()}
    assert {got[k] for k, *_ in rows} == {f"l{i:02}" for i in range(30)}


def test_pieces_of_long_texts_count_each_gram_once(monkeypatch):
    text = "".join(chr(97 + k * k % 26) for k in range(1000))
    whole = langid.profiles([text, "xyz"], 12, (1, 2, 3))
    monkeypatch.setattr(langid.textkit, "GROUP", 64)
    assert np.allclose(langid.profiles([text, "xyz"], 12, (1, 2, 3)), whole)


def test_text_ids(spark):
    rows = [(f"d{k}", t, lang) for k, t, _, lang in corpus(["aa", "bb"])]
    got = langid.op7(spark.createDataFrame(rows, "doc_id string, text string, lang string")).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} == {"aa", "bb"}


def test_nothing_to_learn(docs_of, spark):
    rows = [(k, "lorin masta", "s", None) for k in range(10)]
    assert {r.lang_pred for r in langid.op7(docs_of(rows)).collect()} == {"und"}
    assert langid.op7(docs_of([])).count() == 0


def test_codewords_are_apart():
    for n in (1, 2, 3, 4, 5, 9, 20):
        c = langid.codewords(n)
        assert len(c) == n and set(np.unique(c)) <= {-1.0, 1.0}
        if n > 2:
            apart = (c[:, None, :] != c[None]).sum(2)
            assert apart[~np.eye(n, dtype=bool)].min() >= (2 if n <= 5 else 5)
            assert (np.abs(c.sum(0)) < n).all()


def test_a_wrong_bit_is_corrected_and_a_tie_is_ambiguous():
    c = langid.codewords(4)
    m = langid.Model(12, (1,), list("abcd"), c, None, None, np.ones(c.shape[1]), 0.2)
    x = c.copy()
    x[:, 0] *= -1
    best, _, _ = langid.decode(m, x)
    assert best.tolist() == [0, 1, 2, 3]
    _, share, vague = langid.decode(m, (c[:1] + c[1:2]) / 2)
    assert vague[0] and share[0] < 0.6


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables are absent")
def test_accuracy_on_the_driver_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op7(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
