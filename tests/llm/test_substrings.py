import hashlib
import re

import numpy as np
from samples import prose

from seriate.llm import substrings, textkit


def brute(docs):
    words = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in docs]
    first = {}
    for k, w in words:
        for i in range(len(w) - 49):
            if k is not None:
                s = tuple(w[i : i + 50])
                first[s] = min(first.get(s, k), k)
    out = []
    for k, w in words:
        gone = set()
        for i in range(len(w) - 49):
            if k is not None and first[tuple(w[i : i + 50])] < k:
                gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(df).collect()), key=str)


def test_equals_brute_force(docs_of):
    p = [prose(100 + k, 70 + 5 * k) for k in range(4)]
    docs = [(k, prose(k, 120)) for k in range(6)]
    docs += [(10 + k, f"{prose(50 + k, 30)} {p[k % 4]}\n {prose(60 + k, 30)}") for k in range(12)]  # shared passages
    docs += [(30, docs[2][1]), (31, docs[2][1]), (32, docs[2][1].replace(" ", "\n "))]  # copies, also by other blanks
    docs += [(33, " ".join([p[1]] * 3)), (34, p[1] + " " + p[1]), (35, " ".join(p[2].split()[:50])), (36, " ".join(p[2].split()[:49]))]  # repeats within, window edges
    docs += [(37, None), (38, ""), (39, " \t\n"), (40, "été " * 60), (41, "été " * 80), (42, prose(0, 120)), (43, prose(1, 119))]
    docs += [(44, docs[3][1]), (44, docs[3][1])]  # a repeated row
    docs += [(45, prose(9, 30_000) + " " + p[3]), (None, p[0]), (None, p[0])]
    assert run(docs_of(docs)) == brute(docs)


def test_hot_passage(docs_of):
    p = prose(1, 60)
    docs = [(k, f"{prose(1000 + k, 8)} {p} {prose(2000 + k, 8)}") for k in range(300)]
    assert run(docs_of(docs)) == brute(docs)


def test_no_documents(docs_of):
    assert substrings.dedup(docs_of([])).count() == 0


def test_kept_texts(docs_of):
    p = prose(1, 60)
    docs = [(1, p), (2, f"before {p} after"), (3, p)]
    assert {r.doc_id: r.kept for r in substrings.kept_texts(docs_of(docs)).collect()} == {2: "before after", 3: ""}


def test_shards_and_passes_do_not_change_the_result(docs_of):
    p = [prose(100 + k, 70 + 5 * k) for k in range(4)]
    docs = [(10 + k, f"{prose(50 + k, 30)} {p[k % 4]} {prose(60 + k, 30)}") for k in range(12)]
    few = substrings.Params(shard=5, together=2)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(docs_of(docs), few).collect()), key=str)
    assert got == brute(docs)


def test_texts_meet_only_the_shards_that_own_a_phrase_of_theirs(docs_of, monkeypatch):
    p, seen, windows = [prose(100 + k, 70 + 5 * k) for k in range(4)], [], substrings._windows
    docs = [(10 + k, f"{prose(50 + k, 30)} {p[k % 4]} {prose(60 + k, 30)}") for k in range(12)] + [(100 + k, prose(500 + k, 90)) for k in range(20)]
    monkeypatch.setattr(substrings, "_windows", lambda texts, *rest: seen.append(texts.count()) or windows(texts, *rest))
    few = substrings.Params(shard=5, together=1)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(docs_of(docs), few).collect()), key=str)
    assert got == brute(docs)
    assert sum(seen) == 12  # however many shards there are


def test_ids_of_any_type(spark):
    p = prose(1, 60)
    df = spark.createDataFrame([("b", p), ("a", f"x {p}"), (None, p)], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in substrings.dedup(df).collect()) == [("None", 0), ("a", 0), ("b", 60)]


def test_automata_alone_locate_phrases():
    h = textkit.mix(np.arange(40, dtype=np.uint64))
    text = np.concatenate([h, h[:35], h])
    phrases, t = textkit.windows(text, 32, 32), substrings.symbols(text)
    wanted = textkit.windows(h, 32, 32)[[0, 3]]
    machine = substrings.compiled(wanted, [t[0:8], t[6:14]])
    assert np.flatnonzero(substrings.locate([machine], t, phrases, 4)).tolist() == [0, 3, 40, 43, 75, 78]
    # A pattern of another phrase is found, but does not count; without patterns nothing is located.
    assert not substrings.locate([substrings.compiled(wanted[:1] ^ np.uint64(1), [t[0:8]])], t, phrases, 4).any()
    assert not substrings.locate([substrings.compiled(wanted[:0], [])], t, phrases, 4).any()
    # Phrases that begin alike share a pattern.
    other = np.concatenate([h[:10], h[20:], h])
    shared = np.concatenate([wanted, textkit.windows(other, 32, 32)[:1]])
    both = substrings.compiled(shared, [t[0:8], t[6:14], t[0:8]])
    assert substrings.locate([both], substrings.symbols(other), textkit.windows(other, 32, 32), 4)[0]
    assert np.flatnonzero(substrings.locate([both], t, phrases, 4)).tolist() == [0, 3, 40, 43, 75, 78]


def test_windows_are_located_by_their_least_phrase(monkeypatch):
    p = substrings.Params(window=9, phrase=4)
    r = np.random.default_rng(1)
    for n in (0, 3, 5, 6, 7, 40, 400):
        phrases = r.integers(0, 60, n).astype(np.uint64)  # many equal ones
        found = np.isin(phrases, r.integers(0, 60, 20).astype(np.uint64))
        least = [phrases[i : i + 6].min() for i in range(n - 5)]
        assert substrings.least_of(phrases, p).tolist() == least
        assert substrings.located(phrases, found, p).tolist() == [i for i, x in enumerate(least) if found[phrases == x].all()]
    # Powers are computed once a base, not once a text; longer texts and earlier, shorter ones agree.
    hashes, made = r.integers(0, 1 << 63, 9000, np.uint64), []
    whole = textkit.windows(hashes, 32, 77)
    monkeypatch.setattr(textkit, "_powers", lambda *a: made.append(a))
    assert (textkit.windows(hashes[:500], 32, 77) == whole[:469]).all() and not made
