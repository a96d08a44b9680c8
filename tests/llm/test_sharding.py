import re
import zlib
from collections import Counter
from hashlib import md5

from seriate.llm import sharding


def draw(key, b):
    return int(md5(f"{key}:{b}".encode()).hexdigest()[:8], 16) >> 1


def jump(key, shards):
    at, nxt = 0, 0
    while nxt < shards:
        at, nxt = nxt, int((nxt + 1) * (2**31 / (draw(key, nxt) + 1)))
    return at


def test_shards_sizes_and_slots(docs_of):
    texts = [None, "", "é", "x" * 50_000]
    docs = [(k, texts[k % 4]) for k in range(600)] + [(5, "x"), (5, "x"), (None, "n")]
    rows = sharding.assign(docs_of(docs), 12, 8).collect()
    assert len(rows) == len(docs)
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard, r.law) == (jump(key, 12), jump(key, 13), "key")
        assert r.grown_shard in (r.shard, 12)
    want = Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.assign(docs_of([])).count() == 0
    assert [(r.shard, r.slot) for r in sharding.assign(docs_of(docs[:3]), 1).orderBy("slot").collect()] == [(0, 0), (0, 1), (0, 2)]


def test_growth_moves_a_small_part(docs_of):
    rows = sharding.assign(docs_of([(k, "") for k in range(8000)])).collect()
    moved = sum(r.shard != r.grown_shard for r in rows)
    assert 8000 / 41 * 0.7 < moved < 8000 / 41 * 1.3
    sizes = Counter(r.shard for r in rows)
    assert len(sizes) == 40 and max(sizes.values()) < 1.4 * 200


def test_no_python_on_the_executors(docs_of):
    plan = sharding.assign(docs_of([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
