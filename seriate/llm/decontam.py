"""Benchmark decontamination: pigeonhole pieces and Myers' bit-parallel distance.

Items and documents are lower-cased and parted into words at white space and
ASCII signs; letters of scripts written without blanks are a word each.  An
item of m words may differ by ``min(m // 5, m // 4 - 1)`` word edits (none under
8 words); it is split into one piece more than that, of at least 4 words (all
of a shorter item), so at least one piece occurs unchanged wherever the item
does within its budget.  Exact piece hits are found with a bit table over
hashed word windows of the pieces' lengths; where enough of the item's words
are around a hit, these surroundings are verified with Myers' algorithm over words.

Defined results: items without a word match nothing; null and empty texts
contain nothing; texts are searched whole; of several occurrences the least
distance and then the earliest end count; repeated rows are judged each,
repeated item ids (null is one) as one item with several texts, in however many blocks
the benchmark is read; empty tables give empty results; ids may be of any type;
other columns are carried or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from . import textkit
from .common import mapped

PIECE = 4
#: Words of benchmark items that one pass over the documents looks for; more items take more passes.
BLOCK_WORDS = 1_000_000
_TABLE = 20
#: Candidate places looked at together.
_CHUNK = 1 << 16
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")


def budget(m: int) -> int:
    return max(0, min(m // 5, m // 4 - 1))


def prepared(text: str | None) -> str:
    low = (text or "").lower()
    return low if low.isascii() or not UNSPACED.search(low) else UNSPACED.sub(r" \g<0> ", low)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and each text's first."""
    raw = [prepared(t).encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, bounds = textkit.word_spans(data, offsets, textkit.SIGNS)
    return textkit.hash_spans(data, starts, ends), bounds


@dataclass
class Index:
    """A block of items: their words, and by length their pieces' hashes in order with (item, start)."""

    ids: list
    items: list[np.ndarray]
    pieces: dict[int, tuple[np.ndarray, np.ndarray]]
    table: np.ndarray


def index(ids: list, items: list[np.ndarray]) -> Index:
    by_length: dict[int, list[tuple[int, int]]] = {}
    for k, w in enumerate(items):
        cuts = np.linspace(0, len(w), budget(len(w)) + 2).astype(int)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > a:
                by_length.setdefault(b - a, []).append((k, a))
    pieces, table = {}, np.zeros(1 << _TABLE, bool)
    for size, at in by_length.items():
        h = np.array([textkit.windows(items[k][a : a + size], size, size)[0] for k, a in at], np.uint64)
        order = np.argsort(h, kind="stable")
        pieces[size] = h[order], np.array(at, np.int64)[order]
        table[h >> np.uint64(64 - _TABLE)] = True
    return Index(ids, items, pieces, table)


def myers(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of the text, and its earliest end."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern.tolist()):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text.tolist()):
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        rise, fall = (minus | ~(horizontal | plus)) & full, plus & horizontal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = rise << 1 & full, fall << 1 & full
        plus, minus = (fall | ~(vertical | rise)) & full, rise & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def places(ix: Index, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, item, where the item would start) of all piece hits, in chunks."""
    for size, (hashes, at) in ix.pieces.items():
        probe = textkit.windows(h, size, size)
        p = np.flatnonzero(ix.table[probe >> np.uint64(64 - _TABLE)])
        lo = np.searchsorted(hashes, probe[p], "left")
        n = np.searchsorted(hashes, probe[p], "right") - lo
        row = np.searchsorted(bounds, p, "right") - 1
        keep = (n > 0) & (p + size <= bounds[row + 1])
        p, lo, n, row = p[keep], lo[keep], n[keep], row[keep]
        for i, j in textkit.groups(np.concatenate([[0], np.cumsum(n)]), _CHUNK):
            own = np.repeat(np.arange(i, j), n[i:j])
            piece = at[np.arange(len(own)) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j]) + lo[own]]
            yield row[own], piece[:, 0], p[own] - piece[:, 1]


def search(ix: Index, texts: list[str | None]) -> Iterator[tuple[int, object, int, int, int]]:
    """(row, item id, distance, budget, end word) of each item found in each text."""
    for i, j in textkit.text_groups([t or "" for t in texts]):
        h, bounds = words(texts[i:j])
        found: dict[tuple[int, object], tuple[int, int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for chunk in places(ix, h, bounds):
            for r, k, start in zip(*(c.tolist() for c in chunk), strict=True):
                if (r, k, start) in tried:
                    continue
                tried.add((r, k, start))
                item, a, b = ix.items[k], int(bounds[r]), int(bounds[r + 1])
                e, m = budget(len(item)), len(item)
                left = max(a, start - e)
                near = h[left : min(b, start + m + e)]
                if np.isin(item, near).sum() < m - e:  # each edit takes one of the item's words at most
                    continue
                d, end = myers(item, near)
                if d <= e:
                    new, key = (d, left - a + end, e), (r, ix.ids[k])
                    found[key] = min(found.get(key, new), new)
        for (r, k), (d, end, e) in sorted(found.items(), key=lambda x: (x[0][0], str(x[0][1]))):
            yield i + r, k, d, e, end


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", most: int | None = None) -> Iterator[Index]:
    """The items in blocks of about ``most`` words, read one partition at a time; all texts of an id are in one block."""
    most = most or BLOCK_WORDS
    ids, items, size = [], [], 0
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).distinct().orderBy("i")
    for r in rows.toLocalIterator():
        w, _ = words([r["t"]])
        if size and size + len(w) > most and r["i"] != ids[-1]:
            yield index(ids, items)
            ids, items, size = [], [], 0
        ids.append(r["i"])
        items.append(w)
        size += len(w)
    yield index(ids, items)


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """A row for each document and item found in it: distance, budget and the end word."""
    rows, out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")), None
    numbers = ["distance", "budget", "end_word"]
    schema = StructType([StructField("k", docs.schema[key].dataType), StructField("i", benchmark.schema[item].dataType), *(StructField(c, LongType()) for c in numbers)])
    kind = to_arrow_type(benchmark.schema[item].dataType)
    for block in blocks(benchmark, item):
        held = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_WORDS words and one id's texts

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = list(search(held.value, b.column(1).to_pylist()))
                row, ids, *rest = zip(*got, strict=True) if got else [[]] * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(ids, kind), *(pa.array(c, pa.int64()) for c in rest)], names=schema.names)

        part = mapped(rows, run, schema)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("k").alias(key), F.col("i").alias(item), *numbers)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows in which no item is found, as they are."""
    at = docs.columns.index(text)
    for block in blocks(benchmark, item):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[r for r, *_ in search(held.value, b.column(at).to_pylist())]] = False
                yield b.filter(pa.array(clean))

        docs = mapped(docs, run, docs.schema)
    return docs
