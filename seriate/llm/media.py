"""Media columns as baseline JPEG, read back as DC-only luminance thumbnails.

A payload byte becomes one flat 8x8 block: its DC coefficient, quantised by 8,
is the byte less 128, so the DC-only thumbnail of the image *is* the payload.
Rows of 192 blocks end in restart markers, which makes rows independent:
decoding runs over all rows of many images in lockstep, a Huffman symbol of
each row per numpy step.  A payload beyond one image's height is stored as
several images, one after another.

The reader takes any baseline JPEG (Huffman-coded, 8-bit, one to four
components, any sampling and restart interval, interleaved or not) and raises
``ValueError`` on others, on truncated data and on invalid codes.

Defined results: a null text counts as empty; an empty text is one row of
blanks; texts of any length are stored whole, image by image; equal texts get
equal values; repeated rows are stored each; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import mapped

WIDTH = 192
#: Block rows of an image at most (the format ends at 8191).
ROWS = 4096

# Fixed values of the format: code lengths and categories of the usual luminance DC table.
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
#: Flat blocks need one AC symbol, the end of the block.
AC_COUNTS = [1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
AC_SYMBOLS = [0]


def codes(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a canonical Huffman table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            if code >> length:
                raise ValueError("over-full Huffman table")
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For each 16-bit window: length * 256 + symbol of the code it starts with; 0 if none."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, code, length in codes(counts, symbols):
        table[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
    return table


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def header(width: int, height: int) -> bytes:
    """Everything before the scan of a one-component image of ``width`` x ``height`` blocks, a restart per row."""
    size = (height * 8).to_bytes(2, "big") + (width * 8).to_bytes(2, "big")
    return (
        b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([8] * 64)) + _segment(0xC0, b"\x08" + size + b"\x01\x01\x11\x00")
        + _segment(0xC4, b"\x00" + bytes(DC_COUNTS + DC_SYMBOLS)) + _segment(0xC4, b"\x10" + bytes(AC_COUNTS + AC_SYMBOLS))
        + _segment(0xDD, width.to_bytes(2, "big")) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


_DC = {s: (c, n) for s, c, n in codes(DC_COUNTS, DC_SYMBOLS)}
_CATEGORY = np.array([abs(d).bit_length() for d in range(-255, 256)])
#: By difference + 255: the DC code, the magnitude bits and the end of block, and how many bits they are.
_LENGTH = np.array([_DC[k][1] + k + 1 for k in _CATEGORY], np.int64)
_VALUE = np.array([(_DC[k][0] << k | (d if d >= 0 else d + (1 << k) - 1)) << 1 for d, k in zip(range(-255, 256), _CATEGORY.tolist(), strict=True)], np.int64)


def encode(samples: np.ndarray, heights: list[int]) -> list[bytes]:
    """JPEG images of consecutive block rows: ``samples`` is rows x width of bytes, ``heights`` splits the rows."""
    rows, width = samples.shape
    dc = samples.astype(np.int64) - 128
    diff = dc.copy()
    diff[:, 1:] -= dc[:, :-1]
    diff += 255
    length, value = _LENGTH[diff], _VALUE[diff]
    ends = np.cumsum(length, 1)
    bits = ends[:, -1]
    size = bits + 7 >> 3
    first = np.concatenate([[0], np.cumsum(size)])
    # Each symbol touches at most three bytes; a last one fills each row with ones.
    pad = size * 8 - bits
    length = np.concatenate([length, pad[:, None]], 1).ravel()
    value = np.concatenate([value, ((1 << pad) - 1)[:, None]], 1).ravel()
    at = (np.concatenate([ends - length.reshape(rows, -1)[:, :-1], bits[:, None]], 1) + first[:-1, None] * 8).ravel()
    value <<= 24 - (at & 7) - length
    at >>= 3
    total = int(first[-1])
    data = sum(np.bincount(at + k, value >> 16 - 8 * k & 255, total + 3) for k in range(3))[:total].astype(np.uint8)
    # Where each byte ends up among headers, stuffed zeros and restart markers.
    full = data == 255
    stuffed = np.cumsum(full) - full
    per_row = np.add.reduceat(full, first[:-1]).astype(np.int64) + size
    heads = [header(width, h) for h in heights]
    head = len(heads[0])
    image = np.repeat(np.arange(len(heights)), heights)
    row_in = np.arange(rows) - np.repeat(np.cumsum([0, *heights[:-1]]), heights)
    before = np.concatenate([[0], np.cumsum(per_row + 2)])[:-1] + head * (image + 1)
    shift = before - np.concatenate([[0], np.cumsum(per_row)])[:-1]
    out = np.zeros(int(before[-1] + per_row[-1] + 2), np.uint8)
    out[np.arange(total) + stuffed + np.repeat(shift, size)] = data
    tail = before + per_row
    out[tail] = 255
    out[tail + 1] = np.where(np.append(image[1:] != image[:-1], True), 0xD9, 0xD0 + row_in % 8)
    starts = np.append(before[row_in == 0] - head, len(out))
    for s, h in zip(starts, heads, strict=False):
        out[s : s + head] = np.frombuffer(h, np.uint8)
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


@dataclass
class Scan:
    """Where the entropy-coded data of an image's first luminance scan lies, and how to read it."""

    width: int  # in blocks of component 0
    height: int
    mcus: int
    interval: int
    layout: tuple[tuple[int, int, bytes, bytes], ...]  # component, blocks an MCU, DC table, AC table
    across: tuple[int, int, int]  # MCUs a row, component 0's sampling
    step: int  # quantisation of component 0's DC
    start: int


def parse(data: bytes, base: int = 0) -> tuple[Scan, int]:
    """The scan of the image at ``base`` and the position after its headers."""

    def take(at: int, n: int) -> bytes:
        if at + n > len(data):
            raise ValueError("truncated JPEG")
        return data[at : at + n]

    if take(base, 2) != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, steps, tables, frame, interval = base + 2, {}, {}, None, 0
    while True:
        mark = take(at, 4)
        if mark[0] != 0xFF:
            raise ValueError("marker expected")
        if mark[1] == 0xFF:  # fill byte
            at += 1
            continue
        kind, n = mark[1], int.from_bytes(mark[2:], "big")
        body = take(at + 4, n - 2)
        at += 2 + n
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                steps[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                count = sum(body[1:17])
                tables[body[0]] = bytes(body[1 : 17 + count])
                body = body[17 + count :]
        elif kind == 0xDD:
            interval = int.from_bytes(body, "big")
        elif kind == 0xC0:
            if body[0] != 8:
                raise ValueError("not 8-bit")
            frame = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), {body[6 + 3 * k]: (k, body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])}
        elif kind in range(0xC1, 0xD0) and kind not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif kind == 0xDA:
            if not frame or not frame[0] or not frame[1]:
                raise ValueError("scan without frame")
            break
    rows, cols, parts = frame
    top_h, top_v = max(p[1] for p in parts.values()), max(p[2] for p in parts.values())
    first = next(p for p in parts.values() if p[0] == 0)
    try:
        chosen = [(parts[body[1 + 2 * k]], tables[body[2 + 2 * k] >> 4], tables[16 | body[2 + 2 * k] & 15]) for k in range(body[0])]
        step = steps[first[3]]
    except KeyError:
        raise ValueError("missing table or component") from None
    if chosen[0][0][0] != 0:
        raise ValueError("the first scan holds no luminance")
    width, height = -(-(-(-cols * first[1] // top_h)) // 8), -(-(-(-rows * first[2] // top_v)) // 8)
    if len(chosen) == 1:
        layout, across, mcus = ((0, 1, *chosen[0][1:]),), (width, 1, 1), width * height
    else:
        wide, high = -(-cols // (8 * top_h)), -(-rows // (8 * top_v))
        layout = tuple((p[0], p[1] * p[2], dc, ac) for p, dc, ac in chosen)
        across, mcus = (wide, first[1], first[2]), wide * high
    return Scan(width, height, mcus, interval or mcus, layout, across, step, at), at


def _tables(spec: bytes, cache: dict[bytes, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    if spec not in cache:
        if len(cache) > 64:
            cache.clear()
        cache[spec] = lookup(list(spec[:16]), list(spec[16:]))
    return cache[spec]


def decode(raw: bytes) -> list[np.ndarray]:
    """The DC-only luminance thumbnails of consecutive baseline images."""
    buf = np.frombuffer(raw, np.uint8)
    marks = np.flatnonzero(buf[:-1] == 255)
    kind = buf[marks + 1]
    ending = marks[(kind != 0) & (kind != 255) & ((kind < 0xD0) | (kind > 0xD7))]
    scans, ends, at = [], [], 0
    while at < len(raw):
        scan, start = parse(raw, at)
        k = int(np.searchsorted(ending, start))
        if k == len(ending):
            raise ValueError("truncated JPEG")
        scans.append(scan)
        ends.append(int(ending[k]))
        while k < len(ending) and buf[ending[k] + 1] != 0xD9:  # later scans of the same image
            k += 1
        if k == len(ending):
            raise ValueError("no end of image")
        at = int(ending[k]) + 2
    starts = np.array([s.start for s in scans], np.int64)
    # Stuffed zeros and restart markers inside scans go; segments start behind markers.
    owner = np.searchsorted(starts, marks, "right") - 1
    inside = (owner >= 0) & (marks < np.array(ends, np.int64)[owner])
    keep = np.ones(len(buf), bool)
    keep[marks[inside & (kind == 0)] + 1] = False
    place = np.concatenate([[0], np.cumsum(keep)])
    clean = np.concatenate([buf[keep], np.zeros(8, np.uint8)]).astype(np.uint32)
    word = clean[:-3] << np.uint32(24) | clean[1:-2] << np.uint32(16) | clean[2:-1] << np.uint32(8) | clean[3:]
    restart = inside & (kind >= 0xD0) & (kind <= 0xD7)
    seg_at = np.concatenate([starts, marks[restart] + 2])
    seg_end = np.concatenate([np.array(ends, np.int64), marks[restart]])
    seg_image = np.concatenate([np.arange(len(scans)), owner[restart]])
    order = np.lexsort((seg_at, seg_image))
    seg_at, seg_image = seg_at[order], seg_image[order]
    seg_end = np.sort(seg_end)
    counts = np.array([-(-s.mcus // s.interval) for s in scans])
    if not np.array_equal(np.bincount(seg_image, minlength=len(scans)), counts):
        raise ValueError("wrong number of restart segments")
    seg_no = np.arange(len(seg_at)) - (np.cumsum(counts) - counts)[seg_image]
    lengths = np.minimum([scans[i].interval for i in seg_image], [scans[i].mcus for i in seg_image] - seg_no * [scans[i].interval for i in seg_image])
    dc: list[np.ndarray] = [np.empty(0)] * len(scans)
    layouts: dict[tuple, list[int]] = {}
    for i, s in enumerate(scans):
        layouts.setdefault(s.layout, []).append(i)
    for layout, images in layouts.items():
        lanes = np.flatnonzero(np.isin(seg_image, images)) if len(layouts) > 1 else np.arange(len(seg_at))
        got = _lockstep(word, place[seg_at[lanes]] * 8, place[seg_end[lanes]] * 8, lengths[lanes], layout)
        for i in images:
            mine = seg_image[lanes] == i if len(images) > 1 else slice(None)
            part, n = got[mine], lengths[lanes][mine]
            flat = part.reshape(-1, part.shape[2]) if n.min() == n.max() else np.concatenate([p[:k] for p, k in zip(part, n, strict=True)])
            dc[i] = flat
    out = []
    for s, blocks in zip(scans, dc, strict=True):
        wide, h, v = s.across
        grid = blocks.reshape(-1, wide, v, h).transpose(0, 2, 1, 3).reshape(-1, wide * h)[: s.height, : s.width]
        out.append(np.clip(np.rint(grid * (s.step / 8)) + 128, 0, 255).astype(np.uint8))
    return out


def _lockstep(word: np.ndarray, at: np.ndarray, end: np.ndarray, lengths: np.ndarray, layout: tuple) -> np.ndarray:
    """DC coefficients (lanes x MCUs x blocks) of component 0, decoding one symbol of each lane per step."""
    order = np.argsort(-lengths, kind="stable")
    at, lengths, end = at[order], lengths[order], end[order]
    out = np.zeros((len(at), int(lengths[0]), layout[0][1]), np.int16)
    last = len(word) - 1
    pred = np.zeros((max(c for c, *_ in layout) + 1, len(at)), np.int64)
    tables = [(c, n, _tables(dc), _tables(ac)) for c, n, dc, ac in layout]
    for t in range(out.shape[1]):
        n = int(np.searchsorted(-lengths, -t, "left"))  # lanes with an MCU t
        pos = at[:n]
        for c, blocks, dc, ac in tables:
            for b in range(blocks):
                hit = dc[word[np.minimum(pos >> 3, last)] >> (16 - (pos & 7)).astype(np.uint32) & np.uint32(0xFFFF)]
                pos += hit >> 8
                size = (hit & 255).astype(np.int64)
                if size.max(initial=0) > 11 or not hit.all():
                    raise ValueError("invalid DC code")
                bits = (word[np.minimum(pos >> 3, last)] << (pos & 7).astype(np.uint32)).astype(np.int64) >> 32 - size
                pos += size
                pred[c, :n] += np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)
                if c == 0:
                    out[:n, t, b] = pred[0, :n]
                live, k = None, None
                while True:
                    p = pos if live is None else pos[live]
                    hit = ac[word[np.minimum(p >> 3, last)] >> (16 - (p & 7)).astype(np.uint32) & np.uint32(0xFFFF)]
                    if not hit.all():
                        raise ValueError("invalid AC code")
                    more = hit & 255
                    step = (hit >> 8) + (more & 15)
                    if live is None:
                        pos += step
                        if not more.any():
                            break
                        live, k = np.arange(n), np.ones(n, np.int64)
                    else:
                        pos[live] += step
                    k = k + (more >> 4) + 1
                    if (((more & 15) == 0) & (more != 0xF0) & (more != 0)).any() or ((k > 64) & (more != 0)).any():
                        raise ValueError("invalid AC run")
                    go = (more != 0) & (k < 64)
                    live, k = live[go], k[go]
                    if not len(live):
                        break
    if (at > end).any():
        raise ValueError("truncated scan")
    back = np.empty_like(out)
    back[order] = out
    return back


def thumbnail_hash(grid: np.ndarray) -> str:
    """Dimensions in blocks, a difference hash and a mean hash of the thumbnail cut to 8 x 9 cells."""
    h, w = grid.shape
    ys, xs = np.arange(8) * h // 8, np.arange(9) * w // 9
    sums = np.add.reduceat(np.add.reduceat(grid.astype(np.int64), np.unique(ys), 0), xs, 1)
    rows = np.diff(np.append(np.unique(ys), h))[:, None] * np.diff(np.append(xs, w))[None, :]
    cells = (sums * 16 // rows)[np.searchsorted(np.unique(ys), ys)]
    rise = np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()
    mean = np.packbits(cells[:, :8] * cells[:, :8].size > cells[:, :8].sum()).tobytes().hex()
    return f"{w}x{h}:{rise}:{mean}"


def payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each filled with blanks to whole rows (one at least), and each one's rows."""
    n = np.diff(offsets)
    rows = np.maximum(1, -(-n // WIDTH))
    out = np.full(int(rows.sum()) * WIDTH, 32, np.uint8)
    to = np.concatenate([[0], np.cumsum(rows)])[:-1] * WIDTH
    src = data[offsets[0] : offsets[-1]]
    out[np.arange(len(src)) + np.repeat(to - (offsets[:-1] - offsets[0]), n)] = src
    return out.reshape(-1, WIDTH), rows


def stored(samples: np.ndarray, rows: np.ndarray) -> Iterator[list[bytes]]:
    """The images of each payload; those of small payloads are made together."""
    at, i = 0, 0
    while i < len(rows):
        j = i + 1
        while j < len(rows) and rows[i : j + 1].sum() <= ROWS:
            j += 1
        if rows[i] > ROWS:
            yield [encode(samples[at + k : at + min(k + ROWS, rows[i])], [int(min(ROWS, rows[i] - k))])[0] for k in range(0, int(rows[i]), ROWS)]
        else:
            for image in encode(samples[at : at + int(rows[i:j].sum())], rows[i:j].tolist()):
                yield [image]
        at += int(rows[i:j].sum())
        i = j


def round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store each text as media, read the stored bytes back, and describe both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.utf8(batch.column(1))
            out: list[tuple] = []
            for i, j in textkit.groups(offsets, ROWS * WIDTH):
                samples, rows = payloads(data, offsets[i : j + 1])
                if j - i > 1:
                    media = [b"".join(m) for m in stored(samples, rows)]
                    grids = _read(media)
                    for k, (m, g) in enumerate(zip(media, grids, strict=True)):
                        back = g.tobytes()
                        out.append((int(offsets[i + k + 1] - offsets[i + k]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), thumbnail_hash(g)))
                else:
                    (images,) = stored(samples, rows)
                    grids = [g for m in images for g in decode(m)]
                    payload, medium = hashlib.sha256(), hashlib.sha256()
                    for m, g in zip(images, grids, strict=True):
                        payload.update(g.tobytes())
                        medium.update(m)
                    whole = np.concatenate(grids)
                    out.append((int(offsets[j] - offsets[i]), whole.size, payload.hexdigest(), zlib.crc32(whole[-1, -16:].tobytes()), sum(map(len, images)), medium.hexdigest(), thumbnail_hash(whole)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["k", *NAMES])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return mapped(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, schema).select(F.col("k").alias(key), *NAMES)


NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def _read(media: list[bytes]) -> list[np.ndarray]:
    """The thumbnails of media of one image each, decoded together."""
    return decode(b"".join(media))
