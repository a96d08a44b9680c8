import hashlib
import zlib

import numpy as np
import pytest

from seriate.llm import media


def row(text):
    raw = (text or "").encode()
    pay = raw + b" " * ((-len(raw)) % 192 or (192 if not raw else 0))
    return len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:])


def test_round_trip(docs_of, monkeypatch):
    monkeypatch.setattr(media, "ROWS", 7)
    texts = [None, "", "a", "x" * 191, "x" * 192, "x" * 193, "éÿ\U0001f600" * 500, "".join(map(chr, range(1, 256))) * 20, "\x00\x7f" * 300, "long text " * 3000]
    docs = [*enumerate(texts), (90, texts[6]), (91, texts[6]), (91, texts[6])]
    got = media.round_trip(docs_of(docs)).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    for k, t in docs:
        r = by[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == row(t)
        assert r.media_bytes > 0 and r.feature.startswith("192x")
    assert tuple(by[6])[1:] == tuple(by[90])[1:] == tuple(by[91])[1:]
    assert media.round_trip(docs_of([])).count() == 0


class Writer:
    """Bits of a scan, with stuffed zeros."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def flush(self):
        raw = self.bits + "1" * (-len(self.bits) % 8)
        self.bits = ""
        return b"".join(bytes([b]) + (b"\0" if b == 255 else b"") for b in (int(raw[i : i + 8], 2) for i in range(0, len(raw), 8)))


def magnitude(v):
    n = abs(v).bit_length()
    return n, v if v > 0 else v + (1 << n) - 1


# A code of 8 bits for each of many symbols is a valid table.
DC, AC = list(range(12)), [0, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 6))]


def image(mcus, comps, size, interval=0, step=16):
    """A baseline image from quantised blocks: mcus x (component, blocks of 64 coefficients)."""
    dht = b"".join(media._segment(0xC4, bytes([c]) + bytes([0] * 7 + [len(s)] + [0] * 8) + bytes(s)) for c, s in ((0, DC), (16, AC)))
    sof = b"\x08" + size[1].to_bytes(2, "big") + size[0].to_bytes(2, "big") + bytes([len(comps)]) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(comps))
    out = b"\xff\xd8" + media._segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + b"\xff" + media._segment(0xDB, b"\0" + bytes([step] * 64)) + media._segment(0xC0, sof) + dht
    out += media._segment(0xDD, interval.to_bytes(2, "big")) if interval else b""
    out += media._segment(0xDA, bytes([len(comps)]) + b"".join(bytes([k + 1, 0]) for k in range(len(comps))) + b"\0\x3f\0")
    w, pred = Writer(), [0] * len(comps)
    for m, mcu in enumerate(mcus):
        if interval and m and m % interval == 0:
            out += w.flush() + bytes([0xFF, 0xD0 + (m // interval - 1) % 8])
            pred = [0] * len(comps)
        for c, blocks in enumerate(mcu):
            for b in blocks:
                n, v = magnitude(b[0] - pred[c])
                pred[c] = b[0]
                w.put(DC.index(n), 8)
                w.put(v, n)
                run = 0
                for x in b[1:]:
                    if x == 0:
                        run += 1
                        continue
                    while run > 15:
                        w.put(AC.index(0xF0), 8)
                        run -= 16
                    n, v = magnitude(x)
                    w.put(AC.index(run << 4 | n), 8)
                    w.put(v, n)
                    run = 0
                if run:
                    w.put(AC.index(0), 8)
    return out + w.flush() + b"\xff\xd9"


def blocks(r, n):
    out = []
    for _ in range(n):
        b = [int(r.integers(-60, 61))] + [0] * 63
        for k in r.integers(1, 64, 5):
            b[int(k)] = int(r.integers(-20, 21))
        out.append(b)
    return out


@pytest.mark.parametrize("interval", [0, 1, 3])
def test_general_baseline_images(interval):
    r = np.random.default_rng(5)
    grey = [[blocks(r, 1)] for _ in range(12)]
    colour = [[blocks(r, 4), blocks(r, 1), blocks(r, 1)] for _ in range(6)]
    data = image(grey, [(1, 1)], (30, 20), interval) + image(colour, [(2, 2), (1, 1), (1, 1)], (44, 28), interval)
    a, b = media.decode(data)
    shade = lambda dc: np.clip(np.rint(np.array(dc) * 2.0) + 128, 0, 255).astype(np.uint8)
    assert (a == shade([m[0][0][0] for m in grey]).reshape(3, 4)).all()
    want = np.zeros((4, 6), np.uint8)
    for m, mcu in enumerate(colour):
        for k, blk in enumerate(mcu[0]):
            want[m // 3 * 2 + k // 2, m % 3 * 2 + k % 2] = shade(blk[0])
    assert (b == want[:4, :6]).all()


def test_wrong_images_are_refused():
    good = media.encode(np.arange(384, dtype=np.uint8).reshape(2, 192), [2])[0]
    assert (media.decode(good)[0].ravel() == np.arange(384).astype(np.uint8)).all()
    for bad in (good[:40], b"\0" + good, good[:-2], good.replace(b"\xff\xc0", b"\xff\xc2", 1), good[:-30] + b"\xff\xd9", good.replace(b"\xff\xd0", b"", 1)):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_hash_of_tiny_and_large_thumbnails():
    flat = np.full((1, 192), 7, np.uint8)
    assert media.thumbnail_hash(flat) == "192x1:" + "0" * 16 + ":" + "0" * 16
    ramp = np.tile(np.arange(192, dtype=np.uint8), (50, 1))
    assert media.thumbnail_hash(ramp).split(":")[1] == "f" * 16
