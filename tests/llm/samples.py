"""Invented texts."""

import random


def prose(seed, n, size=4000):
    """n words from an invented vocabulary."""
    r = random.Random(seed)
    return " ".join("".join(chr(97 + (w * 7 + k * k + w // 26) % 26) for k in range(3 + w % 6)) + str(w % 10) for w in (r.randrange(size) for _ in range(n)))
