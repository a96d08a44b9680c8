"""C-style number texts at the edges, where the JVM's formatting differs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


def g(value: float, digits: int = 6) -> str:
    return f"{value:.{digits}g}"


TAGS = ("seg_id", "start", "end", "len", "pred", "patt", "sal", "energy", "mean", "slope", "Q")
MOTIFS = ("motif_id", "seg_start", "seg_end", "n_segs", "pattern", "total_len", "total_energy")


def tag_row(r: dict) -> list[str]:
    return [str(r["seg_id"]), str(r["start_idx"]), str(r["end_idx"]), str(r["len"]), r["pred"], r["patt"], str(r["sal"]), g(r["energy"]), g(r["mean"]), g(r["slope"]), g(r["q_step"])]


def motif_row(r: dict) -> list[str]:
    return [*(str(r[k]) for k in MOTIFS[:6]), g(r["total_energy"])]


def profile_row(r: dict) -> list[str]:
    out = []
    for k, v in r.items():
        out.append(g(v) if k == "dt" else f"{v:.6f}" if k.startswith(("frac_", "energy_")) else f"{v:.3f}" if k.startswith("sal_") else str(v))
    return out


def aligned(head: Sequence[str], rows: Iterable[Sequence[str]]) -> list[str]:
    """Columns of texts, padded to their widest."""
    table = [list(head), *map(list, rows)]
    wide = [max(len(r[k]) for r in table) for k in range(len(head))]
    return ["  " + "  ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip() for r in table]
