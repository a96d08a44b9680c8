"""Pictures of tags and intensities; needs matplotlib, which nothing else does."""

from __future__ import annotations

from collections.abc import Sequence


def _figure():
    import matplotlib

    matplotlib.use("Agg")
    from matplotlib import pyplot

    return pyplot.subplots()


def tags(rows: Sequence, base: str, position: bool = True, energy: bool = True) -> list[str]:
    """``<base>.segments.png`` with a bar from start to end of each segment, ``<base>.energy.png`` with its energy."""
    made = []
    for wanted, suffix in ((position, "segments"), (energy, "energy")):
        if not wanted or not rows:
            continue
        fig, ax = _figure()
        at = range(len(rows))
        if suffix == "segments":
            ax.barh(at, [r["end"] - r["start"] for r in rows], left=[r["start"] for r in rows])
            ax.set_yticks(list(at), [f"{r['seg_id']} ({r['patt']})" for r in rows])
            ax.set_xlabel("time index")
        else:
            ax.bar([r["seg_id"] for r in rows], [r["energy"] for r in rows])
            ax.set(xlabel="segment", ylabel="energy")
        made.append(f"{base}.{suffix}.png")
        fig.savefig(made[-1])
    return made


def values(series: Sequence[float], path: str) -> None:
    fig, ax = _figure()
    ax.plot(series)
    ax.set(xlabel="bin", ylabel="intensity")
    fig.savefig(path)
