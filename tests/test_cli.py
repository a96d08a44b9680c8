import csv
import math
import random

import pytest

from seriate import cli
from seriate.functions.blobs import MAGIC, SUFFIX


@pytest.fixture
def run(spark, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    return lambda *a: cli.main([str(x) for x in a])


@pytest.fixture
def blob(run, tmp_path):
    src, out = tmp_path / "trend.csv", tmp_path / f"trend{SUFFIX}"
    src.write_text("# value\n" + "\n".join(repr(0.1 * i) for i in range(200)) + "\n")
    assert run("encode", src, out, "--dt", 1, "--t0", "0", "--unit", "step") == 0
    return out


def rows(path):
    with open(path) as f:
        return list(csv.reader(f))


def test_encode_and_decode(run, blob, tmp_path):
    assert blob.stat().st_size == 442
    assert run("decode", blob, tmp_path / "back.csv") == 0
    back = [float(x) for x in (tmp_path / "back.csv").read_text().split()]
    assert back == pytest.approx([0.1 * i for i in range(200)], abs=1e-6)


def test_noisy_series_by_auto(run, tmp_path):
    r = random.Random(123)
    xs = [math.sin(2 * math.pi * i / 50) + r.gauss(0, 0.1) for i in range(300)]
    (tmp_path / "s.csv").write_text("value\n" + "\n".join(map(repr, xs)))
    assert run("encode", tmp_path / "s.csv", tmp_path / f"s{SUFFIX}", "--dt", 60, "--t0", "0", "--unit", "arb", "--predictor", "auto", "--min-segment-length", 30, "--max-segment-length", 80, "--mse-threshold", 0.2) == 0
    run("decode", tmp_path / f"s{SUFFIX}", tmp_path / "b.csv")
    back = [float(x) for x in (tmp_path / "b.csv").read_text().split()]
    assert math.sqrt(sum((a - b) ** 2 for a, b in zip(xs, back, strict=True)) / 300) < 0.3


def test_info(run, blob, capsys):
    run("info", blob, "-v")
    out = capsys.readouterr().out
    for part in ("Time series", "Segments overview", "Stats:", "Motifs:", "Profile:", "ratio     : 3.620x"):
        assert part in out


def test_exports_events_and_clusters(run, blob, tmp_path):
    run("export-tags", blob, tmp_path / "tags.csv")
    head, *body = rows(tmp_path / "tags.csv")
    assert head == ["seg_id", "start", "end", "len", "pred", "patt", "sal", "energy", "mean", "slope", "Q"] and body[0][:7] == ["0", "0", "127", "128", "linear", "trend", "2"]
    run("export-motifs", blob, tmp_path / "motifs.csv")
    assert rows(tmp_path / "motifs.csv") == [["motif_id", "seg_start", "seg_end", "n_segs", "pattern", "total_len", "total_energy"], ["0", "0", "1", "2", "trend", "200", "20.0002"]]
    run("export-profile", blob, tmp_path / "p1.csv")
    run("batch-profile", tmp_path, "-o", tmp_path / "new/p.csv")
    assert rows(tmp_path / "p1.csv") == rows(tmp_path / "new/p.csv")
    p = dict(zip(*rows(tmp_path / "p1.csv"), strict=True))
    assert (p["file"], p["frac_trend"], p["energy_avg"], p["sal_avg"], p["dt"]) == (f"trend{SUFFIX}", "1.000000", "10.000100", "2.000", "1")
    run("events", tmp_path / "p1.csv", "-o", tmp_path / "e.csv")
    assert rows(tmp_path / "e.csv") == [["file", "event_type"], [f"trend{SUFFIX}", "single_trend_regime"]]
    run("clusters", tmp_path / "p1.csv", tmp_path / "c.csv")
    assert rows(tmp_path / "c.csv")[1][-1] == "trend_dominated"


def test_wrong_use(run, blob, tmp_path, capsys):
    assert run() == 0 and "usage" in capsys.readouterr().out
    (tmp_path / f"bad{SUFFIX}").write_bytes(MAGIC + b"xx")
    with pytest.raises(Exception, match="contain header"):
        run("info", tmp_path / f"bad{SUFFIX}")
    (tmp_path / "none.csv").write_text("value\n")
    assert run("encode", tmp_path / "none.csv", tmp_path / "x", "--dt", 1, "--t0", "0", "--unit", "u") == 1
    for extra in ([], [tmp_path / "a", "-o", tmp_path / "b"]):
        with pytest.raises(SystemExit):
            run("events", tmp_path / "p.csv", *extra)
    (tmp_path / "dir").mkdir()
    with pytest.raises(SystemExit):
        run("batch-profile", tmp_path / "dir", "-o", tmp_path / "x.csv")


def test_alarm_commands(run, tmp_path, capsys):
    run("demo-alarms", tmp_path / "log.csv")
    run("alarms", tmp_path / "log.csv", tmp_path / "i.csv", "--dt", 60)
    body = rows(tmp_path / "i.csv")
    assert body[0] == ["value"] and len(body) > 40
    assert "--t0 2025-01-01T" in capsys.readouterr().out
    (tmp_path / "none.csv").write_text("timestamp,type,severity\n")
    run("alarms", tmp_path / "none.csv", tmp_path / "n.csv")
    assert rows(tmp_path / "n.csv") == [["value"]]
    run("demo-data", tmp_path / "demo")
    assert len(rows(tmp_path / "demo/multi_bump.csv")) == 301
