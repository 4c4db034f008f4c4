"""Line matching against a greedy walk, sessions over several batches with late and repeated events."""

import hashlib
import os
import random

from pyspark.sql import functions as F

from vellumflow.operators import matching
from vellumflow.streaming.sessions import closed_sessions

DAY = 86400
LINES = "page string, line_id string, box struct<x0:int,y0:int,x1:int,y1:int>"


def iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union else 0.0


def by_hand(truth, pred):
    scored = [(-iou(a, b), hashlib.md5(f"{t}:{p}".encode()).hexdigest(), t, p, g) for g, t, a in truth for h, p, b in pred if g == h and g is not None and a and b and iou(a, b) > 0]
    used, out = set(), {}
    for worse, _, t, p, g in sorted(scored):
        if not {(g, "t", t), (g, "p", p)} & used:
            used |= {(g, "t", t), (g, "p", p)}
            out[g, t, p] = -worse
    return out


def test_matching(spark):
    """Random boxes over several cells and below zero, one crowded page, boxes that overlap alike, null and empty ones."""
    rng = random.Random(3)

    def boxes(n, name, spread):
        out = []
        for k in range(n):
            x, y = rng.randrange(-80, spread), rng.randrange(-80, spread)
            out.append((f"p{k % 5 if k % 2 else 0}", f"{name}{k}", (x, y, x + rng.randrange(0, 160), y + rng.randrange(0, 40))))
        return out

    truth, pred = boxes(300, "t", 500), boxes(260, "q", 500)
    truth += [("even", f"t{k}", (0, 10 * k, 50, 10 * k + 10)) for k in range(60)] + [(None, "t", (0, 0, 9, 9)), ("p0", "none", None)]
    pred += [("even", f"q{k}", (0, 10 * k + 5, 50, 10 * k + 15)) for k in range(60)] + [(None, "q", (0, 0, 9, 9)), ("alone", "q", (0, 0, 9, 9))]
    a, b = spark.createDataFrame(truth, LINES), spark.createDataFrame(pred, LINES)
    want = by_hand(truth, pred)
    for cell in (32, 256):
        got = matching.match_lines(a, b, cell=cell).collect()
        assert {(r["page"], r["truth"], r["pred"]): r["iou"] for r in got if r["truth"] and r["pred"]} == {k: v for k, v in want.items()}
        assert len(got) == len(truth) + len(pred) - len(want)
    n = matching.matching_summary(matching.match_lines(a, b)).first()
    assert (n["n_matched"], n["n_missed"], n["n_invented"]) == (len(want), len(truth) - len(want), len(pred) - len(want))
    assert matching.matching_summary(matching.match_lines(a, b.limit(0))).first()["n_missed"] == len(truth)
    assert matching.match_lines(a.limit(0), b.limit(0)).collect() == []


def test_sessions(spark, tmp_path):
    """Batches of a file each: a repeated event counts once, a late one not at all, an open session isn't written."""
    batches = [
        [(1, "a", 0, 1.0), (2, "a", 10, 2.0), (2, "a", 10, 2.0), (3, "b", 15, 4.0)],
        [(2, "a", 10, 2.0), (4, "a", 35, 8.0), (5, "b", 300, 16.0)],
        [(7, "b", 320, 64.0)],
        [(6, "a", 20, 32.0), (8, "a", 900, 128.0)],
    ]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event_id long, user_id string, m int, value double").withColumn("ts", F.timestamp_seconds(F.col("m") * 60 + DAY)).drop("m")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        at = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime)[-1]
        os.utime(at, (1_000_000_000 + k, 1_000_000_000 + k))
    got = closed_sessions(spark, str(tmp_path / "in"), files=1)
    rows = sorted((r["user_id"], (r["a"] - DAY) // 60, (r["z"] - DAY) // 60, r["n"], r["total"]) for r in got.withColumns({"a": F.unix_seconds("first_at"), "z": F.unix_seconds("ends_at")}).collect())
    assert rows == [("a", 0, 65, 3, 11.0), ("b", 15, 45, 1, 4.0), ("b", 300, 350, 2, 80.0)]
