"""Operators over ordered points of lines: windows partitioned by line, so each line is one sort in one task's stream.

Points are rows (line, seq, x, y, ...). Corner detection folds over one line's samples and is the one operator here that
is not a window: its runs tolerate gaps and restart behind them, so it works on one line's arrays at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(line: str, seq: str):
    return Window.partitionBy(line).orderBy(seq)


def running_distance(points: DataFrame, line: str = "line", seq: str = "seq") -> DataFrame:
    """step_m from the point before and s, the distance along the line."""
    w = _order(line, seq)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    stepped = points.withColumn("step_m", step)
    return stepped.withColumn("s", F.sum("step_m").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def curvature(points: DataFrame, line: str = "line", seq: str = "seq") -> DataFrame:
    """curvature: signed, of the circle through a point and its neighbours; 0 at the ends."""
    w = _order(line, seq)
    x0, y0, x2, y2 = F.lag("x").over(w), F.lag("y").over(w), F.lead("x").over(w), F.lead("y").over(w)
    x1, y1 = F.col("x"), F.col("y")
    cross = (x1 - x0) * (y2 - y1) - (y1 - y0) * (x2 - x1)
    sides = F.hypot(x1 - x0, y1 - y0) * F.hypot(x2 - x1, y2 - y1) * F.hypot(x2 - x0, y2 - y0)
    return points.withColumn("curvature", F.coalesce(F.when(sides > 0, 2 * cross / sides), F.lit(0.0)))


def turn_angle(points: DataFrame, line: str = "line", seq: str = "seq") -> DataFrame:
    """turn: the wrapped change of heading at a point, in radians (null at the ends)."""
    w = _order(line, seq)
    ahead = F.atan2(F.lead("y").over(w) - F.col("y"), F.lead("x").over(w) - F.col("x"))
    behind = F.atan2(F.col("y") - F.lag("y").over(w), F.col("x") - F.lag("x").over(w))
    return points.withColumn("turn", F.pmod(ahead - behind + math.pi, F.lit(2 * math.pi)) - math.pi)


def smooth(points: DataFrame, value: str, out: str, half: int = 2, line: str = "line", seq: str = "seq") -> DataFrame:
    """Centred mean over 2 half + 1 samples; beyond the ends the end's value repeats. Lines under 3 samples stay."""
    w = _order(line, seq)
    whole = Window.partitionBy(line)
    frame = w.rowsBetween(-half, half)
    at, n = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before, after = F.greatest(F.lit(0), half + 1 - at), F.greatest(F.lit(0), half - (n - at))
    mean = (F.sum(value).over(frame) + before * first + after * last) / (2 * half + 1)
    return points.withColumn(out, F.when(n < 3, F.col(value)).otherwise(mean))


def fill_gaps(points: DataFrame, value: str, out: str, at: str = "s", line: str = "line", seq: str = "seq") -> DataFrame:
    """Missing values, linear between the nearest known ones; flat before the first and after the last."""
    w = _order(line, seq)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("s"), F.col(value).alias("v")))
    before = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(known, True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    share = (F.col(at) - before["s"]) / (after["s"] - before["s"])
    between = F.when(after["s"] > before["s"], before["v"] + share * (after["v"] - before["v"])).otherwise(before["v"])
    return points.withColumn(out, F.coalesce(F.col(value), between, before["v"], after["v"]))


def repair_flagged(points: DataFrame, value: str, flagged: str, out: str, at: str = "s", line: str = "line", seq: str = "seq") -> DataFrame:
    """Each flagged run on a straight line between its neighbours; on one side flat; with none the values stay."""
    hidden = points.withColumn("_v", F.when(~F.col(flagged), F.col(value)))
    return fill_gaps(hidden, "_v", "_f", at, line, seq).withColumn(out, F.coalesce("_f", value)).drop("_v", "_f")


def islands(points: DataFrame, condition: Column, gap: int = 0, line: str = "line", seq: str = "seq") -> DataFrame:
    """Runs of rows that meet the condition, with up to `gap` others inside: line, run (from 1), first, last, rows."""
    w = _order(line, seq)
    numbered = points.withColumn("_at", F.row_number().over(w)).where(condition)
    new = F.coalesce(F.col("_at") - F.lag("_at").over(w) > gap + 1, F.lit(True)).cast("int")
    runs = numbered.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(line, "run").agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count(F.lit(1)).alias("rows"))


def grade_stats(points: DataFrame, z: str, window_m: float = 100.0, line: str = "line", seq: str = "seq") -> DataFrame:
    """climb, descent and the greatest grade in percent over the window, after filling gaps and smoothing."""
    w = _order(line, seq)
    counts = F.count(z).over(Window.partitionBy(line))
    known = points.withColumn("_known", counts).where("_known >= 2")
    filled = smooth(fill_gaps(known, z, "_z", "s", line, seq), "_z", "_z", 2, line, seq)
    spaced = filled.withColumn("_d", F.col("_z") - F.lag("_z").over(w)).withColumn("_h", F.col("s") - F.lag("s").over(w))
    step = Window.partitionBy(line)
    spaced = spaced.withColumn("_k", F.greatest(F.lit(1), F.bround(window_m / F.greatest(F.expr("median(_h)").over(step), F.lit(1e-6)), 0).cast("int")))
    # k is constant on a line: the row k places ahead, by its number
    spaced = spaced.withColumn("_at", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(step))
    ahead = spaced.select(F.col(line).alias("_l"), (F.col("_at") - F.least(F.col("_k"), F.col("_n") - 1)).alias("_p"), F.col("_z").alias("_z2"), F.col("s").alias("_s2"))
    joined = spaced.join(ahead, (F.col(line) == F.col("_l")) & (F.col("_at") == F.col("_p")), "left")
    grade = F.when(F.col("_s2") > F.col("s"), F.abs(F.col("_z2") - F.col("_z")) / (F.col("_s2") - F.col("s")) * 100).otherwise(0.0)
    return joined.groupBy(line).agg(
        F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(0.0)).alias("climb_m"),
        F.coalesce(F.sum(F.when(F.col("_d") < 0, -F.col("_d"))), F.lit(0.0)).alias("descent_m"),
        F.max(grade).alias("max_grade"),
    )


def resample(points: DataFrame, step: float = 10.0, line: str = "line", seq: str = "seq") -> DataFrame:
    """Evenly spaced points, at most `step` apart, with both ends: line, k, s, x, y.

    Each piece between two points gives the samples that fall into it, so a line of any length streams.
    """
    w = _order(line, seq)
    placed = running_distance(points, line, seq)
    placed = placed.withColumn("_total", F.max("s").over(Window.partitionBy(line))).where("_total > 0")
    placed = placed.withColumn("_n", F.greatest(F.floor(F.col("_total") / step) + 1, F.lit(2)))
    placed = placed.withColumn("_gap", F.col("_total") / (F.col("_n") - 1))
    placed = placed.withColumn("_s0", F.lag("s").over(w)).withColumn("_x0", F.lag("x").over(w)).withColumn("_y0", F.lag("y").over(w)).where("step_m > 0")
    lo = F.when(F.col("_s0") <= 0, F.lit(0)).otherwise(F.floor(F.col("_s0") / F.col("_gap") + 1e-9) + 1)
    hi = F.when(F.col("s") >= F.col("_total") - 1e-9, F.col("_n") - 1).otherwise(F.floor(F.col("s") / F.col("_gap") + 1e-9))
    pieces = placed.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi").withColumn("k", F.explode(F.sequence("_lo", "_hi")))
    at = F.col("k") * F.col("_gap")
    share = (at - F.col("_s0")) / F.col("step_m")
    return pieces.select(line, "k", at.alias("s"), (F.col("_x0") + share * (F.col("x") - F.col("_x0"))).alias("x"), (F.col("_y0") + share * (F.col("y") - F.col("_y0"))).alias("y"))


CORNERS = "s double, radius double, sign int, heading double, length double"


def corners_of(x: np.ndarray, y: np.ndarray, s: np.ndarray, r_max: float = 600.0, least_turn: float = 25.0, coherence: float = 0.55) -> list[tuple]:
    """Corners of one resampled line, in order: runs of tight samples of one sign, one sample of tolerance."""
    n = len(x)
    if n < 4:
        return []
    k = np.zeros(n)
    ax, ay, bx, by = np.diff(x)[:-1], np.diff(y)[:-1], np.diff(x)[1:], np.diff(y)[1:]
    sides = np.hypot(ax, ay) * np.hypot(bx, by) * np.hypot(ax + bx, ay + by)
    np.divide(2 * (ax * by - ay * bx), sides, out=k[1:-1], where=sides > 0)
    k[0], k[-1] = k[1], k[-2]
    k = np.convolve(np.pad(k, 2, mode="edge"), np.full(5, 0.2), mode="valid")
    radius = np.divide(1.0, np.abs(k), out=np.full(n, np.inf), where=k != 0)
    sign = np.where(radius <= r_max, np.sign(k), 0).astype(int)
    step, head = float(s[1] - s[0]), np.arctan2(np.diff(y), np.diff(x))
    out, at = [], 1
    while at < n - 1:
        if sign[at] == 0:
            at += 1
            continue
        same = np.flatnonzero(sign[at : n - 1] == sign[at])
        breaks = np.flatnonzero(np.diff(same) > 2)
        first, last = at, at + int(same[breaks[0]] if len(breaks) else same[-1])
        at = last + 1
        lo, hi = max(first - 2, 0), min(last + 2, n - 1)
        part = k[lo : hi + 1]
        turn = math.degrees(np.trapezoid(np.where(np.sign(part) == sign[first], np.abs(part), 0.0), dx=step))
        if turn < least_turn:
            continue
        b = min(hi - 1, len(head) - 1)
        net = abs(math.degrees((head[b] - head[lo] + math.pi) % (2 * math.pi) - math.pi)) if b > lo else 0.0
        if net / turn < coherence:
            continue
        tight = radius[first : last + 1]
        out.append((float(s[first + int(tight.argmin())]), float(np.percentile(tight[np.isfinite(tight)], 20)), int(sign[first]), turn, float(s[last] - s[first]) + step))
    return out


def detect_corners(samples: DataFrame, line: str = "line") -> DataFrame:
    """Corners of every resampled line (line, k, s, x, y): line and the columns of CORNERS."""
    columns = [c.split()[0] for c in CORNERS.split(", ")]

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k", kind="stable")
        corners = pd.DataFrame(corners_of(*(rows[c].to_numpy(float) for c in ("x", "y", "s"))), columns=columns)
        corners.insert(0, line, rows[line].iloc[0])
        return corners

    # one line's samples at a time, as arrays of numbers: a batch of packed lines would hold every sample as an object
    of_line = samples.schema[line].dataType.simpleString()
    return samples.select(line, "k", "s", "x", "y").groupBy(line).applyInPandas(found, f"`{line}` {of_line}, {CORNERS}")


def esses_share(corners: DataFrame, line: str = "line", most_gap: float = 200.0) -> DataFrame:
    """Share of turning in alternating pairs of corners: line, esses."""
    w = Window.partitionBy(line).orderBy("s")
    pair = F.when((F.lag("sign").over(w) != F.col("sign")) & (F.col("s") - F.lag("s").over(w) <= most_gap), F.col("heading") + F.lag("heading").over(w))
    return corners.withColumn("_pair", pair).groupBy(line).agg(F.coalesce(F.least(F.lit(1.0), F.sum("_pair") / (2 * F.sum("heading"))), F.lit(0.0)).alias("esses"))


def straight_share(lines: DataFrame, corners: DataFrame, line: str = "line", length: str = "length_m", lo: float = 100.0, hi: float = 500.0) -> DataFrame:
    """Share of length in straights of lo to hi metres between corners: line, straight_share."""
    w = Window.partitionBy(line).orderBy("s")
    ends = corners.withColumn("_end", F.max(F.col("s") + F.col("length") / 2).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = ends.withColumn("_before", F.greatest(F.coalesce(F.lag("_end").over(w), F.lit(0.0)), F.lit(0.0)))
    gaps = ends.withColumn("_gap", F.greatest(F.greatest(F.col("s") - F.col("length") / 2, F.col("_before")) - F.col("_before"), F.lit(0.0)))
    good = lambda c: F.when(c.between(lo, hi), c).otherwise(0.0)
    sums = gaps.groupBy(line).agg(F.sum(good(F.col("_gap"))).alias("_good"), F.max("_end").alias("_last"))
    rest = F.greatest(F.col(length) - F.coalesce(F.greatest("_last", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    share = F.least(F.lit(1.0), (F.coalesce("_good", F.lit(0.0)) + good(rest)) / F.col(length))
    alone = F.when(F.col(length).between(lo, hi), 1.0).otherwise(0.0)
    return lines.join(sums, line, "left").select(line, F.when(F.col(length) <= 0, 0.0).when(F.col("_last").isNull(), alone).otherwise(share).alias("straight_share"))


def supported_spans(pairs: DataFrame, reasons: Column, evidence: list[str], line: str = "line", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Spans of neighbouring vertex pairs that nothing rules out and whose evidence is the same, and what was dropped.

    pairs: line, seq, length_m and the evidence columns; reasons: names of what rules a pair out, in order. Gives
    (line, span, first_seq, last_seq, length_m, evidence) and (reason, pairs, km) by the first reason.
    """
    marked = pairs.withColumn("_why", F.get(reasons, F.lit(0)))
    dropped = marked.where("_why is not null").groupBy(F.col("_why").alias("reason")).agg(F.count(F.lit(1)).alias("pairs"), (F.sum("length_m") / 1000).alias("km"))
    w = _order(line, seq)
    same = F.struct(*evidence)
    good = marked.where("_why is null").withColumn("_same", same)
    new = (F.lag(seq).over(w) == F.col(seq) - 1) & F.lag("_same").over(w).eqNullSafe(F.col("_same"))
    spans = good.withColumn("_new", F.when(new, 0).otherwise(1)).withColumn("span", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kept = spans.groupBy(line, "span").agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.sum("length_m").alias("length_m"), *[F.first(e).alias(e) for e in evidence])
    return kept, dropped
