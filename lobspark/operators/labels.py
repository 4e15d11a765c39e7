"""Triple-barrier labels on the true mid path, EWMA volatility, uniqueness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lobspark.operators.folds import ordered_fold
from lobspark.operators.ordered import BUCKET, asof, balanced_bucket_width, bucket_of, running, shift, with_bucket
from lobspark.session import DAY_NS, NS_PER_S, materialize

DEFAULT_HORIZONS: Mapping[str, int] = {"2s": 2 * NS_PER_S, "10s": 10 * NS_PER_S, "60s": 60 * NS_PER_S}


class _Decay:
    """Sums carried into each bucket of one path: what came before, halved for every half-life since."""

    def __init__(self, halvings: float):
        self.halvings, self.last, self.s, self.w, self.n = halvings, None, 0.0, 0.0, 0

    def push(self, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b, s, w, n in zip(pdf[BUCKET].tolist(), pdf["s"].tolist(), pdf["w"].tolist(), pdf["n"].tolist()):
            fade = 0.5 ** ((b - self.last) * self.halvings) if self.last is not None else 0.0
            out.append((b, self.s * fade, self.w * fade, self.n))
            self.last, self.s, self.w, self.n = b, self.s * fade + s, self.w * fade + w, self.n + n
        return pd.DataFrame(out, columns=[BUCKET, "__cs", "__cw", "__cn"])

    def finish(self) -> None:
        return None


def ewma_vol(path: DataFrame, keys: Sequence[str], halflife_ns: int, width: int | None = None) -> DataFrame:
    """``vol_bps`` and ``n_returns`` at every point of a coalesced path (``keys, ts, mid``).

    Weights halve per ``halflife_ns``. Sums are taken relative to a bucket start of at most 64
    half-lives; the carry into a bucket is folded over all earlier buckets, one summary row each.
    """
    keys = list(keys)
    width = width or 64 * halflife_ns
    hl = float(halflife_ns)
    p = materialize(shift(path, keys, ["ts"], {"prev_mid": F.col("mid")}, width=max(width, DAY_NS)))
    p = with_bucket(p, "ts", width)
    ret = (F.col("mid") - F.col("prev_mid")) / F.col("prev_mid") * 1e4
    up = F.pow(F.lit(2.0), (F.col("ts") - F.col(BUCKET) * width) / hl)
    p = p.withColumns({"__s": ret * ret * up, "__w": F.when(ret.isNotNull(), up), "__n": ret.isNotNull().cast("bigint")})
    local = W.partitionBy(*keys, BUCKET).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    sums = {f"__l{c}": F.sum(f"__{c}").over(local) for c in ("s", "w", "n")}
    per = p.groupBy(*keys, BUCKET).agg(*[F.coalesce(F.sum(f"__{c}"), F.lit(0)).alias(c) for c in ("s", "w", "n")])
    kinds = dict(p.select(*keys).dtypes)
    ddl = "".join(f"`{k}` {kinds[k]}, " for k in keys) + f"{BUCKET} bigint, __cs double, __cw double, __cn bigint"
    per = ordered_fold(per.select(*keys, BUCKET, *[F.col(c).cast(t).alias(c) for c, t in (("s", "double"), ("w", "double"), ("n", "bigint"))]), keys, [BUCKET], lambda key: _Decay(width / hl), ddl)
    out = p.withColumns(sums).join(per, [*keys, BUCKET], "left")
    s = F.coalesce("__ls", F.lit(0.0)) + F.col("__cs")
    w = F.coalesce("__lw", F.lit(0.0)) + F.col("__cw")
    return out.select(
        *keys,
        "ts",
        "mid",
        (F.coalesce("__ln", F.lit(0)) + F.col("__cn")).alias("n_returns"),
        F.sqrt(s / F.when(w > 0, w)).alias("vol_bps"),
    )


def barrier_width(width_mult: float, vol_floor_bps: float, min_returns: int) -> dict[str, Column]:
    """``width_bps`` with its rejection reason (null when a width exists)."""
    width = F.greatest(F.coalesce("vol_bps", F.lit(0.0)), F.lit(float(vol_floor_bps))) * width_mult
    few = F.coalesce("n_returns", F.lit(0)) < min_returns
    return {
        "width_bps": F.when(~few & (width > 0), width),
        "label_reason": F.when(few, "insufficient_vol_history").when(width <= 0, "degenerate_barrier_width"),
    }


def anchors_with_width(path_vol: DataFrame, anchors: DataFrame, keys: Sequence[str], *, width_mult: float, vol_floor_bps: float,
                       min_returns: int, width: int = DAY_NS) -> DataFrame:
    """Anchors (``keys, t_event, p0``) with the path state at ``t_event`` and their barrier width."""
    at = asof(
        anchors, path_vol, keys, left_ts="t_event", right_ts="ts", width=width,
        cols={"path_mid": F.col("mid"), "vol_bps": F.col("vol_bps"), "n_returns": F.col("n_returns")},
    )
    return at.withColumns(barrier_width(width_mult, vol_floor_bps, min_returns))


def coverage_gate(anchors: DataFrame, keys: Sequence[str], max_horizon_ns: int, coverage_end: Column) -> DataFrame:
    """Violations that make labels undefined: no path state, wrong ``p0``, window past coverage."""
    return anchors.groupBy(*keys).agg(
        F.count("*").alias("n_anchors"),
        F.count_if(F.col("path_mid").isNull()).alias("no_path_point"),
        F.count_if(F.col("path_mid").isNotNull() & (F.col("path_mid") != F.col("p0"))).alias("p0_mismatch"),
        F.count_if(F.col("t_event") + max_horizon_ns > coverage_end).alias("window_past_coverage"),
    )


def first_hits(mid: np.ndarray, lo: np.ndarray, hi: np.ndarray, p0: np.ndarray, width: np.ndarray) -> np.ndarray:
    """First index in ``[lo, hi)`` whose return against ``p0`` reaches the width, for all anchors at once; -1 for none."""
    found, at, step = np.full(len(lo), -1, np.int64), lo.astype(np.int64), 8
    left = np.flatnonzero(lo < hi)
    while len(left):
        idx = at[left, None] + np.arange(step)
        ret = (mid[np.minimum(idx, len(mid) - 1)] - p0[left, None]) / p0[left, None] * 1e4
        hit = (np.abs(ret) >= width[left, None]) & (idx < hi[left, None])
        any_ = hit.any(axis=1)
        found[left[any_]] = idx[any_, hit[any_].argmax(axis=1)]
        at[left] += step
        left = left[~any_ & (at[left] < hi[left])]
        step = max(8, min(2 * step, (1 << 20) // max(1, len(left))))
    return found


class _PathThenAnchors:
    """The points of one bucket first, kept as arrays, then its anchors, batch by batch, through ``answer``."""

    COLUMNS = ("mid",)

    def __init__(self):
        self.parts, self.ts = [], None

    def push(self, pdf: pd.DataFrame) -> pd.DataFrame | None:
        kind = pdf["kind"].to_numpy()
        pts = pdf[kind == 0]
        if len(pts):
            self.parts.append([pts["ts"].to_numpy(np.int64), *(pts[c].to_numpy(float) for c in self.COLUMNS)])
        a = pdf[kind == 1]
        if not len(a):
            return None
        if self.ts is None:
            arrays = [np.concatenate(x) for x in zip(*self.parts)] if self.parts else [np.empty(0, np.int64), *(np.empty(0) for _ in self.COLUMNS)]
            self.ts, self.values = arrays[0], arrays[1:]
        return self.answer(a.reset_index(drop=True))

    def finish(self):
        return None


def _labelled(a: pd.DataFrame, ts: np.ndarray, mid: np.ndarray, lo: np.ndarray, hi: np.ndarray, before: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """Labels of anchors over the points ``[lo, hi)``; without any of these the return of ``before`` (NaN: zero). Also which anchors hit."""
    t, h = a["ts"].to_numpy(np.int64), a["horizon_ns"].to_numpy(np.int64)
    p0, w = a["mid"].to_numpy(float), a["width_bps"].to_numpy(float)
    hit = first_hits(mid, lo, hi, p0, w)
    end = before.copy()
    some = np.flatnonzero(hi > lo)
    end[some] = mid[hi[some] - 1]
    lab, at = np.zeros(len(a), np.int64), t + h
    won = np.flatnonzero(hit >= 0)
    end[won] = mid[hit[won]]
    y = np.where(np.isnan(end), 0.0, (end - p0) / p0 * 1e4)
    lab[won], at[won] = np.where(y[won] > 0, 1, -1), ts[hit[won]]
    out = a[["ts", "horizon"]].rename(columns={"ts": "t_event"})
    out["y_fwd_bps"], out["label"], out["t_barrier"], out["p0"], out["width_bps"] = y, lab, at, p0, w
    return out, hit >= 0


class _BarrierScan(_PathThenAnchors):
    """Path of one bucket plus one horizon of look-ahead."""

    def answer(self, a):
        t = a["ts"].to_numpy(np.int64)
        lo, hi = (np.searchsorted(self.ts, x, side="right") for x in (t, t + a["horizon_ns"].to_numpy(np.int64)))
        return _labelled(a, self.ts, self.values[0], lo, hi, np.full(len(a), np.nan))[0]


class _OwnBlock(_PathThenAnchors):
    """The part of the horizon inside the anchor's own block; ``open`` rows go on, with the last mid seen."""

    def __init__(self, width: int):
        super().__init__()
        self.width = width

    def answer(self, a):
        t, h = a["ts"].to_numpy(np.int64), a["horizon_ns"].to_numpy(np.int64)
        lo, hi = (np.searchsorted(self.ts, x, side="right") for x in (t, t + h))
        out, hit = _labelled(a, self.ts, self.values[0], lo, hi, np.full(len(a), np.nan))
        out["open"] = ~hit & ((t + h) // self.width > t // self.width)
        seen = np.full(len(a), np.nan)
        some = np.flatnonzero(hi > lo)
        seen[some] = self.values[0][hi[some] - 1]
        out["seen"], out["horizon_ns"] = seen, h
        return out


class _BlockIndex(_PathThenAnchors):
    """First later block whose lowest or highest mid is a crossing, by the extremes of blocks alone; ``ts`` are block numbers."""

    COLUMNS = ("low", "high", "last")

    def answer(self, a):
        low, high, last = self.values
        lo, hi = np.searchsorted(self.ts, a["ts"].to_numpy(np.int64), side="right"), np.searchsorted(self.ts, a["end_block"].to_numpy(np.int64), side="right")
        p0, w = a["mid"].to_numpy(float), a["width_bps"].to_numpy(float)
        # extremes side by side: the first hit in either row is a hit of the block, for returns grow with the mid
        hit = first_hits(np.stack([low, high], axis=1).ravel(), 2 * lo, 2 * hi, p0, w) // 2
        target = np.where(hit >= 0, hit, np.where((hi > lo) & (self.ts[np.minimum(hi, len(self.ts)) - 1] == a["end_block"]), hi - 1, -1)) if len(self.ts) else np.full(len(a), -1)
        until = np.where(target >= 0, target, hi)
        before = a["seen"].to_numpy(float).copy()
        some = np.flatnonzero(until > lo)
        before[some] = last[until[some] - 1]
        out = a[["t_event", "horizon", "horizon_ns", "width_bps"]].copy()
        out["p0"], out["seen"], out["target"] = p0, before, np.where(target >= 0, self.ts[np.maximum(target, 0)] if len(self.ts) else 0, _NOWHERE)
        return out


class _TargetBlock(_PathThenAnchors):
    """The block that the index names, up to the horizon."""

    def answer(self, a):
        t = a["t_event"].to_numpy(np.int64)
        a = a.assign(ts=t)
        hi = np.searchsorted(self.ts, t + a["horizon_ns"].to_numpy(np.int64), side="right")
        return _labelled(a, self.ts, self.values[0], np.zeros(len(a), np.int64), hi, a["seen"].to_numpy(float))[0]


#: Points of a path that one task keeps, and the block number that stands for none.
BLOCK_POINTS, _NOWHERE = 1_000_000, -(2**63)
#: Blocks whose extremes one task keeps.
BLOCKS_AT_ONCE = 100_000


def triple_barrier(path: DataFrame, anchors: DataFrame, keys: Sequence[str], width: int | None = None, longest: int | None = None) -> DataFrame:
    """First path point in ``(t_event, t_event + horizon]`` at or beyond ±width, else the as-of return.

    ``path``: keys, ts, mid. ``anchors``: keys, t_event, p0, width_bps, horizon, horizon_ns. ``width`` is the block of time that a task keeps
    (unset: the widest with at most ``BLOCK_POINTS`` points), ``longest`` the longest horizon (unset: looked up in the anchors). Where horizons are no longer than it, a point is needed by its own block
    and, near the border, the one before. Longer horizons are searched in the anchor's block, then over the extremes of the later blocks, and
    only the one block where the first crossing must be is read: blocks without are skipped, and memory does not grow with the horizon.
    """
    keys = list(keys)
    width = width or balanced_bucket_width(path, keys, "ts", BLOCK_POINTS)
    longest = longest or anchors.agg(F.max("horizon_ns")).first()[0] or 0
    ddl = "".join(f"{k} {t}, " for k, t in anchors.select(*keys).dtypes)
    result = "t_event bigint, horizon string, y_fwd_bps double, label bigint, t_barrier bigint, p0 double, width_bps double"
    zero = {"horizon_ns": F.lit(0).cast("bigint"), "kind": F.lit(0)}
    at, own = [*keys, BUCKET], bucket_of("ts", width)
    a = anchors.select(*keys, F.col("t_event").alias("ts"), F.col("p0").alias("mid"), "width_bps", "horizon", "horizon_ns", F.lit(1).alias("kind")).withColumn(BUCKET, own)
    points = path.select(*keys, "ts", "mid").withColumns(zero)
    if longest <= width:
        near = F.when(F.col("ts") - own * width <= longest, F.array(own, own - 1)).otherwise(F.array(own))
        p = points.withColumn(BUCKET, F.explode(near)).join(a.select(*at).distinct(), at, "left_semi")
        return ordered_fold(p.unionByName(a, allowMissingColumns=True), at, ["kind", "ts"], lambda key: _BarrierScan(), f"{ddl}{BUCKET} bigint, {result}").drop(BUCKET)

    p = points.withColumn(BUCKET, own)
    stream = p.join(a.select(*at).distinct(), at, "left_semi").unionByName(a, allowMissingColumns=True)
    first = materialize(ordered_fold(stream, at, ["kind", "ts"], lambda key: _OwnBlock(width), f"{ddl}{BUCKET} bigint, {result}, open boolean, seen double, horizon_ns bigint"))
    # the index: one row per block, with one horizon of look-ahead for every stretch of blocks
    blocks = p.groupBy(*at).agg(F.min("mid").alias("low"), F.max("mid").alias("high"), F.max_by("mid", "ts").alias("last"))
    stretch = max(BLOCKS_AT_ONCE, -(-longest // width) + 1)
    group = F.expr(f"`{BUCKET}` div {stretch}L")
    none = {c: F.lit(0).cast("bigint") for c in ("t_event", "horizon_ns", "end_block")}
    blocks = blocks.withColumn("__g", F.explode(F.array(group, group - 1))).select(*keys, "__g", F.col(BUCKET).alias("ts"), "low", "high", "last", F.lit(0).alias("kind")).withColumns(none)
    pending = first.where("open").select(*keys, group.alias("__g"), F.col(BUCKET).alias("ts"), "t_event", "horizon", "horizon_ns", F.expr(f"(t_event + horizon_ns) div {width}L").alias("end_block"), F.col("p0").alias("mid"), "width_bps", "seen", F.lit(1).alias("kind"))
    found = ordered_fold(blocks.unionByName(pending, allowMissingColumns=True), [*keys, "__g"], ["kind", "ts"], lambda key: _BlockIndex(), f"{ddl}__g bigint, t_event bigint, horizon string, horizon_ns bigint, width_bps double, p0 double, seen double, target bigint")
    found = materialize(found.drop("__g"))
    routed = found.where(f"target <> {_NOWHERE}L").select(*keys, F.col("target").alias(BUCKET), "t_event", "horizon", "horizon_ns", "width_bps", F.col("p0").alias("mid"), "seen", F.col("t_event").alias("ts"), F.lit(1).alias("kind"))
    stream = p.join(routed.select(*at).distinct(), at, "left_semi").withColumn("t_event", F.lit(0).cast("bigint")).unionByName(routed, allowMissingColumns=True)
    last = ordered_fold(stream, at, ["kind", "ts"], lambda key: _TargetBlock(), f"{ddl}{BUCKET} bigint, {result}")
    names = [*keys, *[c.split()[0] for c in result.split(", ")]]
    empty = found.where(f"target = {_NOWHERE}L").withColumns({"y_fwd_bps": F.coalesce((F.nanvl("seen", F.lit(None).cast("double")) - F.col("p0")) / F.col("p0") * 1e4, F.lit(0.0)), "label": F.lit(0).cast("bigint"), "t_barrier": F.col("t_event") + F.col("horizon_ns")})
    return first.where("not open").select(*names).unionByName(last.select(*names)).unionByName(empty.select(*names))


def uniqueness(rows: DataFrame, keys: Sequence[str], width: int = DAY_NS) -> DataFrame:
    """``uniqueness`` = 1 / spans ``[t_event, t_barrier)`` of the same keys covering ``t_event``."""
    starts = rows.select(*rows.columns, F.col("t_event").alias("__t"), F.lit(1).alias("__k"), F.lit(1).cast("bigint").alias("__d"))
    ends = rows.select(*keys, F.col("t_barrier").alias("__t"), F.lit(0).alias("__k"), F.lit(-1).cast("bigint").alias("__d"))
    both = starts.unionByName(ends, allowMissingColumns=True)
    out = running(both, keys, ["__t", "__k"], {"__c": ("sum", F.col("__d"))}, width=width)
    return out.filter("__k = 1").withColumn("uniqueness", F.lit(1.0) / F.greatest("__c", F.lit(1))).drop("__t", "__k", "__d", "__c")
