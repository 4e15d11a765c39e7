"""Seeded replay: folds that start from a validated snapshot and reseed after a sustained cross.

The reseed trigger depends on folded state. A key (symbol-day, or symbol-day-arm) whose events fit into one task is
folded in one go. Larger ones are cut into time buckets that fold at the same time, each from an assumed state: which
snapshot the book was last reset to, and since when it is crossed. The book under such a snapshot needs no fold of the
earlier buckets, for it is the snapshot's levels and the last later size of each level. Buckets report the last reset and
cross of their own; a prefix scan over them gives the states that should have been assumed, and only buckets
that were started from another state are folded again, until none is. After n rounds the first n buckets are right, and a day
without reseeds takes one.

A task streams Arrow batches and keeps one book. Inside a batch best prices of all events come from one vectorised pass, and
only snapshots are visited one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lobspark.operators import kernels as K
from lobspark.operators.book import MAX_BUCKET_EVENTS, PRICE_SCALE, touch_metrics
from lobspark.operators.folds import ordered_fold
from lobspark.operators.ordered import BUCKET, balanced_bucket_width, bucket_of
from lobspark.operators.quality import classify_snapshot
from lobspark.session import DAY_NS, NS_PER_S, materialize

#: Stands for "no snapshot yet" and "not crossed" where a bucket's state is handed on.
COLD = -(2**63)


@dataclass(frozen=True)
class ReseedPolicy:
    enabled: bool = True  # intraday reseed; the first seed is always taken
    min_levels: int = 1
    reseed_after_ns: int = 2 * NS_PER_S
    max_spread_frac: float | None = None


class _Replay:
    def __init__(self, k: int, scale: float, policy: ReseedPolicy, names: Sequence[str]):
        self.k, self.scale, self.policy, self.names = k, scale, policy, list(names)
        self.bid, self.ask = K.Side(1), K.Side(-1)
        self.seeded, self.seed_ts, self.reason = False, None, "no_snapshots"
        self.since, self.duration, self.reseeds, self.blocked = None, 0, 0, 0
        self.last, self.reset_at, self.flipped = None, None, False

    def push(self, pdf: pd.DataFrame) -> pd.DataFrame | None:
        kind, ts = pdf["kind"].to_numpy(), pdf["ts"].to_numpy(np.int64)
        self.last = int(ts[-1])
        cols = {c: pdf[c].to_numpy() for c in ("side", "tick", "size", "reason", "bid_t", "bid_s", "ask_t", "ask_s")}
        out, lo = [], 0
        while lo < len(kind):
            lo = self._segment(kind, ts, cols, lo, out)
        return pd.concat(out, ignore_index=True) if out else None

    def _segment(self, kind, ts, cols, lo: int, out: list) -> int:
        """Run from row ``lo`` to the batch end, or up to the snapshot that replaces the book."""
        k, t = kind[lo:], ts[lo:]
        is_d = k == 1
        n = int(is_d.sum())
        pos = np.cumsum(is_d) - is_d
        rows = np.flatnonzero(is_d) + lo
        bid = cols["side"][rows] == "bid"
        ep, tick, size = np.arange(n), cols["tick"][rows].astype(np.int64), cols["size"][rows].astype(float)
        b, a = self.bid.prepare(ep[bid], tick[bid], size[bid]), self.ask.prepare(ep[~bid], tick[~bid], size[~bid])
        bb, ba = b.best_path(n), a.best_path(n)
        cr = (bb != K.NONE) & (ba != K.NONE) & (bb >= ba)
        dts = t[is_d]
        stop, replace = len(k), None
        for s in np.flatnonzero(k == 2):
            i = lo + s
            why, p = cols["reason"][i], pos[s]
            if not self.seeded:
                if why == "ok":
                    stop, replace = s, i
                    break
                if self.reason == "no_snapshots":
                    self.reason = why
            elif self.policy.enabled and cr[p]:
                off = np.flatnonzero(~cr[:p])
                start = int(dts[off[-1]]) if len(off) else self.since
                if start is not None and t[s] - start >= self.policy.reseed_after_ns:
                    if why == "ok":
                        stop, replace = s, i
                        break
                    self.blocked += 1
        n_used = n if replace is None else int(pos[stop])
        smp = np.flatnonzero(k[:stop] == 3)
        if len(smp):
            out.append(self._samples(t[smp], pos[smp], b, a))
        if self.seeded:
            flips = np.flatnonzero(cr[1 : n_used + 1] != cr[:n_used])
            self.flipped |= len(flips) > 0
            for j in flips:
                if cr[j + 1]:
                    self.since = int(dts[j])
                elif self.since is not None:
                    self.duration += int(dts[j]) - self.since
                    self.since = None
        b.apply_until(n_used)
        a.apply_until(n_used)
        if replace is None:
            return lo + len(k)
        now = int(t[stop])
        for side, name in ((self.bid, "bid"), (self.ask, "ask")):
            side.reset(cols[f"{name}_t"][replace], cols[f"{name}_s"][replace])
        if self.seeded:
            self.reseeds += 1
            if self.since is not None:
                self.duration += now - self.since
            out.append(pd.DataFrame({"row_type": ["reseed"], "ts": [now]}))
        else:
            self.seeded, self.seed_ts, self.reason = True, now, "ok"
        self.since = None
        self.reset_at = now
        return lo + stop + 1

    def _samples(self, t, pp, b, a) -> pd.DataFrame:
        f = {"row_type": ["sample"] * len(t), "ts": t}
        for name, blk in (("bid", b), ("ask", a)):
            tk, sz, depth = blk.top(pp, self.k)
            f[f"{name}_depth"] = depth
            for i in range(self.k):
                f[f"{name}_{i}_price"] = np.where(tk[:, i] == K.NONE, np.nan, tk[:, i] / self.scale)
                f[f"{name}_{i}_size"] = sz[:, i]
        return pd.DataFrame(f)

    def finish(self) -> pd.DataFrame:
        if self.since is not None and self.last > self.since:
            self.duration += self.last - self.since
        return pd.DataFrame(
            {
                "row_type": ["metrics"], "ts": [self.last], "seed_accepted": [self.seeded],
                "seed_ts": pd.array([self.seed_ts if self.seed_ts is not None else pd.NA], dtype="Int64"), "seed_reason": [self.reason],
                "reseed_count": pd.array([self.reseeds], dtype="Int64"), "reseed_blocked": pd.array([self.blocked], dtype="Int64"),
                "crossed_duration_ns": pd.array([self.duration], dtype="Int64"),
            }
        )


_BIGINTS = ("bid_depth", "ask_depth", "seed_ts", "reseed_count", "reseed_blocked", "crossed_duration_ns")


class _Shaped(_Replay):
    """Outputs every declared column, integers as nullable integers."""

    def _shape(self, out: pd.DataFrame | None) -> pd.DataFrame | None:
        if out is None:
            return None
        out = out.reindex(columns=self.names)
        cols = {}
        for c in self.names:
            v = out[c]
            if c in _BIGINTS or c == "ts":
                cols[c] = v.astype("Int64").reset_index(drop=True)
            elif c in ("row_type", "seed_reason"):
                cols[c] = pd.Series([None if x is None or x != x else str(x) for x in v], dtype=object)
            elif c == "seed_accepted":
                cols[c] = pd.Series([None if x is None or x != x else bool(x) for x in v], dtype=object)
            else:
                cols[c] = v.astype(float).reset_index(drop=True)
        return pd.DataFrame(cols)

    def push(self, pdf):
        return self._shape(super().push(pdf))

    def finish(self):
        return self._shape(super().finish())


_EXIT = "reset_at bigint, crossed_since bigint"


class _BucketReplay(_Shaped):
    """A replay of one bucket, from the state and the levels that head it."""

    def push(self, pdf):
        kind = pdf["kind"].to_numpy()
        if self.last is None:
            if kind[0] == -1:
                self.last = int(pdf["ts"].iloc[0])
                epoch, since = int(pdf["epoch"].iloc[0]), int(pdf["since"].iloc[0])
                self.seeded, self.reason = epoch != COLD, "no_snapshots" if epoch == COLD else "ok"
                self.since = None if since == COLD else since
        levels = pdf[kind == 0]
        if len(levels):
            bid, tick, size = (levels["side"] == "bid").to_numpy(), levels["tick"].to_numpy(np.int64), levels["size"].to_numpy(float)
            for side, own in ((self.bid, bid), (self.ask, ~bid)):
                side.reset(np.append(side.tick, tick[own]), np.append(side.size, size[own]))
        rest = pdf[kind > 0]
        out = super().push(rest) if len(rest) else None
        if out is not None:
            for c in ("reset_at", "crossed_since"):
                out[c] = pd.array([pd.NA] * len(out), dtype="Int64")
        return out

    def finish(self):
        end = self.last
        self.last = None  # the run that is still open is closed where the key ends, not the bucket
        since, self.since = self.since, None
        out = super().finish()
        bid, ask = self.bid.best(), self.ask.best()
        # a bucket that was crossed all along hands on what it was given
        through = self.seeded and self.reset_at is None and not self.flipped and K.NONE not in (bid, ask) and bid >= ask
        out["crossed_since"] = pd.array([pd.NA if through else COLD if since is None else since], dtype="Int64")
        out["reset_at"] = pd.array([pd.NA if self.reset_at is None else self.reset_at], dtype="Int64")
        out["ts"] = pd.array([end], dtype="Int64")
        return out


def _levels_at(events: DataFrame, entries: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Live levels at the opening of each entry's bucket: those of its snapshot, and the last size of each since then."""
    level = [*keys, "side", "tick"]
    deltas = events.where("kind = 1").select(*level, "ts", "seq", "size", BUCKET)
    spans = entries.groupBy(*keys, "epoch").agg(F.min(BUCKET).alias("__begin"), F.max(BUCKET).alias("__end"))
    span = ["epoch", "__begin", "__end"]
    seeded = spans.where(F.col("epoch") != COLD).withColumn("__at", bucket_of("epoch", width))
    # the bucket of the snapshot itself: its ladder, overlaid by what came after it
    ladder = events.where("kind = 2 and reason = 'ok'").drop(BUCKET, "epoch").join(seeded.withColumn("ts", F.col("epoch")), [*keys, "ts"])
    pieces = [F.expr(f"zip_with({n}_t, {n}_s, (t, z) -> struct('{n}' as side, t as tick, z as size))") for n in ("bid", "ask")]
    ladder = ladder.select(*keys, *span, F.col("__at").alias(BUCKET), "ts", F.lit(COLD).alias("seq"), F.inline(F.concat(*pieces)))
    after = deltas.join(seeded.withColumnRenamed("__at", BUCKET), [*keys, BUCKET]).where("ts > epoch")
    first = ladder.unionByName(after.select(*ladder.columns)).groupBy(*level, *span, BUCKET).agg(F.max_by("size", F.struct("ts", "seq")).alias("size"))
    # whole buckets after it, by an equality on the bucket, so that no task gets a key
    whole = deltas.groupBy(*level, BUCKET).agg(F.max_by("size", F.struct("ts", "seq")).alias("size"))
    cold = spans.where(F.col("epoch") == COLD).join(events.groupBy(*keys).agg((F.min(BUCKET) - 1).alias("__at")), keys)
    used = seeded.unionByName(cold.select(*seeded.columns)).where("__end > __at + 1")
    used = used.select(*keys, *span, F.explode(F.sequence(F.col("__at") + 1, F.col("__end") - 1)).alias(BUCKET))
    changes = first.unionByName(whole.join(used, [*keys, BUCKET]).select(*first.columns))
    w = W.partitionBy(*level, "epoch").orderBy(BUCKET)
    live = changes.withColumn("__next", F.lead(BUCKET).over(w)).where("size > 0")
    live = live.withColumn("__stop", F.least(F.coalesce("__next", "__end"), F.col("__end"))).withColumn("__from", F.greatest(F.col(BUCKET) + 1, F.col("__begin"))).where("__stop >= __from")
    live = live.withColumn(BUCKET, F.explode(F.sequence("__from", "__stop"))).join(entries.select(*keys, BUCKET, "epoch"), [*keys, BUCKET, "epoch"], "left_semi")
    return live.select(*level, BUCKET, "size")


def _in_buckets(stream: DataFrame, keys: list[str], width: int, fold, ddl: str) -> DataFrame:
    """The replay of every key in buckets that fold at the same time; see the module's text."""
    at = [*keys, BUCKET]
    events = materialize(stream.withColumn(BUCKET, bucket_of("ts", width)))
    before = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)

    def wanted(own: DataFrame) -> DataFrame:
        """What each bucket has to start from, given the last reset and cross of those before it."""
        return own.withColumns({f"want_{n}": F.coalesce(F.last(c, ignorenulls=True).over(before), F.lit(COLD)) for n, c in (("epoch", "reset_at"), ("since", "crossed_since"))})

    first = events.where("kind = 2 and reason = 'ok'").groupBy(*keys).agg(F.min("ts").alias("seed"))
    guess = events.select(*at).distinct().join(first, keys, "left")
    guess = guess.withColumn("reset_at", F.when(bucket_of("seed", width) == F.col(BUCKET), F.col("seed"))).withColumn("crossed_since", F.lit(COLD))
    entries = materialize(wanted(guess).select(*at, F.col("want_epoch").alias("epoch"), F.col("want_since").alias("since")))
    rounds, state = [], None
    while True:
        inside = events if state is None else events.join(entries, at, "left_semi")
        heads = entries.select(*at, "epoch", "since", F.lit(-1).alias("kind"))
        seeds = _levels_at(events, entries, keys, width).withColumn("kind", F.lit(0))
        opened = heads.unionByName(seeds, allowMissingColumns=True).withColumns({"ts": F.expr(f"`{BUCKET}` * {width}L"), "seq": F.lit(0).cast("bigint"), "tick": F.coalesce("tick", F.lit(0).cast("bigint"))})
        zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("epoch", "since")}
        found = materialize(ordered_fold(opened.unionByName(inside, allowMissingColumns=True).withColumns(zero), at, ["ts", "kind", "seq"], fold, f"{ddl}, {_EXIT}"))
        rounds.append((found, entries))
        new = entries.join(found.where("row_type = 'metrics'").select(*at, "reset_at", "crossed_since"), at)
        state = materialize(new if state is None else state.join(entries, at, "left_anti").unionByName(new.select(*state.columns)))
        wrong = wanted(state).where("want_epoch <> epoch or want_since <> since")
        entries = materialize(wrong.select(*at, F.col("want_epoch").alias("epoch"), F.col("want_since").alias("since")))
        if entries.isEmpty():
            break
    final = None
    for found, used in reversed(rounds):
        if final is None:
            final, later = found, used.select(*at)
        else:
            final, later = final.unionByName(found.join(later, at, "left_anti")), later.unionByName(used.select(*at)).distinct()
    return final


def book_replay_seeded(
    deltas: DataFrame, snapshots: DataFrame, samples: DataFrame, *, k: int, policy: ReseedPolicy = ReseedPolicy(),
    keys: Sequence[str] = ("symbol", "dt"), scale: float = PRICE_SCALE, width: int | None = None,
) -> DataFrame:
    """Tagged rows: ``sample`` (top-K as of the sample), ``reseed`` (times) and one ``metrics`` row per key.

    ``snapshots``: keys, sample_ts, bids, asks, one per key and time; a snapshot at a delta's own time comes after it. ``width`` is the time
    bucket that one task folds; unset, deltas are counted once and keys are cut only where a day has more than ``MAX_BUCKET_EVENTS``.
    Rows do not depend on it.
    """
    keys = list(keys)
    width = width or balanced_bucket_width(deltas, keys, "origin_ns", MAX_BUCKET_EVENTS)
    zero = F.lit(0).cast("bigint")
    d = deltas.select(*keys, F.col("origin_ns").alias("ts"), F.lit(1).alias("kind"), F.col("seq").cast("bigint").alias("seq"), "side", F.col("tick").cast("bigint").alias("tick"), F.col("size").cast("double").alias("size"))
    ladder = []
    for name in ("bid", "ask"):
        ladder.append(F.transform(f"{name}s", lambda x: F.round(x["px"] * scale).cast("bigint")).alias(f"{name}_t"))
        ladder.append(F.transform(f"{name}s", lambda x: x["sz"].cast("double")).alias(f"{name}_s"))
    reason = classify_snapshot(policy.min_levels, policy.max_spread_frac)
    s = snapshots.select(*keys, F.col("sample_ts").alias("ts"), F.lit(2).alias("kind"), zero.alias("seq"), zero.alias("tick"), reason.alias("reason"), *ladder)
    g = samples.select(*keys, F.col("sample_ts").alias("ts"), F.lit(3).alias("kind"), zero.alias("seq"), zero.alias("tick"))
    stream = s.unionByName(d, allowMissingColumns=True).unionByName(g, allowMissingColumns=True)
    lv = []
    for side in ("bid", "ask"):
        lv.append(f"{side}_depth bigint")
        for i in range(k):
            lv += [f"{side}_{i}_price double", f"{side}_{i}_size double"]
    body = ["row_type string", "ts bigint", *lv, "seed_accepted boolean", "seed_ts bigint", "seed_reason string", "reseed_count bigint", "reseed_blocked bigint", "crossed_duration_ns bigint"]
    names = [c.split()[0] for c in body]
    types = dict(deltas.dtypes)
    ddl = "".join(f"{c} {types[c]}, " for c in keys)
    if width >= DAY_NS:
        return ordered_fold(stream, keys, ["ts", "kind", "seq"], lambda key: _Shaped(k, scale, policy, names), ddl + ", ".join(body))
    found = materialize(_in_buckets(stream, keys, width, lambda key: _BucketReplay(k, scale, policy, names), f"{ddl}{BUCKET} bigint, {', '.join(body)}"))
    return found.where("row_type <> 'metrics'").select(*keys, *names).unionByName(_key_metrics(found.where("row_type = 'metrics'"), keys).select(*keys, *names))


def _key_metrics(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """One metrics row per key from those of its buckets; a run that is still crossed at the last event ends there."""
    other = [c for c in buckets.columns if c not in (*keys, BUCKET, "row_type", "ts", "seed_accepted", "seed_ts", "seed_reason", "reseed_count", "reseed_blocked", "crossed_duration_ns", "reset_at", "crossed_since")]
    since = F.max_by(F.col("crossed_since"), F.when(F.col("crossed_since").isNotNull(), F.col(BUCKET)))
    cause = F.min_by(F.when(F.col("seed_reason") != "no_snapshots", F.col("seed_reason")), F.when(F.col("seed_reason") != "no_snapshots", F.col(BUCKET)))
    m = buckets.groupBy(*keys).agg(
        F.max("ts").alias("ts"), F.min("seed_ts").alias("seed_ts"), F.coalesce(cause, F.lit("no_snapshots")).alias("cause"),
        F.sum("reseed_count").alias("reseed_count"), F.sum("reseed_blocked").alias("reseed_blocked"), F.sum("crossed_duration_ns").alias("__closed"), since.alias("__since"),
    )
    m = m.withColumns({"row_type": F.lit("metrics"), "seed_accepted": F.col("seed_ts").isNotNull(), "seed_reason": F.when(F.col("seed_ts").isNotNull(), "ok").otherwise(F.col("cause"))})
    m = m.withColumn("crossed_duration_ns", F.col("__closed") + F.when(F.col("__since") > COLD, F.greatest(F.col("ts") - F.col("__since"), F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint")))
    types = dict(buckets.dtypes)
    return m.withColumns({c: F.lit(None).cast(types[c]) for c in other})


def replay_frame(tagged: DataFrame) -> DataFrame:
    drop = ["row_type", "seed_accepted", "seed_ts", "seed_reason", "reseed_count", "reseed_blocked", "crossed_duration_ns"]
    return tagged.filter("row_type = 'sample'").withColumns(touch_metrics()).withColumnRenamed("ts", "sample_ts").drop(*drop)


def replay_metrics(tagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return tagged.filter("row_type = 'metrics'").select(*keys, "seed_accepted", "seed_ts", "seed_reason", "reseed_count", "reseed_blocked", "crossed_duration_ns")
