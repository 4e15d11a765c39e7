"""Level-2 book state as DataFrames: validity intervals, top-K reads, best-quote paths.

The state at a cut is the last size per (side, tick), which is associative. Work is therefore split
into ``(keys, time bucket)``: seed rows carry each live level into a bucket, and every bucket folds
on its own, however hot one symbol is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lobspark.operators import kernels as K
from lobspark.operators.folds import ordered_fold
from lobspark.operators.ordered import BUCKET, balanced_bucket_width, bucket_of, shift
from lobspark.session import DAY_NS, HOUR_NS

PRICE_SCALE = 100

#: Events of one key that a task folds, where the caller names no bucket width.
MAX_BUCKET_EVENTS = 4_000_000


# ------------------------------------------------------------------ relational forms
def merge_events(deltas: DataFrame, trades: DataFrame) -> DataFrame:
    """Deltas and trades in one stream; total order is ``(ts, kind, seq)``, deltas (0) first."""
    cols = ["symbol", "dt", "origin_ns", "received_ns", "seq", "side", "tick"]
    d = deltas.select(*cols, F.col("size").alias("amount"), F.lit(0).cast("bigint").alias("kind"))
    t = trades.select(*cols, F.col("quantity").alias("amount"), F.lit(1).cast("bigint").alias("kind"))
    return d.unionByName(t)


def level_intervals(
    deltas: DataFrame, keys: Sequence[str] = ("symbol",), *, ts: str = "origin_ns", width: int = HOUR_NS
) -> DataFrame:
    """Rows ``[valid_from, valid_to)`` with the size of a level; ``valid_to`` null = still live."""
    lv = shift(
        deltas, [*keys, "side", "tick"], [ts, "seq"], {"valid_to": F.col(ts)}, width=width, lead=True
    )
    return (
        lv.filter(F.col("size") > 0)
        .filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col(ts)))
        .select(*keys, "side", "tick", "size", F.col(ts).alias("valid_from"), "valid_to")
    )


def book_at_instant(
    deltas: DataFrame, at: Column, keys: Sequence[str] = ("symbol",), *, ts: str = "origin_ns"
) -> DataFrame:
    """Full-depth book at one instant: last size per level among events with ``ts <= at``."""
    return (
        deltas.filter(F.col(ts) <= at)
        .groupBy(*keys, "side", "tick")
        .agg(F.max_by("size", F.struct(ts, "seq")).alias("size"))
        .filter(F.col("size") > 0)
    )


def seq_anomalies(
    deltas: DataFrame, keys: Sequence[str] = ("symbol",), *, ts: str = "origin_ns", width: int = HOUR_NS
) -> DataFrame:
    """Rows whose sequence number does not increase past the previously applied delta."""
    out = shift(deltas, keys, [ts, "pos"], {"prev_seq": F.col("seq")}, width=width)
    return out.groupBy(*keys).agg(
        F.count("*").alias("n_deltas"),
        F.count_if(F.col("seq") <= F.col("prev_seq")).alias("n_anomalies"),
    )


# ------------------------------------------------------------------ chunk-parallel fold
def bucket_seeds(
    deltas: DataFrame, keys: Sequence[str], active: DataFrame, *, ts: str, width: int
) -> DataFrame:
    """Live levels at the opening of every active bucket: ``keys, bucket, side, tick, size``."""
    lvl = [*keys, "side", "tick"]
    last = deltas.groupBy(*lvl, bucket_of(ts, width).alias(BUCKET)).agg(
        F.max_by("size", F.struct(ts, "seq")).alias("size")
    )
    horizon = active.groupBy(*keys).agg(F.max(BUCKET).alias("__end"))
    w = W.partitionBy(*lvl).orderBy(BUCKET)
    return (
        last.withColumn("__next", F.lead(BUCKET).over(w))
        .filter(F.col("size") > 0)
        .join(horizon, list(keys))
        .withColumn("__stop", F.least(F.coalesce("__next", "__end"), F.col("__end")))
        .filter(F.col("__stop") > F.col(BUCKET))
        .withColumn(BUCKET, F.explode(F.sequence(F.col(BUCKET) + 1, F.col("__stop"))))
        .select(*lvl, BUCKET, "size")
        .join(active, [*keys, BUCKET], "left_semi")
    )


class _BookFold:
    """Streams seeds, deltas and probes of one bucket; answers probes or every event."""

    def __init__(self, k: int, scale: float, carry: Sequence[str], path: bool):
        self.k, self.scale, self.carry, self.path = k, scale, list(carry), path
        self.bid, self.ask = K.Side(1), K.Side(-1)

    def push(self, pdf: pd.DataFrame) -> pd.DataFrame | None:
        kind = pdf["kind"].to_numpy()
        is_event = kind < 2
        n = int(is_event.sum())
        pos = np.cumsum(is_event) - is_event
        ev = pdf[is_event]
        bid = (ev["side"] == "bid").to_numpy()
        ep = np.arange(n)
        tick = ev["tick"].to_numpy(np.int64)
        size = ev["size"].to_numpy(np.float64)
        b = self.bid.prepare(ep[bid], tick[bid], size[bid])
        a = self.ask.prepare(ep[~bid], tick[~bid], size[~bid])
        out = self._path(pdf, kind, is_event, a, b, n) if self.path else self._probe(pdf, kind, pos, a, b)
        b.apply_until(n)
        a.apply_until(n)
        return out

    def _path(self, pdf, kind, is_event, a, b, n):
        sel = kind[is_event] == 1
        if not sel.any():
            return None
        bb, ba = b.best_path(n)[1:][sel], a.best_path(n)[1:][sel]
        rows = pdf[kind == 1]
        return pd.DataFrame(
            {
                "ts": rows["ts"].to_numpy(),
                "seq": rows["seq"].to_numpy(),
                "best_bid": np.where(bb == K.NONE, np.nan, bb / self.scale),
                "best_ask": np.where(ba == K.NONE, np.nan, ba / self.scale),
            }
        )

    def _probe(self, pdf, kind, pos, a, b):
        probe = kind == 2
        if not probe.any():
            return None
        rows, pp = pdf[probe], pos[probe]
        out = {"ts": rows["ts"].to_numpy(), "seq": rows["seq"].to_numpy()}
        for c in self.carry:
            out[c] = rows[c].to_numpy()
        for name, blk in (("bid", b), ("ask", a)):
            t, s, depth = blk.top(pp, self.k)
            out[f"{name}_depth"] = depth
            for i in range(self.k):
                out[f"{name}_{i}_price"] = np.where(t[:, i] == K.NONE, np.nan, t[:, i] / self.scale)
                out[f"{name}_{i}_size"] = s[:, i]
        return pd.DataFrame(out)

    def finish(self):
        return None


def _key_ddl(df: DataFrame, keys: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"{k} {types[k]}, " for k in keys)


def _stream(deltas, probes, keys, ts, width, carry):
    """Seeds, deltas and probes as one frame with ``kind, ts, seq, side, tick, size`` columns."""
    d = deltas.select(
        *keys,
        F.col(ts).alias("ts"),
        F.col("seq").cast("bigint").alias("seq"),
        "side",
        F.col("tick").cast("bigint").alias("tick"),
        F.col("size").cast("double").alias("size"),
    ).withColumn(BUCKET, bucket_of("ts", width))
    base = probes if probes is not None else d
    active = base.select(*keys, BUCKET).distinct()
    seeds = bucket_seeds(d, keys, active, ts="ts", width=width)
    inside = d.join(active, [*keys, BUCKET], "left_semi") if probes is not None else d
    s = seeds.select(
        *keys,
        BUCKET,
        F.expr(f"`{BUCKET}` * {width}L").alias("ts"),
        F.lit(-1).cast("bigint").alias("seq"),
        "side",
        "tick",
        "size",
        F.lit(0).alias("kind"),
    )
    out = s.unionByName(inside.withColumn("kind", F.lit(1)))
    if probes is not None:
        # BIGINT columns must not carry nulls into pandas, or nanoseconds would become floats
        for c, t in carry.items():
            out = out.withColumn(c, F.lit(0 if t == "bigint" else None).cast(t))
        out = out.unionByName(probes.withColumns({"kind": F.lit(2), "tick": F.lit(0).cast("bigint")}), allowMissingColumns=True)
    return out


def book_asof(
    deltas: DataFrame,
    probes: DataFrame,
    *,
    k: int,
    keys: Sequence[str] = ("symbol",),
    ts: str = "origin_ns",
    probe_ts: str = "sample_ts",
    probe_seq: str | None = None,
    carry: Mapping[str, str] | None = None,
    width: int | None = None,
    scale: float = PRICE_SCALE,
) -> DataFrame:
    """Top-``k`` book each probe sees (events with ``ts <= probe_ts`` applied, ties included).

    Returns ``keys, probe_ts, [probe_seq], carry…, mid, microprice, {bid,ask}_depth`` and the wide
    level columns; a missing level is null. ``carry`` maps extra probe columns to their types. ``width`` is the time
    bucket one task folds; unset, the widest that keeps a key's bucket within ``MAX_BUCKET_EVENTS``.
    """
    # carried columns get a name of their own inside the fold, so that a probe's side is not taken for the book's
    width = width or balanced_bucket_width(deltas, list(keys), ts, MAX_BUCKET_EVENTS)
    carried = {c: f"__c_{c}" for c in carry or {}}
    carry = {carried[c]: t for c, t in (carry or {}).items()}
    p = probes.select(
        *keys,
        F.col(probe_ts).alias("ts"),
        (F.col(probe_seq) if probe_seq else F.lit(0)).cast("bigint").alias("seq"),
        *[F.col(c).alias(inner) for c, inner in carried.items()],
    ).withColumn(BUCKET, bucket_of("ts", width))
    stream = _stream(deltas, p, list(keys), ts, width, carry)
    level_cols = []
    for side in ("bid", "ask"):
        level_cols.append(f"{side}_depth bigint")
        for i in range(k):
            level_cols += [f"{side}_{i}_price double", f"{side}_{i}_size double"]
    extra = "".join(f"{c} {t}, " for c, t in carry.items())
    schema = f"{_key_ddl(deltas, keys)}{BUCKET} bigint, ts bigint, seq bigint, {extra}{', '.join(level_cols)}"
    names = list(carry)
    out = ordered_fold(
        stream,
        [*keys, BUCKET],
        ["ts", "kind", "seq"],
        lambda key: _BookFold(k, scale, names, path=False),
        schema,
    )
    out = out.drop(BUCKET).withColumnRenamed("ts", probe_ts)
    out = out.withColumnRenamed("seq", probe_seq) if probe_seq else out.drop("seq")
    out = out.withColumnsRenamed({inner: c for c, inner in carried.items()})
    lead = [*keys, probe_ts, *([probe_seq] if probe_seq else []), *carried]
    wide = [c.split()[0] for c in level_cols]
    return out.withColumns(touch_metrics()).select(*lead, "mid", "microprice", *wide)


def quote_path(
    deltas: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "origin_ns",
    width: int | None = None,
    scale: float = PRICE_SCALE,
) -> DataFrame:
    """Best bid and ask after every delta: ``keys, ts, seq, best_bid, best_ask`` (null = no side)."""
    width = width or balanced_bucket_width(deltas, list(keys), ts, MAX_BUCKET_EVENTS)
    stream = _stream(deltas, None, list(keys), ts, width, {})
    schema = f"{_key_ddl(deltas, keys)}{BUCKET} bigint, ts bigint, seq bigint, best_bid double, best_ask double"
    out = ordered_fold(
        stream, [*keys, BUCKET], ["ts", "kind", "seq"], lambda key: _BookFold(1, scale, (), path=True), schema
    )
    return out.drop(BUCKET)


# ------------------------------------------------------------------ column libraries
def touch_metrics(
    bid: str = "bid_0_price", ask: str = "ask_0_price", bs: str = "bid_0_size", as_: str = "ask_0_size"
) -> dict[str, Column]:
    """``mid`` and size-weighted ``microprice`` of the touch; null unless both sides are present."""
    b, a, bz, az = (F.col(c) for c in (bid, ask, bs, as_))
    return {"mid": (b + a) / 2.0, "microprice": (az * b + bz * a) / (bz + az)}


def top_validity(
    bid: str = "bid_0_price", ask: str = "ask_0_price", bs: str = "bid_0_size", as_: str = "ask_0_size"
) -> Column:
    """First failing check of a book top, or ``ok``; a locked book counts as crossed."""
    b, a, bz, az = (F.col(c) for c in (bid, ask, bs, as_))

    def bad(c: Column) -> Column:
        return c.isNull() | F.isnan(c) | (c <= 0) | (c == float("inf"))

    return (
        F.when(b.isNull() & a.isNull(), "missing_book")
        .when(b.isNull() | a.isNull(), "one_sided_book")
        .when(bad(b) | bad(a) | bad(bz) | bad(az), "invalid_book")
        .when(b >= a, "crossed_book")
        .otherwise("ok")
    )


def grid(days: DataFrame, step_ns: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Regular sample grid over every UTC day present; the step must divide the day."""
    if DAY_NS % step_ns:
        raise ValueError(f"grid step {step_ns} ns does not divide a day")
    open_ns = F.unix_micros(F.col("dt").cast("timestamp")) * 1000
    return (
        days.select(*keys, "dt")
        .distinct()
        .withColumn("sample_ts", F.explode(F.sequence(open_ns, open_ns + DAY_NS - step_ns, F.lit(step_ns))))
    )


# ------------------------------------------------------------------ path operators
def true_mid_path(quotes: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mid after each delta while the book is usable, plus the as-of point at each day open."""
    usable = F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull() & (F.col("best_bid") < F.col("best_ask"))
    return quotes.filter(usable).select(
        *keys, "ts", "seq", ((F.col("best_bid") + F.col("best_ask")) / 2.0).alias("mid")
    )


def coalesce_path(path: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One point per timestamp: the last mid at that instant."""
    return path.groupBy(*keys, "ts").agg(F.max_by("mid", "seq").alias("mid"))


def instant_validity(quotes: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Validity of the book after the last event of each timestamp."""
    last = quotes.groupBy(*keys, "ts").agg(F.max_by(F.struct("best_bid", "best_ask"), "seq").alias("q"))
    b, a = F.col("q.best_bid"), F.col("q.best_ask")
    ok = b.isNotNull() & a.isNotNull() & (b < a)
    return last.select(*keys, "ts", F.coalesce(ok, F.lit(False)).alias("valid"))


def day_open(dt: str = "dt") -> Column:
    """UTC midnight of a DATE column as BIGINT nanoseconds."""
    return F.unix_micros(F.col(dt).cast("timestamp")) * 1000


def day_of(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(F.timestamp_micros(F.floor(c / 1000).cast("bigint")))


def open_points(deltas: DataFrame, days: DataFrame, *, width: int | None = None) -> DataFrame:
    """Touch as of each day open: ``symbol, dt, ts, best_bid, best_ask``."""
    opens = days.select("symbol", "dt", day_open().alias("ts"))
    at = book_asof(deltas, opens, k=1, probe_ts="ts", carry={"dt": "date"}, width=width)
    return at.select(
        "symbol", "dt", "ts", F.col("bid_0_price").alias("best_bid"), F.col("ask_0_price").alias("best_ask")
    )


def mid_path_with_opens(quotes: DataFrame, opens: DataFrame) -> DataFrame:
    """Path points: as-of point at each usable day open, then the mid after every usable delta."""
    o = opens.select("symbol", "ts", F.lit(-1).cast("bigint").alias("seq"), "best_bid", "best_ask")
    return true_mid_path(quotes.select("symbol", "ts", "seq", "best_bid", "best_ask").unionByName(o))


def invalid_intervals(quotes: DataFrame, opens: DataFrame) -> DataFrame:
    """Half-open stretches ``[start_ns, end_ns)`` per day in which the true book is unusable."""
    from lobspark.operators.ordered import islands

    q = quotes.withColumn("dt", day_of("ts")).select("symbol", "dt", "ts", "seq", "best_bid", "best_ask")
    o = opens.select("symbol", "dt", "ts", F.lit(-1).cast("bigint").alias("seq"), "best_bid", "best_ask")
    points = instant_validity(q.unionByName(o), ["symbol", "dt"])
    runs = (
        islands(points, ["symbol", "dt"], ["ts"], [F.col("valid")])
        .groupBy("symbol", "dt", "island")
        .agg(F.min("ts").alias("start_ns"), F.first("valid").alias("valid"))
    )
    nxt = F.lead("start_ns").over(W.partitionBy("symbol", "dt").orderBy("start_ns"))
    return (
        runs.withColumn("end_ns", F.coalesce(nxt, day_open() + DAY_NS))
        .filter(~F.col("valid"))
        .select("symbol", "dt", "start_ns", "end_ns")
    )
