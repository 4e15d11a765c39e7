"""Dollar bars with a time cap, their decision clock, and member-trade features.

Bars reset on every close. A symbol-day is cut into chunks of time: each reduces itself, as a task of its own, to a map
from the state before it to the state after it, a short walk over the maps finds the state before every chunk, and the
chunks then tag their trades in parallel. A task streams Arrow batches and keeps the open bar's totals, or one chunk's
instants and notionals. Chaining across days (the decision watermark) is a running maximum over bars.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lobspark.operators.book import day_open
from lobspark.operators.folds import ordered_fold
from lobspark.operators.ordered import balanced_bucket_width, bucket_of, running
from lobspark.session import DAY_NS, materialize

REASONS = ("threshold", "time_cap", "day_end")

#: Trades of a chunk that one task keeps as two numbers each.
CHUNK_TRADES = 2_000_000


def threshold_schedule(
    days: DataFrame, *, window_days: int, warmup_days: int, target_bars: int, seed_threshold: float, min_coverage: float = 0.0
) -> DataFrame:
    """Per-day threshold from strictly prior days; ``days``: symbol, dt, notional, coverage."""
    if window_days < warmup_days:
        raise ValueError("window_days shorter than warmup_days makes warm-up permanent")
    d = days.withColumn("__day", F.datediff("dt", F.lit("1970-01-01").cast("date")))
    w = W.partitionBy("symbol").orderBy("__day").rangeBetween(-window_days, -1)
    norm = F.when(F.col("coverage") >= min_coverage, F.col("notional") / F.col("coverage"))
    n = F.count(norm).over(w)
    return d.select(
        "symbol",
        "dt",
        F.when(n < warmup_days, F.lit(float(seed_threshold))).otherwise(F.avg(norm).over(w) / target_bars).alias("threshold"),
        (n < warmup_days).alias("is_warmup"),
    )


def day_totals(trades: DataFrame) -> DataFrame:
    return trades.groupBy("symbol", "dt").agg(
        F.sum(F.col("price") * F.col("quantity")).alias("notional"), F.lit(1.0).alias("coverage")
    )


class OpenBar(NamedTuple):
    """What one symbol-day carries from trade to trade: the open bar's number, start, notional and trades."""

    number: int
    since: int
    held: float = 0.0
    trades: int = 0


def _caps(bar: OpenBar, until: int, cap_ns: int) -> tuple[OpenBar, list]:
    """Bars that the cap has closed by ``until``; their count follows from the time passed, only the first holds trades."""
    passed = max(0, (until - bar.since) // cap_ns)
    rows = [(bar.number + q, bar.since + q * cap_ns, "time_cap", bar.since + (q + 1) * cap_ns, bar.held * (q == 0)) for q in range(passed)]
    return (OpenBar(bar.number + passed, bar.since + passed * cap_ns) if passed else bar), rows


def _reach(held: float, notional: np.ndarray, threshold: float) -> tuple[int, float]:
    """Trades taken until the sum reaches the threshold (-1: it does not) and the sum then; looks ahead in doubling steps."""
    done, step = 0, 512
    while done < len(notional):
        sums = np.add.accumulate(np.append(held, notional[done : done + step]))[1:]
        over = sums >= threshold
        if over.any():
            k = int(over.argmax())
            return done + k + 1, float(sums[k])
        held, done, step = float(sums[-1]), done + len(sums), 2 * step
    return -1, held


def assign_bars(bar: OpenBar, ts: np.ndarray, notional: np.ndarray, threshold: float, cap_ns: int) -> tuple[OpenBar, np.ndarray, np.ndarray, list]:
    """The state after some trades in order, each trade's bar number, whether it opens its bar, and the bars closed."""
    numbers, opens, closed, at = np.empty(len(ts), np.int64), np.zeros(len(ts), bool), [], 0
    while at < len(ts):
        bar, capped = _caps(bar, int(ts[at]), cap_ns)
        closed += capped
        stop = int(np.searchsorted(ts, bar.since + cap_ns))
        taken, total = _reach(bar.held, notional[at:stop], threshold)
        end = at + taken if taken > 0 else stop
        numbers[at:end], opens[at] = bar.number, bar.trades == 0
        if taken > 0:
            closed.append((bar.number, bar.since, "threshold", None, total))
            bar = OpenBar(bar.number + 1, int(ts[end - 1]))
        else:
            bar = bar._replace(held=total, trades=bar.trades + end - at)
        at = end
    return bar, numbers, opens, closed


def close_day(bar: OpenBar, day_end: int, cap_ns: int) -> list:
    """The bars left at the end of the day: caps that passed, then a bar that still holds trades."""
    bar, rows = _caps(bar, day_end, cap_ns)
    return [*rows, *([(bar.number, bar.since, "day_end", day_end, bar.held)] if bar.trades else [])]


TAGGED = (
    "bar_idx bigint, origin_ns bigint, received_ns bigint, seq bigint, side string, price double, quantity double, "
    "prev_price double, interval_start bigint, close_reason string, cap_fire bigint, notional double, "
    "threshold double, is_warmup boolean"
)
#: What a fold starts from: the open bar, the price before it, and the day's end if the fold is to close it.
STATE = "number bigint, since bigint, held double, open_trades bigint, last_price double"
_INTS = ("bar_idx", "origin_ns", "received_ns", "seq", "interval_start", "cap_fire", "chunk", "number", "since", "open_trades")


def _names(schema: str) -> list[str]:
    return [c.strip().split()[0] for c in schema.split(",")]


def _typed(cols: dict, n: int, names: list[str] = _names(TAGGED)) -> pd.DataFrame:
    """Frame in schema order; nanosecond columns are nullable integers, never floats."""
    out = {}
    for c in names:
        if c in _INTS:
            out[c] = pd.array(cols[c], dtype="Int64") if c in cols else pd.array([pd.NA] * n, dtype="Int64")
        else:
            out[c] = cols.get(c, [None] * n)
    return pd.DataFrame(out)


def _closed_bars(closed: list, threshold: float, warmup: bool, names: list[str] = _names(TAGGED)) -> pd.DataFrame | None:
    if not closed:
        return None
    idx, start, reason, fire, acc = (list(x) for x in zip(*closed))
    n = len(idx)
    cap_fire = [pd.NA if f is None else f for f in fire]
    return _typed({"bar_idx": idx, "interval_start": start, "close_reason": reason, "cap_fire": cap_fire, "notional": acc, "threshold": [threshold] * n, "is_warmup": [warmup] * n}, n, names)


class _BarFold:
    """Tags trades with their bars from the state that the head row gives."""

    def __init__(self, cap_ns: int):
        self.cap, self.bar = cap_ns, None

    def push(self, pdf: pd.DataFrame) -> list | None:
        if self.bar is None:
            head = pdf.iloc[0]
            if head["kind"] != 0:
                raise ValueError("a symbol-day has trades and no threshold")
            self.threshold, self.warmup, self.last_price = float(head["threshold"]), bool(head["is_warmup"]), float(head["last_price"])
            self.bar = OpenBar(int(pdf["number"].iloc[0]), int(pdf["since"].iloc[0]), float(head["held"]), int(pdf["open_trades"].iloc[0]))
            self.day_end = int(pdf["day_end"].iloc[0])
        t = pdf[pdf["kind"].to_numpy() == 1]
        if not len(t):
            return None
        price = t["price"].to_numpy(float)
        before = self.bar.number
        self.bar, number, opens, closed = assign_bars(self.bar, t["origin_ns"].to_numpy(np.int64), price * t["quantity"].to_numpy(float), self.threshold, self.cap)
        prev = np.concatenate([[self.last_price], price[:-1]])
        prev[opens | np.concatenate([[number[0] != before], number[1:] != number[:-1]])] = np.nan
        self.last_price = price[-1]
        cols = {c: t[c].to_numpy() for c in ("origin_ns", "received_ns", "seq", "side", "price", "quantity")}
        rows = _typed({**cols, "bar_idx": number, "prev_price": prev}, len(t))
        return [rows, _closed_bars(closed, self.threshold, self.warmup)]

    def finish(self) -> pd.DataFrame | None:
        if self.bar is None or not self.day_end:
            return None
        return _closed_bars(close_day(self.bar, self.day_end, self.cap), self.threshold, self.warmup)


# ------------------------------------------------------------------ one symbol-day in several tasks
def _first_close(bar: OpenBar, ts: np.ndarray, notional: np.ndarray, threshold: float, cap_ns: int) -> tuple[int, int]:
    """The first trade that closes a bar by threshold (-1: none) and the number of the bar after it."""
    at = 0
    while at < len(ts):
        bar, _ = _caps(bar, int(ts[at]), cap_ns)
        stop = int(np.searchsorted(ts, bar.since + cap_ns))
        taken, total = _reach(bar.held, notional[at:stop], threshold)
        if taken > 0:
            return at + taken - 1, bar.number + 1
        bar, at = bar._replace(held=total, trades=bar.trades + stop - at), stop
    return -1, bar.number


def next_closes(ts: np.ndarray, notional: np.ndarray, threshold: float, cap_ns: int) -> tuple[np.ndarray, np.ndarray]:
    """For a bar opened by the close at each trade: the next trade that closes by threshold (len: none), and the bars closed until then.

    Sums come from prefix sums; where they are too close to the threshold to tell, the trades are added up one by one, as
    the fold does. Every turn of the loop takes the open bars past one cap.
    """
    n = len(ts)
    sums = np.concatenate([[0], np.cumsum(notional, dtype=np.longdouble)])
    near = threshold * 1e-9 + float(sums[-1]) * 1e-14
    close, count = np.full(n, n), np.zeros(n, dtype=np.int64)
    who, at, since = np.arange(n - 1), np.arange(1, n), ts[:-1].copy()
    while len(who):
        passed = np.maximum(0, (ts[at] - since) // cap_ns)
        since, count[who] = since + passed * cap_ns, count[who] + passed
        want = sums[at] + threshold
        k = np.searchsorted(sums, want)
        hit = np.maximum(k - 1, at)
        for i in np.flatnonzero((np.abs(sums[np.minimum(k, n)] - want) < near) | (np.abs(sums[k - 1] - want) < near)):
            taken, _ = _reach(0.0, notional[at[i] :], threshold)
            hit[i] = at[i] + taken - 1 if taken > 0 else n
        stop = np.searchsorted(ts, since + cap_ns)
        closes = hit < stop
        close[who[closes]], count[who[closes]] = hit[closes], count[who[closes]] + 1
        on = ~closes & (stop < n)
        who, at, since = who[on], stop[on], since[on]
    return close, count


def chunk_map(ts: np.ndarray, notional: np.ndarray, threshold: float, cap_ns: int) -> dict | None:
    """How a chunk of trades takes any state before it to the state after it; None where it is no shorter than its trades.

    Closes by threshold are a graph: each has one next close. Pointer doubling leads from every close to the last one in the
    chunk. Whatever bar is open before, a close comes as soon as trades less than a cap apart hold two thresholds: the trades up
    to there are the ``head``, and those after the earliest last close the ``tail``. Between them nothing need be kept.
    """
    n = len(ts)
    if not n or not threshold > 0 or not (notional >= 0).all() or not np.isfinite(notional).all():
        return None
    sums = np.concatenate([[0], np.cumsum(notional, dtype=np.longdouble)])
    full = sums[1:] - sums[np.searchsorted(ts, ts - cap_ns, side="right")] >= 2 * threshold * (1 + 1e-6)
    head = int(full.argmax()) + 1
    if not full.any() or 2 * head >= n:
        return None
    close, count = next_closes(ts, notional, threshold, cap_ns)
    jump = np.where(close < n, close, np.arange(n))
    total = np.where(close < n, count, 0)
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        total, jump = total + total[jump], further
    last, tail = jump[:head], int(jump[:head].min())
    if head + n - tail >= n:
        return None
    return {"ts": ts[:head], "notional": notional[:head], "last": last - tail, "count": total[:head], "tail_ts": ts[tail:], "tail_notional": notional[tail:]}


_MAP = {"ts": np.int64, "notional": np.float64, "last": np.int64, "count": np.int64, "tail_ts": np.int64, "tail_notional": np.float64}


class _ChunkFold:
    """Collects a chunk's instants and notionals and gives its map as one row of packed arrays."""

    def __init__(self, cap_ns: int):
        self.cap, self.threshold, self.parts = cap_ns, None, []

    def push(self, pdf: pd.DataFrame) -> None:
        if self.threshold is None:
            self.threshold = float(pdf["threshold"].iloc[0])
        t = pdf[pdf["kind"].to_numpy() == 1]
        if len(t):
            self.price = float(t["price"].iloc[-1])
            self.parts.append((t["origin_ns"].to_numpy(np.int64), t["price"].to_numpy(float) * t["quantity"].to_numpy(float)))

    def finish(self) -> pd.DataFrame:
        ts, notional = (np.concatenate(x) for x in zip(*self.parts))
        short = chunk_map(ts, notional, self.threshold, self.cap) or {"ts": ts, "notional": notional}
        return pd.DataFrame({**{c: [short[c].astype(kind).tobytes() if c in short else None] for c, kind in _MAP.items()}, "chunk_price": [self.price]})


_WALKED = f"{TAGGED}, chunk bigint, {STATE}"


class _DayWalk:
    """Walks a symbol-day over its chunk maps: the state before each chunk, and the bars left when the day ends."""

    def __init__(self, cap_ns: int):
        self.cap, self.bar, self.last_price = cap_ns, None, np.nan

    def _after(self, m: dict) -> OpenBar:
        if m["last"] is None:
            return assign_bars(self.bar, m["ts"], m["notional"], self.threshold, self.cap)[0]
        j, number = _first_close(self.bar, m["ts"], m["notional"], self.threshold, self.cap)
        k = int(m["last"][j])
        fresh = OpenBar(number + int(m["count"][j]), int(m["tail_ts"][k]))
        return assign_bars(fresh, m["tail_ts"][k + 1 :], m["tail_notional"][k + 1 :], self.threshold, self.cap)[0]

    def push(self, pdf: pd.DataFrame) -> pd.DataFrame | None:
        if self.bar is None:
            head = pdf.iloc[0]
            self.threshold, self.warmup = float(head["threshold"]), bool(head["is_warmup"])
            self.bar, self.day_end = OpenBar(0, int(pdf["since"].iloc[0])), int(pdf["day_end"].iloc[0])
        rows = []
        for i in np.flatnonzero(pdf["kind"].to_numpy() == 1):
            row = pdf.iloc[i]
            rows.append((int(pdf["chunk"].iloc[i]), *self.bar, self.last_price))
            self.bar = self._after({c: None if row[c] is None else np.frombuffer(row[c], dtype=kind) for c, kind in _MAP.items()})
            self.last_price = float(row["chunk_price"])
        n = len(rows)
        names = ["chunk", *_names(STATE)]
        return _typed({**dict(zip(names, map(list, zip(*rows)))), "threshold": [self.threshold] * n, "is_warmup": [self.warmup] * n}, n, _names(_WALKED)) if n else None

    def finish(self) -> pd.DataFrame | None:
        return _closed_bars(close_day(self.bar, self.day_end, self.cap), self.threshold, self.warmup, _names(_WALKED))


def _heads(schedule: DataFrame) -> DataFrame:
    """The state at the start of each scheduled day."""
    zero = F.lit(0).cast("bigint")  # no nulls in BIGINT columns: pandas would turn them into floats
    return schedule.select(
        "symbol", "dt", "threshold", "is_warmup", F.lit(0).alias("kind"), day_open().alias("origin_ns"), zero.alias("received_ns"), zero.alias("seq"),
        zero.alias("number"), day_open().alias("since"), F.lit(0.0).alias("held"), zero.alias("open_trades"), F.lit(float("nan")).alias("last_price"),
        (day_open() + DAY_NS).alias("day_end"),
    )


def _bodies(trades: DataFrame, *more: str) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return trades.select(
        "symbol", "dt", *more, "origin_ns", "received_ns", "seq", "side", "price", "quantity", F.lit(1).alias("kind"),
        zero.alias("number"), zero.alias("since"), zero.alias("open_trades"), zero.alias("day_end"),
    )


def tagged_bars(trades: DataFrame, schedule: DataFrame, cap_ns: int, *, width: int | None = None) -> DataFrame:
    """Member rows (trade columns set) and bar rows (close columns set) of every symbol-day.

    ``schedule`` rows head each day, so a day without trades still emits its capped empty bars. ``width`` cuts days into
    chunks of time that are separate tasks (a divisor of a day; unset: trades are counted once and the widest one with at most
    ``CHUNK_TRADES`` in a chunk is taken). Rows do not depend on it.
    """
    if width is None:
        width = balanced_bucket_width(trades, ["symbol", "dt"], "origin_ns", CHUNK_TRADES)
    out = f"symbol string, dt date, {TAGGED}"
    if width >= DAY_NS:
        stream = _heads(schedule).unionByName(_bodies(trades), allowMissingColumns=True)
        return ordered_fold(stream, ["symbol", "dt"], ["kind", "origin_ns", "seq"], lambda key: _BarFold(cap_ns), out)
    cut = trades.withColumn("chunk", bucket_of("origin_ns", width))
    cells = cut.select("symbol", "dt", "chunk").distinct().join(schedule.select("symbol", "dt", "threshold"), ["symbol", "dt"])
    stream = cells.withColumns({"kind": F.lit(0), "origin_ns": F.lit(0).cast("bigint"), "seq": F.lit(0).cast("bigint")}).unionByName(
        cut.select("symbol", "dt", "chunk", "origin_ns", "seq", "price", "quantity", F.lit(1).alias("kind")), allowMissingColumns=True
    )
    keys = ["symbol", "dt", "chunk"]
    maps = ordered_fold(stream, keys, ["kind", "origin_ns", "seq"], lambda key: _ChunkFold(cap_ns), f"symbol string, dt date, chunk bigint, {', '.join(f'{c} binary' for c in _MAP)}, chunk_price double")
    heads = _heads(schedule).select("symbol", "dt", "kind", "threshold", "is_warmup", "since", "day_end", F.lit(0).cast("bigint").alias("chunk"))
    zero = {c: F.lit(0).cast("bigint") for c in ("since", "day_end")}
    stream = heads.unionByName(maps.withColumns({"kind": F.lit(1), **zero}), allowMissingColumns=True)
    walked = materialize(ordered_fold(stream, ["symbol", "dt"], ["kind", "chunk"], lambda key: _DayWalk(cap_ns), f"symbol string, dt date, {_WALKED}"))
    zero = {c: F.lit(0).cast("bigint") for c in ("origin_ns", "received_ns", "seq", "day_end")}
    entries = walked.where("chunk IS NOT NULL").select(*keys, "threshold", "is_warmup", *_names(STATE)).withColumns({"kind": F.lit(0), **zero})
    stream = entries.unionByName(_bodies(cut, "chunk"), allowMissingColumns=True)
    members = ordered_fold(stream, keys, ["kind", "origin_ns", "seq"], lambda key: _BarFold(cap_ns), f"symbol string, dt date, chunk bigint, {TAGGED}")
    return members.drop("chunk").unionByName(walked.where("chunk IS NULL").select("symbol", "dt", *_names(TAGGED)))


def bars_from_tagged(tagged: DataFrame) -> DataFrame:
    """One row per bar with its close, member totals and path extremes."""
    buy = F.col("side") == "buy"
    n = F.col("price") * F.col("quantity")
    sign = F.when(buy, 1.0).otherwise(-1.0)
    member = F.col("seq").isNotNull()
    key = F.struct("origin_ns", "seq")
    return tagged.groupBy("symbol", "dt", "bar_idx").agg(
        F.max("interval_start").alias("interval_start"),
        F.max("close_reason").alias("close_reason"),
        F.max("cap_fire").alias("cap_fire"),
        F.max("threshold").alias("threshold"),
        F.max("is_warmup").alias("is_warmup"),
        F.max("notional").alias("notional"),
        F.count("seq").alias("n_trades"),
        F.max("received_ns").alias("max_received"),
        F.max("origin_ns").alias("last_origin"),
        F.count_if(buy & member).alias("n_buy"),
        F.sum(F.when(member, sign * n)).alias("signed_notional"),
        F.sum(F.when(member, sign * F.col("quantity"))).alias("signed_amount"),
        F.sum("quantity").alias("total_amount"),
        F.sum(n).alias("total_notional"),
        F.max(n).alias("largest_notional"),
        F.sum(F.pow(F.log(F.col("price") / F.col("prev_price")) * 1e4, 2)).alias("rv"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.min_by("price", F.when(member, key)).alias("open_price"),
        F.max_by("price", F.when(member, key)).alias("close_price"),
    )


def dollar_bars(trades: DataFrame, schedule: DataFrame, cap_ns: int, *, width: int | None = None) -> DataFrame:
    return bars_from_tagged(tagged_bars(trades, schedule, cap_ns, width=width))


def decision_watermark(bars: DataFrame, width: int = 30 * DAY_NS) -> DataFrame:
    """``t_event``: running maximum over bars of the last receipt and the forced-close instant."""
    b = bars.withColumns({"open_ns": day_open(), "__c": F.greatest("max_received", "cap_fire")})
    out = running(b, ["symbol"], ["open_ns", "bar_idx"], {"t_event": ("max", F.col("__c"))}, width=width)
    return out.drop("__c")


def coalesce_bars(bars: DataFrame) -> DataFrame:
    """Keep the last-closing bar of every decision instant (also across midnight)."""
    cols = [c for c in bars.columns if c not in ("symbol", "t_event")]
    last = bars.groupBy("symbol", "t_event").agg(F.max_by(F.struct(*cols), F.struct("open_ns", "bar_idx")).alias("b"))
    return last.select("symbol", "t_event", *[F.col(f"b.{c}").alias(c) for c in cols])


def close_ns() -> Column:
    return F.coalesce("cap_fire", "last_origin")


def bar_diagnostics(bars: DataFrame) -> DataFrame:
    return bars.select(
        "symbol", "dt", "bar_idx", "close_reason",
        close_ns().alias("close_ns"),
        (close_ns() - F.col("interval_start")).alias("elapsed_ns"),
        (F.col("close_reason") == "time_cap").alias("emitted_by_time_cap"),
    )


# ------------------------------------------------------------------ member features (0 on empty bars)
def trade_flow(mid: Column | None = None) -> dict[str, Column]:
    c = F.col
    some = c("n_trades") > 0

    def when(x: Column) -> Column:
        return F.when(some, x).otherwise(0.0)

    out = {
        "cvd": when(c("signed_notional") / c("threshold")),
        "signed_vol": when(c("signed_amount") / c("total_amount")),
        "aggressor_imb": when((2 * c("n_buy") - c("n_trades")) / c("n_trades")),
        "largest_print": when(c("largest_notional") / c("threshold")),
        "trade_count": c("n_trades").cast("double"),
    }
    if mid is not None:
        vwap = c("total_notional") / c("total_amount")
        out["vwap_minus_mid"] = when((vwap - mid) / mid * 1e4)
    return out


def intrabar_path() -> dict[str, Column]:
    """Realized variance and worst adverse log move against the bar's own direction, both in bps."""
    c = F.col
    two = c("n_trades") >= 2
    up = c("close_price") >= c("open_price")
    worst = F.when(up, -F.log(c("low") / c("open_price"))).otherwise(F.log(c("high") / c("open_price"))) * 1e4
    return {
        "rv_intrabar": F.when(two, c("rv")).otherwise(0.0),
        "mae_intrabar": F.when(two, F.greatest(F.lit(0.0), worst)).otherwise(0.0),
    }


def clock_features() -> dict[str, Column]:
    e = close_ns() - F.col("interval_start")
    n = F.col("n_trades")
    tod = (F.col("t_event") % DAY_NS) / float(DAY_NS) * (2.0 * np.pi)
    return {
        "elapsed_ns": e.cast("double"),
        "event_intensity": F.when(n > 0, F.log1p(n * 1e9 / F.greatest(e, F.lit(1)))).otherwise(0.0),
        "tod_sin": F.sin(tod),
        "tod_cos": F.cos(tod),
    }


