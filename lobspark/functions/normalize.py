"""Column libraries that turn raw vendor columns into the canonical contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Raw column names accepted for each canonical field, preferred name first.
ALIASES: Mapping[str, Sequence[str]] = {
    "origin_ns": ("origin_time", "timestamp"),
    "received_ns": ("received_time", "receipt_timestamp"),
    "price": ("price",),
    "quantity": ("quantity", "amount", "size"),
    "side": ("side",),
    "trade_id": ("trade_id", "id"),
    "funding_rate": ("funding_rate", "rate"),
    "open_interest": ("open_interest", "oi"),
    "next_funding_time": ("next_funding_time",),
}


def pick(df: DataFrame, field: str) -> Column:
    """First present alias of a canonical field; a missing field names the columns seen."""
    for c in ALIASES[field]:
        if c in df.columns:
            return F.col(c)
    raise ValueError(f"no {field} column among {df.columns}; accepted: {list(ALIASES[field])}")


def side_of(c: Column) -> Column:
    """buy/sell from any known spelling (``buy``, ``b``, ``BUY_ESTIMATED`` …); null if unknown."""
    s = F.lower(F.trim(c))
    return F.when((s == "b") | s.startswith("buy"), "buy").when((s == "s") | s.startswith("sell"), "sell")


def strict_side(c: Column) -> Column:
    """As :func:`side_of`, failing the job on an unknown spelling."""
    return F.coalesce(side_of(c), F.raise_error(F.concat(F.lit("unknown side: "), F.coalesce(c, F.lit("null")))))


def normalize(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = (), optional: Sequence[str] = ()) -> DataFrame:
    """Canonical projection: two BIGINT clocks, then ``fields`` with their types."""
    types = {"trade_id": "bigint", "side": None, "next_funding_time": "bigint"}
    cols = [pick(df, "origin_ns").cast("bigint").alias("origin_ns"), pick(df, "received_ns").cast("bigint").alias("received_ns")]
    for f in [*fields, *[o for o in optional if any(a in df.columns for a in ALIASES[o])]]:
        c = strict_side(pick(df, f)) if f == "side" else pick(df, f).cast(types.get(f, "double"))
        cols.append(c.alias(f))
    return df.select(*keep, *cols)


def normalize_trades(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return normalize(df, ("price", "quantity", "side", "trade_id"), keep)


def normalize_funding(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return normalize(df, ("funding_rate",), keep, optional=("next_funding_time",))


def normalize_open_interest(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return normalize(df, ("open_interest",), keep)


def normalize_liquidations(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return normalize(df, ("price", "quantity", "side"), keep)


def vendor_time_ns(text: Column, day_open_ns: Column) -> Column:
    """``HH:MM:SS.fffffff`` or ``YYYY-MM-DDTHH:MM:SS.fffffff`` as nanoseconds since the day open.

    Spark timestamps stop at microseconds, so the fraction is carried separately.
    """
    clock = F.when(text.contains("T"), F.split_part(text, F.lit("T"), F.lit(2))).otherwise(text)
    clock = F.regexp_replace(clock, "Z$", "")
    hms = F.split(F.split_part(clock, F.lit("."), F.lit(1)), ":")
    secs = hms[0].cast("bigint") * 3600 + hms[1].cast("bigint") * 60 + hms[2].cast("bigint")
    frac = F.rpad(F.split_part(clock, F.lit("."), F.lit(2)), 9, "0").cast("bigint")
    tod = secs * 1_000_000_000 + frac
    date_ns = F.unix_micros(F.to_date(F.substring(text, 1, 10)).cast("timestamp")) * 1000
    return F.when(text.contains("T"), date_ns - day_open_ns + tod).otherwise(tod)


def decimal_places(text: Column) -> Column:
    """Decimal places of a decimal string without trailing zeros."""
    frac = F.regexp_replace(F.split_part(text, F.lit("."), F.lit(2)), "0+$", "")
    return F.length(frac).cast("bigint")


def to_ticks(text: Column, scale: int) -> Column:
    """Exact integer ticks of a decimal string; null when off tick or not a decimal."""
    v = text.try_cast("decimal(28,10)") * F.lit(scale).cast("decimal(10,0)")
    return F.when(v == F.floor(v), v.cast("bigint"))


# Seconds, milliseconds, microseconds or nanoseconds to nanoseconds.
EPOCH_MULTIPLIERS = (1, 1_000, 1_000_000, 1_000_000_000)
EPOCH_LO, EPOCH_HI = 1_577_836_800_000_000_000, 1_893_456_000_000_000_000  # 2020-01-01, 2030-01-01


def epoch_multiplier(median: Column) -> Column:
    """The multiplier that puts a column's median positive value inside [2020, 2030); null if none."""
    out = F.lit(None).cast("bigint")
    for m in reversed(EPOCH_MULTIPLIERS):
        v = median * float(m)
        out = F.when((v >= float(EPOCH_LO)) & (v < float(EPOCH_HI)), F.lit(m).cast("bigint")).otherwise(out)
    return out


def log_return_bps(simple_bps: Column) -> Column:
    return F.log1p(simple_bps / 1e4) * 1e4


def spread_regime(spread_tick: Column, boundary: float) -> Column:
    return F.when(spread_tick <= boundary, "tight").otherwise("wide")
