"""Per-decision features from the observable book and the bar's member trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.operators.bars import clock_features, intrabar_path, trade_flow
from lobspark.operators.ordered import shift
from lobspark.session import DAY_NS

# The ordered feature manifest.
FEATURE_COLS = (
    "ofi_integrated", "microprice_dev", "queue_imb", "spread_tick", "cvd", "depth_imbalance", "book_slope",
    "vwap_minus_mid", "trade_count", "signed_vol", "aggressor_imb", "largest_print", "event_intensity",
    "rv_intrabar", "mae_intrabar", "elapsed_ns", "tod_sin", "tod_cos",
)


def level_columns(k: int) -> list[str]:
    return [f"{s}_{i}_{f}" for s in ("bid", "ask") for i in range(k) for f in ("price", "size")]


def prior_read(reads: DataFrame, k: int, keys: Sequence[str] = ("symbol",), width: int = DAY_NS) -> DataFrame:
    """Attach the previous surviving read's ladder, depth and read time (``prev_*``)."""
    cols = [*level_columns(k), "bid_depth", "ask_depth", "target_read_ts"]
    return shift(reads, keys, ["t_event"], {f"prev_{c}": F.col(c) for c in cols}, width=width)


def _side_flow(side: str, k: int) -> Column:
    total = F.lit(0.0)
    for i in range(k):
        p, q = F.col(f"{side}_{i}_price"), F.col(f"prev_{side}_{i}_price")
        s, z = F.col(f"{side}_{i}_size"), F.col(f"prev_{side}_{i}_size")
        better, worse = (p > q, p < q) if side == "bid" else (p < q, p > q)
        total = total + F.when(better, s).when(worse, -z).otherwise(s - z)
    return total


def book_features(k: int, tick_size: float) -> dict[str, Column]:
    """Order-flow imbalance and book shape of one read against the read before."""
    c = F.col
    mid, thr = c("mid"), c("threshold")
    bd = sum((c(f"bid_{i}_size") for i in range(1, k)), c("bid_0_size"))
    ad = sum((c(f"ask_{i}_size") for i in range(1, k)), c("ask_0_size"))
    span = (c(f"ask_{k - 1}_price") - c(f"bid_{k - 1}_price")) / mid * 1e4
    return {
        "ofi_integrated": (_side_flow("bid", k) - _side_flow("ask", k)) * mid / thr,
        "microprice_dev": (c("microprice") - mid) / mid * 1e4,
        "queue_imb": (c("bid_0_size") - c("ask_0_size")) / (c("bid_0_size") + c("ask_0_size")),
        "spread_tick": (c("ask_0_price") - c("bid_0_price")) / tick_size,
        "depth_imbalance": (bd - ad) / (bd + ad),
        "book_slope": (bd + ad) * mid / thr / span,
    }


def feature_rejection(k: int) -> Column:
    """``no_prior_read`` or ``insufficient_depth`` (prior or current ladder shorter than ``k``)."""
    short = F.least("bid_depth", "ask_depth", "prev_bid_depth", "prev_ask_depth") < k
    return F.when(F.col("prev_target_read_ts").isNull(), "no_prior_read").when(short, "insufficient_depth")


def build_features(rows: DataFrame, k: int, tick_size: float, keys: Sequence[str] = ("symbol",), width: int = DAY_NS) -> DataFrame:
    """Bars joined with their surviving reads to feature rows; rejected rows still feed the lag."""
    x = prior_read(rows, k, keys, width)
    x = x.withColumns(
        {
            "feature_reason": feature_rejection(k),
            "t_feature_start": F.least("interval_start", "prev_target_read_ts"),
        }
    )
    cols = {**book_features(k, tick_size), **trade_flow(F.col("mid")), **intrabar_path(), **clock_features()}
    return x.withColumns(cols)
