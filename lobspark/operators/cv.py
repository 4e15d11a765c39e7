"""Purged and embargoed combinatorial cross-validation, models fitted per split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lobspark.operators.boost import BoostParams, Ensemble, boosted_forecast, boosted_ladder, cut_points, fit_boosted, placed
from lobspark.operators.ordered import rank
from lobspark.session import DAY_NS, materialize


def time_groups(rows: DataFrame, n_groups: int, keys: Sequence[str] = (), width: int = DAY_NS, ties: Sequence[str] = ()) -> DataFrame:
    """``grp`` = floor(rank · n / N) by t_event (not ``ntile``); rows of one instant are ordered by ``ties``."""
    keys = list(keys)
    r = rank(rows, keys, ["t_event", *ties], width=width, name="__rn")
    n = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    # one count row per key, sent: a shuffle by these few keys would put all rows of one into a task
    r = r.join(F.broadcast(n), keys) if keys else r.crossJoin(F.broadcast(n))
    return r.withColumn("grp", F.expr(f"((__rn - 1) * {n_groups}) div __n")).drop("__rn", "__n")


def merge_intervals(rows: DataFrame, keys: Sequence[str], lo: str, hi: str, width: int = DAY_NS) -> DataFrame:
    """Union of overlapping (or touching) closed spans as disjoint intervals."""
    from lobspark.operators.ordered import running

    keys = list(keys)
    x = rows.select(*keys, F.col(lo).alias("lo"), F.col(hi).alias("hi")).groupBy(*keys, "lo").agg(F.max("hi").alias("hi"))
    x = running(x, keys, ["lo"], {"__m": ("max", F.col("hi"))}, width=width, inclusive=False)
    x = x.withColumn("__new", (F.col("__m").isNull() | (F.col("lo") > F.col("__m"))).cast("bigint"))
    x = running(x, keys, ["lo"], {"__id": ("sum", F.col("__new"))}, width=width)
    return x.groupBy(*keys, "__id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).drop("__id")


def split_table(n_groups: int, k: int) -> list[tuple[int, list[int]]]:
    if n_groups < 2 or not 1 <= k < n_groups:
        raise ValueError("need n_groups >= 2 and 1 <= k < n_groups")
    return [(i, list(c)) for i, c in enumerate(combinations(range(n_groups), k))]


def split_groups(rows: DataFrame, *, n_groups: int, k: int, embargo_ns: int, keys: Sequence[str] = (), keep: Sequence[str] = (), width: int = DAY_NS) -> DataFrame:
    """Every row once, with its group and ``hit``: one flag per group, true where a test group of that number keeps the row out of training.

    Time groups are contiguous, so a row outside a test group meets that group's spans exactly when
    it meets ``[min t_event, max t_barrier]`` of the group, and the embargo runs from that maximum.
    The purge therefore needs only the group bounds (n_groups rows), no row-to-row join.
    """
    split_table(n_groups, k)
    keys = list(keys)
    rest = [c for c in dict.fromkeys(["t_barrier", *keep]) if c not in (*keys, "t_event")]
    # ordered by all columns: rows that still tie are equal, so groups do not depend on the run
    g = time_groups(rows.select(*keys, "t_event", *rest), n_groups, keys, width, rest)
    bounds = g.groupBy(*keys, "grp").agg(F.min("t_event").alias("lo"), F.max("t_barrier").alias("hi"))
    per_key = bounds.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("grp", F.struct("lo", "hi")))).alias("bounds"))
    g = g.join(F.broadcast(per_key), keys) if keys else g.crossJoin(F.broadcast(per_key))  # one row of n_groups bounds per key
    hit = []
    for i in range(n_groups):
        b = F.col("bounds")[F.lit(i).cast("bigint")]
        meets = (F.col("t_event") <= b["hi"]) & (F.col("t_barrier") >= b["lo"]) | (F.col("t_event") > b["hi"]) & (F.col("t_event") <= b["hi"] + embargo_ns)
        hit.append(F.coalesce((F.col("grp") == i) | meets, F.lit(False)))
    return g.select(*keys, "t_event", *rest, "grp", F.array(*hit).alias("hit"))


def _with_splits(g: DataFrame, n_groups: int, k: int) -> DataFrame:
    """``g`` (``grp, hit``) × split, with the role of its rows there."""
    splits = F.array(*[F.struct(F.lit(i).cast("bigint").alias("split"), F.array(*[F.lit(c) for c in cs]).alias("test")) for i, cs in split_table(n_groups, k)])
    x = g.withColumn("__s", F.explode(splits))
    is_test = F.array_contains(F.col("__s.test").cast("array<bigint>"), F.col("grp"))
    out = F.exists("__s.test", lambda c: F.element_at("hit", c + 1))
    return x.withColumns({"split": F.col("__s.split"), "role": F.when(is_test, "test").when(out, "purged").otherwise("train")}).drop("__s")


def _exploded(g: DataFrame, n_groups: int, k: int) -> DataFrame:
    return _with_splits(g, n_groups, k).drop("hit")


def cpcv_splits(
    rows: DataFrame, *, n_groups: int, k: int, embargo_ns: int, keys: Sequence[str] = (), keep: Sequence[str] = (), width: int = DAY_NS
) -> DataFrame:
    """Every row × split with its role: ``test``, ``train`` or ``purged`` (see ``split_groups``)."""
    return _exploded(split_groups(rows, n_groups=n_groups, k=k, embargo_ns=embargo_ns, keys=keys, keep=keep, width=width), n_groups, k)


# ------------------------------------------------------------------ ridge
def _gram_columns(x: Sequence[str], y: str, w: str) -> list:
    """Weighted sums of products of the centred columns."""
    c = [F.col(a) - F.col(f"__m{i}") for i, a in enumerate(x)]
    v, w = F.col(y) - F.col("__my"), F.col(w)
    cols = [F.first("__my").alias("my"), *[F.first(f"__m{i}").alias(f"m{i}") for i in range(len(c))]]
    for i, a in enumerate(c):
        cols.append(F.sum(w * a * v).alias(f"y{i}"))
        cols += [F.sum(w * a * c[j]).alias(f"g{i}_{j}") for j in range(i, len(c))]
    return cols


def fit_ridge(train: DataFrame, keys: Sequence[str], x: Sequence[str], y: str = "y_fwd_bps", w: str = "uniqueness", alpha: float = 1.0) -> DataFrame:
    """Weighted ridge with intercept for every key: means first, then Gram sums of the centred columns.

    Columns of any size (nanoseconds) lose no digits that way. The d × d solve runs on the one summary row of each key.
    """
    keys, x = list(keys), list(x)
    d = len(x)
    mean = {f"__m{i}": F.col(a) for i, a in enumerate(x)} | {"__my": F.col(y)}
    means = train.groupBy(*keys).agg(*[(F.sum(F.col(w) * v) / F.sum(w)).alias(n) for n, v in mean.items()])
    sums = train.join(F.broadcast(means), keys).groupBy(*keys).agg(F.count("*").alias("n"), *_gram_columns(x, y, w))
    return _solved(sums, keys, d, alpha)


def _solved(sums: DataFrame, keys: Sequence[str], d: int, alpha: float) -> DataFrame:
    """``keys, n, intercept, b0, …`` from one summary row per key: means ``m0, …, my``, centred products ``g0_0, …`` and ``y0, …``."""
    keys, types = list(keys), dict(sums.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "n bigint", "intercept double", *[f"b{i} double" for i in range(d)]])

    def solve(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                mx, my = np.array([r[f"m{i}"] for i in range(d)]), r["my"]
                a = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
                b = np.array([r[f"y{i}"] for i in range(d)])
                beta = np.linalg.solve(a + alpha * np.eye(d), b) if r["n"] >= 2 else np.zeros(d)
                b0 = my - mx @ beta if r["n"] >= 2 else 0.0
                out.append([*[r[k] for k in keys], int(r["n"]), float(b0), *map(float, beta)])
            yield pd.DataFrame(out, columns=[*keys, "n", "intercept", *[f"b{i}" for i in range(d)]])

    return sums.mapInPandas(solve, schema)


def ridge_rung(g: DataFrame, x: Sequence[str], *, n_groups: int, k: int, keys: Sequence[str] = (), y: str = "y_fwd_bps", w: str = "uniqueness", alpha: float = 1.0) -> DataFrame:
    """The rows of ``split_groups`` with ``f``: the mean forecast of the ridge models whose split tests the row."""
    mine = ridge_models(g, x, n_groups=n_groups, k=k, keys=keys, y=y, w=w, alpha=alpha)
    f = F.col("intercept")
    for i, a in enumerate(x):
        f = f + F.col(f"b{i}") * F.col(a)
    return g.join(F.broadcast(mine), [*keys, "grp"]).withColumn("f", f).drop("intercept", *[f"b{i}" for i in range(len(x))])


def ridge_models(g: DataFrame, x: Sequence[str], *, n_groups: int, k: int, keys: Sequence[str] = (), y: str = "y_fwd_bps", w: str = "uniqueness", alpha: float = 1.0) -> DataFrame:
    """``keys, grp, intercept, b0, …``: the mean coefficients of the ridge models whose split tests the group, from the rows of ``split_groups``.

    Rows are never copied per split. Those of one group with equal flags have equal roles in every split, so their Gram sums are taken once, centred on
    the key's own means, and moved to the means of each split's training rows. Forecasts are linear, so their mean is that of the mean coefficients.
    """
    keys, x = list(keys), list(x)
    d, v = len(x), [*x, y]
    mean = g.groupBy(*keys).agg(*[(F.sum(F.col(w) * F.col(c)) / F.sum(w)).alias(f"__c{i}") for i, c in enumerate(v)])
    r = g.join(F.broadcast(mean), keys) if keys else g.crossJoin(F.broadcast(mean))  # one row per key
    c, u = [F.col(a).cast("double") - F.col(f"__c{i}") for i, a in enumerate(v)], F.col(w).cast("double")
    products = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    names = ["n", "s", *[f"s{i}" for i in range(d + 1)], *[f"s{i}_{j}" for i, j in products]]
    sums = [F.count("*"), F.sum(u), *[F.sum(u * a) for a in c], *[F.sum(u * c[i] * c[j]) for i, j in products]]
    centre = [f"__c{i}" for i in range(d + 1)]
    cells = r.groupBy(*keys, "grp", "hit").agg(*[a.alias(n) for a, n in zip(sums, names)], *[F.first(m).alias(m) for m in centre])
    train = _with_splits(cells, n_groups, k).where("role = 'train'")
    train = train.groupBy(*keys, "split").agg(*[F.sum(n).alias(n) for n in names], *[F.first(m).alias(m) for m in centre])
    models = train.select(*keys, "split", "n", *[(F.col(f"__c{i}") + F.col(f"s{i}") / F.col("s")).alias("my" if i == d else f"m{i}") for i in range(d + 1)],
                          *[(F.col(f"s{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("s")).alias(f"y{i}" if j == d else f"g{i}_{j}") for i, j in products if i < d])
    models = _solved(models, [*keys, "split"], d, alpha)
    pairs = g.sparkSession.createDataFrame([(i, c) for i, cs in split_table(n_groups, k) for c in cs], "split bigint, grp bigint")
    coef = ["intercept", *[f"b{i}" for i in range(d)]]
    return models.join(F.broadcast(pairs), "split").groupBy(*keys, "grp").agg(*[F.avg(b).alias(b) for b in coef])  # one row per key and group


def ridge_forecast(rows: DataFrame, models: DataFrame, keys: Sequence[str], x: Sequence[str]) -> DataFrame:
    """``f`` per row; ``models`` holds one row per key (splits × horizons)."""
    m = rows.join(F.broadcast(models), list(keys))
    f = F.col("intercept")
    for i, c in enumerate(x):
        f = f + F.col(f"b{i}") * F.col(c)
    return m.withColumn("f", f).drop("n", "intercept", *[f"b{i}" for i in range(len(x))])


def collapse_forecasts(forecasts: DataFrame, row_keys: Sequence[str], expected: int) -> DataFrame:
    """Mean of the repeated out-of-sample forecasts of a row, with an exact multiplicity check."""
    return forecasts.groupBy(*row_keys).agg(F.avg("f").alias("f"), F.count("*").alias("n_seen"), (F.count("*") == expected).alias("complete"))


def cv_ladder(rows: DataFrame, *, features: Sequence[str], micro: str, n_groups: int, k: int, embargo_ns: int,
              keep: Sequence[str], keys: Sequence[str] = (), width: int = DAY_NS, boost=None, label: str = "label") -> DataFrame:
    """Out-of-sample forecasts of the rungs (naive, microprice, ridge, and with ``boost`` the boosted ones), averaged per row.

    Rows are split, and models fitted, inside each of ``keys`` (horizons). ``keep`` must tell rows of one instant apart.
    ``boost`` is a ``BoostParams``.
    """
    keys = list(keys)
    keep = [c for c in keep if c not in keys]
    cols = list(dict.fromkeys([*features, micro, *keep, *([label] if boost else [])]))
    own = [*keys, "t_event", *keep]
    g = materialize(split_groups(rows, n_groups=n_groups, embargo_ns=embargo_ns, k=k, keys=keys, keep=cols, width=width))
    out = ridge_rung(g, features, n_groups=n_groups, k=k, keys=keys).select(*own, "f", F.lit("ridge").alias("model"))
    naive = rows.select(*own, F.lit(0.0).alias("f"), F.lit("naive").alias("model"))
    mp = rows.select(*own, F.col(micro).cast("double").alias("f"), F.lit("microprice").alias("model"))
    out = out.unionByName(naive).unionByName(mp)
    if boost:
        s = materialize(_exploded(g, n_groups, k))
        trees = boosted_ladder(s, keys=keys, features=features, own=own, times=comb(n_groups - 1, k - 1), params=boost, label=label)
        out = out.unionByName(trees.select(*own, "f", "model"))
    return out


# ------------------------------------------------------------------ boosted trees
ONE = "__model"


@dataclass
class Boosted:
    """One ensemble over the columns of ``x``: its cut points (a table of one row) and its trees."""

    x: list[str]
    cuts: DataFrame
    fit: Ensemble


def _fit_boosted(train: DataFrame, x: Sequence[str], y: Column, label: Column, w: str, params: BoostParams) -> Boosted:
    rows = train.withColumn(ONE, F.lit(0))
    cuts = materialize(cut_points(rows, [ONE], x, params.bins))
    rows = placed(rows, cuts, [ONE], x).select(ONE, "bins", y.cast("double").alias("y"), label.cast("int").alias("label"), F.col(w).cast("double").alias("w"))
    return Boosted(list(x), cuts, fit_boosted(rows, [ONE], params))


def fit_gbt_reg(train: DataFrame, x: Sequence[str], y: str = "y_fwd_bps", w: str = "uniqueness", trees: int = 200, depth: int = 5, step: float = 0.05) -> Boosted:
    """Boosted regression trees on all rows: binned once, rows with equal bins one weighted row (see ``boost``)."""
    return _fit_boosted(train, x, F.col(y), F.lit(0), w, BoostParams(trees, depth, step))


def gbt_forecast(model: Boosted, rows: DataFrame, x: Sequence[str]) -> DataFrame:
    return _boosted(model, rows, x).withColumn("f", F.col("f_reg")).drop("f_reg", "f_clf")


def fit_gbt_clf(train: DataFrame, x: Sequence[str], label: str = "label", w: str = "uniqueness", trees: int = 200, depth: int = 5, step: float = 0.05) -> Boosted:
    """One model of down, flat and up: a tree per class and round, on the softmax loss."""
    return _fit_boosted(train, x, F.lit(0.0), F.col(label), w, BoostParams(trees, depth, step))


def gbt_clf_forecast(model: Boosted, rows: DataFrame, x: Sequence[str], scale: float) -> DataFrame:
    """(P(up) − P(down)) · scale in bps; 0 where training rows had a single class."""
    fit = replace(model.fit, scale=np.where(model.fit.scale > 0, scale, 0.0))
    return _boosted(replace(model, fit=fit), rows, x).withColumn("f", F.col("f_clf")).drop("f_reg", "f_clf")


def _boosted(model: Boosted, rows: DataFrame, x: Sequence[str]) -> DataFrame:
    if list(x) != model.x:
        raise ValueError(f"fitted on {model.x}")
    return boosted_forecast(placed(rows.withColumn(ONE, F.lit(0)), model.cuts, [ONE], x), model.fit, [ONE]).drop(ONE, "bins")


def block_index(rows: DataFrame, s: int, width: int = DAY_NS, keys: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """Row position inside ``keys``, by t_event and ``ties``, cut into ``s`` near-equal blocks, the first N mod s one row longer."""
    keys = list(keys)
    r = rank(rows, keys, ["t_event", *ties], width=width, name="__rn")
    n = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    x = r.join(F.broadcast(n), keys) if keys else r.crossJoin(F.broadcast(n))  # one count row per key
    i, m = F.expr("__rn - 1"), F.expr(f"__n % {s}")
    small = F.expr(f"(__n % {s}) * (__n div {s} + 1)")
    blk = F.when(i < small, F.expr(f"(__rn - 1) div (__n div {s} + 1)")).otherwise(m + F.expr(f"(__rn - 1 - (__n % {s}) * (__n div {s} + 1)) div greatest(__n div {s}, 1)"))
    return x.withColumn("block", blk.cast("bigint")).drop("__rn", "__n")


def pbo_logits(perf: DataFrame, s: int = 8, trial: str = "trial", keys: Sequence[str] = ()) -> DataFrame:
    """In-sample winner and its out-of-sample rank for every half split of ``s`` blocks, inside each of ``keys``.

    ``perf``: keys, block, trial, swp (Σ weight·pnl), sw (Σ weight): s × trials rows, whatever the matrix size.
    """
    keys = list(keys)
    combos = [list(c) for c in combinations(range(s), s // 2)]
    cells = F.array(*[F.struct(F.lit(i).cast("bigint").alias("combo"), F.array(*[F.lit(b).cast("bigint") for b in c]).alias("tr")) for i, c in enumerate(combos)])
    x = perf.withColumn("c", F.explode(cells)).select(*keys, "block", trial, "swp", "sw", "c.combo", "c.tr")
    ins = F.array_contains("tr", F.col("block"))
    p = x.groupBy(*keys, "combo", trial).agg(
        (F.sum(F.when(ins, F.col("swp"))) / F.sum(F.when(ins, F.col("sw")))).alias("is_perf"),
        (F.sum(F.when(~ins, F.col("swp"))) / F.sum(F.when(~ins, F.col("sw")))).alias("oos_perf"),
    )
    w = W.partitionBy(*keys, "combo")
    first = F.row_number().over(w.orderBy(F.desc("is_perf"), trial))
    p = p.withColumns({"__r": first, "n": F.count("*").over(w)})
    p = p.withColumn("best_oos", F.max(F.when(F.col("__r") == 1, F.col("oos_perf"))).over(w))
    out = p.groupBy(*keys, "combo").agg(
        F.max(F.when(F.col("__r") == 1, F.col(trial))).alias("winner"),
        F.count_if(F.col("oos_perf") <= F.col("best_oos")).alias("rank_count"),
        F.max("n").alias("n_trials"),
    )
    rel = F.col("rank_count") / (F.col("n_trials") + 1)
    return out.withColumn("logit", F.log(rel / (1 - rel)))


def pbo(pnl: DataFrame, s: int = 8, trial: str = "trial", pnl_col: str = "pnl", weight: str = "uniqueness") -> DataFrame:
    """Probability of backtest overfitting over long rows ``block, trial, pnl, weight``."""
    perf = pnl.groupBy("block", trial).agg(F.sum(F.col(weight) * F.col(pnl_col)).alias("swp"), F.sum(weight).alias("sw"))
    return pbo_logits(perf, s, trial).agg(F.avg((F.col("logit") < 0).cast("double")).alias("pbo"), F.count("*").alias("n_combinations"))
