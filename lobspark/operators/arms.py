"""The matched study of several feature arms: one pool of trials, one noise band and one verdict per key.

Arms are sets of columns of one matrix, so their rows, labels, costs and splits are the same by construction. Rows are never copied per split, and per
candidate only inside the tasks that sum them up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lobspark.functions.normal import deflated_sharpe
from lobspark.operators import cv
from lobspark.operators import evaluate as E
from lobspark.operators.boost import RUNGS, BoostParams, cut_points, grown, mean_forecasts, placed, started_cells
from lobspark.operators.study import PBO_BLOCKS, PBO_ROWS, Gate, check_lookback
from lobspark.session import DAY_NS, materialize

CONFIGS = ("naive", "ridge", *RUNGS)
COLUMNS = ["y_fwd_bps", "cost_bps", "half_spread_bps", "uniqueness", "regime"]


@dataclass(frozen=True)
class Band:
    n_boot: int = 2000
    block: int = 16
    alpha: float = 0.05
    seed: int = 0


def feature_sets(arms: Mapping[str, Sequence[str]], control: str, combined: str, variants: Mapping[str, Mapping[str, Sequence[str]]]) -> list[tuple[str, str, list[str]]]:
    """(arm, variant, features) of every fit. The combined arm has the features of all others, none of which shares one with the control."""
    if control not in arms or combined not in arms or len(arms) < 3:
        raise ValueError(f"needs the arms {control!r}, {combined!r} and another one")
    others = {c for a, cs in arms.items() if a not in (control, combined) for c in cs}
    if others & set(arms[control]):
        raise ValueError(f"the control shares features with another arm: {sorted(others & set(arms[control]))}")
    if set(arms[combined]) != others | set(arms[control]):
        raise ValueError(f"{combined!r} must have the features of all other arms and no more")
    out = [(a, "base", list(cs)) for a, cs in arms.items()]
    for name, per_arm in variants.items():
        if name == "base" or set(per_arm) != set(arms):
            raise ValueError(f"variant {name!r} must name the features of every arm")
        out += [(a, name, list(cs)) for a, cs in per_arm.items()]
    for a, name, cs in out:
        if not cs or len(set(cs)) != len(cs) or not set(cs) <= set(arms[a]):
            raise ValueError(f"features of {a!r}, {name!r}: some of the arm's, each once")
    return out


def _boosted(g: DataFrame, sets: list[tuple[str, str, list[str]]], *, n_groups: int, k: int, keys: list[str], params: BoostParams, label: str) -> DataFrame:
    """``g`` with ``forecasts`` of the boosted rungs of every set (see ``mean_forecasts``). All sets are fitted together: a feature that one lacks lies in one bin there and is never cut."""
    features = list(dict.fromkeys(c for _, _, cs in sets for c in cs))
    rows = placed(g, materialize(cut_points(g, keys, features, params.bins)), keys, features)
    y, w = F.col("y_fwd_bps").cast("double"), F.col("uniqueness").cast("double")
    known = rows.where(y.isNotNull() & w.isNotNull() & F.col(label).isNotNull())
    mean = g.groupBy(*keys).agg(F.avg(y).alias("__c"))
    d = y - F.col("__c")
    # rows of a group with equal flags have equal roles in every split, those with equal bins and label equal gradients
    cells = known.join(F.broadcast(mean), keys).groupBy(*keys, "grp", "hit", "bins", F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(d).alias("d1"), F.sum(d * d).alias("d2"))
    own = [F.struct(F.lit(a).alias("arm"), F.lit(v).alias("variant"), F.array(*[F.col("bins")[i] if c in cs else F.lit(0) for i, c in enumerate(features)]).alias("bins")) for a, v, cs in sets]
    cells = materialize(cells).withColumn("__a", F.explode(F.array(*own))).select("*", "__a.arm", "__a.variant", F.col("__a.bins").alias("__b")).drop("__a", "bins").withColumnRenamed("__b", "bins")
    train = cv._with_splits(cells, n_groups, k).where("role = 'train'").drop("grp", "hit", "role")
    fit = grown(*started_cells(train, ["arm", "variant", *keys, "split"], params), params)
    tests = [[s for s, groups in cv.split_table(n_groups, k) if i in groups] for i in range(n_groups)]
    return mean_forecasts(rows, fit, keys, [(a, v) for a, v, _ in sets], tests).drop("bins")


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"__{c}"]) for c in keys])


def figures(pnl: DataFrame, own: Sequence[str]) -> DataFrame:
    """Trade figures, Sharpe ratios (trades, all rows), skew, kurtosis and Matthews correlation by ``own``, in two passes over rows that never leave their tasks."""
    own, p = list(own), F.col("pnl")
    t = F.when(F.col("traded"), p)
    u, ut = F.when(p.isNotNull(), F.col("uniqueness")), F.when(t.isNotNull(), F.col("uniqueness"))
    m = pnl.groupBy(*own).agg((F.sum(ut * t) / F.sum(ut)).alias("__t"), (F.sum(u * p) / F.sum(u)).alias("__a"), F.avg(t).alias("__m"))
    m = m.select(*[F.col(c).alias(f"__{c}") for c in own], "__t", "__a", "__m")
    x = pnl.join(F.broadcast(m), _same(pnl, m, own))  # one row per group
    sign, real = F.signum("f").cast("int"), F.signum("y_fwd_bps").cast("int")
    hit, d = F.col("traded"), t - F.col("__m")
    x = x.groupBy(*own).agg(
        F.count("*").alias("n_rows"), F.count(p).alias("n_pnl"), F.count_if(hit).alias("n_trades"), F.coalesce(F.sum(F.when(hit, F.col("uniqueness"))), F.lit(0.0)).alias("effective_trades"),
        F.sum("gross").alias("gross_pnl"), F.sum(p).alias("net_pnl"), F.count(t).alias("__n"),
        (F.sum(ut * (t - F.col("__t")) ** 2) / F.sum(ut)).alias("__vt"), (F.sum(u * (p - F.col("__a")) ** 2) / F.sum(u)).alias("__va"), F.first("__t").alias("__t"), F.first("__a").alias("__a"),
        *[F.sum(F.pow(d, i)).alias(f"__m{i}") for i in (2, 3, 4)], F.count_if(hit & (sign == real)).alias("__hits"),
        *[F.count_if(hit & (v == c)).alias(f"__{n}{c + 1}") for n, v in (("p", sign), ("r", real)) for c in (-1, 0, 1)],
    )
    n, m2, m3, m4 = F.col("__n").cast("double"), F.col("__m2"), F.col("__m3"), F.col("__m4")
    ratio = lambda mean, var, rows: F.when((rows >= 2) & (F.col(var) > 0), F.col(mean) / (F.sqrt(var) + 1e-12)).otherwise(0.0)
    skew = F.when((n > 2) & (m2 > 0), F.sqrt(n * (n - 1)) / (n - 2) * (m3 / n) / F.pow(m2 / n, 1.5)).otherwise(0.0)
    var = m2 / (n - 1)
    kurt = n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * m4 / (var * var) - (n - 1) ** 2 * 3 / ((n - 2) * (n - 3)) + 3.0
    s, c = F.col("n_trades").cast("double"), F.col("__hits").cast("double")
    dot = lambda a, b: sum((F.col(f"__{a}{i}").cast("double") * F.col(f"__{b}{i}") for i in (1, 2)), F.col(f"__{a}0").cast("double") * F.col(f"__{b}0"))
    both = F.sqrt((s * s - dot("p", "p")) * (s * s - dot("r", "r")))
    return x.select(
        *own, "n_rows", "n_pnl", "n_trades", (F.col("n_trades") / F.col("n_rows")).alias("turnover"), "effective_trades", "gross_pnl", "net_pnl", (F.col("gross_pnl") - F.col("net_pnl")).alias("cost_wall"),
        ratio("__t", "__vt", F.col("__n")).alias("trade_sharpe"), ratio("__a", "__va", F.col("n_pnl")).alias("sample_sharpe"),
        skew.alias("skew"), F.when((n > 3) & (m2 > 0), kurt).otherwise(3.0).alias("kurt"), F.when((s > 1) & (both > 0), (c * s - dot("p", "r")) / both).otherwise(0.0).alias("mcc"),
    )


def _pbo(rows: DataFrame, pnl: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``keys, pbo`` (null: too few rows) over the candidates ``id`` of ``pnl``. Blocks come from ranks of bare row numbers; other rows look up where each begins."""
    blocks = cv.block_index(rows.select(*keys, "t_event", "row"), PBO_BLOCKS, width, keys, ["row"])
    starts = blocks.groupBy(*keys, "block").agg(F.min(F.struct("t_event", "row")).alias("lo"), F.count("*").alias("n")).groupBy(*keys).agg(F.sort_array(F.collect_list("lo")).alias("los"), F.sum("n").alias("n_finite"))
    starts = materialize(starts)
    here = F.expr("cast(size(filter(los, s -> s <= struct(t_event, row))) - 1 as bigint)")
    x = pnl.join(F.broadcast(starts.select(*keys, "los")), keys).withColumn("block", here)  # one row per key
    perf = x.groupBy(*keys, "block", "id").agg(F.sum(F.col("uniqueness") * F.col("pnl")).alias("swp"), F.sum("uniqueness").alias("sw"))
    p = cv.pbo_logits(perf, PBO_BLOCKS, "id", keys).groupBy(*keys).agg(F.avg((F.col("logit") < 0).cast("double")).alias("pbo"))
    return starts.join(p, keys, "left").select(*keys, F.when(F.col("n_finite") >= PBO_ROWS, F.col("pbo")).alias("pbo"))


def _bands(rows: DataFrame, found: list, ids: dict, keys: list[str], control: str, combined: str, band: Band, width: int) -> DataFrame:
    """For every key, the combined arm's best boosted candidate against the control's with the same configuration: paired difference and its bootstrap band."""
    out = []
    for key in dict.fromkeys(tuple(r[c] for c in keys) for r in found):
        pool = [r for r in found if tuple(r[c] for c in keys) == key and r["arm"] == combined and r["config"] in RUNGS]
        best = max(pool, key=lambda r: (r["net_pnl"] if r["net_pnl"] is not None else float("-inf"), -r["id"]))
        twin = ids[control, best["variant"], best["config"]]
        x = rows.where(reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(keys, key)], F.lit(True)))
        x = x.select("t_event", "row", *COLUMNS, F.col("fs")[best["id"]].alias("fa"), F.col("fs")[twin].alias("fb"))
        series = materialize(E.numbered(x, ["t_event", "row"], E.net_pnl("fa")["pnl"] - E.net_pnl("fb")["pnl"], width))
        edges = E.bootstrap_band(E.block_bootstrap(series, n_boot=band.n_boot, block=band.block, seed=band.seed), band.alpha).first()
        low, high = edges["band_low"], edges["band_high"]
        out.append((*key, best["id"], series.agg(F.sum("p")).first()[0], low, high, bool(low is not None and low > 0)))
    types = dict(rows.dtypes)
    return rows.sparkSession.createDataFrame(out, ", ".join([*[f"{c} {types[c]}" for c in keys], "combined_id int", "delta_net_pnl double", "band_low double", "band_high double", "beats_control boolean"]))


def run_arms_study(
    matrix: DataFrame, arms: Mapping[str, Sequence[str]], *, control: str, combined: str, n_groups: int, k: int, embargo_ns: int, max_lookback_ns: int, keys: Sequence[str] = ("horizon",),
    label: str = "label", variants: Mapping[str, Mapping[str, Sequence[str]]] = {}, boost: BoostParams = BoostParams(), gate: Gate = Gate(), band: Band = Band(), width: int = DAY_NS,
) -> tuple[DataFrame, DataFrame]:
    """Every candidate (arm, variant, configuration) of every key with its figures and verdict, and its figures by regime.

    The ladder is naive (once per arm), ridge and the boosted rungs. The Sharpe ratio is deflated by all candidates of all arms and keys and
    ``gate.extra_trials`` earlier ones, spread over the key's own; the probability of overfitting takes the candidates of all arms, and one naive column. A key passes
    if a boosted candidate outside the control passes alone, the combined arm beats the control beyond the noise band, and overfitting is improbable
    enough; without that probability it is inconclusive. Rows without outcome, cost, weight or instant are no evidence for band and overfitting.
    """
    keys = list(keys)
    check_lookback(matrix, embargo_ns=embargo_ns, max_lookback_ns=max_lookback_ns)
    sets = feature_sets(arms, control, combined, variants)
    features = list(dict.fromkeys(c for _, _, cs in sets for c in cs))
    keep = [c for c in dict.fromkeys([*COLUMNS, label, *features]) if c not in keys]
    g = cv.split_groups(matrix, n_groups=n_groups, k=k, embargo_ns=embargo_ns, keys=keys, keep=keep, width=width)
    g = materialize(g.withColumn("row", F.monotonically_increasing_id()))  # the same rows for every arm
    x = _boosted(g, sets, n_groups=n_groups, k=k, keys=keys, params=boost, label=label)
    forecasts: dict[tuple, Column] = {(a, "base", "naive"): F.lit(0.0) for a in arms}
    for i, (arm, variant, cs) in enumerate(sets):
        models = cv.ridge_models(g, cs, n_groups=n_groups, k=k, keys=keys)
        models = models.select(*keys, "grp", F.struct("intercept", *[f"b{j}" for j in range(len(cs))]).alias(f"__r{i}"))
        x = x.join(F.broadcast(models), [*keys, "grp"], "left")  # one row per key and group
        f = sum((F.col(f"__r{i}.b{j}") * F.col(c) for j, c in enumerate(cs)), F.col(f"__r{i}.intercept"))
        forecasts[arm, variant, "ridge"] = F.when(F.col(f"__r{i}").isNull(), 0.0).otherwise(f)
        for j, rung in enumerate(RUNGS):
            forecasts[arm, variant, rung] = F.col("forecasts")[2 * i + j]
    names = sorted(forecasts)  # the order that decides ties
    ids = {name: i for i, name in enumerate(names)}
    rows = materialize(x.select(*keys, "t_event", "row", *COLUMNS, F.array(*[forecasts[n].cast("double") for n in names]).alias("fs")))
    long = rows.select(*keys, "t_event", "row", *COLUMNS, F.posexplode("fs").alias("id", "f")).withColumns(E.net_pnl()).withColumn("traded", F.coalesce("traded", F.lit(False)))

    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("t_event", *COLUMNS[:4])]) & ~F.isnan("y_fwd_bps")
    one_naive = [i for (a, _, config), i in ids.items() if config != "naive" or a == control]
    p = _pbo(rows.where(known), long.where(known & F.col("id").isin(one_naive)), keys, width)
    named = rows.sparkSession.createDataFrame([(i, *n) for n, i in ids.items()], "id int, arm string, variant string, config string")
    c = materialize(figures(long, [*keys, "id"]).join(F.broadcast(named), "id"))
    bands = _bands(rows.where(known), c.collect(), ids, keys, control, combined, band, width)  # a row per candidate and key

    spread = c.groupBy(*keys).agg((F.stddev_pop("trade_sharpe") + 1e-9).alias("sd"))
    count = c.agg(F.greatest(F.lit(2), F.count("*") + gate.extra_trials).alias("n_trials"))
    naive = c.where("config = 'naive'").select(*keys, "arm", F.col("net_pnl").alias("naive_net"))
    c = c.join(spread, keys).crossJoin(F.broadcast(count)).join(naive, [*keys, "arm"]).join(p, keys, "left").join(bands, keys)
    c = c.withColumn("dsr", deflated_sharpe(F.col("trade_sharpe"), F.col("sd"), F.col("n_trials"), E.dsr_sample_count(F.col("effective_trades")), F.col("skew"), F.col("kurt")))
    limits = {"dsr_min": gate.dsr_min, "min_trades": gate.min_trades, "min_effective": gate.min_effective, "min_sharpe": gate.min_sharpe, "pbo_max": gate.pbo_max}
    c = E.gate_verdict(c.withColumn("name", F.concat_ws("/", "arm", "variant", "config")), **limits, keys=keys).drop("is_winner", "verdict", "name")
    can = F.col("passes_solo") & F.col("config").isin(*RUNGS) & (F.col("arm") != control)
    ready = F.max(can).over(W.partitionBy(*keys)) & F.col("beats_control")  # a handful of candidates
    verdict = F.when(ready & (F.col("pbo") < gate.pbo_max), "pass").when(ready & F.col("pbo").isNull(), "inconclusive").otherwise("fail")
    c = c.withColumn("verdict", verdict).withColumn("__can", can & (F.col("verdict") == "pass"))
    first = F.row_number().over(W.orderBy(F.desc("__can"), F.desc("net_pnl"), *keys, "id")) == 1
    c = c.withColumn("is_winner", first & F.col("__can")).drop("__can", "sd", "naive_net")
    regimes = figures(long, [*keys, "id", "regime"]).join(F.broadcast(named), "id")
    return materialize(c), regimes.select(*keys, "arm", "variant", "config", "regime", "net_pnl", "sample_sharpe", F.col("n_pnl").alias("n"))
