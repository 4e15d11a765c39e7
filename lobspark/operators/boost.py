"""Gradient boosting on histograms, for all splits and keys at once.

Features are cut into bins once. A level of a tree needs only the sums of gradients by (model, node, feature, bin), so one
grouped aggregation grows that level in every model: each key × split, and in each the regression tree and one tree per
class. Jobs per round depend on the depth alone, not on how many models there are. Tasks sum their rows first and give
out sums; the best cut of every node is chosen in SQL and only the chosen cuts come to the driver.

Rows of one model with the same bins and label always have the same score, so before the first tree they become one row with their
summed weight, weighted mean outcome and count: gradients are linear in them, and rounds cost what distinct rows cost. A model that
has at most ``IN_TASK`` bins left (rows × features) fits into one task, which grows all its trees; a job a level would cost more than
the level. Larger ones grow as said above.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.operators.stats import quantiles
from lobspark.session import materialize

#: Outputs of a model: the regression, then the scores of down, flat and up.
CLASSES = (-1, 0, 1)
OUTPUTS = 1 + len(CLASSES)
#: Rounds after which scores are stored; until then tasks add the trees since.
STORE_EVERY = 10
#: Bins (summed rows × features) of a model up to which one task grows it.
IN_TASK = 1_000_000


@dataclass(frozen=True)
class BoostParams:
    trees: int = 200
    depth: int = 5
    step: float = 0.05
    bins: int = 32
    min_rows: int = 50  # on either side of a cut
    min_hessian: float = 1e-3


@dataclass
class Trees:
    """Cuts and leaf values by (model, output, node); node 0 is the root, 2i + 1 and 2i + 2 follow node i; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, models: int, depth: int) -> Trees:
        shape = (models, OUTPUTS, 2 ** (depth + 1) - 1)
        return cls(np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape))

    def nodes(self, model: np.ndarray, bins: np.ndarray, output: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
        """Node of each row after some levels, and whether it is that deep."""
        node, open_, row = np.zeros(len(model), np.int64), np.ones(len(model), bool), np.arange(len(model))
        for _ in range(levels):
            f = self.feature[model, output, node]
            open_ &= f >= 0
            right = bins[row, np.maximum(f, 0)] > self.cut[model, output, node]
            node = np.where(open_, 2 * node + 1 + right, node)
        return node, open_


@dataclass
class Ensemble:
    """Models in the order of ``names`` (rows of keys and split), their starting scores, scale of the class score, and trees."""

    names: list[tuple]
    start: np.ndarray
    scale: np.ndarray
    params: BoostParams
    trees: list[Trees] = field(default_factory=list)


def cut_points(rows: DataFrame, keys: Sequence[str], features: Sequence[str], bins: int) -> DataFrame:
    """One row per key with the cut points of every feature (``__e0``, ``__e1``, …): exact quantiles inside each of ``keys``."""
    probs = {f"q{i}": i / bins for i in range(1, bins)}
    cuts = quantiles(rows, list(keys), {f"c{j}": F.col(c) for j, c in enumerate(features)}, probs)
    return cuts.select(*keys, *[F.array(*[f"c{j}_{q}" for q in probs]).alias(f"__e{j}") for j in range(len(features))])


def placed(rows: DataFrame, cuts: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``bins``: for every feature the number of its cut points below the value; null: 0."""
    keys = list(keys)
    # one row of cut points per key; the rows look small to Spark where they compress well, so the side to send is named
    x = rows.join(F.broadcast(cuts), keys) if keys else rows.crossJoin(F.broadcast(cuts))
    place = [F.expr(f"case when `{c}` is null then 0 else size(filter(__e{j}, e -> e < cast(`{c}` as double))) end") for j, c in enumerate(features)]
    return x.withColumn("bins", F.array(*[p.cast("int") for p in place])).drop(*[f"__e{j}" for j in range(len(features))])


def binned(rows: DataFrame, keys: Sequence[str], features: Sequence[str], bins: int) -> DataFrame:
    """``bins`` of the rows by cut points that are exact quantiles of these rows inside each of ``keys``."""
    return placed(rows, cut_points(rows, keys, features, bins), keys, features)


def _matrix(b: pa.RecordBatch, name: str, kind) -> np.ndarray:
    return np.asarray(b[name].flatten(), dtype=kind).reshape(b.num_rows, -1)


def _gradients(y: np.ndarray, label: np.ndarray, w: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted gradients and hessians of squared error and of the softmax loss, by row and output."""
    g, h = np.empty_like(score), np.empty_like(score)
    g[:, 0], h[:, 0] = w * (score[:, 0] - y), w
    e = np.exp(score[:, 1:] - score[:, 1:].max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    k = len(CLASSES)
    g[:, 1:] = w[:, None] * (p - (label[:, None] == np.array(CLASSES)))
    h[:, 1:] = w[:, None] * p * (1 - p) * k / (k - 1)
    return g, h


def _add(sums: np.ndarray, trees: Trees, model: np.ndarray, x: np.ndarray, values: tuple[np.ndarray, ...], level: int, bins: int) -> None:
    """Add gradients, hessians and counts of rows to ``sums`` by output, feature and (model, node, bin)."""
    g, h, n = values
    first, width = 2**level - 1, 2**level
    for o in range(OUTPUTS):
        node, deep = trees.nodes(model, x, o, level)
        cell = ((model * width + node - first) * bins)[deep]
        for j in range(x.shape[1]):
            at = cell + x[deep, j]
            for q, v in enumerate((g[deep, o], h[deep, o], n[deep])):
                sums[q, o, j] += np.bincount(at, weights=v, minlength=sums.shape[3])


def _histograms(trees: Trees, level: int, bins: int, pending: list[Trees], depth: int, step: float):
    first, width = 2**level - 1, 2**level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, d = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            x, score = _matrix(b, "bins", np.int64), _matrix(b, "score", float)
            model = b["model"].to_numpy(zero_copy_only=False)
            y, label, w, n = (b[c].to_numpy(zero_copy_only=False) for c in ("y", "label", "w", "n"))
            if pending:
                score = _apply(pending, depth, step)(b, score.copy())
            g, h = _gradients(y, label, w, score)
            d = x.shape[1]
            shape = (OUTPUTS, d, trees.feature.shape[0] * width * bins)
            sums = np.zeros((3, *shape)) if sums is None else sums
            _add(sums, trees, model, x, (g, h, n), level, bins)
        if sums is not None:
            o, j, cell = np.nonzero(sums[2])
            g, h, n = sums[:, o, j, cell]
            columns = [cell // (width * bins), o, cell // bins % width + first, j, cell % bins]
            for i in range(0, len(o), 50_000):
                s = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([*[pa.array(c[s].astype(np.int32)) for c in columns], pa.array(g[s]), pa.array(h[s]), pa.array(n[s].astype(np.int64))], names=["model", "output", "node", "feature", "bin", "g", "h", "n"])

    return run


def node_sums(rows: DataFrame, trees: Trees, level: int, bins: int, pending: Sequence[Trees] = (), step: float = 0.0) -> DataFrame:
    """``model, output, node, feature, bin, g, h, n`` of one level; rows: ``model, bins, y, label, w, n, score``; ``pending``: trees that the score lacks."""
    depth = (trees.feature.shape[2] + 1).bit_length() - 2
    run = _histograms(trees, level, bins, list(pending), depth, step)
    cells = rows.select("model", "bins", "y", "label", "w", "n", "score").mapInArrow(run, "model int, output int, node int, feature int, bin int, g double, h double, n long")
    # tasks have summed their rows; one exchange by node serves these sums and the choice of the cut
    cells = cells.repartition("model", "output", "node")
    return cells.groupBy("model", "output", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def best_cuts(cells: DataFrame, params: BoostParams) -> DataFrame:
    """Every node's best cut (rows with bin <= cut go left), with the sums of both sides; ``gain`` null: none is allowed."""
    over = "over (partition by model, output, node, feature order by bin)"
    whole = "over (partition by model, output, node, feature)"
    x = cells.selectExpr("*", *[f"sum({c}) {over} as {c}l" for c in "ghn"], *[f"sum({c}) {whole} as {c}a" for c in "ghn"])
    x = x.selectExpr("*", "ga - gl as gr", "ha - hl as hr", "na - nl as nr")
    ok = f"nl >= {params.min_rows} and nr >= {params.min_rows} and hl >= {params.min_hessian} and hr >= {params.min_hessian}"
    x = x.withColumn("gain", F.expr(f"case when {ok} then round(gl * gl / hl + gr * gr / hr - ga * ga / ha, 6) end"))
    pick = "struct(coalesce(gain, -1D) as gain, -feature as feature, -bin as bin, gl, hl, gr, hr, ga, ha)"
    best = x.groupBy("model", "output", "node").agg(F.max(F.expr(pick)).alias("b"))
    return best.selectExpr("model", "output", "node", "case when b.gain > 0 then b.gain end as gain", "-b.feature as feature", "-b.bin as cut", "b.gl", "b.hl", "b.gr", "b.hr", "b.ga", "b.ha")


def _apply(trees: list[Trees], depth: int, step: float):
    def scores(b: pa.RecordBatch, score: np.ndarray) -> np.ndarray:
        x, model = _matrix(b, "bins", np.int64), b["model"].to_numpy(zero_copy_only=False)
        for t in trees:
            for o in range(OUTPUTS):
                node, _ = t.nodes(model, x, o, depth)
                score[:, o] += step * t.value[model, o, node]
        return score

    return scores


def _listed(score: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, score.size + 1, score.shape[1], dtype=np.int32), pa.array(score.ravel()))


def started(train: DataFrame, keys: Sequence[str], params: BoostParams) -> tuple[Ensemble, DataFrame | None]:
    """Models without trees yet, and the rows with their model's number and starting scores; see ``fit_boosted``."""
    share = [F.sum(F.when(F.col("label") == c, F.col("w")).otherwise(0.0)).alias(f"s{i}") for i, c in enumerate(CLASSES)]
    sums = train.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("mean"), F.stddev_pop("y").alias("sd"), F.sum("w").alias("sw"), *share)
    return _started(sums, train.select(*keys, "bins", "label", "w", (F.col("w") * F.col("y")).alias("wy"), F.lit(1).alias("n")), keys, params)


def started_cells(cells: DataFrame, keys: Sequence[str], params: BoostParams) -> tuple[Ensemble, DataFrame | None]:
    """``started`` from rows that stand for several: keys, ``bins, label, w`` (Σ w), ``wy`` (Σ w·y), ``n``, and ``d1, d2`` (Σ and Σ² of y less a constant of the key)."""
    share = [F.sum(F.when(F.col("label") == c, F.col("w")).otherwise(0.0)).alias(f"s{i}") for i, c in enumerate(CLASSES)]
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum("d2") / F.sum("n") - F.pow(F.sum("d1") / F.sum("n"), 2)))
    sums = cells.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("wy") / F.sum("w")).alias("mean"), spread.alias("sd"), F.sum("w").alias("sw"), *share)
    return _started(sums, cells.select(*keys, "bins", "label", "w", "wy", "n"), keys, params)


def _started(sums: DataFrame, summed: DataFrame, keys: Sequence[str], params: BoostParams) -> tuple[Ensemble, DataFrame | None]:
    keys = list(keys)
    k = len(CLASSES)
    facts = sums.orderBy(*keys).collect()  # one row per key and split
    names = [tuple(r[c] for c in keys) for r in facts]
    start, scale = np.zeros((len(names), OUTPUTS)), np.zeros(len(names))
    usable = [i for i, r in enumerate(facts) if r["n"] >= 2 and r["sw"] > 0]
    for i in usable:
        s = np.array([facts[i][f"s{c}"] for c in range(k)])
        start[i] = [facts[i]["mean"], *np.log(np.maximum(s / facts[i]["sw"], 1e-15))]
        scale[i] = facts[i]["sd"] + 1e-9 if (s > 0).sum() > 1 else 0.0
    fit = Ensemble(names, start, scale, params)
    if not names:
        return fit, None
    types = dict(summed.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in keys], "model int", "score array<double>"])
    numbered = summed.sparkSession.createDataFrame([(*names[i], i, start[i].tolist()) for i in usable], schema)
    # one row per model; its size is unknown to Spark, which would else send the training rows through the driver
    x = summed.join(F.broadcast(numbered), keys).groupBy("model", "bins", "label")
    x = x.agg(F.first("score").alias("score"), F.sum("w").alias("w"), F.sum("wy").alias("wy"), F.sum("n").alias("n"))
    return fit, materialize(x.select("model", "bins", F.when(F.col("w") > 0, F.col("wy") / F.col("w")).otherwise(0.0).alias("y"), "label", "w", "n", "score"))


def _cut(t: Trees, sums: np.ndarray, level: int, params: BoostParams) -> bool:
    """``best_cuts`` of one model in a task, written into ``t``; ``sums``: (g, h, n) by output, feature, node of the level, bin. False: no cut is left."""
    left = sums.cumsum(axis=-1)
    every = left[..., -1:]
    right = every - left
    ok = ((left[2] >= params.min_rows) & (right[2] >= params.min_rows) & (left[1] >= params.min_hessian) & (right[1] >= params.min_hessian))
    part = lambda s: s[0] ** 2 / np.where(ok, s[1], 1.0)
    gain = np.where(ok, np.round(part(left) + part(right) - part(np.broadcast_to(every, left.shape)), 6), -1.0)
    out, d, width, bins = gain.shape
    best = gain.transpose(0, 2, 1, 3).reshape(out, width, d * bins).argmax(axis=-1)  # the first one: smallest feature, then smallest bin
    if level == 0:
        g, h = every[0, :, 0, 0, 0], every[1, :, 0, 0, 0]
        t.value[0, :, 0] = np.where(h > 0, -g / np.where(h > 0, h, 1.0), 0.0)
    o, node = np.nonzero(np.take_along_axis(gain.transpose(0, 2, 1, 3).reshape(out, width, d * bins), best[..., None], -1)[..., 0] > 0)
    feature, cut = np.divmod(best[o, node], bins)
    at = 2**level - 1 + node
    t.feature[0, o, at], t.cut[0, o, at] = feature, cut
    for side, child in ((left, 1), (right, 2)):
        g, h = side[:2, o, feature, node, cut]
        t.value[0, o, 2 * at + child] = -g / h
    return len(o) > 0


def _grown(params: BoostParams):
    """All trees of one model from its rows: ``model, tree, feature, cut, value``, one row per tree."""

    def run(rows: pa.Table) -> pa.Table:
        b = rows.combine_chunks().to_batches()[0]
        x, score = _matrix(b, "bins", np.int64), _matrix(b, "score", float).copy()
        y, label, w, n = (b[c].to_numpy(zero_copy_only=False) for c in ("y", "label", "w", "n"))
        model, out = np.zeros(len(x), np.int64), []
        for _ in range(params.trees):
            t, values = Trees.empty(1, params.depth), (*_gradients(y, label, w, score), n)
            for level in range(params.depth):
                sums = np.zeros((3, OUTPUTS, x.shape[1], 2**level * params.bins))
                _add(sums, t, model, x, values, level, params.bins)
                if not _cut(t, sums.reshape(*sums.shape[:3], 2**level, params.bins), level, params):
                    break
            for o in range(OUTPUTS):
                score[:, o] += params.step * t.value[0, o, t.nodes(model, x, o, params.depth)[0]]
            out.append(t)
        flat = [pa.array([getattr(t, c)[0].ravel().tolist() for t in out], pa.list_(kind)) for c, kind in (("feature", pa.int32()), ("cut", pa.int32()), ("value", pa.float64()))]
        return pa.table([pa.array([b["model"][0].as_py()] * len(out), pa.int32()), pa.array(range(len(out)), pa.int32()), *flat], names=["model", "tree", "feature", "cut", "value"])

    return run


def fit_boosted(train: DataFrame, keys: Sequence[str], params: BoostParams) -> Ensemble:
    """One ensemble for all of ``keys`` (with the split among them). ``train``: keys, ``bins, y, label, w``.

    Models start from the weighted mean and the log shares of the classes. A model of fewer than two rows stays at zero, one of a single
    class gives no class score.
    """
    return grown(*started(train, keys, params), params)


def grown(fit: Ensemble, rows: DataFrame | None, params: BoostParams) -> Ensemble:
    """The ensemble with its trees; ``fit, rows`` as ``started`` gives them."""
    if rows is None:
        return fit
    fit.trees = [Trees.empty(len(fit.names), params.depth) for _ in range(params.trees)]
    sizes = rows.groupBy("model").agg((F.count("*") * F.max(F.size("bins"))).alias("n")).collect()  # one row per model
    small, large = ([r["model"] for r in sizes if (r["n"] <= IN_TASK) == fits] for fits in (True, False))
    if small:
        trees = rows.where(F.col("model").isin(small)).groupBy("model").applyInArrow(_grown(params), "model int, tree int, feature array<int>, cut array<int>, value array<double>")
        for r in trees.collect():  # the trees: a row per model and round
            t = fit.trees[r["tree"]]
            for c in ("feature", "cut", "value"):
                at = getattr(t, c)
                at[r["model"]] = np.reshape(r[c], at.shape[1:])
    if large:
        _grow_levels(rows.where(F.col("model").isin(large)), fit, params)
    return fit


def _grow_levels(rows: DataFrame, fit: Ensemble, params: BoostParams) -> None:
    """Trees of the models in ``rows``, one job a level for all of them."""
    pending = []
    for t in fit.trees:
        for level in range(params.depth):
            cuts = best_cuts(node_sums(rows, t, level, params.bins, pending, params.step), params).collect()  # one row per open node
            for c in cuts:
                at = (c["model"], c["output"], c["node"])
                if level == 0:
                    t.value[at] = -c["ga"] / c["ha"] if c["ha"] > 0 else 0.0
                if c["gain"] is not None:
                    t.feature[at], t.cut[at] = c["feature"], c["cut"]
                    t.value[at[0], at[1], 2 * at[2] + 1], t.value[at[0], at[1], 2 * at[2] + 2] = -c["gl"] / c["hl"], -c["gr"] / c["hr"]
            if not any(c["gain"] is not None for c in cuts):
                break
        pending.append(t)
        if len(pending) < STORE_EVERY:
            continue
        add = _apply(pending, params.depth, params.step)

        def grown(batches: Iterator[pa.RecordBatch], add=add) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield b.set_column(b.schema.get_field_index("score"), "score", _listed(add(b, _matrix(b, "score", float).copy())))

        rows, pending = materialize(rows.mapInArrow(grown, rows.schema)), []


def boosted_forecast(rows: DataFrame, fit: Ensemble, keys: Sequence[str]) -> DataFrame:
    """``rows`` (keys, ``bins``) with ``f_reg`` (bps) and ``f_clf``: (P(up) − P(down)) times the training spread of y; models that were not fitted give 0."""
    keys = list(keys)
    if not fit.names:
        return rows.withColumns({"f_reg": F.lit(0.0), "f_clf": F.lit(0.0)})
    types = dict(rows.dtypes)
    numbered = rows.sparkSession.createDataFrame([(*x, i) for i, x in enumerate(fit.names)], ", ".join([*[f"{c} {types[c]}" for c in keys], "model int"]))
    x = rows.join(F.broadcast(numbered), keys, "left").withColumn("model", F.coalesce("model", F.lit(-1)))
    add = _apply(fit.trees, fit.params.depth, fit.params.step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            model = b["model"].to_numpy(zero_copy_only=False)
            score = add(b, fit.start[model].copy())
            e = np.exp(score[:, 1:] - score[:, 1:].max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            known = model >= 0
            out = [np.where(known, score[:, 0], 0.0), np.where(known, (p[:, -1] - p[:, 0]) * fit.scale[model], 0.0)]
            keep = [c for c in b.schema.names if c != "model"]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], *map(pa.array, out)], names=[*keep, "f_reg", "f_clf"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields if f.name != "model"], "f_reg double", "f_clf double"])
    return x.mapInArrow(run, schema)


def mean_forecasts(rows: DataFrame, fit: Ensemble, keys: Sequence[str], firsts: Sequence[tuple], tests: Sequence[Sequence[int]]) -> DataFrame:
    """``rows`` (keys, ``grp, bins``) with ``forecasts``: for each of ``firsts`` (what precedes the keys in a model's name), ``f_reg`` and ``f_clf`` of
    ``boosted_forecast``, averaged over ``tests[grp]``, the splits that test the row. Rows are not copied per split; equal ones of a batch are forecast once.
    """
    keys, at = list(keys), {x: i for i, x in enumerate(fit.names)}
    add = _apply(fit.trees, fit.params.depth, fit.params.step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes: dict[tuple, int] = {}
            code = [codes.setdefault(x, len(codes)) for x in zip(*[b[c].to_pylist() for c in [*keys, "grp"]])]
            cells, back = np.unique(np.column_stack([code, _matrix(b, "bins", np.int64)]), axis=0, return_inverse=True)
            named, out = list(codes), np.zeros((len(cells), 2 * len(firsts)))
            for i, first in enumerate(firsts):
                for j in range(len(tests[0])):
                    model = np.array([at.get((*first, *x[:-1], tests[x[-1]][j]), -1) for x in named])[cells[:, 0]]
                    known = model >= 0
                    one = pa.RecordBatch.from_arrays([_listed(cells[:, 1:]), pa.array(model)], names=["bins", "model"])
                    score = add(one, fit.start[model].copy()) if len(fit.names) else np.zeros((len(cells), OUTPUTS))
                    e = np.exp(score[:, 1:] - score[:, 1:].max(axis=1, keepdims=True))
                    p = e / e.sum(axis=1, keepdims=True)
                    out[:, 2 * i] += np.where(known, score[:, 0], 0.0)
                    out[:, 2 * i + 1] += np.where(known, (p[:, -1] - p[:, 0]) * (fit.scale[model] if len(fit.names) else 0.0), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, _listed(out[back.ravel()] / len(tests[0]))], names=[*b.schema.names, "forecasts"])

    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields], "forecasts array<double>"]))


#: Rungs of the ladder that this module fits.
RUNGS = {"gbt_reg": "f_reg", "gbt_clf": "f_clf"}


def boosted_ladder(splits: DataFrame, *, keys: Sequence[str], features: Sequence[str], own: Sequence[str], times: int, params: BoostParams, y: str = "y_fwd_bps", label: str = "label", w: str = "uniqueness") -> DataFrame:
    """Out-of-sample forecasts of the boosted rungs, averaged over the ``times`` splits that test a row: ``own, f, model``.

    ``splits``: every row × split with its role (``cpcv_splits``), the features, outcome, label and weight.
    """
    keys = list(keys)
    x = materialize(binned(splits, keys, features, params.bins))
    named = x.select(*keys, "split", "bins", F.col(y).cast("double").alias("y"), F.col(label).cast("int").alias("label"), F.col(w).cast("double").alias("w"), "role")
    fit = fit_boosted(named.where("role = 'train'").drop("role"), [*keys, "split"], params)
    f = boosted_forecast(x.where("role = 'test'").select("split", "bins", *dict.fromkeys([*keys, *own])), fit, [*keys, "split"])
    f = f.groupBy(*own).agg(*[F.avg(c).alias(c) for c in RUNGS.values()], (F.count("*") == times).alias("complete"))
    cases = F.array(*[F.struct(F.lit(name).alias("model"), F.col(c).alias("f")) for name, c in RUNGS.items()])
    return f.select(*own, "complete", F.explode(cases).alias("x")).select(*own, "complete", "x.f", "x.model")
