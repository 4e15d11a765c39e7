"""Standard normal distribution as column expressions (Spark has no built-in)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the normal tail (West 2005), highest power first.
TAIL_NUM = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_DEN = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
    793.826512519948, 440.413735824752,
)
# Acklam's rational approximation of the inverse, highest power first.
INV_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
INV_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
INV_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
INV_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661415917, 1.0)
SPLIT = 0.02425


def _poly(coef: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coef[0])
    for c in coef[1:]:
        out = out * x + c
    return out


def _let(c: Column, fn) -> Column:
    """Bind a sub-expression once instead of repeating it in the formula."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def norm_cdf(z: Column) -> Column:
    return _let(z, _cdf)


def _cdf(z: Column) -> Column:
    a = F.abs(z)
    e = F.exp(-a * a / 2.0)
    near = e * _poly(TAIL_NUM, a) / _poly(TAIL_DEN, a)
    frac = a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))
    tail = F.when(a < 7.07106781186547, near).when(a <= 37, e / frac / 2.506628274631).otherwise(0.0)
    return F.when(z > 0, 1.0 - tail).otherwise(tail)


def _guess(p: Column) -> Column:
    def mid(q: Column) -> Column:
        return _let(q * q, lambda r: _poly(INV_A, r) * q / _poly(INV_B, r))

    def side(t: Column) -> Column:
        return _let(F.sqrt(F.log(t) * -2.0), lambda s: _poly(INV_C, s) / _poly(INV_D, s))

    return F.when(p < SPLIT, side(p)).when(p > 1 - SPLIT, -side(1.0 - p)).otherwise(_let(p - 0.5, mid))


def norm_ppf(p: Column) -> Column:
    """Inverse of :func:`norm_cdf`, refined by one Halley step."""

    def refine(x: Column) -> Column:
        err = (norm_cdf(x["x"]) - x["p"]) * 2.5066282746310002 * F.exp(x["x"] * x["x"] / 2.0)
        return _let(F.struct(err.alias("e"), x["x"].alias("x")), lambda v: v["x"] - v["e"] / (v["x"] * v["e"] / 2.0 + 1.0))

    start = _let(p.cast("double"), lambda q: F.struct(q.alias("p"), _guess(q).alias("x")))
    return F.when((p > 0) & (p < 1), _let(start, refine))


GAMMA = 0.5772156649015329
E = 2.718281828459045


def deflated_sharpe(sr: Column, sr_trials_std: Column, n_trials: Column, t: Column, skew: Column, kurt: Column) -> Column:
    """Probability that the Sharpe ratio exceeds the best of ``n_trials`` skill-free trials."""
    sr0 = sr_trials_std * (norm_ppf(1.0 - 1.0 / n_trials) * (1 - GAMMA) + norm_ppf(1.0 - 1.0 / (n_trials * E)) * GAMMA)
    denom = F.sqrt(F.greatest(F.lit(1e-12), 1.0 - skew * sr + (kurt - 1.0) / 4.0 * sr * sr))
    return norm_cdf((sr - sr0) * F.sqrt(F.greatest(t - 1, F.lit(1.0))) / denom)
