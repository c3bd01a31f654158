"""Scores of a model against observations, as aggregate expressions.

All of them come from co-moments over complete pairs, because co-moments are computed in one pass,
combine on the map side and merge across groups. `corr` and `regr_r2` are not used: the first raises
an error and the second returns 1 on constant input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Expressions over the columns of `moment_columns`. R2 is null where either side is constant.
R_SQUARED = "try_divide(sxy * sxy, sxx * syy)"
SLOPE = "try_divide(sxy, sxx)"
INTERCEPT = f"my - {SLOPE} * mx"
MEAN_ERROR = "CASE WHEN n > 0 THEN mx - my END"
RMSE = "CASE WHEN n > 0 THEN sqrt(sdd / nullif(n, 0) + (mx - my) * (mx - my)) END"
CORRELATION = "try_divide(sxy, sqrt(sxx) * sqrt(syy))"
# R2 of obs ~ mod, adjusted for one predictor. A constant model explains nothing: 0.
ADJUSTED_R_SQUARED = (
    f"CASE WHEN n < 3 THEN NULL WHEN sxx = 0 THEN 0D ELSE 1 - (1 - {R_SQUARED}) * (n - 1) / nullif(n - 2, 0) END"
)
REGRESSION = {"rsq": ADJUSTED_R_SQUARED, "rmse": RMSE, "slope": SLOPE, "bias": MEAN_ERROR, "nvals": "n"}


def quoted(name: str) -> str:
    return f"`{name}`"


def moment_columns(mod: str = "mod", obs: str = "obs") -> list[Column]:
    """Pair count, means, centred second moments, and the centred moment of the error.

    Only pairs of finite numbers count: one infinite value would make every score of its group NaN.
    """
    m, o = (f"CASE WHEN abs({quoted(c)}) < double('Infinity') THEN {quoted(c)} END" for c in (mod, obs))
    return [F.expr(e) for e in (
        f"regr_count({o}, {m}) AS n",
        f"avg(CASE WHEN {o} IS NOT NULL THEN {m} END) AS mx",
        f"avg(CASE WHEN {m} IS NOT NULL THEN {o} END) AS my",
        f"regr_sxx({o}, {m}) AS sxx",
        f"regr_syy({o}, {m}) AS syy",
        f"regr_sxy({o}, {m}) AS sxy",
        f"regr_sxx({m} - {o}, {m} - {o}) AS sdd",
    )]


def regression_columns(only_if: str | None = None) -> list[Column]:
    """The statistics row, from the columns that `moment_columns` names.

    With a condition, the scores (not the pair count) are null where it does not hold.
    """
    def shown(name: str, score: str) -> str:
        return score if only_if is None or name == "nvals" else f"CASE WHEN {only_if} THEN {score} END"

    return [F.expr(f"{shown(name, score)} AS {name}") for name, score in REGRESSION.items()]
