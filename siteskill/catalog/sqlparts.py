"""Pieces of the SQL side that many queries share."""

from __future__ import annotations


def moments(mod: str = "mod", obs: str = "obs") -> str:
    return (
        f"regr_count({obs}, {mod}) AS n, regr_sxx({obs}, {mod}) AS sxx, regr_syy({obs}, {mod}) AS syy, "
        f"regr_sxy({obs}, {mod}) AS sxy, sqrt(avg(({mod} - {obs}) * ({mod} - {obs}))) AS rmse, "
        f"avg({mod} - {obs}) AS bias, count({obs}) AS n_obs, count({mod}) AS n_mod, "
        f"avg(CASE WHEN {mod} IS NOT NULL THEN {obs} END) AS my, avg(CASE WHEN {obs} IS NOT NULL THEN {mod} END) AS mx"
    )


STATS = (
    "CASE WHEN n < 3 THEN NULL WHEN sxx = 0 THEN 0 "
    "ELSE 1 - (1 - sxy * sxy / NULLIF(sxx * syy, 0)) * (n - 1) / NULLIF(n - 2, 0) END AS rsq, "
    "rmse, sxy / NULLIF(sxx, 0) AS slope, bias, n AS nvals, my - sxy / NULLIF(sxx, 0) * mx AS intercept"
)


def stats(table: str, by: str = "", mod: str = "mod", obs: str = "obs", where: str = "true") -> str:
    """`rsq, rmse, slope, bias, nvals` and the group columns."""
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"SELECT {keys}{STATS} FROM (SELECT {keys}{moments(mod, obs)} FROM {table} {group}) WHERE {where}"


def strict(aggregate: str, column: str) -> str:
    return f"CASE WHEN count({column}) = count(*) THEN {aggregate}({column}) END"


def lerp(table: str, keys: str, order: str, columns: list[str], suffix: str = "") -> str:
    """Linear interpolation of inner gaps by row position."""
    part = f"PARTITION BY {keys}"
    known, filled = [], []
    for c in columns:
        known.append(
            f"count({c}) OVER ({part}) AS k_{c}, "
            f"max(CASE WHEN {c} IS NOT NULL THEN rn END) OVER ({part} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p0_{c}, "
            f"min(CASE WHEN {c} IS NOT NULL THEN rn END) OVER ({part} ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1_{c}, "
            f"last_value({c} IGNORE NULLS) OVER ({part} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0_{c}, "
            f"first_value({c} IGNORE NULLS) OVER ({part} ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1_{c}"
        )
        filled.append(
            f"CASE WHEN k_{c} < 2 THEN NULL WHEN {c} IS NOT NULL THEN {c} WHEN p0_{c} IS NULL OR p1_{c} IS NULL THEN NULL "
            f"ELSE v0_{c} + (v1_{c} - v0_{c}) * (rn - p0_{c}) / (p1_{c} - p0_{c}) END AS {c}{suffix}"
        )
    keep = "*" if suffix else f"* EXCLUDE ({', '.join(columns)})"
    return (
        f"SELECT {keep}, {', '.join(filled)} FROM (SELECT *, {', '.join(known)} FROM "
        f"(SELECT *, row_number() OVER ({part} ORDER BY {order}) AS rn FROM {table}))"
    )
