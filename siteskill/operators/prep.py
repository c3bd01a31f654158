"""Quality filters, site selection and forcing columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units
from ..functions.calendar import first_day, is_leap_day, last_day_of_year
from ..functions.nulls import finite, not_in, not_true, skip_sum

# Land-use classes left out of an evaluation, the quality floor, code spellings.
EXCLUDED_LAND_USE = ("CRO", "WET")
QUALITY_FLOOR = 0.8
KOEPPEN_SPELLING = {"BSh": "Bsh", "BWh": "Bwh", "BSk": "Bsk"}


def quality_filter(df: DataFrame, qc: str = "gpp_qc", keep: Sequence[str] = ("date", "gpp"), floor: float = QUALITY_FLOOR) -> DataFrame:
    """Rows above the quality floor; a null quality does not pass."""
    return df.where(F.col(qc) > floor).select(*keep)


def c3_sites(sites: DataFrame, flag: str = "c4") -> DataFrame:
    """Sites not flagged, including those whose flag is unknown."""
    return sites.where(not_true(flag))


def drop_all_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without the rows in which every named column is null."""
    return df.dropna(how="all", subset=list(columns))


def undropped(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows whose drop flags are all known and false. A flag is a boolean or the text `FALSE`."""
    for flag in flags:
        df = df.where(F.upper(F.col(flag).cast("string")) == "FALSE")
    return df


def select_sites(
    sites: DataFrame, land_use: str = "igbp_land_use", excluded: Sequence[str] = EXCLUDED_LAND_USE,
    drop_flags: Sequence[str] = (),
) -> DataFrame:
    """Sites outside the excluded land uses that no flag drops."""
    return undropped(sites.where(not_in(land_use, list(excluded))), drop_flags)


def recode(df: DataFrame, column: str = "koeppen_code", spelling: Mapping[str, str] = KOEPPEN_SPELLING) -> DataFrame:
    return df.replace(dict(spelling), subset=[column])


def year_window(
    df: DataFrame, windows: DataFrame, bounds: Sequence[tuple[str, str]], date: str = "date", key: str = "sitename"
) -> DataFrame:
    """Rows whose year lies inside every (first, last) window of their site."""
    columns = [c for pair in bounds for c in pair]
    joined = df.join(windows.select(key, *columns), key)
    for first, last in bounds:
        joined = joined.where(F.year(date).between(F.col(first), F.col(last)))
    return joined.drop(*columns)


def date_window(df: DataFrame, windows: DataFrame, first: str, last: str, date: str = "date", key: str = "sitename") -> DataFrame:
    """Rows from January 1 of the site's first year to December 31 of its last."""
    joined = df.join(windows.select(key, first, last), key)
    return joined.where(F.col(date).between(first_day(first), last_day_of_year(last))).drop(first, last)


def exclude_from(df: DataFrame, site: str, year: int, date: str = "date", key: str = "sitename") -> DataFrame:
    """Without one site's rows from a year on."""
    return df.where(~((F.col(key) == site) & (F.year(date) >= year)))


def drop_leap_days(df: DataFrame, date: str = "date") -> DataFrame:
    return df.where(~is_leap_day(date))


def finite_pairs(
    df: DataFrame, x: str, y: str, xlim: tuple[float, float] | None = None, ylim: tuple[float, float] | None = None,
    log: str = "",
) -> DataFrame:
    """Finite pairs inside the axis limits; an axis on a log scale keeps positive values only."""
    out = df.where(finite(x) & finite(y))
    for column, limits, axis in ((x, xlim, "x"), (y, ylim, "y")):
        if limits:
            out = out.where(F.col(column).between(*limits))
        if axis in log:
            out = out.where(F.col(column) > 0)
    return out


def water_balance_sites(
    df: DataFrame, rain: str = "rain", et: Column | None = None, key: str = "sitename"
) -> DataFrame:
    """Per site the totals of rain and evapotranspiration, for sites that do not evaporate more than falls."""
    et = units.evapotranspiration("le", "temp", "patm") if et is None else et
    totals = df.groupBy(key).agg(
        skip_sum(units.per_second_to_per_day(rain)).alias("rain_total"), skip_sum(et).alias("et_total")
    )
    return totals.where(~(F.col("et_total") > F.col("rain_total")))


def forcing_per_second(df: DataFrame, columns: Sequence[str] = ("prec", "ppfd")) -> DataFrame:
    """Daily totals as fluxes per second."""
    return df.withColumns({c: units.per_day_to_per_second(c) for c in columns})


def required_forcing(df: DataFrame) -> DataFrame:
    """Columns a simulation needs that the data lack: all rain liquid, flat daily temperature."""
    return df.withColumns({
        "rainf": F.col("prec"), "snowf": F.lit(0.0), "tmin": F.col("temp"), "tmax": F.col("temp"), "netrad": F.lit(0.0),
    })


def constant_forcing(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    """Override forcing columns by constants."""
    return df.withColumns({c: F.lit(float(v)) for c, v in values.items()})


def tagged(df: DataFrame, column: str, *patterns: str) -> DataFrame:
    """Rows whose tag matches every pattern."""
    for pattern in patterns:
        df = df.where(F.col(column).rlike(pattern))
    return df
