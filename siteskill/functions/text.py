"""String expressions on site metadata and settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def koeppen_code(label: str | Column) -> Column:
    """`"Cfb - temperate"` gives `"Cfb"`."""
    return F.split(_c(label), " - ")[0]


def hemisphere(lat: str | Column) -> Column:
    """North for positive latitudes; the equator counts as south, an unknown latitude stays null."""
    lat = _c(lat)
    return F.when(lat.isNull(), None).when(lat > 0, "north").otherwise("south")


def climate_zone(code: str | Column, side: str | Column) -> Column:
    """Label `code hemisphere`; a missing part shows as NA so that two zones never share a label."""
    return F.concat_ws(" ", F.coalesce(_c(code), F.lit("NA")), F.coalesce(_c(side), F.lit("NA")))


def source_tokens(source: str) -> list[str]:
    """Parts of a benchmark source name, such as `"fluxnet"` or `"fluxnet_daily"`."""
    return source.split("_")
