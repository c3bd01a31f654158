"""Preparation of the forcing table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.joins import keep_sites
from ..operators.prep import exclude_from, select_sites, undropped, year_window


def prepare_drivers(
    forcing: DataFrame, site_info: DataFrame, site_years: DataFrame, targets: Sequence[str] = ("gpp", "le"),
    exclusions: Sequence[tuple[str, int]] = (),
) -> DataFrame:
    """Forcing rows of the selected sites, in the years good for every target.

    `site_years` has `drop_<target>`, `year_start_<target>` and `year_end_<target>` per site.
    `exclusions` are (site, year) pairs: that site is left out from that year on.
    """
    good = undropped(site_years, [f"drop_{t}" for t in targets])
    kept = keep_sites(good, select_sites(site_info))
    out = year_window(forcing, kept, [(f"year_start_{t}", f"year_end_{t}") for t in targets])
    for site, year in exclusions:
        out = exclude_from(out, site, year)
    return out
