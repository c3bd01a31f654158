"""Runs of a condition and series aligned on their onset."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs
from ..operators.bins import offset_bin
from ..operators.gaps import interpolate
from ..operators.scan import number_chunk
from ..plans.events import align_events, event_response
from .case import Case
from .levels import daily
from .sqlparts import lerp
from .views import flags

MIN_LEN, BEFORE, AFTER, NBINS, NORMBIN = 4, 5, 10, 5, 2
MERGE_ROUNDS = 14


def _flagged(spark, sf, above=60.0, change=lambda df: df):
    df = change(daily(spark, sf))
    return df.select(F.col("sitename").alias("site"), "date", "obs", (F.col("obs") > above).alias("hot"))


def with_null_keys(df):
    """The first site loses its name and every site its first date; the order of the rows stays."""
    first = df.groupBy(F.col("sitename").alias("_site")).agg(F.min("date").alias("_first"))
    joined = df.join(first, F.col("sitename") == F.col("_site"))
    least = df.select("sitename").where("sitename IS NOT NULL").distinct().orderBy("sitename").limit(1)  # a smallest string would be told by sorting
    no_name = F.col("sitename") == least.scalar()
    return joined.withColumns({"sitename": F.when(~no_name, F.col("sitename")), "date": F.nullif("date", "_first")}).drop("_site", "_first")


NULL_KEYS_SQL = """(SELECT * REPLACE (nullif(sitename, (SELECT min(sitename) FROM site_daily)) AS sitename,
                     nullif(date, min(date) OVER (PARTITION BY sitename)) AS date) FROM site_daily)"""


def null_keys(sql: str) -> str:
    """The same query over the series with null keys; a null date comes first."""
    return sql.replace("FROM site_daily)", f"FROM {NULL_KEYS_SQL})").replace("ORDER BY date)", "ORDER BY date NULLS FIRST)")


def indexed_sql(above: float) -> str:
    return f"""(SELECT sitename AS site, date, obs, mod, coalesce(obs > {above}, false) AS hot,
                 row_number() OVER (PARTITION BY sitename ORDER BY date) AS rn FROM site_daily)"""


def runs_sql(above: float, min_len: int) -> str:
    """Gaps and islands by the difference of two row numbers."""
    return f"""
    SELECT site, row_number() OVER (PARTITION BY site ORDER BY start_rn) AS run_id, start_rn, len, start, deficit FROM (
      SELECT site, min(rn) AS start_rn, count(*) AS len, min(date) AS start, sum(obs) AS deficit FROM (
        SELECT *, rn - row_number() OVER (PARTITION BY site ORDER BY rn) AS island FROM {indexed_sql(above)} WHERE hot)
      GROUP BY site, island HAVING count(*) >= {min_len})
    """


def merge_sql() -> str:
    """The merge rounds spelled out; more of them than any series of this length can need."""
    parts = [f"r0 AS MATERIALIZED (SELECT site, start_rn, len FROM ({runs_sql(50.0, 2)}))"]
    for i in range(MERGE_ROUNDS):
        parts.append(f"""r{i + 1} AS MATERIALIZED (
          SELECT site, min(start_rn) AS start_rn, max(start_rn + len) - min(start_rn) AS len FROM (
            SELECT site, start_rn, len, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY site ORDER BY start_rn) AS grp FROM (
              SELECT site, start_rn, len, coalesce(
                start_rn - (lag(start_rn) OVER w + lag(len) OVER w) < least(len, lag(len) OVER w), false) AS joins
              FROM r{i} WINDOW w AS (PARTITION BY site ORDER BY start_rn)))
          GROUP BY site, grp)""")
    return f"""WITH {', '.join(parts)}
        SELECT site, row_number() OVER (PARTITION BY site ORDER BY start_rn) AS run_id, start_rn, len FROM r{MERGE_ROUNDS}"""


MANY = ("median", "q33", "q66", "mean", "n")


def _align(spark, sf, do_norm=False, **options):
    df = daily(spark, sf)
    series = df.select(F.col("sitename").alias("site"), "date", "obs", "mod")
    return align_events(series, flags(df), ["obs", "mod"], MIN_LEN, BEFORE, AFTER, do_norm, NBINS, NORMBIN, **options)


def _response(do_norm):
    def build(spark, sf):
        df = daily(spark, sf)
        series = df.select(F.col("sitename").alias("site"), "date", "obs", "mod")
        return event_response(series, flags(df), MIN_LEN, BEFORE, AFTER, do_norm, NBINS, NORMBIN)
    return build


def _windows_sql() -> str:
    return f"""
    SELECT w.site, w.inst, w.dday, i.date, i.obs, i.mod FROM (
      SELECT r.site, r.run_id AS inst, r.start_rn, unnest(generate_series(-{BEFORE}, least({AFTER}, r.len))) AS dday
      FROM ({runs_sql(60.0, MIN_LEN)}) r
      JOIN (SELECT sitename AS site, count(*) AS n FROM site_daily GROUP BY 1) s ON r.site = s.site
      WHERE r.start_rn - {BEFORE} >= 1 AND r.start_rn + least({AFTER}, r.len) <= s.n) w
    JOIN {indexed_sql(60.0)} i ON i.site = w.site AND i.rn = w.start_rn + w.dday
    """


WIDTH = (AFTER + BEFORE + 1) / NBINS
EDGES = int((AFTER + BEFORE) / WIDTH + 1e-10) + 1
BIN_SQL = (
    f"CASE WHEN ceil((dday + {BEFORE}) / {WIDTH}::DOUBLE) BETWEEN 1 AND {EDGES - 1} "
    f"THEN CAST(ceil((dday + {BEFORE}) / {WIDTH}::DOUBLE) AS INTEGER) END"
)
TERCILES = "quantile_cont({v}, 0.5) AS {p}median, quantile_cont({v}, 0.33) AS {p}q33, quantile_cont({v}, 0.66) AS {p}q66"


def _normalised_sql() -> str:
    return f"""WITH w AS (SELECT *, {BIN_SQL} AS inbin FROM ({_windows_sql()})),
        b AS (SELECT inbin, quantile_cont(obs, 0.5) AS obs, quantile_cont(mod, 0.5) AS mod, quantile_cont(mod - obs, 0.5) AS bias,
                     row_number() OVER (ORDER BY inbin) AS place FROM w WHERE inbin IS NOT NULL GROUP BY 1),
        c AS (SELECT obs, mod, bias FROM b WHERE place = {NORMBIN})"""


CASES = {
    "f2_runs": Case(
        "site:s run_id:i start_rn:i len:i start:d",
        lambda s, d: runs.find_runs(_flagged(s, d), "hot", MIN_LEN), f"SELECT * FROM ({runs_sql(60.0, MIN_LEN)})",
    ),
    "f3_running_length": Case(
        "site:s date:d run_len:i", lambda s, d: runs.running_length(_flagged(s, d), "hot"),
        f"""SELECT site, date, rn - coalesce(max(CASE WHEN NOT hot THEN rn END) OVER (PARTITION BY site ORDER BY rn), 0) AS run_len
            FROM {indexed_sql(60.0)}""",
    ),
    "f4_run_deficit": Case(
        "site:s run_id:i len:i deficit:f",
        lambda s, d: runs.find_runs(_flagged(s, d), "hot", MIN_LEN, deficit="obs"), f"SELECT * FROM ({runs_sql(60.0, MIN_LEN)})",
    ),
    "f5_merged_runs": Case(
        "site:s run_id:i start_rn:i len:i", lambda s, d: runs.merge_runs(runs.find_runs(_flagged(s, d, 50.0), "hot", 2)), merge_sql(),
    ),
    "f2_runs_with_null_keys": Case(
        "site:s run_id:i start_rn:i len:i start:d",
        lambda s, d: runs.find_runs(_flagged(s, d, 60.0, with_null_keys), "hot", MIN_LEN), null_keys(f"SELECT * FROM ({runs_sql(60.0, MIN_LEN)})"),
    ),
    "f3_running_length_with_null_keys": Case(
        "site:s date:d run_len:i", lambda s, d: runs.running_length(_flagged(s, d, 60.0, with_null_keys), "hot"),
        null_keys(f"""SELECT site, date, rn - coalesce(max(CASE WHEN NOT hot THEN rn END) OVER (PARTITION BY site ORDER BY rn), 0) AS run_len
            FROM {indexed_sql(60.0)}"""),
    ),
    "f5_merged_runs_with_null_keys": Case(
        "site:s run_id:i start_rn:i len:i",
        lambda s, d: runs.merge_runs(runs.find_runs(_flagged(s, d, 50.0, with_null_keys), "hot", 2)), null_keys(merge_sql()),
    ),
    "f5_merged_runs_in_small_chunks": Case(
        "site:s run_id:i start_rn:i len:i start:d deficit:f",
        lambda s, d: runs.merge_runs(
            runs.find_runs(_flagged(s, d, 50.0), "hot", 2, deficit="obs"), chunk=number_chunk("start_rn", 20)),
        f"""SELECT m.site, m.run_id, m.start_rn, m.len, min(r.start) AS start, sum(r.deficit) AS deficit
            FROM ({merge_sql()}) m JOIN ({runs_sql(50.0, 2)}) r ON r.site = m.site AND r.start_rn BETWEEN m.start_rn AND m.start_rn + m.len - 1
            GROUP BY ALL""",
    ),
    "f7_linear_interpolation_with_null_keys": Case(
        "sitename:s date:d obs:f obs_filled:f mod_filled:f",
        lambda s, d: interpolate(with_null_keys(daily(s, d)), ["sitename"], "date", ["obs", "mod"], suffix="_filled"),
        lerp(NULL_KEYS_SQL, "sitename", "date", ["obs", "mod"], "_filled").replace("ORDER BY date)", "ORDER BY date NULLS FIRST)"),
    ),
    "f11_offset_bins": Case(
        "dday:i inbin:i n:i",
        lambda s, d: _align(s, d).rows.withColumn("inbin", offset_bin(F.col("dday"), BEFORE, AFTER, NBINS)).groupBy("dday", "inbin").agg(
            F.count("*").alias("n")),
        f"SELECT dday, {BIN_SQL} AS inbin, count(*) AS n FROM ({_windows_sql()}) GROUP BY 1, 2",
    ),
    "d6_event_windows": Case(
        "site:s inst:i dday:i date:d obs:f mod:f", lambda s, d: _align(s, d).rows, _windows_sql()),
    "l14_align_events": Case(
        "dday:i obs_median:f obs_q33:f obs_q66:f mod_median:f mod_q33:f mod_q66:f", lambda s, d: _align(s, d).by_day,
        f"SELECT dday, {TERCILES.format(v='obs', p='obs_')}, {TERCILES.format(v='mod', p='mod_')} FROM ({_windows_sql()}) GROUP BY 1",
    ),
    "k2_summaries_by_day": Case(
        "dday:i " + " ".join(f"{v}_{n}:{'i' if n == 'n' else 'f'}" for v in ("obs", "mod") for n in MANY), lambda s, d: _align(s, d, names=MANY).by_day,
        f"""SELECT dday, {', '.join(f"{TERCILES.format(v=v, p=f'{v}_')}, avg({v}) AS {v}_mean, count({v}) AS {v}_n" for v in ('obs', 'mod'))}
            FROM ({_windows_sql()}) GROUP BY 1""",
    ),
    "l14_align_events_normalised": Case(
        "site:s inst:i dday:i inbin:i date:d obs:f mod:f", lambda s, d: _align(s, d, True).rows,
        f"{_normalised_sql()} SELECT site, inst, dday, inbin, date, w.obs - c.obs AS obs, w.mod - c.mod AS mod FROM w, c",
    ),
    "l14_event_response": Case(
        "dday:i median:f q33:f q66:f", _response(False),
        f"SELECT dday, {TERCILES.format(v='(mod - obs)', p='')} FROM ({_windows_sql()}) GROUP BY 1",
    ),
    "l14_event_response_normalised": Case(
        "dday:i median:f q33:f q66:f", _response(True),
        f"{_normalised_sql()} SELECT dday, {TERCILES.format(v='(w.mod - w.obs - c.bias)', p='')} FROM w, c GROUP BY 1",
    ),
}
