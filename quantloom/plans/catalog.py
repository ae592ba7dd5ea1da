"""Registered queries of the engine, each with the DuckDB text that must give the same rows.

All of them run over whole test tables, through the deterministic panel of sources.fixtures. Numbers are rounded alike in
both engines; z is rounded before it meets a threshold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.rolling import rounded
from quantloom.operators import calendar, clusters, context, costs, discovery, features, hedge, metrics, signals
from quantloom.params import Filters, Params
from quantloom.plans import walkforward
from quantloom.sources import fixtures, panels
from quantloom.sources.fixtures import duck

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
REFIT, BURN, BLACKOUT = 63, 252, 3
#: The panel's residuals revert within days, so the half-life's lower bound is loosened.
LOOSE = Filters(min_hl=0.05)
#: What the richer simulation query switches on.
FULL = Params(borrow_apr_bps=50.0, enable_adv_cap=True, enable_impact=True, earnings_blackout_days=BLACKOUT, month_end_forceclose=True, cooldown_days=5, min_adv_usd=2500.0)
#: Exits at the crossing, entries without confirmation, no exit at earnings.
PLAIN = Params(zero_cross_exit=True, no_entry_confirm=True, earnings_blackout_days=BLACKOUT, earnings_force_exit=False, cooldown_days=2)


# Dates are compared as text, which both engines print alike.
def query(name: str, oracle: str | None = None, dates: tuple[str, ...] = ()):
    def keep(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("string") for c, kind in out.dtypes if kind == "date"})

        QUERIES[name] = run
        if oracle:
            replaced = ", ".join(f"CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}" for c in dates)
            ORACLES[name] = f"SELECT * REPLACE ({replaced}) FROM ({oracle}) AS whole" if dates else oracle
        return f

    return keep


def r(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    out = rounded(F.col(c) if isinstance(c, str) else c, digits)
    return out.alias(name or c) if name or isinstance(c, str) else out


# ---------------------------------------------------------------------------------------------- shared inputs


def panel_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel: tickers by dates, made from the tables and written once a session."""
    return fixtures.panel_table(spark, sf_dir)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.prices(panel_of(spark, sf_dir))


def ticker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.ticker_features(prices(spark, sf_dir))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ticker_rows(spark, sf_dir)
    return features.align(own, features.all_pairs(own.select("ticker").distinct()))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.pair_features(aligned(spark, sf_dir), Params())


def segment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.segments(calendar.calendar(prices(spark, sf_dir)), REFIT, BURN)


def every_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair in every segment."""
    tickers = prices(spark, sf_dir).select("ticker").distinct()
    names = features.all_pairs(tickers)
    return names.crossJoin(F.broadcast(segment_table(spark, sf_dir)))  # a list of names by a list of segments


def trading(spark: SparkSession, sf_dir: str, p: Params) -> walkforward.Backtest:
    own = prices(spark, sf_dir)
    rich = p.earnings_blackout_days > 0
    panel = panel_of(spark, sf_dir)
    earnings = panels.earnings(fixtures.derived(fixtures.EARNINGS_SQL, panel)) if rich else None
    regime = panels.regime(fixtures.derived(fixtures.REGIME_SQL, panel)) if rich else None
    return walkforward.backtest(own, every_pair(spark, sf_dir), p, earnings, regime)


# ---------------------------------------------------------------------------------------------- shared oracle text

_PANEL = f"WITH RECURSIVE panel AS MATERIALIZED ({duck(fixtures.PANEL_SQL)})"
_TICKER = f"""{_PANEL}, px AS MATERIALIZED (
  SELECT ticker, date, close, volume, ln(close) AS lp, close / lag(close) OVER w - 1 AS ret,
         CASE WHEN count(close * volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) = 63
              THEN avg(close * volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) END AS adv
  FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date))"""
_ALIGN = f"""{_TICKER}, al AS MATERIALIZED (
  SELECT x.ticker AS a, y.ticker AS b, x.date, x.lp AS pa, y.lp AS pb, x.ret AS ra, y.ret AS rb, x.adv AS adva, y.adv AS advb
  FROM px x JOIN px y ON x.date = y.date AND x.ticker < y.ticker)"""
_OLS = f"""{_ALIGN}, ols AS MATERIALIZED (
  SELECT *, CASE WHEN count(pa) OVER w = 63 THEN regr_slope(pa, pb) OVER w END AS beta,
            CASE WHEN count(pa) OVER w = 63 THEN regr_intercept(pa, pb) OVER w END AS alpha
  FROM al WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))"""
_SERIES_STEPS = """sp AS (
  SELECT *, pa - (beta * pb + alpha) AS s, lag(beta) OVER (PARTITION BY a, b ORDER BY date) AS beta1 FROM ols
), sr AS (SELECT *, ra - beta1 * rb AS rp FROM sp
), ser AS MATERIALIZED (
  SELECT *, CASE WHEN count(s) OVER w = 63 THEN avg(s) OVER w END AS mu, nullif(CASE WHEN count(s) OVER w = 63 THEN stddev_samp(s) OVER w END, 0) AS sd,
         nullif(CASE WHEN count(rp) OVER w = 63 THEN stddev_samp(rp) OVER w END, 0) AS sigma
  FROM sr WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)
), zz AS MATERIALIZED (SELECT *, (s - mu) / sd AS z FROM ser)"""
_SERIES = f"{_OLS}, {_SERIES_STEPS}"

#: The filter as a recursion over a pair's rows, with its ring of squared gaps as a list; named like the regression.
_KALMAN_STEPS = f"""kn AS MATERIALIZED (
  SELECT *, pb / sc AS h FROM (SELECT a, b, date, pa, pb, row_number() OVER g AS rn, least(63, greatest(20, count(*) OVER (PARTITION BY a, b) // 4)) AS m,
    CASE WHEN abs(avg(pb) OVER (g ROWS 29 PRECEDING)) < 1e-6 THEN 1.0 ELSE avg(pb) OVER (g ROWS 29 PRECEDING) END AS sc FROM al WINDOW g AS (PARTITION BY a, b ORDER BY date)) q
), k0 AS (SELECT a, b, any_value(m) AS m, regr_slope(pa, h) AS s0, regr_intercept(pa, h) AS l0, sum(h * h) + 1e-8 AS xx, sum(h) AS x, count(*) + 1e-8 AS c FROM kn WHERE rn <= m GROUP BY a, b
), k1 AS (SELECT kn.a, kn.b, var_pop(pa - (h * s0 + l0)) + 1e-8 AS v, list(power(pa - (h * s0 + l0), 2) ORDER BY rn) FILTER (rn > kn.m - 30) AS ring FROM kn JOIN k0 ON k0.a = kn.a AND k0.b = kn.b WHERE rn <= kn.m GROUP BY kn.a, kn.b
), kal AS (
  SELECT a, b, CAST(0 AS BIGINT) AS rn, s0 AS slope, l0 AS level, v * c / (xx * c - x * x) AS p11, -v * x / (xx * c - x * x) AS p12, -v * x / (xx * c - x * x) AS p21, v * xx / (xx * c - x * x) AS p22, ring,
         CAST(NULL AS DATE) AS date, CAST(NULL AS DOUBLE) AS beta, CAST(NULL AS DOUBLE) AS beta_std FROM k0 JOIN k1 USING (a, b)
  UNION ALL
  SELECT a, b, rn, slope + k1 * gap, level + k2 * gap, q11 - k1 * (h * q11 + p21), p12 - k1 * (h * p12 + q22), p21 - k2 * (h * q11 + p21), q22 - k2 * (h * p12 + q22), ring, date,
         (slope + k1 * gap) / sc, sqrt(greatest(q11 - k1 * (h * q11 + p21), 0)) / sc
  FROM (SELECT *, (q11 * h + p12) / total AS k1, (p21 * h + q22) / total AS k2
    FROM (SELECT *, h * (q11 * h + p12) + (p21 * h + q22) + list_avg(ring) + 1e-8 AS total
      FROM (SELECT f.a, f.b, f.rn, f.date, f.h, f.sc, slope, level, p11 + 1e-4 AS q11, p12, p21, p22 + 1e-4 AS q22, pa - (f.h * slope + level) AS gap, list_append(ring, power(pa - (f.h * slope + level), 2))[-30:] AS ring
            FROM kal k JOIN kn f ON f.a = k.a AND f.b = k.b AND f.rn = k.rn + 1) q1) q2) q3)"""
_KALMAN = f"""{_ALIGN}, {_KALMAN_STEPS}, ols AS MATERIALIZED (SELECT al.*, kal.beta, kal.level AS alpha, kal.beta_std FROM al JOIN kal ON kal.a = al.a AND kal.b = al.b AND kal.date = al.date)"""
_SEGMENTS = f"""cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS rn FROM (SELECT DISTINCT date FROM panel)),
  seg AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS segment_id, date AS d0,
                 coalesce(lead(date) OVER (ORDER BY date), (SELECT max(date) FROM cal)) AS d1
          FROM cal WHERE rn >= {BURN} AND (rn - {BURN}) % {REFIT} = 0)"""
_EARN = f"""ern AS (SELECT ticker, CAST(earnings_date AS DATE) AS earnings_date FROM ({duck(fixtures.EARNINGS_SQL, panel='panel')})),
  blk AS MATERIALIZED (SELECT DISTINCT e.ticker, c.date FROM ern e JOIN cal c ON c.date BETWEEN e.earnings_date - {BLACKOUT} AND e.earnings_date + {BLACKOUT})"""
_REGIME = f"reg AS MATERIALIZED ({duck(fixtures.REGIME_SQL, panel='panel')})"


def _rd(c: str, digits: int = 6, name: str | None = None) -> str:
    return f"round({c}, {digits}) + 0.0 AS {name or c}"


_SERIES_KALMAN = f"{_KALMAN}, {_SERIES_STEPS}"


def _fold_sql(p: Params) -> str:
    """The simulation as a recursion over a segment's rows, written independently of the fold."""
    series = _SERIES_KALMAN if p.use_kalman else _SERIES
    rich = p.earnings_blackout_days > 0
    bps = p.cost_bps / 1e4
    w0 = f"({p.target_spread_vol_bps / 1e4!r} / sigma)"
    part = lambda adv: f"CASE WHEN {adv} > 0 THEN {w0} * {p.portfolio_notional_usd!r} / {adv} END"
    w = f"{w0} * coalesce(least(1.0, {p.adv_cap_pct!r} / greatest({part('adva')}, {part('advb')})), 1.0)" if p.enable_adv_cap else w0
    leg = lambda adv: f"coalesce(CASE WHEN {adv} > 0 THEN sqrt({p.portfolio_notional_usd!r} / {adv}) END, 0.0)"
    imp = f"{p.impact_k_bps / 1e4!r} * ({leg('adva')} + {leg('advb')})" if p.enable_impact else "0.0"
    c5 = "OVER (PARTITION BY segment_id, a, b ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    low = f"coalesce(coalesce(ra, 0), 0.0)"
    floor = f" OR coalesce(adva, 0) < {p.min_adv_usd!r} OR coalesce(advb, 0) < {p.min_adv_usd!r}" if p.min_adv_usd > 0 else ""
    if p.use_kalman:
        floor += f" OR coalesce(CASE WHEN abs(beta1) > 1e-6 THEN std1 / abs(beta1) END > {p.kalman_beta_unc_cap!r}, FALSE)"
    std = ", lag(beta_std) OVER (PARTITION BY a, b ORDER BY date) AS std1" if p.use_kalman else ""
    left = "pos * z >= 0" if p.zero_cross_exit else f"abs(z) <= {p.z_exit!r}"
    turned = lambda c: "TRUE" if p.no_entry_confirm else f"coalesce({c}, FALSE)"
    force = "blk" if p.earnings_force_exit else "FALSE"
    extra = f", {_EARN}, {_REGIME}" if rich else ""
    ctx = "LEFT JOIN blk ba ON ba.ticker = zz.a AND ba.date = zz.date LEFT JOIN blk bb ON bb.ticker = zz.b AND bb.date = zz.date LEFT JOIN reg ON reg.date = zz.date" if rich else ""
    flags = "(ba.ticker IS NOT NULL OR bb.ticker IS NOT NULL) AS blk, coalesce(reg.scale, 1.0) AS rscale" if rich else "FALSE AS blk, 1.0 AS rscale"
    borrow = f"{p.borrow_apr_bps / 1e4 / 252!r} * size"
    close_pos = "pos <> 0" if p.month_end_forceclose else "FALSE"
    return f"""{series}, zk AS MATERIALIZED (SELECT *{std} FROM zz), {_SEGMENTS}{extra}, raw AS (
  SELECT segment_id, a, b, zz.date, round(z, 9) AS z, s, beta1, rp, sigma, {w} AS w, {imp} AS imp, {low} AS x5, coalesce(rb, 0.0) AS y5, adva, advb, {flags}{', std1' if std else ''}
  FROM zk AS zz JOIN seg ON zz.date BETWEEN seg.d0 AND seg.d1 {ctx}
), m5 AS (
  SELECT *, avg(x5) {c5} AS mx, avg(y5) {c5} AS my, avg(x5 * x5) {c5} AS mxx, avg(y5 * y5) {c5} AS myy, avg(x5 * y5) {c5} AS mxy, covar_pop(x5, y5) {c5} AS cv, stddev_pop(x5) {c5} AS sx, stddev_pop(y5) {c5} AS sy, count(*) {c5} AS n5
  FROM raw
), fr AS MATERIALIZED (
  SELECT segment_id, a, b, date, row_number() OVER g AS rn, count(*) OVER (PARTITION BY segment_id, a, b) AS last, z, lag(z) OVER g AS zprev, s, beta1, rp, w, imp, blk, rscale,
         coalesce(n5 = 5 AND round(cv / nullif(sx * sy, 0), 9) < 0.5, FALSE) AS brk,
         (z IS NOT NULL AND rp IS NOT NULL AND coalesce(sigma > 0, FALSE)) AS valid, (rscale < 0.05 OR blk{floor}) AS shut
  FROM m5 WINDOW g AS (PARTITION BY segment_id, a, b ORDER BY date)
), sim AS (
  SELECT segment_id, a, b, CAST(0 AS BIGINT) AS rn, CAST(NULL AS DATE) AS date, 0 AS pos, 0 AS days, {p.cooldown_days} AS since, CAST(NULL AS DOUBLE) AS es, CAST(NULL AS DOUBLE) AS eb,
         CAST(1.0 AS DOUBLE) AS er, CAST(0.0 AS DOUBLE) AS pnl, CAST(0.0 AS DOUBLE) AS cost, 0 AS trip, 0 AS win, 0 AS held, CAST(0.0 AS DOUBLE) AS lw
  FROM (SELECT DISTINCT segment_id, a, b FROM fr)
  UNION ALL
  SELECT segment_id, a, b, rn, date,
    CASE WHEN out OR (rn = last AND close) THEN 0 ELSE pos2 END, CASE WHEN out OR enter <> 0 THEN 0 ELSE days2 END, CASE WHEN out THEN 0 ELSE since2 END, es2, eb2, CASE WHEN out THEN 1.0 ELSE er2 END,
    gain - c - CASE WHEN close THEN {2 * bps!r} * lw2 * er2 ELSE 0 END, c + CASE WHEN close THEN {2 * bps!r} * lw2 * er2 ELSE 0 END,
    CASE WHEN out OR close THEN 1 ELSE 0 END, CASE WHEN (out AND coalesce((s - es2) * pos * size > 0, FALSE)) OR (close AND coalesce((s - es2) * pos2 * lw2 * er2 > 0, FALSE)) THEN 1 ELSE 0 END,
    CASE WHEN out THEN days2 WHEN close THEN CASE WHEN enter <> 0 THEN 0 ELSE days2 END ELSE 0 END, lw2
  FROM (
    SELECT *, CASE WHEN out THEN 0 WHEN enter <> 0 THEN enter ELSE pos END AS pos2, rn = last AND NOT out AND ({close_pos.replace('pos', '(CASE WHEN enter <> 0 THEN enter ELSE pos END)')}) AS close,
      CASE WHEN enter <> 0 THEN s ELSE es END AS es2, CASE WHEN enter <> 0 THEN beta1 ELSE eb END AS eb2, CASE WHEN enter <> 0 THEN rscale ELSE er END AS er2, CASE WHEN valid THEN w ELSE lw END AS lw2,
      CASE WHEN hold THEN size * pos * rp ELSE 0 END AS gain,
      CASE WHEN enter <> 0 THEN {2 * bps!r} * ew + sqrt(ew) * imp ELSE 0 END + CASE WHEN out THEN {2 * bps!r} * size + sqrt(size) * imp ELSE 0 END + CASE WHEN hold THEN {borrow} ELSE 0 END AS c
    FROM (
      SELECT *, w * rscale AS ew, w * er AS size,
        hold AND ({left} OR days2 >= {p.time_stop} OR abs(z) > {p.hard_stop!r} OR brk OR coalesce(abs(eb) > 1e-6 AND abs((beta1 - eb) / eb) > 0.30, FALSE) OR {force}) AS out,
        CASE WHEN free AND z >= {p.z_entry!r} AND {turned('z < zprev')} THEN -1 WHEN free AND z <= -{p.z_entry!r} AND {turned('z > zprev')} THEN 1 ELSE 0 END AS enter
      FROM (
        SELECT f.segment_id, f.a, f.b, f.rn, f.last, f.date, f.z, f.zprev, f.s, f.beta1, f.rp, f.w, f.imp, f.blk, f.rscale, f.brk, f.valid, t.pos, t.es, t.eb, t.er, t.lw,
          f.valid AND t.pos <> 0 AS hold, t.days + CASE WHEN f.valid AND t.pos <> 0 THEN 1 ELSE 0 END AS days2, t.since + CASE WHEN f.valid AND t.pos = 0 THEN 1 ELSE 0 END AS since2,
          f.valid AND t.pos = 0 AND NOT f.shut AND ({p.cooldown_days} = 0 OR t.since + 1 >= {p.cooldown_days}) AS free
        FROM sim t JOIN fr f ON f.segment_id = t.segment_id AND f.a = t.a AND f.b = t.b AND f.rn = t.rn + 1) q1) q2) q3
), done AS MATERIALIZED (SELECT * FROM sim WHERE rn > 0), tot AS (
  SELECT segment_id, a, b, CAST(sum(trip) AS INTEGER) AS trips, sum(win) AS wins, sum(held) AS held, sum(abs(pnl)) AS moved FROM done GROUP BY ALL
), trd AS (SELECT * FROM tot WHERE trips > 0 OR moved > 0), port AS MATERIALIZED (
  SELECT segment_id, date, sum(pnl) AS pnl, sum(cost) AS cost, sum(pnl) + sum(cost) AS pnl_gross FROM done JOIN trd USING (segment_id, a, b) GROUP BY ALL)"""


_BASE = _fold_sql(Params())
_RICH = _fold_sql(FULL)
_CROSS = _fold_sql(PLAIN)
_KAL_FOLD = _fold_sql(Params(use_kalman=True))

# ---------------------------------------------------------------------------------------------- per ticker


@query("log_returns", f"{_TICKER} SELECT ticker, date, {_rd('lp')}, {_rd('ret', 8)} FROM px", dates=('date',))
def log_returns(spark, sf_dir):
    return ticker_rows(spark, sf_dir).select("ticker", "date", r("lp"), r("ret", 8))


@query("weekly_panel", f"WITH p AS ({duck(fixtures.WEEKLY_SQL)}) SELECT ticker, date, {_rd('ln(close)', 7, 'log_close')}, volume FROM p", dates=('date',))
def weekly_panel(spark, sf_dir):
    return panels.prices(fixtures.weekly(spark, sf_dir)).select("ticker", "date", r(F.log("close"), 7, "log_close"), "volume")


@query("adv63", f"{_TICKER} SELECT ticker, date, {_rd('adv', 4)} FROM px", dates=('date',))
def adv63(spark, sf_dir):
    return ticker_rows(spark, sf_dir).select("ticker", "date", r("adv", 4))


@query(
    "factor_zscore",
    f"""{_PANEL}, fac AS (SELECT * FROM ({duck(fixtures.FACTORS_SQL, panel='panel')}) WHERE factor <> 'FF_RF')
SELECT date, factor, round(coalesce(CASE WHEN count(ret) OVER w >= 63 AND ret IS NOT NULL THEN (ret - avg(ret) OVER w) / (stddev_samp(ret) OVER w + 1e-8) END, 0.0), 6) + 0.0 AS z
FROM fac WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""", dates=('date',))
def factor_zscore(spark, sf_dir):
    raw = fixtures.derived(fixtures.FACTORS_SQL, panel_of(spark, sf_dir))
    return features.factor_zscore(panels.factor_returns(raw)).select("date", "factor", r("z"))


# ---------------------------------------------------------------------------------------------- per pair


@query("pair_align", f"{_ALIGN} SELECT a, b, count(*) AS n, min(date) AS first_date, max(date) AS last_date, {_rd('sum(pa - pb)', 5, 'gap')} FROM al GROUP BY a, b HAVING count(*) >= 84", dates=('first_date', 'last_date'))
def pair_align(spark, sf_dir):
    own = features.long_enough(aligned(spark, sf_dir), Params())
    return own.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), r(F.sum(F.col("pa") - F.col("pb")), 5).alias("gap"))


@query("rolling_ols", f"{_OLS} SELECT a, b, date, {_rd('beta', 5)}, {_rd('alpha', 5)} FROM ols", dates=('date',))
def rolling_ols(spark, sf_dir):
    return features.rolling_ols(aligned(spark, sf_dir), 63).select("a", "b", "date", r("beta", 5), r("alpha", 5))


@query("spread_zscore", f"{_SERIES} SELECT a, b, date, {_rd('s', 5)}, {_rd('z', 4)} FROM zz WHERE abs(round(z, 9)) >= 2", dates=('date',))
def spread_zscore(spark, sf_dir):
    own = features.zscore(features.spread(features.rolling_ols(aligned(spark, sf_dir), 63)), 63)
    return own.where(F.abs(F.round("z", 9)) >= 2).select("a", "b", "date", r("s", 5), r("z", 4))


@query("pair_return_vol", f"{_SERIES} SELECT a, b, date, {_rd('rp')}, {_rd('sigma', 7)} FROM zz", dates=('date',))
def pair_return_vol(spark, sf_dir):
    own = features.pair_returns(features.rolling_ols(aligned(spark, sf_dir), 63), 63)
    return own.select("a", "b", "date", r("rp"), r("sigma", 7))


_W0 = "0.001 / sigma"
_CAPPED = f"{_W0} * coalesce(least(1.0, 0.01 / greatest(CASE WHEN adva > 0 THEN {_W0} * 1e7 / adva END, CASE WHEN advb > 0 THEN {_W0} * 1e7 / advb END)), 1.0)"


@query("vol_target_weight", f"{_SERIES} SELECT a, b, date, {_rd(_CAPPED, 7, 'w')} FROM zz WHERE sigma IS NOT NULL", dates=('date',))
def vol_target_weight(spark, sf_dir):
    return features.vol_weight(series(spark, sf_dir), Params(enable_adv_cap=True)).where("sigma IS NOT NULL").select("a", "b", "date", r("w", 7))


@query(
    "impact_borrow_cost",
    f"""{_SERIES} SELECT a, b, date, {_rd(f'2 * 0.0003 * {_W0}', 9, 'explicit')}, {_rd(f'sqrt({_W0}) * 0.0015 * (coalesce(sqrt(1e7 / nullif(adva, 0)), 0) + coalesce(sqrt(1e7 / nullif(advb, 0)), 0))', 7, 'impact')},
{_rd(f'0.005 / 252 * {_W0}', 9, 'borrow')} FROM zz WHERE sigma IS NOT NULL""", dates=('date',))
def impact_borrow_cost(spark, sf_dir):
    p = Params(enable_impact=True, borrow_apr_bps=50.0)
    own = signals.impact_factor(features.vol_weight(series(spark, sf_dir), p), p).where("sigma IS NOT NULL")
    w = F.col("w")
    return own.select("a", "b", "date", r(costs.explicit(w, p), 9, "explicit"), r(costs.impact(w, F.col("imp")), 7, "impact"), r(costs.borrow(w, p), 9, "borrow"))


@query(
    "price_anchor",
    f"""{_ALIGN}, s0 AS (SELECT date AS d FROM (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM panel)) WHERE n = 253)
SELECT a, b, round(coalesce(arg_max(pa, date) FILTER (date < d), arg_min(pa, date)), 6) + 0.0 AS na, round(coalesce(arg_max(pb, date) FILTER (date < d), arg_min(pb, date)), 6) + 0.0 AS nb,
       round(sum(pa) / coalesce(arg_max(pa, date) FILTER (date < d), arg_min(pa, date)), 4) + 0.0 AS total FROM al, s0 GROUP BY a, b""",
)
def price_anchor(spark, sf_dir):
    start = calendar.calendar(prices(spark, sf_dir)).where("rn = 252").select(F.col("date").alias("d0"))
    own = features.with_anchors(aligned(spark, sf_dir).crossJoin(F.broadcast(start)), ("a", "b"))  # one row on the right
    return own.groupBy("a", "b").agg(r(F.first("na"), 6, "na"), r(F.first("nb"), 6, "nb"), r(F.sum("qa"), 4, "total"))


@query("kalman_beta", f"{_KALMAN} SELECT a, b, date, {_rd('beta', 4)}, {_rd('alpha', 4)}, {_rd('beta_std', 4)} FROM ols", dates=('date',))
def kalman_beta(spark, sf_dir):
    own = hedge.kalman(aligned(spark, sf_dir), Params().kalman_delta)
    return own.select("a", "b", "date", r("beta", 4), r("alpha", 4), r("beta_std", 4))


_CAP = "DATE '1996-06-28'"


@query("capped_panel", f"{_PANEL} SELECT ticker, count(*) AS days, max(date) AS last_date, {_rd('sum(ln(close))', 5, 'total')} FROM panel WHERE date <= {_CAP} GROUP BY ticker", dates=('last_date',))
def capped_panel(spark, sf_dir):
    own = features.ticker_features(features.capped(prices(spark, sf_dir), "1996-06-28"))
    return own.groupBy("ticker").agg(F.count(F.lit(1)).alias("days"), F.max("date").alias("last_date"), r(F.sum("lp"), 5, "total"))


_SPARSE = f"""WITH wk AS MATERIALIZED ({duck(fixtures.WEEKLY_SQL)}), kw AS (SELECT * FROM wk WHERE (ascii(right(ticker, 1)) * 7 + dayofyear(date) * 3 + year(date)) % 11 <> 0),
  gr AS (SELECT t.ticker, d.date, close, volume FROM (SELECT DISTINCT ticker FROM kw) t CROSS JOIN (SELECT DISTINCT date FROM kw) d LEFT JOIN kw USING (ticker, date)),
  fi AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS pad FROM gr),
  dn AS (SELECT ticker, date, close, pad / lag(pad) OVER w - 1 AS ret, count(close * volume) OVER v AS n, avg(close * volume) OVER v AS av
         FROM fi WINDOW w AS (PARTITION BY ticker ORDER BY date), v AS (PARTITION BY ticker ORDER BY date ROWS 7 PRECEDING))"""


@query("sparse_panel", f"{_SPARSE} SELECT ticker, date, {_rd('ret', 8)}, round(CASE WHEN n = 8 THEN av END, 4) + 0.0 AS adv FROM dn WHERE close IS NOT NULL", dates=('date',))
def sparse_panel(spark, sf_dir):
    """Tickers without rows on some days: windows are of the calendar, not of a ticker's rows."""
    raw = fixtures.weekly(spark, sf_dir).where((F.ascii(F.substring("ticker", -1, 1)) * 7 + F.dayofyear("date") * 3 + F.year("date")) % 11 != 0)
    return features.ticker_features(panels.prices(raw), adv_window=8).select("ticker", "date", r("ret", 8), r("adv", 4))


@query(
    "factor_sources",
    f"""{_PANEL}, fac AS (SELECT *, CASE factor WHEN 'SPY' THEN 'etf' WHEN 'LOW' THEN 'ff' ELSE 'fred' END AS source FROM ({duck(fixtures.FACTORS_SQL, panel='panel')}) WHERE factor <> 'FF_RF')
SELECT k.kind, factor, count(*) AS days, {_rd('sum(ret)', 8, 'total')} FROM fac, (VALUES ('etf_only'), ('ff_fred_first'), ('both')) k(kind)
WHERE k.kind = 'both' OR (k.kind = 'etf_only') = (source = 'etf') GROUP BY ALL
UNION ALL SELECT 'control', factor, count(*), {_rd('sum(ret)', 8, 'total')} FROM fac WHERE factor = 'SPY' GROUP BY factor
UNION ALL SELECT 'control without a market', factor, count(*), {_rd('sum(ret)', 8, 'total')} FROM fac WHERE factor <> 'SPY' GROUP BY factor""",
)
def factor_sources(spark, sf_dir):
    """The sets of factors that a run may name, and those that returns are controlled for."""
    raw = fixtures.derived(fixtures.FACTORS_SQL, panel_of(spark, sf_dir)).withColumn("source", F.when(F.col("factor") == "SPY", "etf").when(F.col("factor") == "LOW", "ff").otherwise("fred"))
    parts = [(k, panels.factor_returns(raw, k)) for k in panels.FACTOR_SOURCES]
    every = panels.factor_returns(raw)
    parts += [("control", panels.control_factors(every)), ("control without a market", panels.control_factors(every.where("factor != 'SPY'")))]
    out = None
    for kind, df in parts:
        own = df.groupBy("factor").agg(F.count(F.lit(1)).alias("days"), r(F.sum("ret"), 8, "total")).select(F.lit(kind).alias("kind"), "factor", "days", "total")
        out = own if out is None else out.unionByName(own)
    return out


# ---------------------------------------------------------------------------------------------- calendar and context


@query("refit_segments", f"{_PANEL}, {_SEGMENTS} SELECT * FROM seg", dates=('d0', 'd1'))
def refit_segments(spark, sf_dir):
    return segment_table(spark, sf_dir)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by rule, for queries that need some: tickers in four clusters, by the last digit and the length of their name and by segment."""
    own = prices(spark, sf_dir).select("ticker").distinct()
    parts = segment_table(spark, sf_dir)
    return own.crossJoin(F.broadcast(parts)).select("segment_id", F.col("d0").alias("refit_date"), "ticker", F.pmod(F.ascii(F.substring("ticker", -1, 1)) * (1 + F.col("segment_id") % 3) + F.length("ticker"), F.lit(4)).cast("int").alias("cluster"))


_LABELS = "lab AS (SELECT segment_id, d0 AS refit_date, ticker, CAST((ascii(right(ticker, 1)) * (1 + segment_id % 3) + length(ticker)) % 4 AS INTEGER) AS cluster FROM (SELECT DISTINCT ticker FROM panel), seg)"
_MEMBERS = f"mem AS ({duck(fixtures.MEMBERSHIP_DUCK, panel='panel')})"


@query(
    "membership_point_in_time",
    f"""{_PANEL}, {_SEGMENTS}, {_LABELS}, {_MEMBERS} SELECT l.* FROM lab l WHERE EXISTS (SELECT 1 FROM mem m WHERE m.ticker = l.ticker AND m.start_date <= l.refit_date AND (m.end_date IS NULL OR m.end_date >= l.refit_date))""", dates=('refit_date',))
def membership_point_in_time(spark, sf_dir):
    members = panels.membership(fixtures.derived(fixtures.MEMBERSHIP_SQL, panel_of(spark, sf_dir)))
    return context.active(_labelled(spark, sf_dir), members)


@query("earnings_blackout", f"{_PANEL}, {_SEGMENTS}, {_EARN} SELECT ticker, date FROM blk", dates=('date',))
def earnings_blackout(spark, sf_dir):
    panel = panel_of(spark, sf_dir)
    earnings = panels.earnings(fixtures.derived(fixtures.EARNINGS_SQL, panel))
    return context.blackout(earnings, panel.select("ticker").distinct(), panel.select("date").distinct(), BLACKOUT)


@query("regime_join", f"{_PANEL}, {_REGIME} SELECT panel.date, ticker, CAST(coalesce(scale, 1.0) AS DOUBLE) AS rscale FROM panel LEFT JOIN reg ON reg.date = panel.date", dates=('date',))
def regime_join(spark, sf_dir):
    panel = panel_of(spark, sf_dir)
    return context.with_regime(panel.select("date", "ticker"), panels.regime(fixtures.derived(fixtures.REGIME_SQL, panel))).select("date", "ticker", "rscale")


@query(
    "regime_scale",
    f"""{_PANEL}, {_REGIME}, st AS (SELECT date, CASE scale WHEN 1.0 THEN 0.9 WHEN 0.5 THEN 0.4 ELSE 0.1 END AS scale FROM reg) SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS days, {_rd('avg(CAST(scale AS DOUBLE))', 6, 'mean_scale')} FROM st GROUP BY 1""",
)
def regime_scale(spark, sf_dir):
    raw = fixtures.derived(fixtures.REGIME_SQL, panel_of(spark, sf_dir))
    states = raw.select("date", F.when(F.col("scale") == 1.0, "calm").when(F.col("scale") == 0.5, "stressed").otherwise("crisis").alias("state"))
    own = panels.regime(states, calm=0.9, stressed=0.4, crisis=0.1)
    return own.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("days"), r(F.avg("scale")).alias("mean_scale"))


# ---------------------------------------------------------------------------------------------- signals and simulation


@query("corr5_break", f"{_BASE} SELECT segment_id, a, b, count(*) AS rows_in, count(*) FILTER (brk) AS breaks FROM fr GROUP BY ALL")
def corr5_break(spark, sf_dir):
    rows = signals.corr_break(signals.segment_rows(aligned(spark, sf_dir), every_pair(spark, sf_dir)))
    return rows.groupBy("segment_id", "a", "b").agg(F.count(F.lit(1)).alias("rows_in"), F.sum(F.col("brk").cast("long")).alias("breaks"))


@query(
    "signal_gates",
    f"""{_RICH} SELECT segment_id, a, b, count(*) FILTER (valid) AS valid, count(*) FILTER (shut) AS shut, count(*) FILTER (blk) AS blk, count(*) FILTER (zprev IS NOT NULL) AS with_prev, {_rd('sum(w)', 5, 'w')} FROM fr GROUP BY ALL""",
)
def signal_gates(spark, sf_dir):
    panel = panel_of(spark, sf_dir)
    earnings, regime = panels.earnings(fixtures.derived(fixtures.EARNINGS_SQL, panel)), panels.regime(fixtures.derived(fixtures.REGIME_SQL, panel))
    blocked = context.blackout(earnings, panel.select("ticker").distinct(), panel.select("date").distinct(), BLACKOUT)
    rows = signals.gates(signals.segment_rows(series(spark, sf_dir), every_pair(spark, sf_dir)), FULL, blocked, regime)
    count = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("segment_id", "a", "b").agg(count(F.col("valid")).alias("valid"), count(F.col("shut")).alias("shut"), count(F.col("blk")).alias("blk"), count(F.col("zprev").isNotNull()).alias("with_prev"), r(F.sum("w"), 5).alias("w"))


_SIM_ROWS = "segment_id, a, b, date, round(pnl, 8) + 0.0 AS pnl, round(cost, 8) + 0.0 AS cost, CAST(pos AS INTEGER) AS pos FROM done JOIN trd USING (segment_id, a, b) WHERE pos <> 0 OR pnl <> 0"


@query("trade_fold", f"{_BASE} SELECT {_SIM_ROWS}", dates=('date',))
def trade_fold(spark, sf_dir):
    own = trading(spark, sf_dir, Params()).daily
    return own.where("pos != 0 OR pnl != 0").select("segment_id", "a", "b", "date", r("pnl", 8), r("cost", 8), "pos")


@query("trade_fold_full", f"{_RICH} SELECT {_SIM_ROWS}", dates=('date',))
def trade_fold_full(spark, sf_dir):
    own = trading(spark, sf_dir, FULL).daily
    return own.where("pos != 0 OR pnl != 0").select("segment_id", "a", "b", "date", r("pnl", 8), r("cost", 8), "pos")


@query("trade_stats", f"{_BASE} SELECT segment_id, a || '|' || b AS pair, trips AS round_trips, {_rd('CAST(wins AS DOUBLE) / nullif(trips, 0)', 6, 'hit_rate')}, {_rd('CAST(held AS DOUBLE) / nullif(trips, 0)', 6, 'avg_hold_days')} FROM trd")
def trade_stats(spark, sf_dir):
    return trading(spark, sf_dir, Params()).stats.select("segment_id", "pair", "round_trips", r("hit_rate"), r("avg_hold_days"))


@query("portfolio_daily", f"{_BASE} SELECT segment_id, date, {_rd('pnl', 7)}, {_rd('cost', 7)}, {_rd('pnl_gross', 7)} FROM port", dates=('date',))
def portfolio_daily(spark, sf_dir):
    return trading(spark, sf_dir, Params()).portfolio.select("segment_id", "date", r("pnl", 7), r("cost", 7), r("pnl_gross", 7))


_EQUITY = f"""{_BASE}, eq AS (SELECT segment_id, date, pnl, pnl_gross, sum(pnl) OVER w AS equity, sum(pnl_gross) OVER w AS equity_gross FROM port WINDOW w AS (ORDER BY date, segment_id ROWS UNBOUNDED PRECEDING)),
  dd AS (SELECT *, equity - max(equity) OVER (ORDER BY date, segment_id ROWS UNBOUNDED PRECEDING) AS drawdown FROM eq)"""


@query("equity_drawdown", f"{_EQUITY} SELECT segment_id, date, {_rd('equity')}, {_rd('equity_gross')}, {_rd('drawdown')} FROM dd", dates=('date',))
def equity_drawdown(spark, sf_dir):
    return metrics.equity(trading(spark, sf_dir, Params()).portfolio).select("segment_id", "date", r("equity"), r("equity_gross"), r("drawdown"))


@query(
    "perf_metrics",
    f"""{_EQUITY}, st AS (SELECT sum(trips) AS trips, avg(CAST(held AS DOUBLE) / nullif(trips, 0)) AS hold, avg(CAST(wins AS DOUBLE) / nullif(trips, 0)) AS hit FROM trd)
SELECT round(avg(pnl) * 252, 6) + 0.0 AS ann_mu, round(stddev_samp(pnl) * sqrt(252), 6) + 0.0 AS ann_sd, round(avg(pnl) * 252 / (stddev_samp(pnl) * sqrt(252)), 5) + 0.0 AS sharpe,
       round(avg(pnl_gross) * 252, 6) + 0.0 AS ann_mu_gross, round(avg(pnl_gross) * 252 / (stddev_samp(pnl_gross) * sqrt(252)), 5) + 0.0 AS sharpe_gross, round(min(drawdown), 6) + 0.0 AS max_drawdown,
       CAST(any_value(trips) AS BIGINT) AS total_round_trips, round(any_value(hold), 6) AS avg_hold_days, round(any_value(hit), 6) AS avg_hit_rate FROM dd, st""",
)
def perf_metrics(spark, sf_dir):
    own = trading(spark, sf_dir, Params())
    own.sim = own.sim.persist()  # looked at twice: for the portfolio and for the trips
    out = metrics.performance(own.portfolio).crossJoin(F.broadcast(metrics.trade_totals(own.stats)))
    return out.select(r("ann_mu"), r("ann_sd"), r("sharpe", 5), r("ann_mu_gross"), r("sharpe_gross", 5), r("max_drawdown"), "total_round_trips", r("avg_hold_days"), r("avg_hit_rate"))


@query("trade_fold_kalman", f"{_KAL_FOLD} SELECT segment_id, a || '|' || b AS pair, trips AS round_trips, {_rd('CAST(wins AS DOUBLE) / nullif(trips, 0)', 6, 'hit_rate')}, {_rd('CAST(held AS DOUBLE) / nullif(trips, 0)', 6, 'avg_hold_days')} FROM trd")
def trade_fold_kalman(spark, sf_dir):
    return trading(spark, sf_dir, Params(use_kalman=True)).stats.select("segment_id", "pair", "round_trips", r("hit_rate"), r("avg_hold_days"))


@query("trade_fold_cross", f"{_CROSS} SELECT {_SIM_ROWS}", dates=('date',))
def trade_fold_cross(spark, sf_dir):
    """Exits where the spread crosses its mean, entries without confirmation, positions held through earnings."""
    own = trading(spark, sf_dir, PLAIN).daily
    return own.where("pos != 0 OR pnl != 0").select("segment_id", "a", "b", "date", r("pnl", 8), r("cost", 8), "pos")


# ---------------------------------------------------------------------------------------------- selection

_CANDIDATES = "cand AS (SELECT x.segment_id, x.cluster, x.ticker AS a, y.ticker AS b FROM lab x JOIN lab y ON x.segment_id = y.segment_id AND x.cluster = y.cluster AND x.ticker < y.ticker)"
_FORM_STEPS = f"""{_LABELS}, {_CANDIDATES}, fw AS MATERIALIZED (
  SELECT c.segment_id, c.cluster, c.a, c.b, al.date, pa, pb, CASE WHEN r0.rn - cal.rn < 63 AND rb IS NOT NULL THEN ra END AS x, CASE WHEN r0.rn - cal.rn < 63 AND ra IS NOT NULL THEN rb END AS y
  FROM cand c JOIN seg ON seg.segment_id = c.segment_id JOIN cal r0 ON r0.date = seg.d0 JOIN al ON al.a = c.a AND al.b = c.b JOIN cal ON cal.date = al.date AND cal.rn BETWEEN r0.rn - 251 AND r0.rn
), lv AS (SELECT segment_id, a, b, regr_slope(pa, pb) AS beta, regr_intercept(pa, pb) AS alpha, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS corr63 FROM fw GROUP BY ALL
), rs AS (SELECT segment_id, cluster, a, b, date, beta, alpha, corr63, pa - beta * pb - alpha AS e FROM fw JOIN lv USING (segment_id, a, b)
), ls AS (SELECT *, lag(e) OVER (PARTITION BY segment_id, a, b ORDER BY date) AS e1 FROM rs
), ag AS (SELECT segment_id, cluster, a, b, any_value(beta) AS beta, any_value(alpha) AS alpha, any_value(corr63) AS corr63, count(e - e1) AS n, regr_sxx(e - e1, e1) AS sxx, regr_syy(e - e1, e1) AS syy, regr_sxy(e - e1, e1) AS sxy FROM ls GROUP BY segment_id, cluster, a, b
), fs AS MATERIALIZED (SELECT *, sxy / sxx AS rho, (sxy / sxx) / sqrt(greatest(syy - sxy / sxx * sxy, 0) / ((n - 2) * sxx)) AS adf FROM ag
), st AS MATERIALIZED (SELECT segment_id, cluster, a, b, n, beta, alpha, corr63, adf, CASE WHEN rho < 0 AND rho > -1 THEN -ln(2.0) / ln(1 + rho) END AS half_life FROM fs)"""
_FORM = f"{_ALIGN}, {_SEGMENTS}, {_FORM_STEPS}"
_JUDGED_STEPS = f"""{_FORM_STEPS}, jd AS (SELECT *, coalesce(beta BETWEEN 0.25 AND 4.0 AND half_life BETWEEN 0.05 AND 30.0 AND corr63 >= 0.70 AND adf <= -3.33613 - 6.1101 / n - 6.823 / (n * n), FALSE) AS passes,
    coalesce(beta BETWEEN 0.25 AND 4.0 AND half_life BETWEEN 0.05 AND 30.0 AND corr63 >= 0.65 AND adf <= -3.04445 - 4.2412 / n - 2.720 / (n * n), FALSE) AS passes_held FROM st),
  rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY segment_id, cluster ORDER BY passes DESC, round(adf, 9) ASC NULLS LAST, a, b) AS INTEGER) AS pair_rank
         FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, cluster ORDER BY round(corr63, 9) DESC NULLS LAST, a, b) AS corr_rank FROM jd) WHERE corr_rank <= 40),
  tp AS MATERIALIZED (SELECT * FROM rk WHERE passes AND pair_rank <= 5)"""
#: The walk over segments as a recursion whose state is a list of pairs with their last three marks as bits.
_WALK_STEPS = f"""{_JUDGED_STEPS}, ws AS MATERIALIZED (
  SELECT segment_id, CAST(row_number() OVER (ORDER BY segment_id) AS INTEGER) AS ord, rws FROM (
    SELECT segment_id, list({{'pair': a || '|' || b, 'rank': pair_rank, 'new': passes, 'old': passes_held}} ORDER BY pair_rank, a, b) AS rws FROM rk WHERE passes OR passes_held GROUP BY segment_id) q
), wk AS (
  SELECT 0 AS ord, CAST(-1 AS INTEGER) AS segment_id, CAST([] AS STRUCT(pair VARCHAR, bits INTEGER)[]) AS hist, CAST([] AS VARCHAR[]) AS held, CAST([] AS VARCHAR[]) AS fresh
  UNION ALL
  SELECT ord, segment_id, CASE WHEN len(held) + len(fresh) = 0 THEN hist ELSE list_transform(list_distinct(list_concat(list_transform(hist, lambda h: h.pair), held, fresh)),
      lambda p: {{'pair': p, 'bits': CAST((coalesce(list_filter(hist, lambda h: h.pair = p)[1].bits, 0) * 2 + CASE WHEN list_contains(held, p) OR list_contains(fresh, p) THEN 1 ELSE 0 END) % 8 AS INTEGER)}}) END, held, fresh
  FROM (SELECT ord, segment_id, hist, held, list_transform(list_slice(list_filter(rws, lambda x: x.new AND x.rank <= 5 AND NOT list_contains(held, x.pair)), 1,
          greatest(CAST(floor(len(held) / 0.65::DOUBLE * 0.35::DOUBLE) AS INTEGER) + 1, 5)), lambda x: x.pair) AS fresh
        FROM (SELECT s.ord, s.segment_id, hist, rws, list_transform(list_filter(rws, lambda x: x.old AND coalesce(bit_count(list_filter(hist, lambda h: h.pair = x.pair)[1].bits) >= 2, FALSE)), lambda x: x.pair) AS held
              FROM wk JOIN ws s ON s.ord = wk.ord + 1) q1) q2
), wp AS MATERIALIZED (
  SELECT u.segment_id, u.maintenance, rk.a, rk.b, u.pair, rk.pair_rank, rk.cluster, rk.beta, rk.alpha
  FROM (SELECT segment_id, unnest(held) AS pair, TRUE AS maintenance FROM wk UNION ALL SELECT segment_id, unnest(fresh), FALSE FROM wk) u JOIN rk ON rk.segment_id = u.segment_id AND rk.a || '|' || rk.b = u.pair)"""
#: Labels held while they agree with the new ones: h names the refit date whose labels are held.
_FROZEN = """aric AS (SELECT x.segment_id AS i, y.segment_id AS j, x.cluster AS p, y.cluster AS c, count(*) AS n FROM lab x JOIN lab y ON x.ticker = y.ticker AND x.segment_id < y.segment_id GROUP BY ALL),
  arit AS (SELECT i, j, sum(n * (n - 1) / 2.0) AS bth, sum(n) AS t FROM aric GROUP BY i, j), arix AS (SELECT i, j, sum(n * (n - 1) / 2.0) AS x FROM (SELECT i, j, p, sum(n) AS n FROM aric GROUP BY ALL) GROUP BY i, j),
  ariy AS (SELECT i, j, sum(n * (n - 1) / 2.0) AS y FROM (SELECT i, j, c, sum(n) AS n FROM aric GROUP BY ALL) GROUP BY i, j),
  arij AS MATERIALIZED (SELECT i, j, coalesce((bth - x * y / (t * (t - 1) / 2.0)) / nullif((x + y) / 2.0 - x * y / (t * (t - 1) / 2.0), 0), 1.0) AS ari FROM arit JOIN arix USING (i, j) JOIN ariy USING (i, j)),
  hl AS (SELECT 0 AS j, 0 AS h UNION ALL SELECT hl.j + 1, CASE WHEN ari < 0.6 THEN hl.j + 1 ELSE hl.h END FROM hl JOIN arij ON arij.i = hl.h AND arij.j = hl.j + 1),
  frz AS MATERIALIZED (SELECT hl.j AS segment_id, seg.d0 AS refit_date, o.ticker, o.cluster FROM hl JOIN lab o ON o.segment_id = hl.h JOIN seg ON seg.segment_id = hl.j)"""
_JUDGED = f"{_ALIGN}, {_SEGMENTS}, {_JUDGED_STEPS}"


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prices(spark, sf_dir)
    pairs = discovery.candidates(_labelled(spark, sf_dir))
    return discovery.ranking(features.align(features.ticker_features(own), pairs), calendar.calendar(own), segment_table(spark, sf_dir), pairs, LOOSE)


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The few pairs chosen."""
    return discovery.top_pairs(_ranking(spark, sf_dir), LOOSE)


def _walked(spark: SparkSession, sf_dir: str) -> discovery.Walk:
    return discovery.walk(_ranking(spark, sf_dir), segment_table(spark, sf_dir), LOOSE)


@query("formation_stats", f"{_FORM} SELECT segment_id, a, b, n, {_rd('beta', 5)}, {_rd('alpha', 5)}, {_rd('corr63', 6)}, {_rd('adf', 5)}, {_rd('half_life', 4)} FROM st")
def formation_stats(spark, sf_dir):
    own = prices(spark, sf_dir)
    pairs = discovery.candidates(_labelled(spark, sf_dir))
    rows = discovery.formation_rows(features.align(features.ticker_features(own), pairs), calendar.calendar(own), segment_table(spark, sf_dir), 252, pairs)
    return discovery.formation_stats(rows, pairs).select("segment_id", "a", "b", "n", r("beta", 5), r("alpha", 5), r("corr63"), r("adf", 5), r("half_life", 4))


@query("top_pairs", f"{_JUDGED} SELECT segment_id, cluster, a, b, pair_rank, {_rd('adf', 5)} FROM tp")
def top_pairs(spark, sf_dir):
    return _top(spark, sf_dir).select("segment_id", "cluster", "a", "b", "pair_rank", r("adf", 5))


@query("candidate_pairs", f"{_PANEL}, {_SEGMENTS}, {_LABELS}, {_CANDIDATES} SELECT segment_id, cluster, a, b FROM cand")
def candidate_pairs(spark, sf_dir):
    return discovery.candidates(_labelled(spark, sf_dir))


@query("traded_universe", f"{_JUDGED} SELECT a AS ticker FROM tp UNION SELECT b FROM tp")
def traded_universe(spark, sf_dir):
    own = _top(spark, sf_dir)
    return own.select(F.col("a").alias("ticker")).union(own.select("b")).distinct()


@query(
    "segment_pair_stats",
    f"""{_BASE}, {_JUDGED_STEPS} SELECT tp.segment_id, tp.a || '|' || tp.b AS pair, pair_rank, coalesce(trips, 0) AS round_trips, {_rd('CAST(wins AS DOUBLE) / nullif(trips, 0)', 6, 'hit_rate')}, {_rd('CAST(held AS DOUBLE) / nullif(trips, 0)', 6, 'avg_hold_days')}
FROM tp LEFT JOIN trd ON trd.segment_id = tp.segment_id AND trd.a = tp.a AND trd.b = tp.b""",
)
def segment_pair_stats(spark, sf_dir):
    own = metrics.attach_stats(_top(spark, sf_dir), trading(spark, sf_dir, Params()).stats)
    return own.select("segment_id", "pair", "pair_rank", F.coalesce("round_trips", F.lit(0)).alias("round_trips"), r("hit_rate"), r("avg_hold_days"))


@query(
    "new_pair_cap",
    f"""{_ALIGN}, {_SEGMENTS}, {_WALK_STEPS} SELECT segment_id, CAST(len(held) AS BIGINT) AS held_over, CAST(len(fresh) AS BIGINT) AS fresh, greatest(CAST(floor(len(held) / 0.65::DOUBLE * 0.35::DOUBLE) AS INTEGER) + 1, 5) AS cap
FROM wk WHERE len(held) + len(fresh) > 0""",
)
def new_pair_cap(spark, sf_dir):
    """How many pairs each segment holds over and takes anew, and how many new ones it may take."""
    own = _walked(spark, sf_dir).selected.groupBy("segment_id").agg(F.count_if("maintenance").alias("held_over"), F.count_if(~F.col("maintenance")).alias("fresh")).toPandas()
    rows = [(int(x.segment_id), int(x.held_over), int(x.fresh), discovery.most_new(int(x.held_over), LOOSE.top_k)) for x in own.itertuples()]  # a row for each segment
    return spark.createDataFrame(rows, "segment_id int, held_over long, fresh long, cap int")


@query("selection_diagnostics", f"{_ALIGN}, {_SEGMENTS}, {_WALK_STEPS} SELECT count(*) AS pairs, count(DISTINCT pair) AS unique_pairs, count(*) FILTER (maintenance) AS maintenance, count(DISTINCT segment_id) AS segments FROM wp")
def selection_diagnostics(spark, sf_dir):
    return metrics.diagnostics(_walked(spark, sf_dir).selected)


@query("walk_selection", f"{_ALIGN}, {_SEGMENTS}, {_WALK_STEPS} SELECT segment_id, a, b, cluster, pair_rank, maintenance, {_rd('beta', 5)}, {_rd('alpha', 5)} FROM wp")
def walk_selection(spark, sf_dir):
    """The pairs of every segment: those held over and, under the cap, new ones."""
    return _walked(spark, sf_dir).selected.select("segment_id", "a", "b", "cluster", "pair_rank", "maintenance", r("beta", 5), r("alpha", 5))


_ORD = "od AS (SELECT segment_id, row_number() OVER (ORDER BY segment_id) AS ord FROM (SELECT DISTINCT segment_id FROM tp)), pp AS (SELECT DISTINCT segment_id, ord, a || '|' || b AS pair FROM tp JOIN od USING (segment_id))"


@query("pair_overlap", f"{_JUDGED}, {_ORD} SELECT y.segment_id, count(*) AS pairs, count(x.pair) AS shared, {_rd('count(x.pair) / count(*)', 6, 'overlap')} FROM pp y LEFT JOIN pp x ON x.ord = y.ord - 1 AND x.pair = y.pair WHERE y.ord > 1 GROUP BY y.segment_id")
def pair_overlap(spark, sf_dir):
    own = metrics.pair_overlap(_top(spark, sf_dir))
    return own.select("segment_id", "pairs", "shared", r("overlap"))


@query(
    "maintenance_history",
    f"""{_ALIGN}, {_SEGMENTS}, {_WALK_STEPS}, od AS (SELECT segment_id, row_number() OVER (ORDER BY segment_id) AS ord FROM (SELECT DISTINCT segment_id FROM wp)), pp AS (SELECT DISTINCT segment_id, ord, pair FROM wp JOIN od USING (segment_id)),
  fo AS (SELECT pair, min(ord) AS f FROM pp GROUP BY pair), gr AS (SELECT fo.pair, od.ord, od.segment_id, (pp.pair IS NOT NULL) AS passed FROM fo JOIN od ON od.ord >= fo.f LEFT JOIN pp ON pp.pair = fo.pair AND pp.ord = od.ord)
SELECT segment_id, pair, passed, CAST(sum(CAST(passed AS INTEGER)) OVER w AS BIGINT) AS passes, sum(CAST(passed AS INTEGER)) OVER w >= 2 AS held_over FROM gr WINDOW w AS (PARTITION BY pair ORDER BY ord ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def maintenance_history(spark, sf_dir):
    return _walked(spark, sf_dir).history


@query(
    "frozen_formation_stats",
    f"""{_JUDGED}, ck AS (SELECT DISTINCT tp.segment_id, d0, a, b, beta, alpha FROM tp JOIN seg USING (segment_id)), sq AS (SELECT ck.segment_id, ck.a, ck.b, al.date, d0, pa - (ck.beta * pb + ck.alpha) AS s FROM ck JOIN al ON al.a = ck.a AND al.b = ck.b),
  sl AS (SELECT *, lag(s) OVER (PARTITION BY segment_id, a, b ORDER BY date) AS s1 FROM sq)
SELECT segment_id, a, b, {_rd('CASE WHEN count(s1) FILTER (date < d0) >= 5 THEN avg(s1) FILTER (date < d0) ELSE 0 END', 6, 'mu')}, {_rd('CASE WHEN count(s1) FILTER (date < d0) >= 5 THEN nullif(stddev_samp(s1) FILTER (date < d0), 0) END', 6, 'sd')} FROM sl GROUP BY ALL""",
)
def frozen_formation_stats(spark, sf_dir):
    chosen = _top(spark, sf_dir).join(segment_table(spark, sf_dir), "segment_id")
    own = ticker_rows(spark, sf_dir)
    out = hedge.frozen_features(features.align(own, chosen), chosen, Params(freeze_beta=True, freeze_spread_stats=True))
    return out.groupBy("segment_id", "a", "b").agg(r(F.first("mu"), 6).alias("mu"), r(F.first("sd"), 6).alias("sd"))


# ---------------------------------------------------------------------------------------------- clusters and walk


@query(
    "adjusted_rand",
    f"""{_PANEL}, {_SEGMENTS}, {_LABELS}, ct AS (SELECT y.segment_id, x.cluster AS p, y.cluster AS c, count(*) AS n FROM lab x JOIN lab y ON y.segment_id = x.segment_id + 1 AND x.ticker = y.ticker GROUP BY ALL),
  bo AS (SELECT segment_id, sum(n * (n - 1) / 2.0) AS bth, sum(n) AS t FROM ct GROUP BY 1), sx AS (SELECT segment_id, sum(n * (n - 1) / 2.0) AS x FROM (SELECT segment_id, p, sum(n) AS n FROM ct GROUP BY ALL) GROUP BY 1),
  sy AS (SELECT segment_id, sum(n * (n - 1) / 2.0) AS y FROM (SELECT segment_id, c, sum(n) AS n FROM ct GROUP BY ALL) GROUP BY 1)
SELECT segment_id, round(coalesce((bth - x * y / (t * (t - 1) / 2.0)) / nullif((x + y) / 2.0 - x * y / (t * (t - 1) / 2.0), 0), 1.0), 6) + 0.0 AS ari FROM bo JOIN sx USING (segment_id) JOIN sy USING (segment_id)""",
)
def adjusted_rand(spark, sf_dir):
    return clusters.adjusted_rand(_labelled(spark, sf_dir)).select("segment_id", r("ari"))


@query(
    "cluster_persistence",
    f"""{_PANEL}, {_SEGMENTS}, {_LABELS}, ct AS (SELECT y.segment_id, x.cluster AS p, y.cluster AS c, count(*) AS n FROM lab x JOIN lab y ON y.segment_id = x.segment_id + 1 AND x.ticker = y.ticker GROUP BY ALL),
  k AS (SELECT unnest([0, 1, 2, 3]) AS k), pm AS (SELECT a.k AS p0, b.k AS p1, c.k AS p2, d.k AS p3 FROM k a, k b, k c, k d WHERE a.k NOT IN (b.k, c.k, d.k) AND b.k NOT IN (c.k, d.k) AND c.k <> d.k),
  sc AS (SELECT segment_id, p0, p1, p2, p3, sum(n) FILTER (c = CASE p WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END) AS good, sum(n) AS t FROM ct, pm GROUP BY ALL)
SELECT segment_id, round(max(coalesce(good, 0) / t), 6) + 0.0 AS persistence FROM sc GROUP BY segment_id""",
)
def cluster_persistence(spark, sf_dir):
    return clusters.persistence(_labelled(spark, sf_dir)).select("segment_id", r("persistence"))


@query("labels_frozen", f"{_PANEL}, {_SEGMENTS}, {_LABELS}, {_FROZEN} SELECT * FROM frz", dates=('refit_date',))
def labels_frozen(spark, sf_dir):
    return clusters.freeze(_labelled(spark, sf_dir), clusters.ClusterParams().ari_threshold)


_PLANTED = f"{_PANEL}, pl AS ({duck(fixtures.PLANTED_SQL, panel='panel')}), {_SEGMENTS}"


def _clustered(method: str) -> None:
    """Labels on a panel whose tickers move in four groups: any sound method finds just these, so SQL can name them. A
    cluster is named after its first ticker."""

    @query(f"cluster_labels_{method}", f"{_PLANTED} SELECT segment_id, d0 AS refit_date, ticker, first AS cluster FROM seg, (SELECT ticker, min(ticker) OVER (PARTITION BY grp) AS first FROM (SELECT DISTINCT ticker, grp FROM pl))", dates=("refit_date",))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = fixtures.derived(fixtures.PLANTED_SQL, panel_of(spark, sf_dir))
        own, days = panels.prices(raw), calendar.calendar(prices(spark, sf_dir))
        factors = features.factor_zscore(panels.factor_returns(fixtures.derived(fixtures.GROUP_FACTORS_SQL, raw)))
        control = panels.control_factors(factors).select("date", "factor", F.col("z").alias("ret"))
        c = clusters.ClusterParams(method=method)
        labels = clusters.freeze(clusters.rolling_labels(features.ticker_features(own), factors, days, segment_table(spark, sf_dir), c, control), c.ari_threshold)
        return labels.withColumn("cluster", F.min("ticker").over(Window.partitionBy("segment_id", "cluster")))


for _m in clusters.METHODS:
    _clustered(_m)


def _walk(spark: SparkSession, sf_dir: str) -> walkforward.WalkForward:
    """The whole run, from labels by rule."""
    panel = panel_of(spark, sf_dir)
    factors = panels.factor_returns(fixtures.derived(fixtures.FACTORS_SQL, panel))
    return walkforward.walk_forward(panels.prices(panel), factors, f=LOOSE, refit=REFIT, labels=_labelled(spark, sf_dir))


#: From labels that are held to the pairs of every segment, beside the simulation of all pairs.
_RUN = f"{_BASE}, {_WALK_STEPS.replace(_LABELS, _LABELS + ', ' + _FROZEN).replace(_CANDIDATES, _CANDIDATES.replace('lab ', 'frz '))}"
_RUN_STATS = "ts AS (SELECT wp.segment_id, wp.pair, wp.a, wp.b, wp.pair_rank, wp.maintenance, t.trips, t.wins, t.held FROM wp LEFT JOIN trd t ON t.segment_id = wp.segment_id AND t.a = wp.a AND t.b = wp.b)"


@query("walk_forward_pairs", f"{_RUN}, {_RUN_STATS} SELECT segment_id, pair, pair_rank, maintenance, trips AS round_trips, {_rd('CAST(wins AS DOUBLE) / nullif(trips, 0)', 6, 'hit_rate')}, {_rd('CAST(held AS DOUBLE) / nullif(trips, 0)', 6, 'avg_hold_days')} FROM ts")
def walk_forward_pairs(spark, sf_dir):
    return _walk(spark, sf_dir).result.segment_pairs.select("segment_id", "pair", "pair_rank", "maintenance", "round_trips", r("hit_rate"), r("avg_hold_days"))


@query(
    "walk_forward_summary",
    f"""{_RUN}, {_RUN_STATS}, prt AS (SELECT segment_id, date, sum(pnl) AS pnl, sum(pnl) + sum(cost) AS gross FROM done JOIN trd USING (segment_id, a, b) JOIN wp USING (segment_id, a, b) GROUP BY ALL),
  eqt AS (SELECT *, sum(pnl) OVER w AS eq FROM prt WINDOW w AS (ORDER BY date, segment_id ROWS UNBOUNDED PRECEDING)), dwn AS (SELECT *, eq - max(eq) OVER (ORDER BY date, segment_id ROWS UNBOUNDED PRECEDING) AS dd FROM eqt),
  perf AS (SELECT round(avg(pnl) * 252, 6) + 0.0 AS ann_mu, round(avg(pnl) * 252 / (stddev_samp(pnl) * sqrt(252)), 5) + 0.0 AS sharpe, round(avg(gross) * 252, 6) + 0.0 AS ann_mu_gross, round(min(dd), 6) + 0.0 AS max_drawdown, count(*) AS days FROM dwn),
  tot2 AS (SELECT CAST(coalesce(sum(trips), 0) AS BIGINT) AS total_round_trips, round(avg(CAST(held AS DOUBLE) / nullif(trips, 0)), 6) AS avg_hold_days, round(avg(CAST(wins AS DOUBLE) / nullif(trips, 0)), 6) AS avg_hit_rate, count(*) AS pairs,
           count(DISTINCT pair) AS unique_pairs, count(*) FILTER (maintenance) AS maintenance, count(DISTINCT segment_id) AS segments FROM ts),
  od AS (SELECT segment_id, row_number() OVER (ORDER BY segment_id) AS ord FROM (SELECT DISTINCT segment_id FROM wp)), pp AS (SELECT ord, pair FROM wp JOIN od USING (segment_id)),
  ovl AS (SELECT avg(v) AS overlap_rate FROM (SELECT y.ord, count(x.pair) / count(*) AS v FROM pp y LEFT JOIN pp x ON x.ord = y.ord - 1 AND x.pair = y.pair WHERE y.ord > 1 GROUP BY y.ord)),
  ctp AS (SELECT y.segment_id, x.cluster AS p, y.cluster AS c, count(*) AS n FROM frz x JOIN frz y ON y.segment_id = x.segment_id + 1 AND x.ticker = y.ticker GROUP BY ALL),
  kk AS (SELECT unnest([0, 1, 2, 3]) AS k), pms AS (SELECT a.k AS p0, b.k AS p1, c.k AS p2, d.k AS p3 FROM kk a, kk b, kk c, kk d WHERE a.k NOT IN (b.k, c.k, d.k) AND b.k NOT IN (c.k, d.k) AND c.k <> d.k),
  scr AS (SELECT segment_id, p0, p1, p2, p3, sum(n) FILTER (c = CASE p WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END) AS good, sum(n) AS t FROM ctp, pms GROUP BY ALL),
  per AS (SELECT avg(v) AS cluster_persistence FROM (SELECT segment_id, max(coalesce(good, 0) / t) AS v FROM scr GROUP BY segment_id))
SELECT perf.*, tot2.*, round(overlap_rate, 6) + 0.0 AS overlap_rate, round(cluster_persistence, 6) + 0.0 AS cluster_persistence, (SELECT count(*) FROM seg) AS planned_segments FROM perf, tot2, ovl, per""",
)
def walk_forward_summary(spark, sf_dir):
    own = _walk(spark, sf_dir)
    row = own.summary().select(
        r("ann_mu"), r("sharpe", 5), r("ann_mu_gross"), r("max_drawdown"), "days", "total_round_trips", r("avg_hold_days"), r("avg_hit_rate"), "pairs", "unique_pairs", "maintenance", "segments",
        r("overlap_rate"), r("cluster_persistence"), "planned_segments",
    )
    out = spark.createDataFrame(row.collect(), row.schema)  # one row
    own.release()
    return out


# ---------------------------------------------------------------------------------------------- a universe that grows

_WIDE = f"WITH panel AS MATERIALIZED ({duck(fixtures.WIDE_SQL)})"


@query("wide_returns", f"""{_WIDE}, px AS (SELECT ticker, date, ln(close) AS lp, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM panel)
SELECT ticker, count(*) AS days, {_rd('sum(lp)', 4, 'total')}, {_rd('sum(ret)', 6, 'ret')} FROM px GROUP BY ticker""")
def wide_returns(spark, sf_dir):
    """A panel with a ticker for each supplier: its universe grows with the tables."""
    own = features.ticker_features(panels.prices(fixtures.panel_table(spark, sf_dir, fixtures.WIDE_SQL)))
    return own.groupBy("ticker").agg(F.count(F.lit(1)).alias("days"), r(F.sum("lp"), 4, "total"), r(F.sum("ret"), 6, "ret"))


_WIDE_LABELS = "lab AS (SELECT segment_id, ticker, CAST(CAST(right(ticker, 6) AS INTEGER) // 10 AS INTEGER) AS cluster FROM (SELECT DISTINCT ticker FROM panel), seg)"


@query(
    "wide_selection",
    f"""{_WIDE}, px AS MATERIALIZED (SELECT ticker, date, ln(close) AS lp, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM panel),
  cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS rn FROM (SELECT DISTINCT date FROM panel)),
  seg AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS segment_id, date AS d0, rn AS rn0 FROM cal WHERE rn >= {BURN} AND (rn - {BURN}) % {4 * REFIT} = 0),
  {_WIDE_LABELS}, {_CANDIDATES}, nb AS (
  SELECT c.segment_id, c.cluster, c.a, c.b, covar_pop(x.ret, y.ret) / nullif(stddev_pop(x.ret) * stddev_pop(y.ret), 0) AS corr
  FROM cand c JOIN seg USING (segment_id) JOIN cal ON cal.rn BETWEEN seg.rn0 - 62 AND seg.rn0 JOIN px x ON x.ticker = c.a AND x.date = cal.date JOIN px y ON y.ticker = c.b AND y.date = cal.date GROUP BY ALL
), rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY segment_id, cluster ORDER BY round(corr, 9) DESC NULLS LAST, a, b) AS INTEGER) AS corr_rank FROM nb)
SELECT segment_id, cluster, a, b, corr_rank FROM rk WHERE corr_rank <= 5""",
)
def wide_selection(spark, sf_dir):
    """The most correlated pairs of every cluster and segment of the growing universe."""
    own = panels.prices(fixtures.panel_table(spark, sf_dir, fixtures.WIDE_SQL))
    days = calendar.calendar(own)
    parts = calendar.segments(days, 4 * REFIT, BURN)
    number = F.substring("ticker", -6, 6).cast("int")
    labels = own.select("ticker").distinct().crossJoin(F.broadcast(parts)).select("segment_id", "ticker", F.floor(number / 10).cast("int").alias("cluster"))
    rows = discovery.cluster_rows(features.ticker_features(own), labels, days, parts, discovery.CORR_ROWS)
    return discovery.most_correlated(rows, None, Filters(cluster_cap=5)).select("segment_id", "cluster", "a", "b", "corr_rank")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_zscore(spark, sf_dir)
