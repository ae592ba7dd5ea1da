"""Deterministic price panels made from the test tables, as there is no price data: the same SQL text runs in Spark
and in DuckDB, so oracles start from equal inputs."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A dense panel of cointegrated tickers: (ticker, date, close, volume).
PANEL_SQL = """
with px as (select p_brand as k, cast(l_shipdate as date) as d, ln(avg(l_extendedprice/l_quantity)) as u, sum(l_quantity) as v
            from {lineitem} join {part} on l_partkey = p_partkey group by 1, 2),
     st as (select avg(u) as m, stddev_samp(u) as s from px),
     mk as (select d, avg(u) as u from px group by 1),
     ms as (select avg(u) as m, stddev_samp(u) as s from mk),
     fx as (select d, cast(row_number() over (order by d) as bigint) as di,
                   sum(0.01*least(greatest((u-m)/s,-2.0),2.0)) over (order by d rows unbounded preceding) as f
            from mk, ms),
     ks as (select k, cast(row_number() over (order by k) as bigint) as ki from (select distinct k from px) q)
select ks.k as ticker, fx.d as date,
       round(exp(4.0 + (0.8+0.02*ki)*f
           + 0.003*(case when px.u is not null then least(greatest((px.u-st.m)/st.s,-2.0),2.0)
                         else 4.0*(cast(((ki*7919+di*di*31+di*ki*ki*613) % 1009) as double)/1009.0-0.5) end)), 4) as close,
       cast(coalesce(px.v, 100.0+ki) as double) as volume
from ks cross join fx cross join st left join px on px.k = ks.k and px.d = fx.d
"""

#: A dense panel with a ticker for each supplier, whose number grows with the scale factor: a common path, one for each ten
#: tickers, and noise by rule; volumes are what the supplier shipped on the day.
WIDE_SQL = """
with fx as (select d, cast(row_number() over (order by d) as bigint) as di from (select distinct cast(l_shipdate as date) as d from {lineitem}) q),
     ks as (select k, cast(row_number() over (order by k) as bigint) - 1 as ki from (select distinct l_suppkey as k from {lineitem}) q),
     gs as (select distinct cast(floor(ki / 10) as bigint) as g from ks),
     gp as (select g, d, sum(0.02 * (cast(((g + 3) * 7919 + di * di * 31 + di * (g + 3) * 613) % 1009 as double) / 1009.0 - 0.5)) over (partition by g order by d rows unbounded preceding) as f from gs cross join fx),
     sh as (select l_suppkey as k, cast(l_shipdate as date) as d, sum(l_quantity) as v from {lineitem} group by 1, 2)
select concat('S', lpad(cast(ki as string), 6, '0')) as ticker, fx.d as date,
       exp(4.0 + (0.9 + 0.01 * (ki % 10)) * gp.f + 0.004 * (cast((ki * 7919 + di * di * 31 + di * ki * ki * 613) % 1009 as double) / 1009.0 - 0.5)) as close,
       cast(coalesce(sh.v, 100.0) as double) as volume
from ks cross join fx join gp on gp.g = cast(floor(ks.ki / 10) as bigint) and gp.d = fx.d left join sh on sh.k = ks.k and sh.d = fx.d
"""

#: The panel with a strong path added to each of four groups of its tickers.
PLANTED_SQL = """
with n as (select ticker, date, close, volume, cast(dense_rank() over (order by ticker) as bigint) as ki, cast(dense_rank() over (order by date) as bigint) as di from {panel}),
     g as (select grp, di, sum(0.08 * (cast(((grp + 1) * 7919 + di * di * 31 + di * (grp + 1) * 613) % 1009 as double) / 1009.0 - 0.5)) over (partition by grp order by di rows unbounded preceding) as f
           from (select distinct ki % 4 as grp, di from n) q)
select n.ticker, n.date, exp(ln(n.close) + g.f) as close, n.volume, g.grp from n join g on g.grp = n.ki % 4 and g.di = n.di
"""

#: Daily changes of the mean log price of all tickers of the planted panel, as SPY, and of each group.
GROUP_FACTORS_SQL = """
with m as (select date, 'SPY' as factor, avg(ln(close)) as f from {panel} group by date union all select date, concat('G', cast(grp as string)), avg(ln(close)) from {panel} group by date, grp)
select date, factor, f - lag(f) over (partition by factor order by date) as ret from m
"""

#: A sparse weekly panel by brand.
WEEKLY_SQL = """
select p_brand as ticker, cast(date_trunc('week', l_shipdate) as date) as date, avg(l_extendedprice/l_quantity) as close, sum(l_quantity) as volume
from {lineitem} join {part} on l_partkey = p_partkey group by 1, 2
"""

#: Each brand's shipping day of highest quantity in a quarter.
EARNINGS_SQL = """
select ticker, date as earnings_date from (
  select ticker, date, row_number() over (partition by ticker, year(date), quarter(date) order by volume desc, date) as r from {panel}) q where r = 1
"""

#: Validity of each brand: from its first trading day but for a shift by its number; open for every second one.
MEMBERSHIP_SQL = """
with b as (select ticker, min(date) as lo, max(date) as hi, cast(row_number() over (order by ticker) as int) as ki from {panel} group by ticker)
select ticker, date_add(lo, 20 * ki) as start_date, case when ki % 2 = 0 then null else date_add(hi, -25 * ki) end as end_date from b
"""
MEMBERSHIP_DUCK = MEMBERSHIP_SQL.replace("date_add(lo, 20 * ki)", "lo + 20 * ki").replace("date_add(hi, -25 * ki)", "hi - 25 * ki")

#: Daily change of the mean log price as SPY, those of two halves of the tickers, and a constant that must be dropped.
FACTORS_SQL = """
with m as (select date, avg(ln(close)) as f, avg(case when ticker < 'Brand#3' then ln(close) end) as lo, avg(case when ticker >= 'Brand#3' then ln(close) end) as hi from {panel} group by date),
     r as (select date, f - lag(f) over (order by date) as spy, lo - lag(lo) over (order by date) as rlo, hi - lag(hi) over (order by date) as rhi from m)
select date, 'SPY' as factor, spy as ret from r union all select date, 'LOW', rlo from r union all select date, 'HIGH', rhi from r
union all select date, 'FF_RF', 0.0001 from r
"""

#: Scale by terciles of the market's trailing volatility: known from row 63 on.
REGIME_SQL = """
with m as (select date, avg(ln(close)) as f from {panel} group by date),
     r as (select date, f - lag(f) over (order by date) as x from m),
     v as (select date, case when count(x) over (order by date rows between 62 preceding and current row) = 63
                             then round(stddev_samp(x) over (order by date rows between 62 preceding and current row), 10) end as v from r),
     t as (select date, ntile(3) over (order by v, date) as n from v where v is not null)
select date, case n when 1 then 1.0 when 2 then 0.5 else 0.0 end as scale from t
"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part")}


_written: dict[tuple[str, str, str], str] = {}


def panel_table(spark: SparkSession, sf_dir: str, sql: str = PANEL_SQL) -> DataFrame:
    """A panel made from the tables, written once a session to the folder that all executors share. With a local master
    that is the machine's folder for temporary files, if none is named."""
    key = (spark.sparkContext.applicationId, sf_dir, sql)
    if key not in _written:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"{(named or 'file://' + tempfile.gettempdir()).rstrip('/')}/quantloom-panel-{uuid.uuid4().hex}"
        spark.sql(sql, **tables(spark, sf_dir)).write.parquet(path)
        atexit.register(_remove, spark, path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended before; nothing else depends on these files
        pass


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WEEKLY_SQL, **tables(spark, sf_dir))


def derived(sql: str, panel_df: DataFrame) -> DataFrame:
    return panel_df.sparkSession.sql(sql, panel=panel_df)


def duck(sql: str, **names: str) -> str:
    """The DuckDB text, with table names in place."""
    return sql.format(**({"lineitem": "lineitem", "part": "part"} | names))
