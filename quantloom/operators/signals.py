"""From pair series to the rows a trading simulation folds over: all conditions that need no state are columns here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.rolling import by, guarded_corr, trailing
from quantloom.operators import context
from quantloom.operators.features import vol_weight
from quantloom.params import CORR_BREAK, CORR_WINDOW, REGIME_FLOOR, Params

Z_DIGITS = 9


def segment_rows(series: DataFrame, selected: DataFrame) -> DataFrame:
    """series of the selected pairs (segment_id, d0, d1, a, b) within [d0, d1], both ends included: a boundary date
    belongs to two segments. Applied after all windows over history. If series tells from which date on a pair has enough
    history (ready), segments that end before it are left out; if it has several seeds of a pair, each segment gets its
    own."""
    keys = ["segment_id", "a", "b", *(["seed"] if "seed" in series.columns and "seed" in selected.columns else [])]
    own = selected.select("d0", "d1", *keys).distinct()
    if "segment_id" in series.columns:
        rows = series.join(own, keys)
        rows = rows.where((F.col("date") >= F.col("d0")) & (F.col("date") <= F.col("d1")))
    else:
        # The range join as an equi join: a row meets the one or two segments of its date before the pairs, not all of them.
        spans = own.select("segment_id", "d0", "d1").distinct().select("segment_id", "d1", F.explode(F.sequence("d0", "d1")).alias("date"))
        rows = series.join(spans, "date").join(own.select(*keys), keys, "left_semi")
    if "ready" in series.columns:
        rows = rows.where(F.col("ready") <= F.col("d1")).drop("ready")
    return rows.drop("d0", "d1", "seed")


def corr_break(rows: DataFrame) -> DataFrame:
    """Adds brk: the legs' returns over the segment's last five rows (missing ones as 0) correlate below the limit."""
    over = trailing(by("segment_id", "a", "b"), CORR_WINDOW)
    own = rows.withColumn("_x", F.coalesce("ra", F.lit(0.0))).withColumn("_y", F.coalesce("rb", F.lit(0.0)))
    low = (F.count(F.lit(1)).over(over) >= CORR_WINDOW) & (F.round(guarded_corr("_x", "_y", over), 9) < CORR_BREAK)
    return own.withColumn("brk", F.coalesce(low, F.lit(False))).drop("_x", "_y")


def impact_factor(rows: DataFrame, p: Params) -> DataFrame:
    """Adds imp: what the square root of a weight is multiplied by for its market impact; 0 for a leg without volume."""
    if not p.enable_impact:
        return rows.withColumn("imp", F.lit(0.0))
    leg = lambda adv: F.coalesce(F.when(F.col(adv) > 0, F.sqrt(F.lit(p.portfolio_notional_usd) / F.col(adv))), F.lit(0.0))
    return rows.withColumn("imp", F.lit(p.impact_k_bps / 1e4) * (leg("adva") + leg("advb")))


def gates(rows: DataFrame, p: Params, blocked: DataFrame | None = None, regime: DataFrame | None = None) -> DataFrame:
    """Adds z rounded, valid, zprev, w, imp, brk, blk, rscale, shut (no entry today, whatever the state)."""
    own = rows.withColumn("z", F.round("z", Z_DIGITS))
    own = own.withColumn("zprev", F.lag("z").over(by("segment_id", "a", "b")))
    own = corr_break(own)
    own = impact_factor(vol_weight(own, p), p)
    own = context.with_regime(context.with_blackout(own, blocked), regime)
    own = own.withColumn("valid", F.col("z").isNotNull() & F.col("rp").isNotNull() & F.coalesce(F.col("sigma") > 0, F.lit(False)))
    shut = (F.col("rscale") < REGIME_FLOOR) | F.col("blk")
    if p.use_kalman and not p.freeze_beta and p.kalman_beta_unc_cap > 0:
        shut = shut | F.coalesce(F.col("unc") > p.kalman_beta_unc_cap, F.lit(False))
    if p.min_adv_usd > 0:
        zero = F.lit(0.0)
        shut = shut | (F.coalesce("adva", zero) < p.min_adv_usd) | (F.coalesce("advb", zero) < p.min_adv_usd)
    return own.withColumn("shut", shut)
