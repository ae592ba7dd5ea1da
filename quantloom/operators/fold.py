"""The per-pair trading simulation as a fold over a segment's rows, in expressions only.

Each (segment, a, b) group is at most a refit period long; its rows are gathered, sorted by date and folded. State kept
from row to row: position, days held, days since exit, spread, beta and regime scale at entry, last weight, tallies. An
array that grows by a row is copied, so rows are folded in runs of RUN, and the runs' rows put together at the end: the
work is in proportion to a segment's length as long as that is not many times RUN squared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.rolling import let
from quantloom.operators import costs
from quantloom.params import BETA_DRIFT, Params

FIELDS = ("date", "z", "zprev", "s", "beta1", "rp", "w", "imp", "brk", "blk", "rscale", "valid", "shut")
_OUT = "array<struct<date:date,pnl:double,cost:double,pos:int>>"
STATE = ("pos", "days", "since", "es", "eb", "er", "lw", "ls", "trips", "wins", "held")
RUN = 32


def _start(p: Params) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(
        F.lit(0).alias("pos"), F.lit(0).alias("days"), F.lit(p.cooldown_days).alias("since"), none.alias("es"), none.alias("eb"), F.lit(1.0).alias("er"),
        F.lit(0.0).alias("lw"), none.alias("ls"), F.lit(0).alias("trips"), F.lit(0).alias("wins"), F.lit(0).cast("long").alias("held"), F.array().cast(_OUT).alias("out"),
    )


def _step(p: Params):
    yes, no = F.lit(True), F.lit(False)

    def step(st: Column, x: Column) -> Column:
        since = st["since"] + F.when(x["valid"] & (st["pos"] == 0), 1).otherwise(0)
        free = x["valid"] & (st["pos"] == 0) & ~x["shut"]
        if p.cooldown_days > 0:
            free = free & (since >= p.cooldown_days)
        turn = (lambda c: yes) if p.no_entry_confirm else (lambda c: F.coalesce(c, no))
        short = free & (x["z"] >= p.z_entry) & turn(x["z"] < x["zprev"])
        long = free & (x["z"] <= -p.z_entry) & turn(x["z"] > x["zprev"])
        held = x["valid"] & (st["pos"] != 0)
        days = st["days"] + F.when(held, 1).otherwise(0)
        reverted = (st["pos"] * x["z"] >= 0) if p.zero_cross_exit else (F.abs(x["z"]) <= p.z_exit)
        out = reverted | (days >= p.time_stop) | (F.abs(x["z"]) > p.hard_stop) | x["brk"]
        if not p.freeze_beta:
            out = out | F.coalesce((F.abs(st["eb"]) > 1e-6) & (F.abs(F.try_divide(x["beta1"] - st["eb"], F.nullif(st["eb"], F.lit(0.0)))) > BETA_DRIFT), no)
        if p.earnings_force_exit:
            out = out | x["blk"]
        enter = F.when(short, -1).when(long, 1).otherwise(0)
        first = F.struct(
            since.alias("since"), days.alias("days"), held.alias("held"), (held & F.coalesce(out, no)).alias("out"), enter.alias("enter"),
            F.when(held, x["w"] * st["er"]).otherwise(0.0).alias("size"), F.when(enter != 0, x["w"] * x["rscale"]).otherwise(0.0).alias("ew"),
        )

        def settle(v: Column) -> Column:
            turn_of = lambda size: costs.explicit(size, p) + costs.impact(size, x["imp"])
            entry = F.when(v["enter"] != 0, turn_of(v["ew"])).otherwise(0.0)
            leave = F.when(v["out"], turn_of(v["size"])).otherwise(0.0)
            cost = entry + leave + (F.when(v["held"], costs.borrow(v["size"], p)).otherwise(0.0) if p.borrow_apr_bps > 0 else F.lit(0.0))
            gain = F.when(v["held"], v["size"] * st["pos"] * x["rp"]).otherwise(0.0)
            won = v["out"] & F.coalesce((x["s"] - st["es"]) * st["pos"] * v["size"] > 0, no)
            inn = v["enter"] != 0
            pos = F.when(v["out"], 0).when(inn, v["enter"]).otherwise(st["pos"])
            row = F.struct(x["date"].alias("date"), (gain - cost).alias("pnl"), cost.alias("cost"), pos.alias("pos"))
            return F.struct(
                pos.alias("pos"), F.when(inn | v["out"], 0).otherwise(v["days"]).alias("days"), F.when(v["out"], 0).otherwise(v["since"]).alias("since"),
                F.when(inn, x["s"]).otherwise(st["es"]).alias("es"), F.when(inn, x["beta1"]).otherwise(st["eb"]).alias("eb"),
                F.when(v["out"], 1.0).when(inn, x["rscale"]).otherwise(st["er"]).alias("er"), F.when(x["valid"], x["w"]).otherwise(st["lw"]).alias("lw"), x["s"].alias("ls"),
                (st["trips"] + F.when(v["out"], 1).otherwise(0)).alias("trips"), (st["wins"] + F.when(won, 1).otherwise(0)).alias("wins"),
                (st["held"] + F.when(v["out"], v["days"]).otherwise(0)).cast("long").alias("held"), F.concat(st["out"], F.array(row)).cast(_OUT).alias("out"),
            )

        return let(first, settle)

    return step


def _finish(p: Params):
    def close(st: Column) -> Column:
        """With the force close, an open position ends on the last row: explicit cost only, by the last valid weight."""
        still = (st["pos"] != 0) if p.month_end_forceclose else F.lit(False)
        size = st["lw"] * st["er"]
        cost = F.when(still, costs.explicit(size, p)).otherwise(0.0)
        won = still & F.coalesce((st["ls"] - st["es"]) * st["pos"] * size > 0, F.lit(False))
        n = F.size(st["out"])
        out = F.transform(st["out"], lambda r, i: F.struct(r["date"].alias("date"), (r["pnl"] - F.when(i == n - 1, cost).otherwise(0.0)).alias("pnl"), (r["cost"] + F.when(i == n - 1, cost).otherwise(0.0)).alias("cost"), F.when((i == n - 1) & still, 0).otherwise(r["pos"]).alias("pos")))
        return F.struct(
            (st["trips"] + F.when(still, 1).otherwise(0)).alias("trips"), (st["wins"] + F.when(won, 1).otherwise(0)).alias("wins"),
            (st["held"] + F.when(still, st["days"]).otherwise(0)).cast("long").alias("held"), (out if p.month_end_forceclose else st["out"]).alias("out"),
        )

    return close


def simulate(rows: DataFrame, p: Params) -> DataFrame:
    """One row for each (segment_id, a, b): trips, wins, held (days over all trips), out (date, pnl, cost, pos)."""
    gathered = rows.groupBy("segment_id", "a", "b").agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("rows"))
    start, step, finish = _start(p), _step(p), _finish(p)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / RUN).cast("int")), lambda i: F.slice("rows", i * RUN + 1, RUN))
    gathered = gathered.select("segment_id", "a", "b", runs.alias("runs"))
    none = F.array().cast(_OUT)
    state = lambda st, out: F.struct(*[st[c].alias(c) for c in STATE], out.alias("out"))

    def run(st: Column, part: Column) -> Column:
        done = F.aggregate(part, state(st, none), step)
        return let(done, lambda d: state(d, F.concat(st["out"], F.array(d["out"]))))

    whole = F.aggregate("runs", state(start, F.array().cast(f"array<{_OUT}>")), run, lambda st: let(state(st, F.flatten(st["out"])), finish))
    return gathered.select("segment_id", "a", "b", whole.alias("f")).select("segment_id", "a", "b", "f.*")


def _moved() -> Column:
    """Whether the pair had a round trip or any profit or loss."""
    return (F.col("trips") > 0) | (F.aggregate("out", F.lit(0.0), lambda acc, x: acc + F.abs(x["pnl"])) > 0)


def traded(sim: DataFrame) -> DataFrame:
    """Pairs with a round trip or any profit or loss."""
    return sim.where(_moved())


def pair_daily(sim: DataFrame) -> DataFrame:
    """segment_id, a, b, date, pnl, cost, pos."""
    return sim.select("segment_id", "a", "b", F.inline("out"))


def traded_daily(sim: DataFrame) -> DataFrame:
    """The same of the pairs that traded. The condition chooses what is unfolded: as a filter it would be pushed below the
    simulation and run it a second time."""
    return sim.select("segment_id", "a", "b", F.inline(F.when(_moved(), F.col("out")).otherwise(F.array().cast(_OUT))))


def trade_stats(sim: DataFrame) -> DataFrame:
    """segment_id, pair, round_trips, hit_rate, avg_hold_days of the pairs that traded."""
    trips = F.nullif("trips", F.lit(0))
    row = F.struct(F.col("trips").alias("round_trips"), F.try_divide("wins", trips).alias("hit_rate"), F.try_divide("held", trips).alias("avg_hold_days"))
    none = F.array().cast("array<struct<round_trips:int,hit_rate:double,avg_hold_days:double>>")
    return sim.select("segment_id", F.concat_ws("|", "a", "b").alias("pair"), F.inline(F.when(_moved(), F.array(row)).otherwise(none)))
