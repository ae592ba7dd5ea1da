import datetime
import random
import sys
from dataclasses import replace
from pathlib import Path

import pytest

from quantloom.operators import fold, signals
from quantloom.params import Params

sys.path.insert(0, str(Path(__file__).parent))
from reference_loop import simulate  # noqa: E402

DAY = datetime.date(2020, 1, 1)
SCHEMA = "segment_id int, a string, b string, date date, z double, s double, beta1 double, rp double, sigma double, ra double, rb double, adva double, advb double, unc double"


def random_rows(seed, n=60):
    rng = random.Random(seed)
    z, out = 0.0, []
    for _ in range(n):
        z = 0.75 * z + rng.gauss(0, 1.3)
        x = rng.gauss(0, 0.01)
        row = {
            "z": round(z, 9), "s": z * 0.01 + rng.gauss(0, 0.002), "beta": 1 + rng.gauss(0, 0.1), "rp": rng.gauss(0, 0.004), "sigma": 0.004 + rng.random() * 0.002, "ra": x,
            "rb": x * 0.9 + rng.gauss(0, 0.004), "adva": 1e6 * (1 + rng.random()), "advb": 2e6 * rng.random(), "blk": rng.random() < 0.05, "scale": rng.choice([1.0, 1.0, 0.5, 0.04, None]), "unc": rng.random() * 0.5,
        }
        if rng.random() < 0.08:
            row[rng.choice(["z", "rp", "sigma", "adva", "advb", "ra", "rb", "unc"])] = None
        out.append(row)
    return out


def run(spark, groups, p):
    """{key: (pnl, cost, trips, wins, held)} by the engine; keys are segment numbers."""
    rows, blocked, scales = [], [], []
    for k, own in groups.items():
        for i, r in enumerate(own):
            d = DAY + datetime.timedelta(days=400 * k + i)
            rows.append((k, f"A{k}", f"B{k}", d, r["z"], r["s"], r["beta"], r["rp"], r["sigma"], r["ra"], r["rb"], r["adva"], r["advb"], r["unc"]))
            if r["blk"]:
                blocked.append((f"B{k}", d))
            if r["scale"] is not None:
                scales.append((d, r["scale"]))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    regime = spark.createDataFrame(scales, "date date, scale double")
    sim = fold.simulate(signals.gates(df, p, spark.createDataFrame(blocked, "ticker string, date date"), regime), p)
    out = {}
    for r in sim.collect():
        out[r.segment_id] = ([x.pnl for x in r.out], [x.cost for x in r.out], r.trips, r.wins, r.held)
    return out


VARIANTS = [
    Params(), Params(no_entry_confirm=True, zero_cross_exit=True), Params(cooldown_days=4, month_end_forceclose=True), Params(enable_impact=True, enable_adv_cap=True, borrow_apr_bps=80.0),
    Params(min_adv_usd=5e5, earnings_force_exit=False), Params(freeze_beta=True, hard_stop=2.5, time_stop=3), Params(use_kalman=True, kalman_beta_unc_cap=0.3), Params(cost_bps=0.0),
    Params(month_end_forceclose=True, enable_impact=True, no_entry_confirm=True, cooldown_days=1, z_entry=1.2),
]


@pytest.mark.parametrize("p", VARIANTS)
def test_fold_equals_an_independent_loop(spark, p):
    groups = {k: random_rows(100 + k) for k in range(12)} | {12: random_rows(5, 1), 13: random_rows(6, 4)}
    got = run(spark, groups, p)
    some = 0
    for k, own in groups.items():
        pnl, cost, trips, wins, hold = simulate(own, p)
        assert got[k][0] == pytest.approx(pnl, abs=1e-12) and got[k][1] == pytest.approx(cost, abs=1e-12)
        assert got[k][2:] == (trips, wins, sum(hold))
        some += trips
    assert some > 0


def flat(zs, **more):
    return [{"z": z, "s": z, "beta": 1.0, "rp": 0.001, "sigma": 0.005, "ra": 0.01 * (i % 3), "rb": 0.01 * (i % 3), "adva": 1e6, "advb": 1e6, "blk": False, "scale": 1.0, "unc": None} | more for i, z in enumerate(zs)]


def test_confirmation_hard_stop_and_no_entry_on_the_exit_row(spark):
    p = replace(Params(), cost_bps=0.0)
    got = run(spark, {0: flat([1.0, 2.5, 2.4, 1.0, 0.3, 2.6, 2.5]), 1: flat([3.0, 5.0, 4.5, 4.4, 1.0]), 2: flat([None, 2.5, 2.4, 0.1])}, p)
    w = 0.001 / 0.005
    assert got[0][0] == pytest.approx([0, 0, 0, -w * 0.001, -w * 0.001, 0, 0])  # the entry row earns nothing, the exit row does
    assert got[0][2] == 1
    assert got[1][2] == 1 and got[1][0][3] != 0  # entered beyond the hard stop, left on the next row
    assert got[2][2] == 1  # 2.5 after an invalid row cannot confirm, 2.4 does


def test_time_stop_and_force_close_on_the_entry_row(spark):
    got = run(spark, {0: flat([2.6] + [2.5 - 0.001 * i for i in range(30)])}, Params(time_stop=20))
    assert got[0][4] >= 20 and got[0][2] == 1
    got = run(spark, {0: flat([2.6, 2.5])}, Params(month_end_forceclose=True))
    assert got[0][2:] == (1, 0, 0) and got[0][1][1] == pytest.approx(4 * 3e-4 * 0.2)


def test_pairs_that_never_traded_are_left_out(spark):
    rows = [(0, "A", "B", DAY, 0.1, 0.1, 1.0, 0.0, 0.01, 0.0, 0.0, 1e6, 1e6, None)]
    sim = fold.simulate(signals.gates(spark.createDataFrame(rows, SCHEMA), Params()), Params())
    assert fold.traded(sim).count() == 0 and fold.trade_stats(sim).count() == 0
