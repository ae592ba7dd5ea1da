"""An independent row-by-row simulation of one pair in one segment, for tests."""

import math


def simulate(rows, p):
    """rows: dicts of z, s, beta, rp, sigma, ra, rb, adva, advb, blk, scale, unc (None is missing), by date."""
    ok = lambda x: x is not None and math.isfinite(x)
    position, held_days, idle = 0, 0, p.cooldown_days
    open_at = {}
    scale_in, weight, before = 1.0, 0.0, None
    pnl, cost, trips, wins, hold = [0.0] * len(rows), [0.0] * len(rows), 0, 0, []
    legs = []

    def impact(size, r):
        if not p.enable_impact:
            return 0.0
        share = sum(math.sqrt(size * p.portfolio_notional_usd / v) for v in (r["adva"], r["advb"]) if ok(v) and v > 0)
        return p.impact_k_bps / 1e4 * share

    def charge(i, amount):
        pnl[i] -= amount
        cost[i] += amount

    for i, r in enumerate(rows):
        legs = (legs + [(r["ra"] if ok(r["ra"]) else 0.0, r["rb"] if ok(r["rb"]) else 0.0)])[-5:]
        z, last, before = r["z"], before, r["z"]
        if not (ok(z) and ok(r["sigma"]) and r["sigma"] > 0 and ok(r["rp"])):
            continue
        weight = p.target_spread_vol_bps / 1e4 / r["sigma"]
        if p.enable_adv_cap:
            shares = [weight * p.portfolio_notional_usd / v for v in (r["adva"], r["advb"]) if ok(v) and v > 0]
            if shares:
                weight *= min(1.0, p.adv_cap_pct / max(shares))
        scale = r["scale"] if ok(r["scale"]) else 1.0
        if position == 0:
            idle += 1
            thin = p.min_adv_usd > 0 and any((v if ok(v) else 0.0) < p.min_adv_usd for v in (r["adva"], r["advb"]))
            unsure = p.use_kalman and not p.freeze_beta and p.kalman_beta_unc_cap > 0 and ok(r["unc"]) and r["unc"] > p.kalman_beta_unc_cap
            if scale < 0.05 or r["blk"] or thin or unsure or (p.cooldown_days > 0 and idle < p.cooldown_days):
                continue
            side = 0
            if z >= p.z_entry and (p.no_entry_confirm or (ok(last) and z < last)):
                side = -1
            elif z <= -p.z_entry and (p.no_entry_confirm or (ok(last) and z > last)):
                side = 1
            if side:
                position, held_days, scale_in = side, 0, scale
                open_at = {"s": r["s"], "beta": r["beta"]}
                size = weight * scale
                charge(i, 2 * p.cost_bps / 1e4 * size + impact(size, r))
            continue
        held_days += 1
        broken = False
        if len(legs) == 5:
            x, y = zip(*legs)
            mx, my = sum(x) / 5, sum(y) / 5
            sx, sy = sum((v - mx) ** 2 for v in x), sum((v - my) ** 2 for v in y)
            if sx > 0 and sy > 0:
                broken = sum((a - mx) * (b - my) for a, b in legs) / math.sqrt(sx * sy) < 0.5
        if not p.freeze_beta and ok(open_at["beta"]) and ok(r["beta"]) and abs(open_at["beta"]) > 1e-6:
            broken = broken or abs((r["beta"] - open_at["beta"]) / open_at["beta"]) > 0.30
        done = position * z >= 0 if p.zero_cross_exit else abs(z) <= p.z_exit
        done = done or held_days >= p.time_stop or abs(z) > p.hard_stop or broken or (p.earnings_force_exit and r["blk"])
        size = weight * scale_in
        pnl[i] += size * position * r["rp"]
        if p.borrow_apr_bps > 0:
            charge(i, p.borrow_apr_bps / 1e4 / 252 * abs(size))
        if done:
            trips += 1
            wins += (r["s"] - open_at["s"]) * position * size > 0
            hold.append(held_days)
            charge(i, 2 * p.cost_bps / 1e4 * size + impact(size, r))
            position, held_days, idle, scale_in = 0, 0, 0, 1.0
    if p.month_end_forceclose and position:
        size = weight * scale_in
        charge(len(rows) - 1, 2 * p.cost_bps / 1e4 * size)
        trips += 1
        wins += rows[-1]["s"] is not None and (rows[-1]["s"] - open_at["s"]) * position * size > 0
        hold.append(held_days)
    return pnl, cost, trips, wins, hold
