"""The ledger of computed stakes against a fold."""

import math
from collections import defaultdict

from matchgrain.plans import registry

SF = "/root/testdata/sf0.001"


def test_ledger_folds_the_computed_stakes_by_expected_value(spark):
    bets = defaultdict(list)
    for r in registry.bets(spark, SF).collect():
        if r.won is not None and r.stake > 0:
            bets[r.league].append((r.kickoff, r.match_id, -round(r.ev, 5), r.provider, r.market, r.selection, r.line, r.decimal_odds, r.stake, r.won))
    want, stakes = {}, set()
    for league, rows in bets.items():
        log, peak = 0.0, 0.0
        for _, match, _, provider, market, selection, line, odds, stake, won in sorted(rows):
            log += math.log(1 + stake * (odds - 1) if won else 1 - stake)
            peak = max(peak, log)
            want[league, match, provider, market, selection, line] = stake, log, peak - log
            stakes.add(stake)
    got = {(r.league, r.match_id, r.provider, r.market, r.selection, r.line): (r.stake, r.log_bankroll, r.log_drawdown) for r in registry.bt03_ledger_kelly(spark, SF).collect()}
    assert got.keys() == want.keys() and len(stakes) > 1
    assert all(abs(a - b) < 1e-5 for k in want for a, b in zip(got[k], want[k], strict=True))
