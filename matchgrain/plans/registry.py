"""All queries of the match analytics by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrain.functions import listing
from matchgrain.functions.written import written
from matchgrain.operators import analysis, asof, baseline, catalog, fixtures, form, model, value, walkforward
from matchgrain.plans import oracle
from matchgrain.sources import feeds, history, merge, reports
from matchgrain.sources import surrogate as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def agg02_fixture_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return src.matches(spark, sf).select("match_id", "league", "status", "home_id", "away_id", "home_score", "away_score")


@query
def agg05_team_splits(spark: SparkSession, sf: str) -> DataFrame:
    return form.splits(src.games(spark, sf))


@query
def agg06_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return form.side_sets(src.games(spark, sf))


@query
def win01_last_n_form(spark: SparkSession, sf: str) -> DataFrame:
    return form.last_games(src.games(spark, sf), 10).select("team_id", "match_id", "rn", "result", "scored", "conceded")


@query
def agg08_weighted_form(spark: SparkSession, sf: str) -> DataFrame:
    out = form.weighted(src.games(spark, sf), 10.0)
    return out.select("team_id", *(F.round(c, 6).alias(c) for c in ("effective_games", "w_points", "w_scored", "w_conceded")))


@query
def agg09_momentum(spark: SparkSession, sf: str) -> DataFrame:
    out = form.momentum(src.games(spark, sf))
    return out.select("team_id", "games", *(F.round(c, 6).alias(c) for c in ("d_points", "d_scored", "d_conceded")))


@query
def agg11_opponent_strength(spark: SparkSession, sf: str) -> DataFrame:
    return form.opponent_strength(src.games(spark, sf, clubs=True)).withColumn("strength", F.round("strength", 6))


@query
def agg12_streak(spark: SparkSession, sf: str) -> DataFrame:
    return form.streaks(src.games(spark, sf))


@query
def agg13_head_to_head(spark: SparkSession, sf: str) -> DataFrame:
    return form.head_to_head(src.finals(spark, sf, clubs=True)).drop("last_met")


@query
def agg14_league_baseline(spark: SparkSession, sf: str) -> DataFrame:
    out = baseline.league_baseline(src.matches(spark, sf))
    return out.select("league", "n", *(F.round(c, 6).alias(c) for c in ("avg_home", "avg_away", "home_advantage", "margin_sd", "draw_rate")))


@query
def win13_trailing_baseline(spark: SparkSession, sf: str) -> DataFrame:
    out = baseline.trailing_baseline(src.matches(spark, sf))
    return out.select("match_id", "league", "n", *(F.round(c, 6).alias(c) for c in ("avg_home", "avg_away", "home_advantage", "draw_rate")))


@query
def agg15_rest_and_congestion(spark: SparkSession, sf: str) -> DataFrame:
    return form.rest(fixtures.team_games(src.matches(spark, sf)).select("team_id", "match_id", "kickoff")).drop("kickoff")


@query
def jn09_asof_previous_match(spark: SparkSession, sf: str) -> DataFrame:
    games = src.games(spark, sf)
    fixtures_ = fixtures.team_games(src.matches(spark, sf).where("status = 'scheduled'")).select("team_id", F.col("match_id").alias("fixture_id"), "kickoff")
    return form.as_of(fixtures_, games, "team_id", "kickoff", ["match_id", "result"]).select("team_id", "fixture_id", "match_id", "result")


@query
def agg17_injury_burden(spark: SparkSession, sf: str) -> DataFrame:
    injuries, stats = src.injuries(spark, sf)
    return baseline.injury_burden(injuries, baseline.appearance_share(stats)).withColumn("burden", F.round("burden", 6))


@query
def agg18_appearance_share(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.appearance_share(src.injuries(spark, sf)[1]).withColumn("importance", F.round("importance", 6))


def cells(spark: SparkSession, sf: str, places: int | None = None) -> DataFrame:
    return model.score_cells(src.goal_rates(spark, sf), places)


@query
def mod12_score_grid(spark: SparkSession, sf: str) -> DataFrame:
    return model.score_grid(src.goal_rates(spark, sf)).withColumn("p", F.round("p", 9))


@query
def mkt01_match_odds(spark: SparkSession, sf: str) -> DataFrame:
    out = model.match_odds(cells(spark, sf))
    return out.select("match_id", *(F.round(c, 7).alias(c) for c in ("home", "draw", "away", "home_draw", "home_away", "draw_away")))


@query
def mkt03_totals(spark: SparkSession, sf: str) -> DataFrame:
    out = model.totals(cells(spark, sf))
    return out.select("match_id", "line", *(F.round(c, 7).alias(c) for c in ("over", "under", "btts", "exp_total", "supremacy")))


@query
def mkt05_correct_score(spark: SparkSession, sf: str) -> DataFrame:
    return model.correct_scores(cells(spark, sf, 9))


@query
def mkt07_fair_odds(spark: SparkSession, sf: str) -> DataFrame:
    return model.match_odds(cells(spark, sf)).select("match_id", "fair_home", "fair_draw", "fair_away", model.fair(F.col("home_draw")).alias("fair_home_draw"))


@query
def mod09_fit_sweeps3(spark: SparkSession, sf: str) -> DataFrame:
    out = model.fit_leagues(src.finals(spark, sf, clubs=True), 10.0, sweeps=3)
    return out.select("league", "team_id", "matches", *(F.round(c, 6).alias(c) for c in ("attack", "defence", "home_advantage")))


@query
def mod08_fit_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The low-score correction, effective matches and log-likelihood of a fit of three sweeps."""
    out = model.fit_leagues(src.finals(spark, sf, clubs=True), 10.0, sweeps=3).groupBy("league").agg(*(F.first(c).alias(c) for c in ("matches", "rho", "effective", "log_likelihood", "reliable")), F.count("*").alias("teams"))
    return out.select("league", "teams", "matches", F.round("rho", 4).alias("rho"), F.round("effective", 2).alias("effective"), F.round("log_likelihood", 3).alias("log_likelihood"), "reliable")


@query
def mod09_fit_by_sweeps(spark: SparkSession, sf: str) -> DataFrame:
    """The same three sweeps as Spark jobs, with correction and likelihood."""
    out = model.fit_leagues(src.finals(spark, sf, clubs=True), 10.0, 3, model.fit_by_sweeps)
    return out.select("league", "team_id", "matches", *(F.round(c, 6).alias(c) for c in ("attack", "defence", "home_advantage")), F.round("rho", 4).alias("rho"), F.round("log_likelihood", 3).alias("log_likelihood"))


@query
def mod09_fit_full(spark: SparkSession, sf: str) -> DataFrame:
    return model.fit_leagues(src.finals(spark, sf, clubs=True), 10.0)


@query
def fc01_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """A document for each scheduled match: the fit, both teams' ratings, expected goals and all markets."""
    ratings = model.fit_leagues(src.finals(spark, sf, clubs=True), 10.0)
    return model.forecast(src.matches(spark, sf, clubs=True).where("status = 'scheduled'"), ratings)


@query
def odd05_parse_quotes(spark: SparkSession, sf: str) -> DataFrame:
    m = src.matches(spark, sf, clubs=True)
    text = lambda c: c.cast("string")
    n = F.col("match_id")
    quotes = m.select(
        "match_id", F.when(n % 7 == 0, "").otherwise(F.concat(F.lit("p"), text(n % 3))).alias("provider"), text(n % 400 - 200).alias("home"), F.when(n % 5 == 0, "EVEN").otherwise(F.concat(F.lit("+"), text(n % 300 + 100))).alias("draw"),
        F.when(n % 11 == 0, "OFF").otherwise(text(n % 90 / 10.0)).alias("away"), text(n % 4 + F.when(n % 2 == 0, 0.5).otherwise(0.0)).alias("total"), F.lit("-110").alias("over"), F.lit(" 1.9 ").alias("under"),
    )
    return value.parse_quotes(quotes)


@query
def odd03_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Provider payloads as JSON text: boxed, signed, worded and nested prices, a line that can push, an entry without a provider."""
    n = F.col("match_id")
    text = lambda c: c.cast("string")
    item = F.struct(
        F.struct(F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("p"), text(n % 3))).alias("id"), F.concat(F.lit("name "), text(n % 3)).alias("name")).alias("provider"),
        F.struct(F.concat(F.lit("+"), text(n % 150 + 100)).alias("moneyLine")).alias("homeTeamOdds"), F.struct(F.lit("OFF").alias("moneyLine"), (1.5 + n % 300 / 100.0).alias("decimal")).alias("awayTeamOdds"),
        (n % 89 + 1.5).alias("drawOdds"), F.when(n % 3 == 0, 2.5).otherwise(3.0).alias("overUnder"), F.lit(-110).alias("overOdds"), F.struct(F.lit("EVEN").alias("american")).alias("underOdds"),
        F.when(n % 2 == 0, F.struct(F.lit("1.8").alias("yes"), F.lit("N/A").alias("no"))).alias("bothTeamsToScoreOdds"),
    )
    nested = F.struct(
        F.struct(F.lit("q").alias("id")).alias("provider"), F.struct(F.struct(F.lit("+150").alias("american")).alias("moneyLine")).alias("homeTeamOdds"),
        F.struct(F.struct(F.lit("OFF").alias("decimal"), F.lit("+120").alias("american")).alias("moneyLine"), F.lit(3.25).alias("odds")).alias("awayTeamOdds"),
        F.lit(3.5).alias("overUnder"), F.struct(F.lit("OFF").alias("decimal"), F.lit("+120").alias("american")).alias("overOdds"), F.struct(F.struct(F.lit(-200).alias("value")).alias("decimal")).alias("underOdds"),
    )
    text = F.when(n % 13 == 0, F.to_json(F.struct(F.array(nested).alias("items")))).otherwise(F.to_json(F.struct(F.array(item).alias("items"))))
    payloads = src.matches(spark, sf, clubs=True).select("match_id", text.alias("payload"))
    return value.parse_payloads(payloads).drop("raw")


@query
def prjn01_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Every fixture, played or not, from what was known strictly before it."""
    m = src.matches(spark, sf, clubs=True)
    return asof.projection_before(m, m, src.games(spark, sf, clubs=True))


@query
def prjn06_projections(spark: SparkSession, sf: str) -> DataFrame:
    """Every scheduled match under the model as of its kickoff, or under form where no fit knows both teams."""
    m = src.matches(spark, sf, clubs=True)
    return walkforward.projections(m.where("status = 'scheduled'"), m, 10.0)


def analyses(spark: SparkSession, sf: str, only: str, project) -> DataFrame:
    """Documents of the club matches of which ``only`` holds, with their absences, under the projections that ``project`` makes of (these, all, form)."""
    m = written(src.matches(spark, sf, clubs=True), "matches")
    asked = m.where(only)
    form = asof.form_of(asked, written(asof.form_at(asked, fixtures.team_games(fixtures.completed(m))), "form"))
    injuries, stats = src.club_injuries(spark, sf)
    return analysis.documents(asked, m, form, src.club_teams(spark, sf), project(asked, m, form), baseline.injury_burden(injuries, baseline.appearance_share(stats)))


@query
def prjn06_insights(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences about every fixture, played or not, under its projection from form."""
    return analysis.insights(analyses(spark, sf, "true", asof.projection_of))


@query
def prjn07_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """The whole document of every scheduled match, under the model where a fit knows both teams."""
    return analyses(spark, sf, "status = 'scheduled'", lambda asked, m, form: walkforward.projections(asked, m, 10.0))


@query
def agg15_context_before(spark: SparkSession, sf: str) -> DataFrame:
    """Rest and congestion of both teams of every fixture, from final matches of the league strictly before it."""
    m = src.matches(spark, sf, clubs=True)
    return asof.context_before(m, m.where("status = 'final'"))


def form_rows(spark: SparkSession, sf: str) -> DataFrame:
    return asof.form_before(src.matches(spark, sf, clubs=True), src.games(spark, sf, clubs=True))


@query
def jn08_form_before(spark: SparkSession, sf: str) -> DataFrame:
    """The records of both teams of every fixture over their last ten games strictly before it, overall and by side."""
    flat = [F.col(f"{split}.{c}").alias(f"{split}_{c}") for split in ("overall", "home", "away") for c in ("played", "wins", "draws", "losses", "scored", "conceded", "avg_scored", "avg_conceded", "win_pct")]
    return form_rows(spark, sf).select("match_id", "team_id", "side", "streak", "points_per_game", *flat)


@query
def agg08_trend_before(spark: SparkSession, sf: str) -> DataFrame:
    """Time-decayed means and momentum of the same games."""
    w = [F.round(f"weighted.{c}", 6).alias(f"w_{c}") for c in ("effective_games", "points", "scored", "conceded")]
    m = [F.round(f"momentum.{c}", 6).alias(f"m_{c}") for c in ("points", "scored", "conceded", "points_delta", "scored_delta", "conceded_delta")]
    return form_rows(spark, sf).select("match_id", "team_id", *w, F.col("momentum.games").alias("m_games"), *m)


@query
def agg11_strength_before(spark: SparkSession, sf: str) -> DataFrame:
    return asof.strength_before(form_rows(spark, sf), src.games(spark, sf, clubs=True)).withColumn("strength", F.round("strength", 6))


@query
def agg13_meetings_before(spark: SparkSession, sf: str) -> DataFrame:
    out = asof.meetings_before(src.matches(spark, sf, clubs=True), src.finals(spark, sf, clubs=True))
    return out.withColumn("last_met", F.get("meetings", F.lit(0))["match_id"]).drop("kickoff", "meetings")


@query
def agg14_baseline_before(spark: SparkSession, sf: str) -> DataFrame:
    return asof.baseline_before(src.matches(spark, sf, clubs=True))


@query
def agg14_baseline_window(spark: SparkSession, sf: str) -> DataFrame:
    """The same over the last three days at most."""
    return asof.baseline_before(src.matches(spark, sf, clubs=True), window_days=3)


def replayed(spark: SparkSession, sf: str, sweeps: int = model.SWEEPS) -> DataFrame:
    """The replay with a refit every five matches."""
    return walkforward.replay(src.finals(spark, sf, clubs=True), [10.0], 5, sweeps)


@query
def bt04_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    return replayed(spark, sf, 3).select("match_id", "league", "before", "point", F.round("lam", 6).alias("lam"), F.round("mu", 6).alias("mu"), "skipped")


@query
def bt05_account(spark: SparkSession, sf: str) -> DataFrame:
    return walkforward.account(replayed(spark, sf, 3)).drop("half_life_days")


@query
def bt06_report(spark: SparkSession, sf: str) -> DataFrame:
    """The whole report of a converged replay: counts, scores, market, calibration and betting."""
    return walkforward.document(replayed(spark, sf), src.odds(spark, sf))


@query
def bt03_replay_bets(spark: SparkSession, sf: str) -> DataFrame:
    """The bets that a replay makes itself, by the fit in force at each match, once that carries enough weight."""
    replayed = walkforward.replay(src.finals(spark, sf, clubs=True), [120.0], 5)
    return walkforward.bets(replayed, src.odds(spark, sf)).select("league", "match_id", "provider", "market", "selection", "line", "decimal_odds", "p", "ev", "stake", "won")


@query
def bt07_half_life_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return walkforward.half_life_sweep(src.finals(spark, sf, clubs=True), [5.0, 10.0, 20.0, 40.0])


@query
def val02_devig(spark: SparkSession, sf: str) -> DataFrame:
    return value.devig(src.odds(spark, sf)).select("match_id", "provider", "market", "selection", "line", F.round("overround", 8).alias("overround"), F.round("implied", 8).alias("implied"), "quoted", "complete")


def bets(spark: SparkSession, sf: str) -> DataFrame:
    """Value bets on final matches under given probabilities, settled."""
    results = src.finals(spark, sf, clubs=True).select("match_id", "league", "kickoff", "home_score", "away_score")
    probability = (F.col("match_id") * 13 + F.length("selection") * 29) % 60 / 100.0 + 0.1
    models = src.odds(spark, sf).where("provider = 'fd-avg'").select("match_id", "market", "selection", "line", probability.alias("probability"))
    out = value.value_bets(src.odds(spark, sf), models).join(results, "match_id")
    return out.withColumn("won", value.settled(*map(F.col, ("market", "selection", "line", "home_score", "away_score"))))


@query
def val05_value_bets(spark: SparkSession, sf: str) -> DataFrame:
    return bets(spark, sf).select("match_id", "provider", "market", "selection", "line", F.round("edge", 7).alias("edge"), F.round("ev", 7).alias("ev"), "stake", "won")


@query
def bt03_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger of level stakes, bets of a match by name, as its SQL has it; bt03_ledger_kelly has the real one."""
    out = value.ledger(bets(spark, sf).withColumns({"stake": F.lit(0.001), "ev": F.lit(0.0)}), "league")
    return out.select("league", "match_id", "provider", "market", "selection", F.round("bankroll", 6).alias("bankroll"), F.round("drawdown", 6).alias("drawdown"))


@query
def bt03_ledger_kelly(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger of the computed stakes, bets of a match by expected value; the drawdown as a logarithm, which has no ties in its last digit."""
    out = value.ledger(bets(spark, sf), "league")
    return out.select("league", "match_id", "provider", "market", "selection", "line", "stake", F.round("log_bankroll", 6).alias("log_bankroll"), F.abs(F.round(F.log(1 - F.col("drawdown")), 6)).alias("log_drawdown"))


@query
def agg25_flat_yield(spark: SparkSession, sf: str) -> DataFrame:
    out = value.flat_yield(bets(spark, sf), "league")
    return out.select("league", "bets", *(F.round(c, 6).alias(c) for c in ("yield", "stderr", "t")))


def market_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """The devigged three-way prices of the first provider beside the outcome of each final match."""
    p = value.devig(src.odds(spark, sf).where("market = '1x2' and provider = 'fd-avg'")).where("complete")
    wide = p.groupBy("match_id").agg(*(F.max(F.when(F.col("selection") == s, F.col("implied"))).alias(s) for s in ("home", "draw", "away")))
    return wide.join(src.finals(spark, sf, clubs=True), "match_id").select("league", "home", "draw", "away", value.actual(F.col("home_score"), F.col("away_score")).alias("outcome"))


@query
def agg22_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = value.scores(market_forecasts(spark, sf), ["league"])
    return out.select("league", "n", *(F.round(c, 6).alias(c) for c in ("log_loss", "brier", "accuracy")))


@query
def agg24_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return value.calibration(market_forecasts(spark, sf)).select("bin", "n", F.round("predicted", 6).alias("predicted"), F.round("observed", 6).alias("observed"))


@query
def flt07_team_semi(spark: SparkSession, sf: str) -> DataFrame:
    m = src.matches(spark, sf)
    named = src.competitors(spark, sf).where(F.col("team_id") % 10 == 3).select(F.col("event_id").alias("match_id"))
    return m.join(named, "match_id", "left_semi").select("match_id", "league", "home_id", "away_id")


@query
def flt08_search(spark: SparkSession, sf: str) -> DataFrame:
    return listing.search(src.table(spark, sf, "part"), "blue, ECONOMY", ["p_name", "p_type"]).unionByName(listing.search(src.table(spark, sf, "part"), "brand#1", ["p_brand"])).select("p_partkey", "p_name", "p_type")


@query
def flt10_page(spark: SparkSession, sf: str) -> DataFrame:
    return listing.page(src.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), ["-c_acctbal", "c_custkey"], number=2, size=25, allowed={"c_acctbal", "c_custkey"})


@query
def snk02_merge(spark: SparkSession, sf: str) -> DataFrame:
    c = src.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    old, new = c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return merge.upsert(old, new, ["c_custkey"])


@query
def snk09_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    s = src.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return merge.replace_snapshot(s, s.where("s_nationkey < 5 and s_acctbal > 0"), ["s_nationkey"])


@query
def snk05_scoreboard(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.scoreboard(src.scoreboard_feed(spark, sf)).where("not error")
    return rows.select("event_id", F.date_format("date", "yyyy-MM-dd HH:mm").alias("day"), "season_year", "season_type", "status", "status_detail")


@query
def snk07_competitors(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.competitors(feeds.scoreboard(src.scoreboard_feed(spark, sf)))
    return rows.select("event_id", "team_id", "home_away", "ord", "display_name")


@query
def snk04_venues(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.venues(feeds.scoreboard(src.scoreboard_feed(spark, sf)))


@query
def mkt08_summary(spark: SparkSession, sf: str) -> DataFrame:
    return model.summary(cells(spark, sf, 9))


@query
def agg13_meetings(spark: SparkSession, sf: str) -> DataFrame:
    return form.meetings(src.finals(spark, sf, clubs=True)).drop("kickoff")


@query
def val06_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Some matches lack a price of the preferred provider, some one of both."""
    odds = src.odds(spark, sf).where("not (match_id % 3 = 0 and provider = 'fd-avg' and selection = 'draw') and not (match_id % 6 = 0 and selection = 'away')")
    out = value.consensus(odds)
    return out.select("match_id", "provider", *(F.round(c, 7).alias(c) for c in ("home", "draw", "away")))


def given_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("match_id")
    total = n % 5 + n % 3 + n % 4 + 3
    return src.finals(spark, sf, clubs=True).select(n, "league", ((n % 5 + 1) / total).alias("home"), ((n % 3 + 1) / total).alias("draw"), ((n % 4 + 1) / total).alias("away"), value.actual(F.col("home_score"), F.col("away_score")).alias("outcome"))


@query
def agg23_market_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Given probabilities beside the market's."""
    out = value.against_market(given_forecasts(spark, sf), value.consensus(src.odds(spark, sf).where("match_id % 4 > 0")), ["league"])
    return out.withColumns({c: F.round(c, 6) for c in ("brier", "market_brier")})


@query
def agg23_market_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """How often outcomes came about in bins of the market's probabilities, by league."""
    out = value.market_calibration(given_forecasts(spark, sf), value.consensus(src.odds(spark, sf).where("match_id % 4 > 0")), ["league"])
    return out.withColumns({c: F.round(c, 6) for c in ("predicted", "observed")})


@query
def bt04_market_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """The replayed model beside the market, by league."""
    return value.against_market(walkforward.outcomes(replayed(spark, sf, 3)), value.consensus(src.odds(spark, sf)), ["league"])


@query
def prj04_selected(spark: SparkSession, sf: str) -> DataFrame:
    return listing.selected(src.matches(spark, sf), 5).select("match_id", "status")


@query
def prj04_selected_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return listing.selected(src.finals(spark, sf).withColumn("status", F.lit("final")), 5).select("match_id", "status")


@query
def prj01_event_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Scoreboard events with their competitors nested, as text."""
    e = feeds.scoreboard(src.scoreboard_feed(spark, sf)).where("not error")
    sides = feeds.competitors(e).groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("ord", "home_away", "team_id"))).alias("competitors"))
    label = F.array_join(F.transform("competitors", lambda c: F.concat_ws(":", c["home_away"], c["team_id"])), ",")
    return e.drop("competitors").where(listing.one_of("status", "final", {"scheduled", "in_progress", "final"}) & listing.season("season_year", "2024")).join(sides, "event_id", "left").select("event_id", F.col("venue.shortName").alias("venue_name"), label.alias("competitors"))


@query
def snk14_history_events(spark: SparkSession, sf: str) -> DataFrame:
    out = history.events(history.matches(src.history_rows(spark, sf)))
    return out.select("event_id", "league", F.date_format("date", "yyyy-MM-dd HH:mm").alias("at"), "name", "season_year", "status")


@query
def snk14_history_sides(spark: SparkSession, sf: str) -> DataFrame:
    return history.sides(history.matches(src.history_rows(spark, sf), "I1")).select("event_id", "home_away", "team_id", "score", "winner", "ord")


@query
def snk15_history_odds(spark: SparkSession, sf: str) -> DataFrame:
    return history.odds(history.matches(src.history_rows(spark, sf))).drop("provider_name", "source_column")


@query
def snk09_injury_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.injuries(src.injury_feed(spark, sf), src.injury_teams(spark, sf)).select("league", "athlete_id", "athlete_name", "status", "team_id", "error")


@query
def snk10_transactions(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.transactions(src.transaction_feed(spark, sf), src.injury_teams(spark, sf)).where("not error")
    return out.select("league", "transaction_id", F.date_format("date", "yyyy-MM-dd").alias("day"), "description", "team_id")


@query
def snk10_transaction_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions merged by league and id, each without an id a row of its own."""
    rows = reports.transactions(src.transaction_feed(spark, sf), src.injury_teams(spark, sf)).where("not error").select("league", "transaction_id", "description", "team_id")
    number = F.coalesce(F.col("transaction_id").cast("long"), F.lit(6))
    again = rows.where(number % 2 == 0).withColumn("description", F.concat(F.lit("new "), F.col("description")))
    return merge.upsert(rows.where(number % 3 == 0), again, ["league", "transaction_id"], optional="transaction_id")


@query
def agg19_appearances(spark: SparkSession, sf: str) -> DataFrame:
    return src.stats_blobs(spark, sf).select("o_orderkey", reports.appearances(F.col("stats")).alias("appearances"))


@query
def prj02_team_list(spark: SparkSession, sf: str) -> DataFrame:
    t = src.catalog_tables(spark, sf)
    return catalog.default_order(catalog.team_list(t["teams"], t["leagues"], t["sports"], True), "team", "id")


@query
def prj02_team_detail(spark: SparkSession, sf: str) -> DataFrame:
    t = src.catalog_tables(spark, sf)
    return catalog.team_detail(t["teams"], t["leagues"], t["sports"]).select("id", "display_name", "is_active", F.col("league.id").alias("league_id"), F.col("league.name").alias("league_name"), F.col("league.sport_slug").alias("sport_slug"))


@query
def jn01_event_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their league and competitors, the nested ones as text."""
    t = src.catalog_tables(spark, sf)
    out = catalog.event_detail(t["events"], t["leagues"], t["sports"], t["competitors"], t["teams"])
    sides = F.array_join(F.transform("competitors", lambda c: F.concat_ws(":", c["home_away"], c["team_abbreviation"], c["score"].cast("string"))), ",")
    return out.select("id", "status", F.col("league.slug").alias("league_slug"), F.col("league.sport_slug").alias("sport_slug"), sides.alias("competitors"))


@query
def prj05_next_of_league(spark: SparkSession, sf: str) -> DataFrame:
    t = src.catalog_tables(spark, sf)
    return catalog.next_of_league(catalog.event_list(t["events"], t["leagues"], t["sports"]), "NATION_2", "Asia", "scheduled").select("id", "league_slug", "sport_slug")


@query
def flt16_fields(spark: SparkSession, sf: str) -> DataFrame:
    asked = {"league": "click", "status": "final", "kickoff": "never", "home_id": ""}
    return catalog.by_fields(src.matches(spark, sf), asked, {"league", "status", "home_id"}).select("match_id", "league", "status")


@query
def mod01_observations(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty latest completed matches of each league strictly before a day."""
    before = F.lit("2024-01-15").cast("timestamp")
    return fixtures.observations(src.matches(spark, sf, clubs=True), before, 50).drop("kickoff")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
