"""What was known before each fixture: form of both teams, opponents' strength, meetings, league baseline, projection.

Games strictly before a fixture's kickoff count, never later ones. The last games of a team travel with the team's latest
game as a short array, so a fixture reads them as of its kickoff by one union and one window, and everything made of them
is computed within the row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrain.functions.columns import once
from matchgrain.functions.rounding import exact_round
from matchgrain.operators import projection
from matchgrain.operators.fixtures import micros, outcome
from matchgrain.operators.form import DAY

#: Games of a form, days in which a game's weight halves, latest games of the momentum, fixtures of a baseline: fixed values.
LOOKBACK, HALF_LIFE_DAYS, MOMENTUM_GAMES, SAMPLE = 10, 60.0, 5, 200
#: Days in which matches are counted, and how many make them a congested run: fixed values.
CONGESTION_DAYS, CONGESTED = 14, 4
GAME = ["opponent_id", "side", "scored", "conceded"]


def sides(fixtures: DataFrame) -> DataFrame:
    """(match_id, league, kickoff, team_id, opponent_id, side): both teams of each fixture, played or not."""
    view = lambda own, other: F.struct(F.col(f"{own}_id").alias("team_id"), F.col(f"{other}_id").alias("opponent_id"), F.lit(own).alias("side"))
    return fixtures.select("match_id", "league", "kickoff", F.explode(F.array(view("home", "away"), view("away", "home"))).alias("s")).select("match_id", "league", "kickoff", "s.*")


def latest_before(left: DataFrame, facts: DataFrame, by: list[str], n: int, value: list[str], name: str = "games") -> DataFrame:
    """``left`` (with kickoff) and the n latest facts of its key strictly before it, the latest first, as an array of structs.

    ``facts`` has the key, kickoff, match_id and ``value``; facts of one kickoff are ordered by match_id. A fact carries the
    n latest up to itself, and a row takes them from the latest fact before it; a key's rows are one team's calendar.
    """
    order = Window.partitionBy(*by).orderBy("kickoff", "match_id").rowsBetween(1 - n, 0)
    items = F.reverse(F.collect_list(F.struct("kickoff", "match_id", *value)).over(order))
    known = facts.select(*by, "kickoff", "match_id", *value).withColumn("_items", items)
    both = left.select(*by, "kickoff", F.struct(*left.columns).alias("_left")).unionByName(known.select(*by, "kickoff", F.struct("kickoff", "match_id", "_items").alias("_fact")), allowMissingColumns=True)
    seen = Window.partitionBy(*by).orderBy(micros(F.col("kickoff"))).rangeBetween(Window.unboundedPreceding, -1)
    rows = both.withColumn("_fact", F.max("_fact").over(seen)).where("_left is not null")
    return rows.select("_left.*", F.coalesce(F.col("_fact._items"), F.array().cast(known.schema["_items"].dataType)).alias(name))


def total(items: Column, f) -> Column:
    """The sum of f over an array, 0 if it is empty."""
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + f(x).cast("double"))


def mean(items: Column, f) -> Column:
    return F.coalesce(F.try_divide(total(items, f), F.size(items)), F.lit(0.0))


def record(items: Column) -> Column:
    """Played, wins, draws, losses, goals, averages of two places and win share of three (zero without games), counted in one pass."""
    first = F.struct(*(F.lit(0).alias(c) for c in ("wins", "draws", "losses")), *(F.lit(0).cast("long").alias(c) for c in ("scored", "conceded")))

    def counted(sums: Column, game: Column) -> Column:
        own, other = game["scored"], game["conceded"]
        kinds = (("wins", own > other), ("draws", own == other), ("losses", own < other))
        return F.struct(*((sums[c] + F.when(x, 1).otherwise(0)).alias(c) for c, x in kinds), (sums["scored"] + own).alias("scored"), (sums["conceded"] + other).alias("conceded"))

    def shown(r: Column) -> Column:
        part = lambda x, places: exact_round(F.coalesce(F.try_divide(x.cast("double"), r["n"]), F.lit(0.0)), places)
        sums = [r["s"][c].alias(c) for c in ("wins", "draws", "losses", "scored", "conceded")]
        means = [part(r["s"][c], 2).alias(f"avg_{c}") for c in ("scored", "conceded")]
        return F.struct(r["n"].alias("played"), *sums, *means, part(r["s"]["wins"] + 0.5 * r["s"]["draws"], 3).alias("win_pct"))

    return once(F.struct(F.size(items).alias("n"), F.aggregate(items, first, counted).alias("s")), shown)


def points(game: Column) -> Column:
    return F.when(game["scored"] > game["conceded"], 3).when(game["scored"] == game["conceded"], 1).otherwise(0)


def weighted(items: Column, at: Column, half_life_days: float) -> Column:
    """Means with weights 2 ** (-age / half life) by days before ``at``; all games weigh 1 if the half life is not positive."""
    age = lambda g: F.greatest((micros(at) - micros(g["kickoff"])) / F.lit(float(DAY)), F.lit(0.0))
    w = lambda g: F.exp(F.lit(-math.log(2) / half_life_days) * age(g)) if half_life_days > 0 else F.lit(1.0)
    sum_ = total(items, w)
    over = lambda f: F.coalesce(F.try_divide(total(items, lambda g: w(g) * f(g)), sum_), F.lit(0.0))
    return F.struct(sum_.alias("effective_games"), over(points).alias("points"), over(lambda g: g["scored"]).alias("scored"), over(lambda g: g["conceded"]).alias("conceded"))


def momentum(items: Column, latest: int) -> Column:
    """Means over the latest games, and how far they are above those over all."""
    some = F.slice(items, 1, latest)
    parts = [("points", points), ("scored", lambda g: g["scored"]), ("conceded", lambda g: g["conceded"])]
    return F.struct(F.size(some).alias("games"), *(mean(some, f).alias(c) for c, f in parts), *((mean(some, f) - mean(items, f)).alias(f"{c}_delta") for c, f in parts))


def streak(items: Column) -> Column:
    """The run of equal results that ends with the latest game, such as W3; empty without games."""
    kinds = F.transform(items, lambda g: outcome(g["scored"], g["conceded"]))
    last = F.get(kinds, F.lit(0))
    first_other = F.array_position(F.transform(kinds, lambda k: k != last), True)
    run = F.when(first_other > 0, first_other - 1).otherwise(F.size(kinds))
    return F.when(F.size(items) > 0, F.concat(F.upper(F.substring(last, 1, 1)), run.cast("string"))).otherwise("")


#: A team at a time: what is known of it is the same for all its fixtures of that kickoff.
TIME = ["league", "team_id", "kickoff"]


def at_times(rows: DataFrame, known: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with what is known of their team at their kickoff; nulls match one another."""
    known = known.withColumnsRenamed({c: f"_k_{c}" for c in TIME})
    return rows.join(known, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in TIME], how).drop(*(f"_k_{c}" for c in TIME))


def form_before(fixtures: DataFrame, games: DataFrame, lookback: int = LOOKBACK, half_life_days: float = HALF_LIFE_DAYS, latest: int = MOMENTUM_GAMES) -> DataFrame:
    """The form of both teams of each fixture from their last ``lookback`` games in the league strictly before it.

    ``games`` are team games. Returns a row for each fixture and team: match_id, league, kickoff, team_id, opponent_id,
    side, games (the latest first), overall, home, away (records), streak, points_per_game, weighted, momentum. A team
    without games has zeros and an empty streak.
    """
    return form_of(fixtures, form_at(fixtures, games, lookback, half_life_days, latest))


def form_at(fixtures: DataFrame, games: DataFrame, lookback: int = LOOKBACK, half_life_days: float = HALF_LIFE_DAYS, latest: int = MOMENTUM_GAMES) -> DataFrame:
    """The form of each team of the fixtures once for each kickoff. All but ``games`` come from that array, without a further shuffle."""
    rows = latest_before(sides(fixtures).select(*TIME).distinct(), games, ["league", "team_id"], lookback, GAME)
    g = F.col("games")
    at_side = lambda side: F.filter(g, lambda x: x["side"] == side)
    return rows.withColumns({
        "overall": record(g), "home": once(at_side("home"), record), "away": once(at_side("away"), record), "streak": streak(g), "points_per_game": exact_round(mean(g, points), 3),
        "weighted": weighted(g, F.col("kickoff"), half_life_days), "momentum": momentum(g, latest),
    })


def form_of(fixtures: DataFrame, known: DataFrame) -> DataFrame:
    """``form_before`` from ``form_at``."""
    return at_times(sides(fixtures), known)


def strength_before(form: DataFrame, games: DataFrame) -> DataFrame:
    """(match_id, team_id, rated_games, strength): the mean, over a form's games, of the opponents' mean goal difference.

    An opponent's rate is over its league games from the form's first game on and strictly before the fixture. It is the
    difference of two running sums, so each opponent of a form reads its sums as of two times: rows are games plus reads,
    however many games lie between, and forms of one team and kickoff read once. ``strength`` is null without games.
    """
    met = F.transform("games", lambda g: g["opponent_id"])
    faced = F.transform(F.array_distinct(met), lambda o: F.struct(o.alias("opponent_id"), F.size(F.filter(met, lambda x: x == o)).alias("times")))
    since = F.array_min(F.transform("games", lambda g: g["kickoff"]))
    asked = form.select(*TIME, "games").dropDuplicates(TIME).select(*TIME, since.alias("since"), F.explode(faced).alias("f")).select(*TIME, "since", "f.*")
    ends = F.explode(F.array(F.struct(F.col("since").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("kickoff").alias("at"), F.lit(1).alias("sign")))).alias("e")
    reads = asked.select(*TIME, "opponent_id", "times", ends).select(*TIME, "opponent_id", "times", "e.*")
    played = games.select("league", F.col("team_id").alias("opponent_id"), F.col("kickoff").alias("at"), (F.col("scored") - F.col("conceded")).alias("margin"))
    before = Window.partitionBy("league", "opponent_id").orderBy(micros(F.col("at"))).rangeBetween(Window.unboundedPreceding, -1)
    known = reads.unionByName(played, allowMissingColumns=True).withColumns({"_sum": F.coalesce(F.sum("margin").over(before), F.lit(0)), "_n": F.count("margin").over(before)})
    known = known.where("sign is not null").repartition(*TIME)  # both groupings below keep it
    rates = known.groupBy(*TIME, "opponent_id").agg(F.max("times").alias("times"), F.try_divide(F.sum(F.col("sign") * F.col("_sum")), F.sum(F.col("sign") * F.col("_n"))).alias("rate"))
    rates = rates.where("rate is not null").groupBy(*TIME).agg(F.sum("times").alias("rated_games"), (F.sum(F.col("times") * F.col("rate")) / F.sum("times")).alias("strength"))
    return at_times(form.select("match_id", *TIME), rates, "left").select("match_id", "team_id", F.coalesce("rated_games", F.lit(0)).alias("rated_games"), "strength")


def context_before(fixtures: DataFrame, finals: DataFrame, days: int = CONGESTION_DAYS, congested_from: int = CONGESTED) -> DataFrame:
    """(match_id, team_id, side, rest_days, recent, congested): whole days since the team's last final match in the league, and those in the days before.

    ``finals`` count with or without scores, strictly before the kickoff, from exactly ``days`` earlier on. ``rest_days`` is null
    without an earlier match. A fixture reads the matches before its kickoff and those before the days in question, and the
    first less the second are recent: one union and one growing window over a team's calendar, however many matches the days hold.
    """
    key, kickoff = ["league", "team_id", "match_id", "side"], micros(F.col("kickoff"))
    now, earlier = F.struct(kickoff.alias("_at"), F.lit(True).alias("_now")), F.struct((kickoff - days * DAY).alias("_at"), F.lit(False).alias("_now"))
    reads = sides(fixtures).select(*key, F.explode(F.array(now, earlier)).alias("r")).select(*key, "r.*")
    played = sides(finals).select("league", "team_id", kickoff.alias("_at"), kickoff.alias("_game"))
    before = Window.partitionBy("league", "team_id").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    known = reads.unionByName(played, allowMissingColumns=True).withColumns({"_last": F.max("_game").over(before), "_n": F.count("_game").over(before)})
    at = lambda c, on: F.max(F.when(F.col("_now") == on, F.col(c)))
    rows = known.where("_now is not null").groupBy(*key).agg(F.floor((at("_at", True) - at("_last", True)) / F.lit(float(DAY))).cast("int").alias("rest_days"), (at("_n", True) - at("_n", False)).alias("recent"))
    return rows.select("match_id", "team_id", "side", "rest_days", "recent", (F.col("recent") >= congested_from).alias("congested"))


def meetings_before(fixtures: DataFrame, finals: DataFrame, limit: int = LOOKBACK) -> DataFrame:
    """Earlier meetings of each fixture's teams in the league, seen from its home team: counts, goals, their mean, the meetings."""
    pair = {"_a": F.least("home_id", "away_id"), "_b": F.greatest("home_id", "away_id")}
    left = fixtures.where("home_id <> away_id").select("match_id", "league", "kickoff", "home_id", "away_id").withColumns(pair)
    rows = latest_before(left, finals.withColumns(pair), ["league", "_a", "_b"], limit, ["home_id", "away_id", "home_score", "away_score"], "meetings").drop("_a", "_b")
    turned = F.transform("meetings", lambda m: F.when(m["home_id"] == F.col("home_id"), F.struct(m["home_score"].alias("scored"), m["away_score"].alias("conceded"))).otherwise(F.struct(m["away_score"].alias("scored"), m["home_score"].alias("conceded"))))
    rows = rows.withColumn("_r", record(turned))
    goals = F.col("_r.scored") + F.col("_r.conceded")
    return rows.select(
        "match_id", "league", "kickoff", "home_id", "away_id", F.col("_r.played").alias("played"), F.col("_r.wins").alias("home_wins"), F.col("_r.losses").alias("away_wins"), F.col("_r.draws").alias("draws"),
        F.col("_r.scored").alias("home_points"), F.col("_r.conceded").alias("away_points"), exact_round(F.coalesce(F.try_divide(goals, F.col("_r.played")), F.lit(0.0)), 2).alias("avg_total_points"), "meetings",
    )


def running(rows: DataFrame, by: list[str], values: dict[str, Column], order: list[str]) -> DataFrame:
    """``rows`` with sums of whole-number values over their group: ``before_`` over rows of an earlier kickoff, ``upto_`` over rows up to it in order.

    Sums run within days and over days' totals, so that no task holds the whole history of a group.
    """
    rows = rows.withColumns({f"_v_{c}": v for c, v in values.items()} | {"_day": F.to_date("kickoff")})
    day = Window.partitionBy(*by, "_day")
    earlier, upto = day.orderBy(micros(F.col("kickoff"))).rangeBetween(Window.unboundedPreceding, -1), day.orderBy("kickoff", *order).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*by, "_day").agg(*(F.sum(f"_v_{c}").alias(f"_d_{c}") for c in values))
    days = days.select(*by, "_day", *(F.coalesce(F.sum(f"_d_{c}").over(past), F.lit(0)).alias(f"_p_{c}") for c in values))
    rows = rows.withColumns({f"_b_{c}": F.coalesce(F.sum(f"_v_{c}").over(earlier), F.lit(0)) for c in values} | {f"_u_{c}": F.sum(f"_v_{c}").over(upto) for c in values}).join(days, [*by, "_day"])
    sums = {f"{name}_{c}": F.col(f"_p_{c}") + F.col(f"_{name[0]}_{c}") for c in values for name in ("before", "upto")}
    return rows.withColumns(sums).drop("_day", *(f"_{p}_{c}" for c in values for p in "vpbu"))


def baseline_before(fixtures: DataFrame, sample: int = SAMPLE, window_days: int | None = None) -> DataFrame:
    """The baseline of each fixture's league over its last ``sample`` final fixtures strictly before it, within ``window_days`` if given.

    The sample is taken before fixtures without scores are dropped. Each is a difference of running sums: those before
    the fixture, less those up to the last final fixture that the sample leaves out, which is found by its number. Returns
    match_id, league, sample, avg_home, avg_away, home_advantage, margin_sd (10 where it is zero or unknown; all of
    two places), draw_rate (three places); zeros without a sample.
    """
    final = F.coalesce(F.col("status") == "final", F.lit(False))
    scored = final & F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    margin = F.col("home_score") - F.col("away_score")
    number = lambda c: F.when(scored, c).otherwise(0).cast("long")
    values = {"final": final.cast("long"), "n": number(F.lit(1)), "home": number(F.col("home_score")), "away": number(F.col("away_score")), "square": number(margin * margin), "draws": number((margin == 0).cast("int"))}
    rows = fixtures.select("match_id", "league", "kickoff", "status", "home_score", "away_score", F.lit(True).alias("_own"))
    if window_days is not None:  # what lies before the window is read as of its begin
        begin = rows.select("match_id", "league", (F.col("kickoff") - F.expr(f"make_dt_interval({int(window_days)})")).alias("kickoff"), F.lit(False).alias("_own"))
        rows = rows.unionByName(begin, allowMissingColumns=True)
    known = running(rows, ["league"], values, ["match_id"])
    own = known.where("_own")
    left_out = F.col("before_final") - sample
    if window_days is not None:
        own = own.join(known.where("not _own").select("match_id", F.col("before_final").alias("_outside")), "match_id")
        left_out = F.greatest(left_out, F.col("_outside"))
    marks = known.where(final).select("league", F.col("upto_final").alias("_last"), *(F.col(f"upto_{c}").alias(f"_{c}") for c in values if c != "final"))
    rows = own.withColumn("_last", left_out).join(marks, ["league", "_last"], "left")
    of = {c: F.col(f"before_{c}") - F.coalesce(f"_{c}", F.lit(0)) for c in values if c != "final"}
    rows = rows.select("match_id", "league", *(v.alias(f"s_{c}") for c, v in of.items()))
    n, gap = F.col("s_n"), F.col("s_home") - F.col("s_away")
    part = lambda x, places=2: exact_round(F.coalesce(F.try_divide(x, n), F.lit(0.0)), places)
    sd = exact_round(F.sqrt(F.try_divide((n * F.col("s_square") - gap * gap).cast("double"), (n * n))), 2)
    return rows.select(
        "match_id", "league", n.alias("sample"), part(F.col("s_home")).alias("avg_home"), part(F.col("s_away")).alias("avg_away"), part(gap).alias("home_advantage"),
        F.when(n * F.col("s_square") > gap * gap, sd).otherwise(projection.MARGIN_SD).alias("margin_sd"), part(F.col("s_draws"), 3).alias("draw_rate"),
    )


def projection_before(fixtures: DataFrame, finals_and_others: DataFrame, games: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Projections of ``fixtures`` from the form of both teams and the league's baseline strictly before each.

    ``finals_and_others`` are all fixtures of the leagues, which baselines come from; ``games`` the team games.
    """
    return projection_of(fixtures, finals_and_others, form_before(fixtures, games, lookback))


def projection_of(fixtures: DataFrame, finals_and_others: DataFrame, form: DataFrame) -> DataFrame:
    """The same from the form of ``form_before`` that is at hand."""
    side = lambda s: form.where(F.col("side") == s).select("match_id", F.col(s).alias(f"{s}_own"), F.col("overall").alias(f"{s}_all"))
    rows = fixtures.select("match_id", "league", "home_id", "away_id").join(side("home"), "match_id").join(side("away"), "match_id")
    return projection.from_form(rows.join(baseline_before(finals_and_others).drop("league"), "match_id"))
