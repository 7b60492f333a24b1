"""The analysis of a fixture as one row: form and circumstances of both teams, meetings, baseline, projection, and sentences about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrain.functions.rounding import exact_round
from matchgrain.operators import asof
from matchgrain.operators.fixtures import completed, team_games

#: From which a streak, a momentum, opponents and a rest are worth a sentence: fixed values.
LONG_STREAK, LEAST_MOMENTUM, MOMENTUM_GAP, STRENGTH_GAP, SHORT_REST = 3, 3, 0.5, 0.3, 3
#: The sentences: fixed values.
SAY = {
    "no_games": "No completed games on record for %s.",
    "record": "%s last %s: %s-%s-%s (%s scored / %s conceded per game).",
    "streak": "%s is on a %s run.",
    "momentum": "%s is running %s points per game %s its own %s-game average over the last %s — a short sample, so treat it as a hint, not a trend.",
    "stronger": "%s faced stronger-than-average opponents (%+.2f goal difference per game), so that record flatters it less than it looks.",
    "weaker": "%s faced weaker-than-average opponents (%+.2f goal difference per game).",
    "congested": "%s has played %s matches in 14 days.",
    "rest": "%s had only %s days' rest.",
    "absences": "%s has %s listed absence%s, weighted %.1f%s.",
    "unknown_time": " (playing time unknown)",
    "meetings": "Head-to-head over %s meeting%s: %s %s - %s %s%s, %s combined points per game.",
    "drawn": " (%s drawn)",
    "no_meetings": "No previous meetings on record between these teams.",
    "lean": "Model leans %s by %s (%s - %s projected).",
    "fallback": "Too little league history to fit the scoreline model, so this projection comes from the form fallback, which prices every draw in the league at the same rate. Use /forecast/ once more matches are stored.",
}
FALLBACK = "fallback_form"


def say(kind: str, *values: Column | str) -> Column:
    return F.format_string(SAY[kind], *values)


def settled(x: Column, places: int) -> Column:
    """A sum of doubles to so many places, taken to nine first, so that the order in which rows were added does not show."""
    return exact_round(F.round(x, 9), places)


def team_rows(fixtures: DataFrame, others: DataFrame, form: DataFrame, teams: DataFrame, injuries: DataFrame | None = None) -> DataFrame:
    """A row for each fixture and side: ``form`` as ``asof.form_before`` gives it beside strength, rest_days, recent, congested, names and absences.

    ``teams`` has league, team_id, abbreviation, display_name; a team without a row goes by its id. ``injuries`` is
    ``baseline.injury_burden``; teams without a row, or all without it, have no absences.
    """
    key = ["match_id", "team_id"]
    rows = form.join(asof.strength_before(form, team_games(completed(others))).select(*key, "strength"), key, "left")
    rows = rows.join(asof.context_before(fixtures, others.where("status = 'final'")).select(*key, "rest_days", "recent", "congested"), key, "left")
    rows = rows.join(teams.select("league", "team_id", "abbreviation", "display_name"), ["league", "team_id"], "left")
    if injuries is None:
        rows = rows.withColumns({"absences": F.lit(0).cast("long"), "burden": F.lit(0.0), "known": F.lit(0).cast("long"), "top": F.lit("")})
    else:
        rows = rows.join(injuries.select("league", "team_id", "absences", "burden", "known", "top"), ["league", "team_id"], "left").fillna({"absences": 0, "burden": 0.0, "known": 0, "top": ""})
    name = F.col("team_id").cast("string")
    return rows.withColumns({"abbreviation": F.coalesce("abbreviation", name, F.lit("")), "display_name": F.coalesce("display_name", name, F.lit("")), "recent": F.coalesce("recent", F.lit(0)), "congested": F.coalesce("congested", F.lit(False))})


def form_notes() -> Column:
    """What the form of a row says; a team without games has one sentence."""
    team, all_ = F.col("abbreviation"), F.col("overall")
    run = F.substring("streak", 2, 9).try_cast("int")
    gap, latest = F.col("momentum.points_delta"), F.col("momentum.games")
    strength = settled(F.col("strength"), 3)
    notes = F.array_compact(
        F.array(
            say("record", team, all_["played"], all_["wins"], all_["draws"], all_["losses"], all_["avg_scored"], all_["avg_conceded"]),
            F.when(run >= LONG_STREAK, say("streak", team, F.col("streak"))),
            F.when((latest >= LEAST_MOMENTUM) & (F.abs(gap) >= MOMENTUM_GAP), say("momentum", team, F.abs(exact_round(gap, 2)), F.when(gap > 0, "above").otherwise("below"), all_["played"], latest)),
            F.when(strength >= STRENGTH_GAP, say("stronger", team, exact_round(strength, 2))).when(strength <= -STRENGTH_GAP, say("weaker", team, exact_round(strength, 2))),
        )
    )
    return F.when(all_["played"] > 0, notes).otherwise(F.array(say("no_games", F.col("display_name"))))


def context_notes() -> Column:
    """What a row's circumstances say: a run of matches, a short rest, absences."""
    team, n = F.col("abbreviation"), F.col("absences")
    return F.array_compact(
        F.array(
            F.when(F.col("congested"), say("congested", team, F.col("recent"))),
            F.when(F.col("rest_days") <= SHORT_REST, say("rest", team, F.col("rest_days"))),
            F.when(n > 0, say("absences", team, n, F.when(n > 1, "s").otherwise(""), settled(F.col("burden"), 1), F.when(F.col("known") > 0, "").otherwise(SAY["unknown_time"]))),
        )
    )


def side_document() -> Column:
    """Team, form and circumstances of a row, its figures rounded as they are shown."""
    shown = lambda c, places: exact_round(F.col(c), places).alias(c.split(".")[-1])
    recent = [shown(f"momentum.{c}", 3) for c in ("points", "scored", "conceded", "points_delta", "scored_delta", "conceded_delta")]
    return F.struct(
        F.struct("team_id", "abbreviation", "display_name").alias("team"),
        F.struct(
            "overall", "home", "away", "streak", (F.col("overall.scored") - F.col("overall.conceded")).alias("point_differential"), "points_per_game",
            F.struct(shown("weighted.effective_games", 2), *(shown(f"weighted.{c}", 3) for c in ("points", "scored", "conceded"))).alias("weighted"),
            F.struct(F.col("momentum.games").alias("games"), *recent).alias("momentum"), settled(F.col("strength"), 3).alias("opponent_strength"), "games",
        ).alias("form"),
        F.struct("rest_days", F.col("recent").alias("matches_in_last_14_days"), "congested", F.struct(F.col("absences").alias("count"), settled(F.col("burden"), 3).alias("weighted"), (F.col("known") > 0).alias("importance_known"), F.col("top").alias("players")).alias("injuries")).alias("context"),
    )


def match_notes() -> Column:
    """What meetings and projection say, of a row with ``home``, ``away``, ``met`` and ``projection``."""
    met, p = F.col("met"), F.col("projection")
    home, away = F.col("home.team.abbreviation"), F.col("away.team.abbreviation")
    drawn = F.when(met["draws"] > 0, say("drawn", met["draws"])).otherwise("")
    meetings = say("meetings", met["played"], F.when(met["played"] > 1, "s").otherwise(""), home, met["home_wins"], met["away_wins"], away, drawn, met["avg_total_points"])
    lean = say("lean", F.when(p["margin"] >= 0, home).otherwise(away), F.abs(p["margin"]), p["expected_home"], p["expected_away"])
    return F.array_compact(F.array(F.when(met["played"] > 0, meetings).otherwise(SAY["no_meetings"]), F.when(p["margin"].isNotNull(), lean), F.when(p["source"] == FALLBACK, SAY["fallback"])))


def documents(fixtures: DataFrame, others: DataFrame, form: DataFrame, teams: DataFrame, projections: DataFrame, injuries: DataFrame | None = None, lookback: int = asof.LOOKBACK, window_days: int | None = None) -> DataFrame:
    """One row for each fixture of two teams from what was known strictly before it.

    ``fixtures`` (match_id, which is unique, league, kickoff, status, home_id, away_id, scores) may be some of ``others``,
    all fixtures of the leagues. ``form`` is that of ``asof.form_before`` under the same ``lookback``; of a written
    ``asof.form_at``, it is made once for strengths and projections too. ``projections`` are those of ``walkforward.projections`` or, without ``source``, of form.
    Columns: match_id, league, kickoff, status, home and away (team, form, context), head_to_head, league_baseline,
    projection, confidence, insights, lookback. Insights hold what is said of the home team's form, of the away team's, of
    the circumstances of both, of meetings and of the projection. A team without games has zeros; a fixture without a
    projection has a null one. Rows of a fixture meet by match_id, so no task holds more than one fixture's.
    """
    if "source" not in projections.columns:
        projections = projections.withColumn("source", F.lit(FALLBACK))
    rows = team_rows(fixtures, others, form, teams, injuries).select("match_id", "side", side_document().alias("d"), form_notes().alias("said"), context_notes().alias("around"))
    at = lambda side, c: F.any_value(F.when(F.col("side") == side, F.col(c)), F.lit(True))
    sides = rows.groupBy("match_id").agg(*(at(s, "d").alias(s) for s in ("home", "away")), F.concat(*(F.coalesce(at(s, c), F.array().cast("array<string>")) for c in ("said", "around") for s in ("home", "away"))).alias("said"))
    pack = lambda df, name: df.select("match_id", F.struct(*(c for c in df.columns if c not in ("match_id", "league", "kickoff", "home_id", "away_id"))).alias(name))
    out = fixtures.select("match_id", "league", "kickoff", "status", "home_score", "away_score").join(sides, "match_id")
    for part, name in ((asof.meetings_before(fixtures, completed(others), lookback), "met"), (baselines(fixtures, others, window_days), "league_baseline"), (projections, "projection")):
        out = out.join(pack(part, name), "match_id", "left")
    return out.select(
        "match_id", "league", "kickoff", "status", "home_score", "away_score", "home", "away", F.col("met").alias("head_to_head"), "league_baseline", F.col("projection").dropFields("confidence").alias("projection"),
        F.col("projection.confidence").alias("confidence"), F.concat("said", match_notes()).alias("insights"), F.lit(lookback).alias("lookback"),
    )


def baselines(fixtures: DataFrame, others: DataFrame, window_days: int | None) -> DataFrame:
    """The baseline before each fixture, of which only those asked for are kept."""
    return asof.baseline_before(others, window_days=window_days).join(fixtures.select("match_id"), "match_id", "left_semi")


def insights(documents: DataFrame) -> DataFrame:
    """(match_id, place, insight): the sentences of each document, one a row, counted from 1."""
    return documents.select("match_id", F.posexplode("insights").alias("pos", "insight")).select("match_id", (F.col("pos") + 1).alias("place"), "insight")
