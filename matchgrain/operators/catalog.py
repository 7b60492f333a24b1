"""Lists and details of stored rows: the rows they refer to, the columns of a list or of one row, default orders, filters by field."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrain.functions.listing import order, same

#: The order of each table's lists: fixed values.
ORDERS = {
    "sport": ["name"], "league": ["name"], "venue": ["name"], "team": ["display_name"], "event": ["-date"], "competitor": ["order"], "athlete": ["last_name", "first_name"],
    "news": ["-published"], "injury": ["-updated_at"], "transaction": ["-date", "-updated_at"], "odds": ["event", "market", "selection"], "season_stats": ["-season_year"],
}


def default_order(rows: DataFrame, table: str, key: str) -> DataFrame:
    """Rows in the order of their table's lists, equal ones by key."""
    keys = ORDERS[table]
    return rows.orderBy(*order(keys, {k.lstrip("-") for k in keys}), key)


def refer(rows: DataFrame, table: DataFrame, key: str, columns: Mapping[str, str], required: bool = True) -> DataFrame:
    """``rows`` with columns (new name: name there) of the row of ``table`` whose id is their ``key``.

    ``table`` has one row an id. Rows without one go if the reference is required, else they keep nulls; a null key has
    none. Only the named columns are read; whether the table is broadcast is left to its size.
    """
    there = table.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(columns.values())))
    out = rows.drop(*columns).join(there, F.col(key) == F.col("_id"), "inner" if required else "left")
    return out.withColumnsRenamed({f"_{i}": name for i, name in enumerate(columns)}).drop("_id")


def in_league(rows: DataFrame, leagues: DataFrame, sports: DataFrame, nested: bool = False) -> DataFrame:
    """``rows`` (league_id) with league_slug and sport_slug or, nested, a struct ``league`` (id, slug, name, sport_slug)."""
    out = refer(rows, leagues, "league_id", {"league_slug": "slug", "_name": "name", "_sport": "sport_id"})
    out = refer(out, sports, "_sport", {"sport_slug": "slug"}).drop("_sport")
    if not nested:
        return out.drop("_name")
    return out.withColumn("league", F.struct(F.col("league_id").alias("id"), F.col("league_slug").alias("slug"), F.col("_name").alias("name"), "sport_slug")).drop("_name", "league_slug", "sport_slug")


def team_list(teams: DataFrame, leagues: DataFrame, sports: DataFrame, is_active: bool | None = None) -> DataFrame:
    """Active teams with the slugs of their league and sport; asking for those that are not active gives none, as lists hold active ones."""
    shown = teams.where("is_active")
    if is_active is not None:
        shown = shown.where(F.col("is_active") == is_active)
    return in_league(shown, leagues, sports).select("id", "abbreviation", "display_name", "is_active", "league_slug", "sport_slug")


def team_detail(teams: DataFrame, leagues: DataFrame, sports: DataFrame) -> DataFrame:
    """All columns of active teams, their league nested."""
    return in_league(teams.where("is_active"), leagues, sports, nested=True).drop("league_id")


def event_list(events: DataFrame, leagues: DataFrame, sports: DataFrame) -> DataFrame:
    return in_league(events, leagues, sports).select("id", "date", "status", "league_slug", "sport_slug")


def event_detail(events: DataFrame, leagues: DataFrame, sports: DataFrame, competitors: DataFrame, teams: DataFrame) -> DataFrame:
    """Events with their league and competitors nested, these in their order; an event without competitors has an empty array."""
    named = refer(competitors, teams, "team_id", {"team_abbreviation": "abbreviation", "team_name": "display_name"})
    sides = named.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("ord", "home_away", "team_id", "team_abbreviation", "team_name", "score"))).alias("competitors"))
    out = in_league(events, leagues, sports, nested=True).drop("league_id").join(sides, F.col("id") == F.col("event_id"), "left").drop("event_id")
    return out.withColumn("competitors", F.coalesce("competitors", F.array().cast(sides.schema["competitors"].dataType)))


def by_fields(rows: DataFrame, asked: Mapping[str, str], allowed: set[str]) -> DataFrame:
    """Rows equal to each value asked for; an empty value, or a field that is not allowed, filters nothing."""
    for name, value in asked.items():
        if name in allowed and value != "":
            rows = rows.where(F.col(name) == F.lit(value))
    return rows


def next_of_league(events: DataFrame, league: str, sport: str, status: str, n: int = 50) -> DataFrame:
    """The ``n`` earliest events of a status in a league of a sport, both named whatever their case; ties by id."""
    wanted: Column = same("league_slug", league) & same("sport_slug", sport) & (F.col("status") == status)
    return events.where(wanted).orderBy("date", "id").limit(n)
