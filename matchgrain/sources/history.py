"""League history from CSV files, one match a row: events, sides, teams and closing prices under ids that repeat.

All columns are read as text; a column that a file lacks is null. Ids are digests of names, so loading a file again
gives the same keys to the upserts of ``merge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrain.sources.merge import latest

#: Slug, name and abbreviation of the league of each division.
DIVISIONS = {
    "I1": ("ita.1", "Italian Serie A", "SERIE A"),
    "I2": ("ita.2", "Italian Serie B", "SERIE B"),
    "E0": ("eng.1", "English Premier League", "PREM"),
    "E1": ("eng.2", "English Championship", "CHAMP"),
    "SP1": ("esp.1", "Spanish La Liga", "LALIGA"),
    "SP2": ("esp.2", "Spanish Segunda División", "LALIGA2"),
    "D1": ("ger.1", "German Bundesliga", "BUND"),
    "D2": ("ger.2", "German 2. Bundesliga", "BUND2"),
    "F1": ("fra.1", "French Ligue 1", "LIGUE1"),
    "F2": ("fra.2", "French Ligue 2", "LIGUE2"),
    "N1": ("ned.1", "Dutch Eredivisie", "ERE"),
    "P1": ("por.1", "Portuguese Primeira Liga", "PRIMEIRA"),
    "T1": ("tur.1", "Turkish Süper Lig", "SUPERLIG"),
    "B1": ("bel.1", "Belgian Pro League", "BELPRO"),
    "SC0": ("sco.1", "Scottish Premiership", "SCOPREM"),
    "G1": ("gre.1", "Greek Super League", "GRESL"),
}
#: The columns of the prices of home, draw, away, over and under by provider, and the line of totals.
PRICES = {
    ("fd-avg", "Market average"): ("OddHome", "OddDraw", "OddAway", "Over25", "Under25"),
    ("fd-max", "Market maximum"): ("MaxHome", "MaxDraw", "MaxAway", "MaxOver25", "MaxUnder25"),
}
SELECTIONS = (("1x2", "home", ""), ("1x2", "draw", ""), ("1x2", "away", ""), ("totals", "over", "2.5"), ("totals", "under", "2.5"))
#: Statistics and their columns behind Home or Away; facts that travel with the event.
STATISTICS = {"shots": "Shots", "shotsOnTarget": "Target", "corners": "Corners", "fouls": "Fouls", "yellowCards": "Yellow", "redCards": "Red"}
FACTS = {"home_elo": "HomeElo", "away_elo": "AwayElo", "form3_home": "Form3Home", "form5_home": "Form5Home", "form3_away": "Form3Away", "form5_away": "Form5Away"}
NEEDED = ["Division", "MatchDate", "MatchTime", "HomeTeam", "AwayTeam", "FTHome", "FTAway", *FACTS.values(), *(c for p in PRICES.values() for c in p), *(s + c for s in ("Home", "Away") for c in STATISTICS.values())]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Files with a header row, every column as text."""
    return spark.read.option("header", True).csv(path)


def number(c: Column) -> Column:
    """The number that a text holds; null for other text, infinities and NaN."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def whole(c: Column) -> Column:
    """A whole number, also of text such as '2.0'; fractions are cut off."""
    return number(c).try_cast("int")


def quoted(c: Column) -> Column:
    """A decimal price between 1.01 and 1000, else null."""
    return F.when(number(c).between(1.01, 1000.0), number(c))


def kickoff(date: Column, time: Column) -> Column:
    """UTC time of a date and a time of day, noon if that is missing or cannot be read; null without a date."""
    day, noon = F.trim(date), F.lit(" 12:00 Z")
    clock = F.coalesce(F.nullif(F.trim(time), F.lit("")), F.lit("12:00"))
    at = lambda text: F.try_to_timestamp(text, F.lit("yyyy-M-d H:m[:s] X"))
    return F.coalesce(at(F.concat(day, F.lit(" "), clock, F.lit(" Z"))), at(F.concat(day, noon)))


def stable_id(prefix: str, *parts: Column) -> Column:
    """The prefix and 20 hexadecimal digits of a digest of the parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 20))


def leagues(division: Column) -> Column:
    """slug, name and abbreviation of a division's league; unknown ones are named by their code."""
    known = F.create_map(*(F.lit(x) if isinstance(x, str) else F.struct(*(F.lit(v).alias(n) for v, n in zip(x, ("slug", "name", "abbreviation"), strict=True))) for kv in DIVISIONS.items() for x in kv))
    other = F.struct(F.concat(F.lit("fd."), F.lower(division)).alias("slug"), F.concat(F.lit("Football-Data "), division).alias("name"), F.substring(F.upper(division), 1, 10).alias("abbreviation"))
    return F.coalesce(F.try_element_at(known, division), other)


def matches(rows: DataFrame, division: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """The rows with a date, of one division (any case) if given and between two instants, as typed matches.

    ``skipped`` marks those without both teams and both goals, which the tables below leave out. Extra columns are
    ignored.
    """
    have = {c for c in rows.columns}
    text = rows.select(*(F.col(f"`{c}`").cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in NEEDED))
    code = F.upper(F.coalesce("Division", F.lit("")))
    if division is not None:
        text = text.where(code == division.upper())
    day = F.date_format(F.try_to_timestamp(F.trim("MatchDate"), F.lit("yyyy-M-d")), "yyyy-MM-dd")
    name = lambda c: F.coalesce(F.trim(c), F.lit(""))
    out = text.withColumns({"kickoff": kickoff(F.col("MatchDate"), F.col("MatchTime")), "league": leagues(code), "_day": day, "home": name("HomeTeam"), "away": name("AwayTeam"), "home_goals": whole(F.col("FTHome")), "away_goals": whole(F.col("FTAway"))})
    out = out.where("kickoff is not null")
    if since:
        out = out.where(F.col("kickoff") >= F.lit(since).cast("timestamp"))
    if until:
        out = out.where(F.col("kickoff") <= F.lit(until).cast("timestamp"))
    skipped = (F.col("home") == "") | (F.col("away") == "") | F.col("home_goals").isNull() | F.col("away_goals").isNull()
    slug = F.col("league.slug")
    out = out.withColumns({"skipped": skipped, "event_id": stable_id("fd", slug, F.col("_day"), F.col("home"), F.col("away")), "home_id": stable_id("fdt", slug, F.col("home")), "away_id": stable_id("fdt", slug, F.col("away"))})
    return out.withColumn("season_year", F.year("_day") - F.when(F.month("_day") >= 7, 0).otherwise(1))


def abbreviation(name: Column) -> Column:
    return F.upper(F.substring(name, 1, 3))


def events(loaded: DataFrame) -> DataFrame:
    """One final event for each key, the last by kickoff where rows repeat it."""
    raw = F.to_json(F.struct(F.lit("football-data").alias("source"), F.col("Division").alias("division"), *(F.col(c).alias(n) for n, c in FACTS.items())))
    rows = loaded.where("not skipped").select(
        "event_id", F.col("league.slug").alias("league"), F.col("kickoff").alias("date"), F.concat("away", F.lit(" at "), "home").alias("name"),
        F.concat(abbreviation(F.col("away")), F.lit(" @ "), abbreviation(F.col("home"))).alias("short_name"), "season_year", F.lit(2).alias("season_type"),
        F.lit("final").alias("status"), F.lit("Final").alias("status_detail"), raw.alias("raw"),
    )
    return latest(rows, ["event_id"], "date")


def sides(loaded: DataFrame) -> DataFrame:
    """Two sides an event with score, winner and the statistics that are whole numbers."""
    stats = lambda side: F.filter(F.array(*(F.struct(F.lit(n).alias("name"), whole(F.col(side + c)).alias("value")) for n, c in STATISTICS.items())), lambda s: s["value"].isNotNull())
    one = lambda own, other, label, ord: F.struct(
        F.lit(own).alias("home_away"), F.col(f"{own}_id").alias("team_id"), F.col(f"{own}_goals").cast("string").alias("score"), (F.col(f"{own}_goals") > F.col(f"{other}_goals")).alias("winner"), F.lit(ord).alias("ord"), stats(label).alias("statistics")
    )
    rows = loaded.where("not skipped").select("event_id", "kickoff", F.array(one("home", "away", "Home", 1), one("away", "home", "Away", 0)).alias("s"))
    return latest(rows, ["event_id"], "kickoff").select("event_id", F.explode("s").alias("s")).select("event_id", "s.*")


def teams(loaded: DataFrame) -> DataFrame:
    """Each team of a league once."""
    each = F.explode(F.array(*(F.struct(F.col(f"{s}_id").alias("team_id"), F.col(s).alias("display_name")) for s in ("home", "away")))).alias("t")
    rows = loaded.where("not skipped").select(F.col("league.slug").alias("league"), each).select("league", "t.*").distinct()
    return rows.withColumn("abbreviation", abbreviation(F.col("display_name")))


def odds(loaded: DataFrame) -> DataFrame:
    """Up to ten prices an event: one row for each provider, market, selection and line with a usable price."""
    row = lambda who, pick, c: F.struct(*(F.lit(v).alias(n) for v, n in zip((*who, *pick, c), ("provider", "provider_name", "market", "selection", "line", "source_column"), strict=True)), quoted(F.col(c)).alias("decimal_odds"))
    rows = [row(who, pick, c) for who, columns in PRICES.items() for pick, c in zip(SELECTIONS, columns, strict=True)]
    each = loaded.where("not skipped").select("event_id", "kickoff", F.explode(F.filter(F.array(*rows), lambda r: r["decimal_odds"].isNotNull())).alias("r")).select("event_id", "kickoff", "r.*")
    return latest(each, ["event_id", "provider", "market", "selection", "line"], "kickoff").drop("kickoff")
