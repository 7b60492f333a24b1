"""Prices: parsing, margins, expected value, stakes, settlement, scores of forecasts and the betting ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrain.functions.columns import once

#: Thresholds of value bets: edge, share of Kelly's stake, largest stake; fixed values.
EDGE, KELLY_SHARE, STAKE_CAP = 0.05, 0.25, 0.05
LOSS_FLOOR = 1e-15
GROUP = ["match_id", "provider", "market", "line"]


def american_to_decimal(a: Column) -> Column:
    return F.when(a > 0, 1 + a / 100).when(a < 0, 1 + 100 / F.abs(a))


def price(text: Column) -> Column:
    """A quoted price as decimal odds: EVEN is 2, numbers between 1 and 100 are decimal, others American; else null.

    Plus signs are dropped first. Prices outside 1.001 to 1000 are null; results have four decimals.
    """
    number = lambda t: F.when(t.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)(E-?[0-9]+)?$"), t.try_cast("double"))
    decimal = lambda t, n: F.when(t.isin("EVEN", "EV"), F.lit(2.0)).when((n > 1) & (n < 100), n).otherwise(american_to_decimal(n))
    read = lambda t: once(number(t), lambda n: once(decimal(t, n), lambda d: F.when(d.between(1.001, 1000), F.round(d, 4))))
    return once(F.upper(F.replace(F.trim(text), F.lit("+"), F.lit(""))), read)


#: Under which names prices stand in an object: of a side, and of a price itself; how deep prices may be nested: fixed values and a bound.
SIDE_KEYS, PRICE_KEYS, DEPTH = ("moneyLine", "moneyline", "decimal", "value", "odds"), ("decimal", "decimalOdds", "value", "moneyLine", "american"), 4


def is_object(text: Column) -> Column:
    return F.substring(F.ltrim(text), 1, 1) == "{"


def coerced(text: Column) -> Column:
    """The price of JSON text: of an object the first of PRICE_KEYS that is present decides, whatever it holds; else ``price``.

    Objects are followed DEPTH levels deep; what lies deeper has no price.
    """
    def inside(t: Column) -> Column:
        keys, chosen = F.json_object_keys(t), F.lit(None).cast("string")
        for k in reversed(PRICE_KEYS):
            chosen = F.when(F.array_contains(keys, k), F.get_json_object(t, f"$.{k}")).otherwise(chosen)
        return F.when(is_object(t), chosen).otherwise(t)

    for _ in range(DEPTH):
        text = once(text, inside)
    return once(text, lambda t: F.when(~is_object(t), price(t)))


def boxed_price(text: Column) -> Column:
    """The price of a side as JSON text: of an object the first of SIDE_KEYS that has a price, else that of the text itself."""
    return F.when(is_object(text), F.coalesce(*(coerced(F.get_json_object(text, f"$.{k}")) for k in SIDE_KEYS))).otherwise(price(text))


def half_line(v: Column) -> Column:
    """A totals line as text if it is no whole number, else null."""
    return F.when(v % 1 != 0, v.cast("string"))


def parse_quotes(quotes: DataFrame) -> DataFrame:
    """Up to five priced rows of each quote (match_id, provider, home, draw, away, total, over, under as text).

    Quotes without a provider are dropped, and so are unpriced selections.
    """
    line = half_line(F.col("total").try_cast("double"))
    row = lambda market, selection, at, source, on=None: F.struct(F.lit(market).alias("market"), F.lit(selection).alias("selection"), at.alias("line"), (price(F.col(source)) if on is None else F.when(on, price(F.col(source)))).alias("decimal_odds"))
    rows = [row("1x2", s, F.lit(""), s) for s in ("home", "draw", "away")] + [row("totals", s, F.coalesce(line, F.lit("")), s, line.isNotNull()) for s in ("over", "under")]
    out = quotes.where("provider is not null and provider <> ''").select("match_id", "provider", F.explode(F.filter(F.array(*rows), lambda r: r["decimal_odds"].isNotNull())).alias("r"))
    return out.select("match_id", "provider", "r.*")


#: The parts of a provider's entry that are read, objects as JSON text.
PAYLOAD = "items array<struct<provider: struct<id: string, name: string>, homeTeamOdds: string, awayTeamOdds: string, drawOdds: string, overUnder: string, overOdds: string, underOdds: string, bothTeamsToScoreOdds: string>>"


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Up to seven priced rows of each provider entry of (match_id, payload as JSON text); entries without a provider id are dropped.

    Returns match_id, provider, provider_name, market, selection, line, decimal_odds, raw, the prices as read, and any other
    columns of the payloads.
    """
    more = [c for c in payloads.columns if c not in ("match_id", "payload")]
    items = payloads.select("match_id", *more, F.explode(F.from_json("payload", PAYLOAD)["items"]).alias("i")).where("i.provider.id <> ''")
    line = half_line(F.col("i.overUnder").try_cast("double"))
    row = lambda market, selection, odds, at=None: F.struct(F.lit(market).alias("market"), F.lit(selection).alias("selection"), (F.lit("") if at is None else at).alias("line"), odds.alias("decimal_odds"))
    three = [row("1x2", s, boxed_price(F.col(f"i.{c}"))) for s, c in (("home", "homeTeamOdds"), ("away", "awayTeamOdds"), ("draw", "drawOdds"))]
    two = [row("totals", s, F.when(line.isNotNull(), coerced(F.col(f"i.{s}Odds"))), F.coalesce(line, F.lit(""))) for s in ("over", "under")]
    btts = [row("btts", s, coerced(F.get_json_object("i.bothTeamsToScoreOdds", f"$.{s}"))) for s in ("yes", "no")]
    rows = F.explode_outer(F.array(*three, *two, *btts)).alias("r")  # explode would compute all prices twice, for a filter on the size
    return items.select("match_id", *more, F.col("i.provider.id").alias("provider"), F.coalesce("i.provider.name", F.lit("")).alias("provider_name"), rows, F.to_json("i").alias("raw")).where("r.decimal_odds is not null").select("match_id", "provider", "provider_name", "r.*", "raw", *more)


def devig(odds: DataFrame) -> DataFrame:
    """Implied probabilities normalised within a provider's market, its overround and whether all outcomes are quoted."""
    w = Window.partitionBy(*GROUP)
    inverse = F.when(F.col("decimal_odds") > 0, 1 / F.col("decimal_odds")).otherwise(0.0)
    total, n = F.sum(inverse).over(w), F.count("*").over(w)
    return odds.select("*", total.alias("overround"), F.try_divide(inverse, total).alias("implied"), n.alias("quoted"), (n == F.when(F.col("market") == "1x2", 3).otherwise(2)).alias("complete"))


def kelly(p: Column, o: Column) -> Column:
    return F.when(o > 1, F.greatest((p * o - 1) / (o - 1), F.lit(0.0))).otherwise(0.0)


def value_bets(odds: DataFrame, model: DataFrame, edge: float = EDGE, share: float = KELLY_SHARE, cap: float = STAKE_CAP) -> DataFrame:
    """Prices whose model probability beats the market's by ``edge`` with a positive expected value.

    ``model`` has match_id, market, selection, line, probability and any columns to keep; probabilities are rounded to five
    decimals first.
    """
    p, o = F.round("probability", 5), F.col("decimal_odds")
    more = [c for c in model.columns if c not in ("match_id", "market", "selection", "line", "probability")]
    rows = devig(odds).where("quoted >= 2").join(model, ["match_id", "market", "selection", "line"])
    rows = rows.select(*more, "match_id", "provider", "market", "selection", "line", "decimal_odds", "implied", p.alias("p"), (p - F.col("implied")).alias("edge"), (p * o - 1).alias("ev"), kelly(p, o).alias("kelly"))
    return rows.where((F.col("edge") >= edge) & (F.col("ev") > 0)).withColumn("stake", F.round(F.least(F.col("kelly") * share, F.lit(cap)), 5))


def settled(market: Column, selection: Column, line: Column, hg: Column, ag: Column) -> Column:
    """Whether a selection won; null for unknown ones. A total equal to its line loses both ways."""
    total, at = hg + ag, line.try_cast("double")
    one = F.when(selection == "home", hg > ag).when(selection == "draw", hg == ag).when(selection == "away", hg < ag)
    both = (hg > 0) & (ag > 0)
    either = F.when(selection == "home_or_draw", hg >= ag).when(selection == "home_or_away", hg != ag).when(selection == "draw_or_away", hg <= ag)
    return (
        F.when(market == "1x2", one)
        .when(market == "double_chance", either)
        .when(market == "totals", F.when(selection == "over", total > at).when(selection == "under", total < at))
        .when(market == "btts", F.when(selection == "yes", both).when(selection == "no", ~both))
    )


def actual(hg: Column, ag: Column) -> Column:
    return F.when(hg > ag, "home").when(hg == ag, "draw").otherwise("away")


def scores(forecasts: DataFrame, by: list[str]) -> DataFrame:
    """Log loss, Brier score and accuracy of (home, draw, away, outcome) rows; equal chances count as the first."""
    hit = F.when(F.col("outcome") == "home", F.col("home")).when(F.col("outcome") == "draw", F.col("draw")).otherwise(F.col("away"))
    brier = sum((F.pow(F.col(o) - (F.col("outcome") == o).cast("double"), 2) for o in ("draw", "away")), F.pow(F.col("home") - (F.col("outcome") == "home").cast("double"), 2))
    best = F.when((F.col("home") >= F.col("draw")) & (F.col("home") >= F.col("away")), "home").when(F.col("draw") >= F.col("away"), "draw").otherwise("away")
    return forecasts.groupBy(*by).agg(F.count("*").alias("n"), F.avg(-F.log(F.greatest(hit, F.lit(LOSS_FLOOR)))).alias("log_loss"), F.avg(brier).alias("brier"), F.avg((best == F.col("outcome")).cast("double")).alias("accuracy"))


def calibration(forecasts: DataFrame, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Mean forecast and observed frequency in equal bins, by group if given; each row gives three forecasts."""
    by = by or []
    each = F.explode(F.array(*(F.struct(F.col(o).alias("p"), (F.col("outcome") == o).cast("double").alias("y")) for o in ("home", "draw", "away")))).alias("f")
    rows = forecasts.select(*by, each).select(*by, "f.p", "f.y", F.least(F.floor(F.col("f.p") * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    return rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("observed"))


def ledger(bets: DataFrame, by: str | list[str]) -> DataFrame:
    """Bankroll after each bet, its peak and drawdown, by running products over the bets in order.

    ``bets`` has match_id, kickoff, provider, market, selection, line, decimal_odds, ev, stake (a fraction) and won. The
    bets of a match are settled by expected value (five decimals), the largest first. The growth of a bet is
    1 + stake * (odds - 1) or 1 - stake, so sums of log growth replace a fold: within the days of ``by`` by a window, over
    days by another one with a row a day, so that no task holds the whole history of a group; drawdown is taken from logarithms,
    as a bankroll of many bets leaves the range of doubles.
    """
    by = [by] if isinstance(by, str) else by
    order = ["kickoff", "match_id", "provider", "market", "selection", "line"]
    growth = F.when(F.col("won"), 1 + F.col("stake") * (F.col("decimal_odds") - 1)).otherwise(1 - F.col("stake"))
    w = Window.partitionBy(*by, "_day").orderBy(*order[:2], F.round("ev", 5).desc(), *order[2:]).rowsBetween(Window.unboundedPreceding, 0)
    rows = bets.where("won is not null and stake > 0").withColumns({"_day": F.to_date("kickoff"), "_g": F.log(growth)})
    rows = rows.withColumn("_sum", F.sum("_g").over(w)).withColumn("_top", F.max("_sum").over(w))
    before = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*by, "_day").agg(F.sum("_g").alias("_all"), F.max("_sum").alias("_most")).withColumn("_base", F.coalesce(F.sum("_all").over(before), F.lit(0.0)))
    days = days.select(*by, "_day", "_base", F.greatest(F.lit(0.0), F.max(F.col("_base") + F.col("_most")).over(before)).alias("_peak"))
    rows = rows.join(days, [*by, "_day"]).withColumn("log_bankroll", F.col("_base") + F.col("_sum"))
    rows = rows.withColumn("_log_peak", F.greatest(F.col("_peak"), F.col("_base") + F.col("_top")))
    rows = rows.withColumns({"bankroll": F.exp("log_bankroll"), "peak": F.exp("_log_peak"), "drawdown": 1 - F.exp(F.col("log_bankroll") - F.col("_log_peak"))})
    return rows.select(*by, *order, "decimal_odds", "ev", "stake", "won", "log_bankroll", "bankroll", "peak", "drawdown", F.exp(F.col("log_bankroll") - F.col("_g")).alias("bankroll_before"))


def ledger_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """What the bets of a ledger came to, by group: bets, wins, hit_rate, staked, profit, yield, the yield of level stakes with its
    standard error and t statistic and whether that is at least 2, final_bankroll, growth, max_drawdown; of four decimals (t of two)."""
    stake = F.col("stake") * F.col("bankroll_before")
    last = F.max_by("bankroll", F.struct("kickoff", "match_id", -F.round("ev", 5), "provider", "market", "selection", "line"))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("bets"), F.count(F.when(F.col("won"), 1)).alias("wins"), F.sum(stake).alias("_staked"), F.sum(F.when(F.col("won"), stake * F.col("decimal_odds")).otherwise(0.0)).alias("_returned"),
        last.alias("_bankroll"), F.greatest(F.max("drawdown"), F.lit(0.0)).alias("_drawdown"),
    )
    profit, four = F.col("_returned") - F.col("_staked"), lambda x, name: F.round(x, 4).alias(name)
    flat = flat_yield(rows, by).select(*by, four(F.col("yield"), "flat_stake_yield"), four(F.col("stderr"), "flat_yield_stderr"), F.round("t", 2).alias("flat_yield_t_stat"))
    out = out.join(flat, by).withColumn("distinguishable_from_zero", F.coalesce(F.abs("flat_yield_t_stat") >= 2, F.lit(False)))
    return out.select(
        *by, "bets", "wins", four(F.col("wins") / F.col("bets"), "hit_rate"), four(F.col("_staked"), "staked"), four(profit, "profit"), four(F.try_divide(profit, F.col("_staked")), "yield"), "flat_stake_yield",
        "flat_yield_stderr", "flat_yield_t_stat", "distinguishable_from_zero", four(F.col("_bankroll"), "final_bankroll"), four(F.col("_bankroll") - 1, "growth"), four(F.col("_drawdown"), "max_drawdown"),
    )


def flat_yield(bets: DataFrame, by: str | list[str]) -> DataFrame:
    """Mean return of one unit a bet, its standard error and t statistic."""
    by = [by] if isinstance(by, str) else by
    gain = F.when(F.col("won"), F.col("decimal_odds") - 1).otherwise(-1.0)
    out = bets.where("won is not null").groupBy(*by).agg(F.count("*").alias("bets"), F.avg(gain).alias("yield"), F.stddev_samp(gain).alias("sd"))
    error = F.col("sd") / F.sqrt("bets")
    return out.select(*by, "bets", "yield", error.alias("stderr"), F.try_divide(F.col("yield"), error).alias("t"))


def consensus(odds: DataFrame, preferred: str = "fd-avg") -> DataFrame:
    """The 1x2 market's probabilities of each match (home, draw, away), from one provider that quotes all three.

    That is the preferred one if it does, else the first by name. Matches without such a provider have no row.
    """
    full = devig(odds.where("market = '1x2'")).where("complete")
    wide = full.groupBy("match_id", "provider").agg(*(F.max(F.when(F.col("selection") == s, F.col("implied"))).alias(s) for s in ("home", "draw", "away"))).dropna()
    best = F.min_by(F.struct("provider", "home", "draw", "away"), F.struct(F.col("provider") != preferred, "provider"))
    return wide.groupBy("match_id").agg(best.alias("m")).select("match_id", "m.*")


def against_market(forecasts: DataFrame, market: DataFrame, by: list[str]) -> DataFrame:
    """Model and market scored on the matches that both cover: log losses of four decimals, their difference, who is better.

    ``forecasts`` has match_id, home, draw, away, outcome and the columns of ``by``; ``market`` match_id, home, draw, away.
    """
    both = forecasts.join(market.select("match_id", *(F.col(s).alias(f"_{s}") for s in ("home", "draw", "away"))), "match_id")
    model = scores(both, by).select(*by, F.col("n").alias("matches"), F.round("log_loss", 4).alias("model_log_loss"), "brier")
    priced = scores(both.select(*by, "outcome", *(F.col(f"_{s}").alias(s) for s in ("home", "draw", "away"))), by)
    out = model.join(priced.select(*by, F.round("log_loss", 4).alias("market_log_loss"), F.col("brier").alias("market_brier")), by)
    delta = F.round(F.col("model_log_loss") - F.col("market_log_loss"), 4)
    return out.withColumns({"log_loss_delta": delta, "beats_market": delta < 0})


def market_calibration(forecasts: DataFrame, market: DataFrame, by: list[str] | None = None, bins: int = 10) -> DataFrame:
    """The calibration of the market's own probabilities, on the matches that forecasts and market both cover."""
    both = forecasts.select("match_id", "outcome", *(by or [])).join(market.select("match_id", "home", "draw", "away"), "match_id")
    return calibration(both, bins, by)
