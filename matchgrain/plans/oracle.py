"""DuckDB SQL for the registered queries, built on common table expressions for the match tables."""

from __future__ import annotations

GOALS = "case when value < 20 then 0 when value < 45 then 1 when value < 75 then 2 when value < 120 then 3 else 4 end"


def base(team: str) -> str:
    return f"""
sides as (select event_id // 2 as match_id, {team} as team_id, event_id % 2 as away, {GOALS} as goals, ts, event_type, json_extract_string(props, '$.k')::int as k from events),
matches as (select h.match_id, h.event_type as league, h.ts as kickoff, case when h.k % 10 = 0 then 'scheduled' else 'final' end as status,
  h.team_id as home_id, a.team_id as away_id, h.goals as home_score, a.goals as away_score
  from sides h join sides a on h.match_id = a.match_id and h.away = 0 and a.away = 1 where h.team_id <> a.team_id),
finals as (select * from matches where status = 'final'),
both_sides as (select match_id, league, status, kickoff, home_id as team_id, away_id as opponent_id, 'home' as side, home_score as scored, away_score as conceded from matches
  union all select match_id, league, status, kickoff, away_id, home_id, 'away', away_score, home_score from matches),
games as (select * exclude (status), case when scored > conceded then 'win' when scored < conceded then 'loss' else 'draw' end as result,
  case when scored > conceded then 3 when scored = conceded then 1 else 0 end as points from both_sides where status = 'final'),
ranked as (select *, row_number() over (partition by team_id order by kickoff desc, match_id desc) as rn from games)"""


USERS, CLUBS = base("user_id"), base("user_id % 20")

#: The rows of league history that are kept, with the slug of their league.
LEAGUE_HISTORY = """with g as (select event_id as n, ts, 'Team ' || event_id as home, 'Side ' || user_id as away, case event_id % 3 when 0 then 'eng.1' when 1 then 'ita.1' else 'fd.zz' end as league from events where event_id % 13 > 0 and event_id % 17 > 0),
h as (select *, 'fd' || substr(sha1(league || '|' || strftime(ts, '%Y-%m-%d') || '|' || home || '|' || away), 1, 20) as event_id from g)"""

GRID = """
rates as (select match_id, (home_id * 7 + 10) % 23 / 10.0::double + 0.3::double as lam, (away_id * 5 + 3) % 19 / 10.0::double + 0.2::double as mu, -0.1::double as rho from matches where status = 'scheduled'),
cells as (select match_id, h.g::int as hg, a.g::int as ag, greatest(exp(-lam) * pow(lam, h.g) / factorial(h.g::int) * exp(-mu) * pow(mu, a.g) / factorial(a.g::int)
  * case when h.g = 0 and a.g = 0 then 1 - lam * mu * rho when h.g = 0 and a.g = 1 then 1 + lam * rho when h.g = 1 and a.g = 0 then 1 + mu * rho when h.g = 1 and a.g = 1 then 1 - rho else 1.0 end, 0) as q
  from rates, range(11) h(g), range(11) a(g)),
grid as (select match_id, hg, ag, q / sum(q) over (partition by match_id) as p from cells)"""

ODDS = """
picks(market, selection, line, k) as (values ('1x2', 'home', '', 0), ('1x2', 'draw', '', 1), ('1x2', 'away', '', 2), ('totals', 'over', '2.5', 0), ('totals', 'under', '2.5', 1)),
odds as (select match_id, provider, market, selection, line, 1.5::double + (match_id * 37 + k * 101 + i * 13) % 500 / 100.0::double as decimal_odds
  from matches, picks, (values ('fd-avg', 0), ('fd-max', 1)) p(provider, i)),
devig as (select *, sum(1 / decimal_odds) over g as overround, 1 / decimal_odds / sum(1 / decimal_odds) over g as implied, count(*) over g as quoted from odds window g as (partition by match_id, provider, market, line))"""

BETS = (
    ODDS
    + """,
priced as (select d.*, round((match_id * 13 + length(selection) * 29) % 60 / 100.0::double + 0.1::double, 5) as p from devig d),
valued as (select *, p - implied as edge, p * decimal_odds - 1 as ev, round(least(greatest((p * decimal_odds - 1) / (decimal_odds - 1), 0) * 0.25, 0.05), 5) as stake from priced),
bets as (select v.*, league, kickoff, case when market = '1x2' then case selection when 'home' then home_score > away_score when 'draw' then home_score = away_score else home_score < away_score end
  when selection = 'over' then home_score + away_score > line::double else home_score + away_score < try_cast(line as double) end as won
  from valued v join finals using (match_id) where edge >= 0.05 and ev > 0)"""
)

FORECASTS = (
    ODDS
    + """,
forecasts as (select league, max(implied) filter (selection = 'home') as home, max(implied) filter (selection = 'draw') as draw, max(implied) filter (selection = 'away') as away,
  any_value(case when home_score > away_score then 'home' when home_score = away_score then 'draw' else 'away' end) as outcome
  from devig join finals using (match_id) where market = '1x2' and provider = 'fd-avg' group by match_id, league)"""
)

#: Matches with the number of the fit in force, every five matches, and the matches before each fit under the fit's name.
PLANNED = """
counted as (select *, count(*) over (partition by league order by epoch_us(kickoff) range between unbounded preceding and 1 preceding) as before from finals),
planned as (select *, case when before >= 20 then (sum((before >= 20)::int) over (partition by league order by kickoff, match_id rows unbounded preceding) - 1)::bigint // 5 end as point from counted),
anchors as (select league, point, min(kickoff) as anchor from planned where point is not null group by all)"""
HISTORY = "select f.* exclude (league), f.league || '#' || point as league, exp(-ln(2) / 10 * (epoch_us(anchor) - epoch_us(kickoff)) / 86400000000.0) as w from finals f join anchors x on f.league = x.league and f.kickoff < x.anchor"

#: The error function as 7.1.26 of Abramowitz and Stegun has it.
ERF = "(((((1.061405429::double * t - 1.453152027::double) * t) + 1.421413741::double) * t - 0.284496736::double) * t + 0.254829592::double) * t"

RECORD = """count(*) as played, count(*) filter (result = 'win') as wins, count(*) filter (result = 'draw') as draws, count(*) filter (result = 'loss') as losses,
  sum(scored)::bigint as scored, sum(conceded)::bigint as conceded, avg(scored) as avg_scored, avg(conceded) as avg_conceded,
  (count(*) filter (result = 'win') + 0.5::double * count(*) filter (result = 'draw')) / count(*) as win_pct, sum(points)::bigint as points"""


AGED = "select f.*, exp(-ln(2) / 10 * (epoch_us(max(kickoff) over (partition by league)) - epoch_us(kickoff)) / 86400000000.0) as w from finals f"


#: The last ten games of each team in the league strictly before each fixture.
LAST_GAMES = """last_games as (select f.match_id, f.league, f.kickoff, f.team_id, g.match_id as g, g.kickoff as played_at, g.opponent_id as met_id, g.side as at_side, g.scored, g.conceded, g.result, g.points,
  row_number() over (partition by f.match_id, f.team_id order by g.kickoff desc, g.match_id desc) as rn
  from both_sides f join games g on g.league = f.league and g.team_id = f.team_id and g.kickoff < f.kickoff qualify rn <= 10)"""
FORM_COLUMNS = [f"{split}_{c}" for split in ("overall", "home", "away") for c in ("played", "wins", "draws", "losses", "scored", "conceded", "avg_scored", "avg_conceded", "win_pct")]


def form_record(split: str, on: str) -> str:
    n = f"count(g) filter ({on})"
    kinds = ", ".join(f"(count(*) filter ({on} and result = '{k}'))::int as {split}_{c}" for k, c in (("win", "wins"), ("draw", "draws"), ("loss", "losses")))
    goals = ", ".join(f"coalesce(sum(l.{c}) filter ({on}), 0)::bigint as {split}_{c}, printf('%.2f', (coalesce(sum(l.{c}) filter ({on}) / {n}::double, 0))::double)::double as {split}_avg_{c}" for c in ("scored", "conceded"))
    return f"({n})::int as {split}_played, {kinds}, {goals}, printf('%.3f', (coalesce((count(*) filter ({on} and result = 'win') + 0.5::double * count(*) filter ({on} and result = 'draw')) / nullif({n}, 0), 0))::double)::double as {split}_win_pct"


FORMS = f"""other as (select l.match_id, l.team_id, f.result as latest, coalesce(min(l.rn) filter (l.result <> f.result) - 1, max(l.rn)) as run from last_games l join last_games f using (match_id, team_id) where f.rn = 1 group by all),
forms as (select s.match_id, s.team_id, s.side, {form_record("overall", "true")}, {form_record("home", "at_side = 'home'")}, {form_record("away", "at_side = 'away'")},
  printf('%.3f', (coalesce(avg(points), 0))::double)::double as points_per_game, coalesce(any_value(upper(latest[1]) || run), '') as streak
  from both_sides s left join last_games l using (match_id, team_id) left join other using (match_id, team_id) group by s.match_id, s.team_id, s.side)"""


def baseline_before(days: int = 0) -> str:
    within = f" and f.kickoff >= m.kickoff - interval {days} day" if days else ""
    return f"""latest as (select m.match_id, f.home_score as h, f.away_score as a from matches m join finals f on f.league = m.league and f.kickoff < m.kickoff{within} qualify row_number() over (partition by m.match_id order by f.kickoff desc, f.match_id desc) <= 200),
baselines as (select m.match_id, m.league, count(h) as sample, {", ".join(f"printf('%.2f', (coalesce(sum({x}) / count(h)::double, 0))::double)::double as {c}" for c, x in (("avg_home", "h"), ("avg_away", "a"), ("home_advantage", "h - a")))},
  case when count(h) * sum((h - a) * (h - a)) > sum(h - a) * sum(h - a) then printf('%.2f', (sqrt((count(h) * sum((h - a) * (h - a)) - sum(h - a) * sum(h - a))::double / (count(h) * count(h))))::double)::double else 10.0::double end as margin_sd,
  printf('%.3f', (coalesce(count(*) filter (h = a) / nullif(count(h), 0)::double, 0))::double)::double as draw_rate from matches m left join latest using (match_id) group by m.match_id, m.league)"""


#: Rest and congestion of each team before each fixture, from final matches of the league.
CONTEXT = """calendar as (select match_id, league, team_id, side, epoch_us(kickoff) as us, status = 'final' as fact from both_sides),
around as (select match_id, team_id, side, (select max(c.us) from calendar c where c.fact and c.league = f.league and c.team_id = f.team_id and c.us < f.us) as last, us,
  (select count(*) from calendar c where c.fact and c.league = f.league and c.team_id = f.team_id and c.us < f.us and c.us >= f.us - 1209600000000) as recent from calendar f),
contexts as (select match_id, team_id, side, floor((us - last) / 86400000000.0)::int as rest_days, recent, recent >= 4 as congested from around)"""

#: Absences of the clubs.
ABSENCES = """athletes as (select ['view', 'signup', 'click', 'error', 'purchase'][(c_nationkey % 5 + 1)::int] as league, c_custkey % 20 as team_id, c_custkey as id, c_nationkey % 5 as k, ['out', 'ir', 'doubtful', 'questionable', 'day_to_day', 'other'][(c_custkey % 6 + 1)::int] as status from customer),
seasons as (select league, id, year(o_orderdate) as season, count(*) as n from orders join athletes on o_custkey = id where id % 4 > 0 group by all),
shares as (select league, id, least(n / most::double, 1.0) as share from (select *, max(n) over (partition by league, season) as most, row_number() over (partition by league, id order by season desc) as rn from seasons) where rn = 1),
absences as (select league, team_id, count(*) as n, sum(case status when 'out' then 1.0 when 'ir' then 1.0 when 'doubtful' then 0.75 when 'questionable' then 0.4 when 'day_to_day' then 0.3 else 0.2 end::double * coalesce(share, 1.0)) as burden, count(share) as known
  from athletes left join shares using (league, id) where id % 3 > 0 group by all)"""


def insights(clubs: str, strength: str, meetings: str, projection: str) -> str:
    """The sentences, from the SQL of the parts they speak of."""
    shown = "printf('%.2f', x)::double".replace
    side = lambda s: f"""case when {s}.overall_played = 0 then ['No completed games on record for Team ' || {s}.team_id || '.'] else [
    'T' || {s}.team_id || ' last ' || {s}.overall_played || ': ' || {s}.overall_wins || '-' || {s}.overall_draws || '-' || {s}.overall_losses || ' (' || {s}.overall_avg_scored || ' scored / ' || {s}.overall_avg_conceded || ' conceded per game).',
    case when substr({s}.streak, 2)::int >= 3 then 'T' || {s}.team_id || ' is on a ' || {s}.streak || ' run.' end,
    case when {s}.m_games >= 3 and abs({s}.gap) >= 0.5 then 'T' || {s}.team_id || ' is running ' || abs({shown("x", f"{s}.gap")}) || ' points per game ' || case when {s}.gap > 0 then 'above' else 'below' end || ' its own ' || {s}.overall_played || '-game average over the last ' || {s}.m_games || ' — a short sample, so treat it as a hint, not a trend.' end,
    case when {s}.strength >= 0.3 then 'T' || {s}.team_id || ' faced stronger-than-average opponents (' || printf('%+.2f', {s}.strength) || ' goal difference per game), so that record flatters it less than it looks.'
      when {s}.strength <= -0.3 then 'T' || {s}.team_id || ' faced weaker-than-average opponents (' || printf('%+.2f', {s}.strength) || ' goal difference per game).' end] end"""  # noqa: E731
    around = lambda s: f"""[case when {s}.congested then 'T' || {s}.team_id || ' has played ' || {s}.recent || ' matches in 14 days.' end, case when {s}.rest_days <= 3 then 'T' || {s}.team_id || ' had only ' || {s}.rest_days || ' days'' rest.' end,
    case when {s}.absent > 0 then 'T' || {s}.team_id || ' has ' || {s}.absent || ' listed absence' || case when {s}.absent > 1 then 's' else '' end || ', weighted ' || printf('%.1f', round({s}.burden, 9)) || case when {s}.known > 0 then '' else ' (playing time unknown)' end || '.' end]"""  # noqa: E731
    return f"""{clubs}, {LAST_GAMES}, {FORMS}, {CONTEXT}, {ABSENCES},
trend as (select match_id, team_id, (count(g) filter (rn <= 5))::int as m_games, avg(points) filter (rn <= 5) - avg(points) as gap from last_games group by all),
tough as (select match_id, team_id, printf('%.3f', round(strength, 9))::double as strength from ({strength})), met as ({meetings}), projected as ({projection}),
teams as (select f.*, m_games, gap, strength, rest_days, recent, congested, a.n as absent, burden, known from forms f join both_sides b using (match_id, team_id) left join trend using (match_id, team_id) left join tough using (match_id, team_id)
  join contexts using (match_id, team_id) left join absences a on a.league = b.league and a.team_id = f.team_id),
notes as (select m.match_id, list_filter(list_concat({side("h")}, {side("a")}, {around("h")}, {around("a")}, [
  case when met.played = 0 then 'No previous meetings on record between these teams.' else 'Head-to-head over ' || met.played || ' meeting' || case when met.played > 1 then 's' else '' end || ': T' || h.team_id || ' ' || met.home_wins || ' - ' || met.away_wins || ' T' || a.team_id || case when met.draws > 0 then ' (' || met.draws || ' drawn)' else '' end || ', ' || met.avg_total_points || ' combined points per game.' end,
  'Model leans T' || case when p.margin >= 0 then h.team_id else a.team_id end || ' by ' || abs(p.margin) || ' (' || p.expected_home || ' - ' || p.expected_away || ' projected).',
  'Too little league history to fit the scoreline model, so this projection comes from the form fallback, which prices every draw in the league at the same rate. Use /forecast/ once more matches are stored.']), lambda x: x is not null) as said
  from matches m join teams h on h.match_id = m.match_id and h.side = 'home' join teams a on a.match_id = m.match_id and a.side = 'away' join met on met.match_id = m.match_id join projected p on p.match_id = m.match_id)
select match_id, generate_subscripts(said, 1)::int as place, unnest(said) as insight from notes"""


#: Teams, leagues and sports of lists and details.
CATALOG = """leagues as (select n_nationkey as league_id, lower(replace(n_name, ' ', '-')) as league_slug, n_name as league_name, lower(replace(r_name, ' ', '-')) as sport_slug from nation join region on r_regionkey = n_regionkey),
teams as (select s_suppkey as id, 'S' || s_suppkey as abbreviation, s_name as display_name, s_acctbal > 0 as is_active, s_nationkey as league_id from supplier)"""


def catalog(clubs: str) -> dict[str, str]:
    return {
        "prj02_team_list": f"with {CATALOG} select id, abbreviation, display_name, is_active, league_slug, sport_slug from teams join leagues using (league_id) where is_active",
        "prj02_team_detail": f"with {CATALOG} select id, display_name, is_active, league_id, league_name, sport_slug from teams join leagues using (league_id) where is_active",
        "jn01_event_detail": f"""{clubs}, {CATALOG}, c as (select match_id, 0 as ord, 'home' as side, home_id + 1 as team, home_score as score from matches union all select match_id, 1, 'away', away_id + 1, away_score from matches),
j as (select match_id, string_agg(side || ':' || abbreviation || ':' || score, ',' order by ord) as competitors from c join teams on id = team group by match_id)
select m.match_id as id, status, league_slug, sport_slug, coalesce(competitors, '') as competitors from matches m join leagues on league_id = m.match_id % 25 left join j using (match_id)""",
        "prj05_next_of_league": f"{clubs}, {CATALOG} select match_id as id, league_slug, sport_slug from matches join leagues on league_id = match_id % 25 where league_slug = 'nation_2' and sport_slug = 'asia' and status = 'scheduled' order by kickoff, match_id limit 50",
        "flt16_fields": f"with {USERS} select match_id, league, status from matches where league = 'click' and status = 'final'",
        "mod01_observations": f"{clubs} select match_id, league, home_id, away_id, home_score, away_score from finals where kickoff < timestamp '2024-01-15' qualify row_number() over (partition by league order by kickoff desc, match_id desc) <= 50",
    }


def fit_blocks(n: int, aged: str) -> str:
    """The rating fit as a chain of common table expressions, one block for each step of a sweep."""
    out = f"""
aged as ({aged}),
pairs as (select league, home_id, away_id, sum(w) as w, sum(w * home_score) as hg, sum(w * away_score) as ag, count(*) as n from aged group by all),
sums as (select league, team_id, sum(s) as s, sum(c) as c from (select league, home_id as team_id, hg as s, ag as c from pairs union all select league, away_id, ag, hg from pairs) group by all),
size as (select league, sum(n)::bigint as matches from pairs group by league),
r0 as (select league, team_id, 1.0::double as att, 1.0::double as def, 1.0::double as ha from sums)"""
    for i in range(1, n + 1):
        r = f"r{i - 1}"
        out += f""",
da{i} as (select league, team_id, sum(d) as d from (select p.league, p.home_id as team_id, w * o.def * o.ha as d from pairs p join {r} o on o.league = p.league and o.team_id = p.away_id
  union all select p.league, p.away_id, w * o.def from pairs p join {r} o on o.league = p.league and o.team_id = p.home_id) group by all),
aa{i} as (select r.league, r.team_id, greatest(s / d, 1e-6) as att, r.def, r.ha from {r} r join sums using (league, team_id) join da{i} using (league, team_id)),
an{i} as (select league, team_id, att / exp(avg(ln(att)) over (partition by league)) as att, ha from aa{i}),
dd{i} as (select league, team_id, sum(d) as d from (select p.league, p.away_id as team_id, w * o.att * o.ha as d from pairs p join an{i} o on o.league = p.league and o.team_id = p.home_id
  union all select p.league, p.home_id, w * o.att from pairs p join an{i} o on o.league = p.league and o.team_id = p.away_id) group by all),
ad{i} as (select a.league, a.team_id, a.att, greatest(c / d, 1e-6) as def from an{i} a join sums using (league, team_id) join dd{i} using (league, team_id)),
hh{i} as (select p.league, greatest(sum(hg) / sum(w * h.att * a.def), 1e-6) as ha from pairs p join ad{i} h on h.league = p.league and h.team_id = p.home_id join ad{i} a on a.league = p.league and a.team_id = p.away_id group by p.league),
r{i} as (select a.league, a.team_id, a.att, a.def, h.ha from ad{i} a join hh{i} h using (league))"""
    return out


#: The low-score factor, and one refinement of the search for the likeliest correction.
TAU = "case when hg = 0 and ag = 0 then 1 - lam * mu * rho when hg = 0 and ag = 1 then 1 + lam * rho when hg = 1 and ag = 0 then 1 + mu * rho when hg = 1 and ag = 1 then 1 - rho else 1.0 end"
RHO_SQL = f""",
c{{r}} as (select league, lo, hi, (hi - lo) / 60 as step, i, lo + i * (hi - lo) / 60 as rho from b{{before}}, range(61) t(i)),
v{{r}} as (select league, i, any_value(rho) as rho, any_value(lo) as lo, any_value(hi) as hi, any_value(step) as step, sum(w * ln({TAU})) as v from c{{r}} join (select * from played where hg <= 1 and ag <= 1) using (league) group by league, i),
b{{r}} as (select league, greatest(lo, rho - step) as lo, least(hi, rho + step) as hi, rho from v{{r}} qualify row_number() over (partition by league order by v desc, i) = 1)"""


def fit_quality() -> str:
    """Three sweeps, the likeliest correction and the log-likelihood."""
    return f"""{fit_blocks(3, AGED)},
played as (select a.league, a.home_score as hg, a.away_score as ag, a.w, greatest(h.att * x.def * h.ha, 1e-6) as lam, greatest(x.att * h.def, 1e-6) as mu from aged a join r3 h on h.league = a.league and h.team_id = a.home_id join r3 x on x.league = a.league and x.team_id = a.away_id),
b0 as (select league, greatest(-0.3, max(-1 / lam), max(-1 / mu)) + 1e-6 as lo, least(0.3, min(1 / (lam * mu)), 1.0) - 1e-6 as hi, 0.0::double as rho from played group by league){"".join(RHO_SQL.format(r=r, before=r - 1) for r in range(1, 5))},
fitted as (select p.league, count(*) as n, sum(w) as effective, any_value(rho) as rho, sum(w * (hg * ln(lam) - lam - ln(factorial(hg)) + ag * ln(mu) - mu - ln(factorial(ag)) + ln({TAU}))) as ll from played p join b4 using (league) group by p.league)"""


def fit_sweeps(n: int) -> str:
    return fit_blocks(n, AGED) + f"""
select league, team_id, matches, round(att, 6) as attack, round(def, 6) as defence, round(ha, 6) as home_advantage from r{n} join size using (league) where matches >= 20"""


def sql() -> dict[str, str]:
    users, clubs = f"with {USERS}", f"with {CLUBS}"
    baseline = "count(*) as n, round(avg(home_score), 6) as avg_home, round(avg(away_score), 6) as avg_away, round(avg(home_score - away_score), 6) as home_advantage"
    number = "case when upper(trim({0})) in ('EVEN', 'EV') then 2.0::double when regexp_matches(trim({0}), '^[+-]?[0-9]+([.][0-9]+)?$') then case when try_cast({0} as double) > 1 and try_cast({0} as double) < 100 and trim({0})[1] <> '+' then try_cast({0} as double) when try_cast({0} as double) > 0 then 1 + try_cast({0} as double) / 100 when try_cast({0} as double) < 0 then 1 + 100 / abs(try_cast({0} as double)) end end"
    out = {
        "agg02_fixture_pivot": f"{users} select match_id, league, status, home_id, away_id, home_score, away_score from matches",
        "agg05_team_splits": f"""{users}, split as (select *, 'overall' as split from games union all select *, side from games)
select team_id, split, {RECORD}, sum(points) / count(*)::double as ppg, (sum(scored) - sum(conceded))::bigint as goal_diff from split group by team_id, split""",
        "agg06_grouping_sets": f"{users} select team_id, side, count(*) as played, sum(scored)::bigint as scored, sum(conceded)::bigint as conceded, sum(points)::bigint as points from games group by grouping sets ((team_id, side), (team_id), ())",
        "win01_last_n_form": f"{users} select team_id, match_id, rn::int as rn, result, scored, conceded from ranked where rn <= 10",
        "agg08_weighted_form": f"""{users}, w as (select *, exp(-ln(2) / 10 * (epoch_us(max(kickoff) over (partition by team_id)) - epoch_us(kickoff)) / 86400000000.0) as w from games)
select team_id, round(sum(w), 6) as effective_games, round(sum(w * points) / sum(w), 6) as w_points, round(sum(w * scored) / sum(w), 6) as w_scored, round(sum(w * conceded) / sum(w), 6) as w_conceded from w group by team_id""",
        "agg09_momentum": f"""{users} select team_id, count(*) as games, round(avg(points) filter (rn <= 5) - avg(points), 6) as d_points, round(avg(scored) filter (rn <= 5) - avg(scored), 6) as d_scored,
  round(avg(conceded) filter (rn <= 5) - avg(conceded), 6) as d_conceded from ranked where rn <= 10 group by team_id""",
        "agg11_opponent_strength": f"""{clubs}, span as (select league, team_id, min(kickoff) as since, max(kickoff) as until from games group by all),
rates as (select s.league, s.team_id, g.team_id as opponent_id, avg(g.scored - g.conceded) as rate from span s join games g on g.league = s.league and g.kickoff >= s.since and g.kickoff < s.until group by all)
select g.league, g.team_id, count(*) as rated_games, round(avg(rate), 6) as strength from games g join rates r on r.league = g.league and r.team_id = g.team_id and r.opponent_id = g.opponent_id group by g.league, g.team_id""",
        "agg12_streak": f"""{users}, latest as (select team_id, result as latest from ranked where rn = 1),
runs as (select team_id, latest, coalesce(min(rn) filter (result <> latest) - 1, max(rn))::int as length from ranked join latest using (team_id) group by all)
select team_id, latest, length, upper(latest[1]) || length as streak from runs""",
        "agg13_head_to_head": f"""{clubs}, met as (select least(home_id, away_id) as team_a, greatest(home_id, away_id) as team_b, case when home_id < away_id then home_score else away_score end as a,
  case when home_id < away_id then away_score else home_score end as b, row_number() over (partition by least(home_id, away_id), greatest(home_id, away_id) order by kickoff desc, match_id desc) as rn from finals)
select team_a, team_b, count(*) as played, count(*) filter (a > b) as a_wins, count(*) filter (a < b) as b_wins, count(*) filter (a = b) as draws, sum(a)::bigint as a_points, sum(b)::bigint as b_points, avg(a + b) as avg_total
from met where rn <= 10 group by team_a, team_b""",
        "agg14_league_baseline": f"""{users}, latest as (select * from finals qualify row_number() over (partition by league order by kickoff desc, match_id desc) <= 200)
select league, {baseline}, round(case when stddev_pop(home_score - away_score) > 0 then stddev_pop(home_score - away_score) else 10 end, 6) as margin_sd, round(avg((home_score = away_score)::int), 6) as draw_rate from latest group by league""",
        "win13_trailing_baseline": f"""{users}, m as (select *, epoch_us(kickoff) as us, status = 'final' as done from matches)
select match_id, league, count(*) filter (done) over w as n, round(avg(home_score) filter (done) over w, 6) as avg_home, round(avg(away_score) filter (done) over w, 6) as avg_away,
  round(avg(home_score - away_score) filter (done) over w, 6) as home_advantage, round(avg((home_score = away_score)::int) filter (done) over w, 6) as draw_rate
from m window w as (partition by league order by us range between 604800000000 preceding and 1 preceding)""",
        "agg15_rest_and_congestion": f"""{users}, a as (select team_id, match_id, epoch_us(kickoff) as us from both_sides),
b as (select *, max(us) over (partition by team_id order by us range between unbounded preceding and 1 preceding) as last, count(*) over (partition by team_id order by us range between 1209600000000 preceding and 1 preceding) as recent from a)
select team_id, match_id, greatest(floor((us - last) / 86400000000.0), 0)::int as rest_days, recent, recent >= 4 as congested from b""",
        "jn09_asof_previous_match": f"""{users}, f as (select team_id, match_id as fixture_id, kickoff from both_sides where status = 'scheduled'), k as (select *, kickoff + interval 1 microsecond as after from games)
select f.team_id, fixture_id, k.match_id, k.result from f asof left join k on f.team_id = k.team_id and f.kickoff >= k.after""",
        "agg18_appearance_share": """with s as (select c_nationkey as league, c_custkey as athlete_id, year(o_orderdate)::int as season, count(*) as n from orders join customer on o_custkey = c_custkey group by all)
select league, athlete_id, season, round(least(n / max(n) over (partition by league, season)::double, 1.0), 6) as importance from (select *, max(n) over (partition by league, season) as most, row_number() over (partition by league, athlete_id order by season desc) as rn from s) where rn = 1""".replace("n / max(n) over (partition by league, season)::double", "n / most::double"),
        "agg17_injury_burden": """with s as (select c_nationkey as league, c_custkey as athlete_id, year(o_orderdate) as season, count(*) as n from orders join customer on o_custkey = c_custkey group by all),
m as (select *, max(n) over (partition by league, season) as most, row_number() over (partition by league, athlete_id order by season desc) as rn from s),
i as (select c_nationkey as league, c_custkey % 50 as team_id, c_name as name, c_custkey as athlete_id, ['out', 'ir', 'doubtful', 'questionable', 'day_to_day', 'other'][(c_custkey % 6 + 1)::int] as status from customer),
x as (select i.*, least(n / most::double, 1.0) as share, case status when 'out' then 1.0 when 'ir' then 1.0 when 'doubtful' then 0.75 when 'questionable' then 0.4 when 'day_to_day' then 0.3 else 0.2 end as severity from i left join m on i.athlete_id = m.athlete_id and rn = 1),
y as (select *, severity * coalesce(share, 1.0) as weight, row_number() over (partition by league, team_id order by name, athlete_id) as place from x)
select league, team_id, string_agg(name, ',' order by weight desc, name) filter (place <= 10) as top, count(*) as absences, round(sum(severity * coalesce(share, 1.0)), 6) as burden, count(share) as known, """
        + ", ".join(f"count(*) filter (status = '{s}') as n_{s}" for s in ("out", "ir", "doubtful", "questionable", "day_to_day", "other"))
        + " from y group by league, team_id",
        "mod12_score_grid": f"{clubs}, {GRID} select match_id, hg, ag, round(p, 9) as p from grid",
        "mkt01_match_odds": f"""{clubs}, {GRID}, o as (select match_id, sum(p) filter (hg > ag) as home, sum(p) filter (hg = ag) as draw, sum(p) filter (hg < ag) as away from grid group by match_id)
select match_id, round(home, 7) as home, round(draw, 7) as draw, round(away, 7) as away, round(home + draw, 7) as home_draw, round(home + away, 7) as home_away, round(draw + away, 7) as draw_away from o""",
        "mkt03_totals": f"""{clubs}, {GRID}, t as (select match_id, line::double as line, sum(case when hg + ag > line then p else 0 end) as over_p, sum(p) filter (hg > 0 and ag > 0) as btts, sum(p * hg) as eh, sum(p * ag) as ea
  from grid, (values (0.5), (1.5), (2.5), (3.5), (4.5)) l(line) group by match_id, line)
select match_id, line, round(over_p, 7) as "over", round(1 - over_p, 7) as "under", round(btts, 7) as btts, round(eh + ea, 7) as exp_total, round(eh - ea, 7) as supremacy from t""",
        "mkt05_correct_score": f"{clubs}, {GRID}, r as (select match_id, hg, ag, round(p, 9) as p from grid) select match_id, hg, ag, p, row_number() over (partition by match_id order by p desc, hg, ag)::int as rank from r qualify rank <= 8",
        "mod09_fit_sweeps3": f"{clubs}, {fit_sweeps(3)}",
        "mkt07_fair_odds": f"""{clubs}, {GRID}, o as (select match_id, sum(p) filter (hg > ag) as home, sum(p) filter (hg = ag) as draw, sum(p) filter (hg < ag) as away from grid group by match_id)
select match_id, round(1 / home, 3) as fair_home, round(1 / draw, 3) as fair_draw, round(1 / away, 3) as fair_away, round(1 / (home + draw), 3) as fair_home_draw from o""",
        "bt04_walk_forward": f"""{clubs}, {PLANNED}, {fit_blocks(3, HISTORY)}
select match_id, p.league, before, point, case when h.att is not null and a.att is not null then round(greatest(h.att * a.def * h.ha, 1e-6), 6) end as lam, case when h.att is not null and a.att is not null then round(greatest(a.att * h.def, 1e-6), 6) end as mu,
  case when point is null then 'no_history' when h.att is null or a.att is null then 'unknown_team' end as skipped
from planned p left join r3 h on h.league = p.league || '#' || point and h.team_id = home_id left join r3 a on a.league = p.league || '#' || point and a.team_id = away_id""",
        "bt05_account": f"""{clubs}, {PLANNED}, strength as (select x.league, point, sum(exp(-ln(2) / 10 * (epoch_us(anchor) - epoch_us(kickoff)) / 86400000000.0)) as effective from finals f join anchors x on f.league = x.league and f.kickoff < anchor group by all),
seen as (select x.league, point, home_id as team_id from finals f join anchors x on f.league = x.league and f.kickoff < anchor union select x.league, point, away_id from finals f join anchors x on f.league = x.league and f.kickoff < anchor),
r as (select p.*, case when p.point is null then 'no_history' when h.team_id is null or a.team_id is null then 'unknown_team' end as skipped, effective from planned p
  left join strength s on s.league = p.league and s.point = p.point
  left join seen h on h.league = p.league and h.point = p.point and h.team_id = home_id left join seen a on a.league = p.league and a.point = p.point and a.team_id = away_id)
select league, count(*) filter (skipped is null) as scored, count(*) filter (skipped = 'no_history') as skipped_no_history, count(*) filter (skipped = 'unknown_team') as skipped_unknown_team, count(*) filter (skipped is null and effective < 60) as skipped_unreliable_fit, count(distinct point) as refits from r group by league""",
        "odd03_payload": f"""{clubs}, q as (select match_id, match_id as n, 1.5::double + match_id % 300 / 100.0::double as d from matches where match_id % 4 <> 0 and match_id % 13 <> 0),
u as (select match_id, '1x2' as market, 'home' as selection, '' as line, 1 + (n % 150 + 100) / 100.0::double as o from q
  union all select match_id, '1x2', 'away', '', d from q union all select match_id, '1x2', 'draw', '', (n % 89 + 1.5::double) from q
  union all select match_id, 'totals', 'over', '2.5', 1 + 100 / 110.0::double from q where n % 3 = 0 union all select match_id, 'totals', 'under', '2.5', 2.0::double from q where n % 3 = 0
  union all select match_id, 'btts', 'yes', '', 1.8::double from q where n % 2 = 0)
select match_id, 'p' || match_id % 3 as provider, 'name ' || match_id % 3 as provider_name, market, selection, line, round(o, 4) as decimal_odds from u where o between 1.001 and 1000
union all select match_id, 'q', '', market, selection, line, o from matches, (values ('1x2', 'home', '', 2.5::double), ('1x2', 'away', '', 3.25::double), ('totals', 'under', '3.5', 1.5::double)) v(market, selection, line, o) where match_id % 13 = 0""",
        "prjn01_projection": f"""{clubs}, {LAST_GAMES}, {FORMS}, {baseline_before()},
h as (select * from forms where side = 'home'), a as (select * from forms where side = 'away'),
e as (select m.match_id, m.league, m.home_id, m.away_id, b.*  exclude (match_id, league),
  case when h.home_played >= 3 then h.home_avg_scored when h.overall_played > 0 then h.overall_avg_scored end as hs, case when h.home_played >= 3 then h.home_avg_conceded when h.overall_played > 0 then h.overall_avg_conceded end as hc,
  case when a.away_played >= 3 then a.away_avg_scored when a.overall_played > 0 then a.overall_avg_scored end as s, case when a.away_played >= 3 then a.away_avg_conceded when a.overall_played > 0 then a.overall_avg_conceded end as c,
  case when h.home_played < 3 or a.away_played < 3 then home_advantage / 2 else 0.0::double end as edge, least(h.overall_played, a.overall_played) as g
  from matches m join h on h.match_id = m.match_id join a on a.match_id = m.match_id join baselines b on b.match_id = m.match_id),
x as (select *, greatest(coalesce((hs + c) / 2, hs, c, 0.0::double) + edge, 0) as eh, greatest(coalesce((s + hc) / 2, s, hc, 0.0::double) - edge, 0) as ea from e),
y as (select *, printf('%.2f', (eh - ea)::double)::double as margin from x),
z as (select *, abs(margin / margin_sd) / sqrt(2) as z, 1 / (1 + 0.3275911::double * abs(margin / margin_sd) / sqrt(2)) as t from y),
n as (select *, case when margin >= 0 then 1 - 0.5::double * {ERF} * exp(-z * z) else 0.5::double * {ERF} * exp(-z * z) end as share from z),
p as (select *, printf('%.4f', ((1 - draw_rate) * share)::double)::double as h, printf('%.4f', (draw_rate)::double)::double as d, printf('%.4f', ((1 - draw_rate) * (1 - share))::double)::double as w from n)
select match_id, league, home_id, away_id, printf('%.2f', (eh)::double)::double as expected_home, printf('%.2f', (ea)::double)::double as expected_away, printf('%.2f', (eh + ea)::double)::double as expected_total, margin,
  case when h >= d and h >= w then printf('%.4f', (h + (1 - (h + d + w)))::double)::double else h end as home_win, case when (h < d or h < w) and d >= w then printf('%.4f', (d + (1 - (h + d + w)))::double)::double else d end as draw,
  case when (h < d or h < w) and d < w then printf('%.4f', (w + (1 - (h + d + w)))::double)::double else w end as away_win, case when g = 0 or sample = 0 then 'none' when g >= 4 then 'medium' else 'low' end as confidence from p""",
        "jn08_form_before": f"{clubs}, {LAST_GAMES}, {FORMS} select match_id, team_id, side, streak, points_per_game, {', '.join(FORM_COLUMNS)} from forms",
        "agg08_trend_before": f"""{clubs}, {LAST_GAMES}, v as (select *, exp(-ln(2) / 60 * (epoch_us(kickoff) - epoch_us(played_at)) / 86400000000.0) as w from last_games)
select s.match_id, s.team_id, round(coalesce(sum(w.w), 0), 6) as w_effective_games, {', '.join(f"round(coalesce(sum(w.w * w.{c}) / sum(w.w), 0), 6) as w_{c}, round(coalesce(avg(w.{c}) filter (rn <= 5), 0), 6) as m_{c}, round(coalesce(avg(w.{c}) filter (rn <= 5) - avg(w.{c}), 0), 6) as m_{c}_delta" for c in ("points", "scored", "conceded"))},
  (count(g) filter (rn <= 5))::int as m_games from both_sides s left join v w using (match_id, team_id) group by s.match_id, s.team_id""",
        "agg11_strength_before": f"""{clubs}, {LAST_GAMES}, span as (select match_id, team_id, any_value(league) as league, min(played_at) as since, any_value(kickoff) as until from last_games group by all),
rates as (select s.match_id, s.team_id, g.team_id as met_id, avg(g.scored - g.conceded) as rate from span s join games g on g.league = s.league and g.kickoff >= s.since and g.kickoff < s.until group by all),
of as (select l.match_id, l.team_id, count(*) as rated_games, avg(rate) as strength from last_games l join rates r using (match_id, team_id, met_id) group by all)
select s.match_id, s.team_id, coalesce(rated_games, 0) as rated_games, round(strength, 6) as strength from both_sides s left join of using (match_id, team_id)""",
        "agg13_meetings_before": f"""{clubs}, met as (select m.match_id, g.match_id as g, g.kickoff as met_at, case when g.home_id = m.home_id then g.home_score else g.away_score end as hs, case when g.home_id = m.home_id then g.away_score else g.home_score end as aws
  from matches m join finals g on g.league = m.league and g.kickoff < m.kickoff and least(g.home_id, g.away_id) = least(m.home_id, m.away_id) and greatest(g.home_id, g.away_id) = greatest(m.home_id, m.away_id)
  qualify row_number() over (partition by m.match_id order by g.kickoff desc, g.match_id desc) <= 10)
select m.match_id, m.league, m.home_id, m.away_id, count(g)::int as played, (count(*) filter (hs > aws))::int as home_wins, (count(*) filter (hs < aws))::int as away_wins, (count(*) filter (hs = aws))::int as draws,
  coalesce(sum(hs), 0)::bigint as home_points, coalesce(sum(aws), 0)::bigint as away_points, printf('%.2f', (coalesce(sum(hs + aws) / count(g)::double, 0))::double)::double as avg_total_points, max_by(g, met_at) as last_met
from matches m left join met using (match_id) group by all""",
        "agg14_baseline_before": f"{clubs}, {baseline_before()} select * from baselines",
        "agg14_baseline_window": f"{clubs}, {baseline_before(3)} select * from baselines",
        "odd05_parse_quotes": f"""{clubs}, q as (select match_id, match_id as n, case when match_id % 7 = 0 then '' else 'p' || match_id % 3 end as provider, (match_id % 400 - 200)::varchar as home,
  case when match_id % 5 = 0 then 'EVEN' else '+' || (match_id % 300 + 100) end as draw, case when match_id % 11 = 0 then 'OFF' else (match_id % 90 / 10.0::double)::varchar end as away,
  match_id % 4 + case when match_id % 2 = 0 then 0.5::double else 0.0::double end as total, '-110' as "over", ' 1.9 ' as "under" from matches where match_id % 7 <> 0),
u as (select match_id, provider, '1x2' as market, 'home' as selection, '' as line, {number.format("home")} as o from q
  union all select match_id, provider, '1x2', 'draw', '', {number.format("draw")} from q union all select match_id, provider, '1x2', 'away', '', {number.format("away")} from q
  union all select match_id, provider, 'totals', 'over', total::varchar, 1 + 100 / 110.0::double from q where total % 1 <> 0 union all select match_id, provider, 'totals', 'under', total::varchar, 1.9::double from q where total % 1 <> 0)
select match_id, provider, market, selection, line, round(o, 4) as decimal_odds from u where o between 1.001 and 1000""",
        "val02_devig": f"{clubs}, {ODDS} select match_id, provider, market, selection, line, round(overround, 8) as overround, round(implied, 8) as implied, quoted, quoted = case market when '1x2' then 3 else 2 end as complete from devig",
        "val05_value_bets": f"{clubs}, {BETS} select match_id, provider, market, selection, line, round(edge, 7) as edge, round(ev, 7) as ev, stake, won from bets",
        "bt03_ledger": f"""{clubs}, {BETS}, b as (select *, exp(sum(ln(case when won then 1 + 0.001::double * (decimal_odds - 1) else 1 - 0.001::double end)) over w) as bankroll from bets
  window w as (partition by league order by kickoff, match_id, provider, market, selection, line rows unbounded preceding)),
c as (select *, greatest(max(bankroll) over (partition by league order by kickoff, match_id, provider, market, selection, line rows unbounded preceding), 1.0) as peak from b)
select league, match_id, provider, market, selection, round(bankroll, 6) as bankroll, round(1 - bankroll / peak, 6) as drawdown from c""",
        "bt03_ledger_kelly": f"""{clubs}, {BETS}, b as (select *, sum(ln(case when won then 1 + stake * (decimal_odds - 1) else 1 - stake end)) over w as log_bankroll from bets where won is not null and stake > 0
  window w as (partition by league order by kickoff, match_id, round(ev, 5) desc, provider, market, selection, line rows unbounded preceding)),
c as (select *, greatest(max(log_bankroll) over (partition by league order by kickoff, match_id, round(ev, 5) desc, provider, market, selection, line rows unbounded preceding), 0) as peak from b)
select league, match_id, provider, market, selection, line, stake, round(log_bankroll, 6) as log_bankroll, round(peak - log_bankroll, 6) as log_drawdown from c""",
        "mod08_fit_quality": f"""{clubs}, {fit_quality()}
select league, (select count(distinct team_id) from r3 where r3.league = f.league) as teams, n as matches, round(rho, 4) as rho, round(effective, 2) as effective, round(ll, 3) as log_likelihood, false as reliable from fitted f where n >= 20""",
        "mod09_fit_by_sweeps": f"""{clubs}, {fit_quality()}
select r.league, team_id, n as matches, round(att, 6) as attack, round(def, 6) as defence, round(ha, 6) as home_advantage, round(rho, 4) as rho, round(ll, 3) as log_likelihood from r3 r join fitted f on r.league = f.league where n >= 20""",
        "agg25_flat_yield": f"""{clubs}, {BETS}, g as (select league, case when won then decimal_odds - 1 else -1.0 end as gain from bets)
select league, count(*) as bets, round(avg(gain), 6) as yield, round(stddev_samp(gain) / sqrt(count(*)), 6) as stderr, round(avg(gain) / (stddev_samp(gain) / sqrt(count(*))), 6) as t from g group by league""",
        "agg22_scores": f"""{clubs}, {FORECASTS} select league, count(*) as n, round(avg(-ln(greatest(case outcome when 'home' then home when 'draw' then draw else away end, 1e-15))), 6) as log_loss,
  round(avg(pow(home - (outcome = 'home')::int, 2) + pow(draw - (outcome = 'draw')::int, 2) + pow(away - (outcome = 'away')::int, 2)), 6) as brier,
  round(avg((outcome = case when home >= draw and home >= away then 'home' when draw >= away then 'draw' else 'away' end)::int), 6) as accuracy from forecasts group by league""",
        "agg24_calibration": f"""{clubs}, {FORECASTS}, f as (select home as p, (outcome = 'home')::int as y from forecasts union all select draw, (outcome = 'draw')::int from forecasts union all select away, (outcome = 'away')::int from forecasts)
select least(floor(p * 10), 9)::int as bin, count(*) as n, round(avg(p), 6) as predicted, round(avg(y), 6) as observed from f group by bin""",
        "flt07_team_semi": f"{users} select match_id, league, home_id, away_id from matches where home_id % 10 = 3 or away_id % 10 = 3",
        "flt08_search": """select p_partkey, p_name, p_type from part where (contains(lower(p_name), 'blue') or contains(lower(p_type), 'blue')) and (contains(lower(p_name), 'economy') or contains(lower(p_type), 'economy'))
union all select p_partkey, p_name, p_type from part where contains(lower(p_brand), 'brand#1')""",
        "flt10_page": "select c_custkey, c_name, c_acctbal from customer order by c_acctbal desc, c_custkey limit 25 offset 25",
        "snk02_merge": """with old as (select c_custkey, c_name, c_acctbal from customer where c_custkey % 3 <> 0), new as (select c_custkey, c_name, c_acctbal + 1 as c_acctbal from customer where c_custkey % 2 = 0)
select n.*, case when o.c_custkey is null then 'created' else 'updated' end as action from new n left join old o using (c_custkey) union all select o.*, 'kept' from old o anti join new using (c_custkey)""",
        "snk09_snapshot": "select s_suppkey, s_nationkey, s_acctbal from supplier where (s_nationkey < 5 and s_acctbal > 0) or s_nationkey not in (select s_nationkey from supplier where s_nationkey < 5 and s_acctbal > 0)",
        "snk05_scoreboard": """select cast(event_id as varchar) as event_id, strftime(case when event_id % 9 > 0 then ts else timestamp '2020-01-01' end, '%Y-%m-%d %H:%M') as day,
cast(year(case when event_id % 9 > 0 then ts else timestamp '2020-01-01' end) as integer) as season_year, 2 as season_type,
case when event_id % 6 = 0 or event_id % 4 = 2 then 'final' when event_id % 4 = 1 then 'in_progress' else 'scheduled' end as status, case when event_id % 6 = 0 then 'Final' else '' end as status_detail
from events where event_id % 11 > 0""",
        "snk07_competitors": """select cast(event_id as varchar) as event_id, cast(user_id + k as varchar) as team_id, case when k = 1 or event_id % 5 > 0 then 'home' else 'away' end as home_away, k as ord, 'team ' || (user_id + k) as display_name
from events, (values (0), (1)) as t(k) where event_id % 11 > 0""",
        "snk04_venues": "select distinct cast(user_id % 7 as varchar) as venue_id, 'ground' as name, '' as city, '' as state, 'USA' as country, true as indoor from events",
        "mkt08_summary": f"""{clubs}, {GRID}, r as (select match_id, hg, ag, round(p, 9) as p from grid),
o as (select match_id, sum(p) filter (hg > ag) as h, sum(p) filter (hg = ag) as d, sum(p) filter (hg < ag) as a, sum(p) filter (hg > 0 and ag > 0) as b from r group by match_id),
t as (select match_id, line, sum(case when hg + ag > line::double then p else 0 end) as o from r, (values ('0.5'), ('1.5'), ('2.5'), ('3.5'), ('4.5')) l(line) group by match_id, line),
u as (select match_id, '1x2' as market, '' as line, 'home' as selection, h as p from o union all select match_id, '1x2', '', 'draw', d from o union all select match_id, '1x2', '', 'away', a from o
  union all select match_id, 'double_chance', '', 'home_or_draw', h + d from o union all select match_id, 'double_chance', '', 'home_or_away', h + a from o union all select match_id, 'double_chance', '', 'draw_or_away', d + a from o
  union all select match_id, 'totals', line, 'over', o from t union all select match_id, 'totals', line, 'under', 1 - o from t union all select match_id, 'btts', '', 'yes', b from o union all select match_id, 'btts', '', 'no', 1 - b from o
  union all select * from (select match_id, 'correct_score', '', hg || '-' || ag, p from r qualify row_number() over (partition by match_id order by p desc, hg, ag) <= 8))
select match_id, market, line, selection, round(p, 5) as probability, round(1 / p, 3) as fair_odds from u""",
        "agg13_meetings": f"""{clubs} select least(home_id, away_id) as team_a, greatest(home_id, away_id) as team_b, match_id, home_id, away_id, home_score, away_score,
row_number() over (partition by least(home_id, away_id), greatest(home_id, away_id) order by kickoff desc, match_id desc)::int as rn from finals qualify rn <= 10""",
        "val06_consensus": f"""{clubs}, {ODDS}, q as (select match_id, provider, selection, 1 / decimal_odds as i from odds where market = '1x2' and not (match_id % 3 = 0 and provider = 'fd-avg' and selection = 'draw') and not (match_id % 6 = 0 and selection = 'away')),
w as (select match_id, provider, sum(i) filter (selection = 'home') / sum(i) as home, sum(i) filter (selection = 'draw') / sum(i) as draw, sum(i) filter (selection = 'away') / sum(i) as away from q group by all having count(*) = 3)
select match_id, provider, round(home, 7) as home, round(draw, 7) as draw, round(away, 7) as away from w qualify row_number() over (partition by match_id order by provider <> 'fd-avg', provider) = 1""",
        "agg23_market_comparison": f"""{clubs}, {ODDS}, w as (select match_id, max(implied) filter (selection = 'home') as mh, max(implied) filter (selection = 'draw') as md, max(implied) filter (selection = 'away') as ma
  from devig where market = '1x2' and provider = 'fd-avg' and match_id % 4 > 0 group by match_id),
f as (select match_id, league, (match_id % 5 + match_id % 3 + match_id % 4 + 3)::double as t, (home_score > away_score)::int as yh, (home_score = away_score)::int as yd, (home_score < away_score)::int as ya, mh, md, ma from finals join w using (match_id)),
s as (select *, (match_id % 5 + 1) / t as h, (match_id % 3 + 1) / t as d, (match_id % 4 + 1) / t as a from f),
l as (select league, count(*) as matches, round(avg(-ln(yh * h + yd * d + ya * a)), 4) as m, round(avg(-ln(yh * mh + yd * md + ya * ma)), 4) as k,
  round(avg(pow(h - yh, 2) + pow(d - yd, 2) + pow(a - ya, 2)), 6) as brier, round(avg(pow(mh - yh, 2) + pow(md - yd, 2) + pow(ma - ya, 2)), 6) as market_brier from s group by league)
select league, matches, m as model_log_loss, k as market_log_loss, brier, market_brier, round(m - k, 4) as log_loss_delta, round(m - k, 4) < 0 as beats_market from l""",
        "agg23_market_calibration": f"""{clubs}, {ODDS}, w as (select match_id, max(implied) filter (selection = 'home') as mh, max(implied) filter (selection = 'draw') as md, max(implied) filter (selection = 'away') as ma
  from devig where market = '1x2' and provider = 'fd-avg' and match_id % 4 > 0 group by match_id),
f as (select league, unnest([mh, md, ma]) as p, unnest([(home_score > away_score)::int, (home_score = away_score)::int, (home_score < away_score)::int]) as y from finals join w using (match_id))
select league, least(floor(p * 10), 9)::int as bin, count(*) as n, round(avg(p), 6) as predicted, round(avg(y), 6) as observed from f group by all""",
        "prj04_selected": f"{users} select match_id, status from matches where status = 'scheduled' order by kickoff, match_id limit 5",
        "prj04_selected_fallback": f"{users} select match_id, status from finals order by kickoff desc, match_id limit 5",
        "prj01_event_detail": """select cast(event_id as varchar) as event_id, 'ground' as venue_name, (case when event_id % 5 > 0 then 'home' else 'away' end) || ':' || user_id || ',home:' || (user_id + 1) as competitors from events
where event_id % 11 > 0 and (event_id % 6 = 0 or event_id % 4 = 2) and year(case when event_id % 9 > 0 then ts else timestamp '2020-01-01' end) = 2024""",
        "snk14_history_events": f"""{LEAGUE_HISTORY} select event_id, league, strftime(ts, '%Y-%m-%d ') || case when n % 4 = 1 then strftime(ts, '%H:%M') else '12:00' end as "at", away || ' at ' || home as name,
(year(ts) - case when month(ts) >= 7 then 0 else 1 end)::int as season_year, 'final' as status from h""",
        "snk14_history_sides": f"""{LEAGUE_HISTORY}, m as (select * from h where n % 3 = 1) select event_id, 'home' as home_away, 'fdt' || substr(sha1(league || '|' || home), 1, 20) as team_id, (n % 5)::varchar as score, n % 5 > n % 3 as winner, 1 as ord from m
union all select event_id, 'away', 'fdt' || substr(sha1(league || '|' || away), 1, 20), (n % 3)::varchar, n % 3 > n % 5, 0 from m""",
        "snk15_history_odds": f"""{LEAGUE_HISTORY} select event_id, 'fd-avg' as provider, '1x2' as market, 'home' as selection, '' as line, n % 400 / 100.0::double as decimal_odds from h where n % 400 >= 101
union all select event_id, 'fd-max', 'totals', 'over', '2.5', 2.1::double from h where n % 2 = 0""",
        "snk09_injury_report": """select c_nationkey as league, c_custkey::varchar as athlete_id, case when c_custkey % 9 > 0 then c_name else '' end as athlete_name, case c_custkey % 4 when 0 then 'out' when 1 then 'ir' when 2 then 'day_to_day' else 'other' end as status,
case when c_custkey % 50 % 2 = 0 then (c_custkey % 50)::varchar end as team_id, c_custkey % 9 = 0 as error from customer""",
        "snk10_transactions": """select (o_orderkey % 25)::int as league, case when o_orderkey % 5 > 0 then o_orderkey::varchar end as transaction_id, case when o_orderkey % 7 > 0 then strftime(o_orderdate, '%Y-%m-%d') end as day, o_orderpriority as description,
case when o_custkey % 50 % 2 = 0 then (o_custkey % 50)::varchar end as team_id from orders where o_orderkey % 6 > 0""",
        "snk10_transaction_merge": """with t as (select (o_orderkey % 25)::int as league, case when o_orderkey % 5 > 0 then o_orderkey::varchar end as transaction_id, o_orderpriority as description,
  case when o_custkey % 50 % 2 = 0 then (o_custkey % 50)::varchar end as team_id, case when o_orderkey % 5 > 0 then o_orderkey else 6 end as n from orders where o_orderkey % 6 > 0)
select league, transaction_id, 'new ' || description as description, team_id, case when transaction_id is not null and n % 3 = 0 then 'updated' else 'created' end as action from t where n % 2 = 0
union all select league, transaction_id, description, team_id, 'kept' from t where n % 3 = 0 and (transaction_id is null or n % 2 <> 0)""",
        "agg19_appearances": """select o_orderkey, coalesce(case when o_orderkey % 4 = 0 and o_orderkey % 40 >= 5 then o_orderkey % 40 - 5 end, case when o_orderkey % 4 < 2 then o_orderkey % 30 end, case when o_orderkey % 3 > 0 then o_orderkey % 20 / 2.0::double end)::double as appearances from orders""",
    }
    parts = (out["agg11_strength_before"].replace("round(strength, 6)", "strength"), out["agg13_meetings_before"], out["prjn01_projection"])
    return out | catalog(clubs) | {"prjn06_insights": insights(clubs, *parts), "agg15_context_before": f"{clubs}, {CONTEXT} select * from contexts"}
