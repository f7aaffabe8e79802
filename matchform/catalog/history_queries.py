"""Unpivots, windows, rolling form and the order of all matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchform.catalog import sql_common as Q
from matchform.catalog.registry import query, rounded
from matchform.functions import scalars as S
from matchform.operators import enrich, history, ordering, reshape
from matchform.operators.assemble import rejoin_sides
from matchform.plans import features

HISTORY = Q.MATCHES + "," + Q.sides(measures=False)
FULL_HISTORY = Q.FULL_MATCHES + "," + Q.sides()
HISTORY_KEYS = ("season", "league", "match_id", "team", "venue")
_KEYS = ", ".join(HISTORY_KEYS)


@query("q_perspective_unpivot", f"WITH {FULL_HISTORY} SELECT * FROM history")
def perspective_unpivot(t):
    return reshape.match_sides(t.matches_with_measures())


XG_MATCHES = f"""{Q.MATCHES}, {Q.XG},
xg_matches AS (SELECT m.match_id, m.kickoff, m.league, "HomeTeam", "AwayTeam", home_xg, away_xg
               FROM matches m JOIN xg ON m.match_id = xg.match_id),
xg_history AS (
  SELECT match_id, kickoff, league, "HomeTeam" AS team, 'home' AS venue, home_xg AS xg, away_xg AS xg_against FROM xg_matches
  UNION ALL
  SELECT match_id, kickoff, league, "AwayTeam", 'away', away_xg, home_xg FROM xg_matches
)"""


def _xg_history(t):
    joined = t.matches().join(t.xg().select("match_id", "home_xg", "away_xg"), "match_id")
    return reshape.xg_sides(joined)


@query("q_perspective_unpivot_xg", f"WITH {XG_MATCHES} SELECT * FROM xg_history")
def perspective_unpivot_xg(t):
    return _xg_history(t)


@query(
    "q_match_numbering",
    f"""WITH {Q.MATCHES} SELECT match_id AS source_id, season, league,
        row_number() OVER (PARTITION BY season, league ORDER BY kickoff, "HomeTeam", "AwayTeam", match_id) - 1 AS match_id
        FROM matches""",
)
def match_numbering(t):
    rows = t.matches().select(
        F.col("match_id").alias("source_id"), "season", "league", "kickoff", "HomeTeam", "AwayTeam"
    )
    order = ("kickoff", "HomeTeam", "AwayTeam", "source_id")
    numbered = ordering.number_rows(rows, enrich.LEAGUE_SEASON, order, "match_id", start=0)
    return numbered.select("source_id", "season", "league", "match_id")


@query(
    "q_global_order",
    f"""WITH {Q.MATCHES} SELECT match_id AS source_id,
        row_number() OVER (ORDER BY kickoff NULLS LAST, league, match_id) AS match_id FROM matches""",
)
def global_order(t):
    rows = t.matches().select("kickoff", "league", "match_id", F.col("match_id").alias("source_id"))
    ordered = ordering.global_order(rows, ("kickoff", "league", "match_id"))
    return ordered.select("source_id", "match_id")


@query(
    "q_previous_event",
    f"""WITH {HISTORY} SELECT {_KEYS}, kickoff,
        lag(kickoff) OVER (PARTITION BY {Q.FORM} ORDER BY kickoff, match_id) AS previous_kickoff FROM history""",
)
def previous_event(t):
    rows = reshape.result_sides(t.matches()).select(*HISTORY_KEYS, "kickoff")
    return history.previous_event(
        rows, history.FORM_KEYS, history.EVENT_ORDER, "kickoff", "previous_kickoff"
    )


@query(
    "q_rest_days",
    """SELECT event_id, user_id, round(epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 86400, 6)
       AS rest_days FROM events""",
)
def rest_days(t):
    rows = t.events.select("event_id", "user_id", "ts")
    found = history.rest_days(rows, ("user_id",), ("ts", "event_id"), "ts")
    return rounded(found.select("event_id", "user_id", "rest_days"))


@query(
    "q_rolling_form_5",
    f"""WITH {FULL_HISTORY} SELECT {_KEYS}, {Q.means(Q.FORM, [(m, 5) for m in Q.LONG + Q.SHORT], digits=6)} FROM history""",
)
def rolling_form_5(t):
    means = {f"{m}_last_5": (m, 5) for m in history.LONG_MEASURES + history.SHORT_MEASURES}
    return _rolled(t, t.matches_with_measures(), history.FORM_KEYS, means)


@query(
    "q_rolling_form_10",
    f"""WITH {HISTORY} SELECT {_KEYS}, {Q.means(Q.FORM, [(m, 10) for m in Q.LONG], digits=6)} FROM history""",
)
def rolling_form_10(t):
    means = {f"{m}_last_10": (m, 10) for m in history.LONG_MEASURES}
    return _rolled(t, t.matches(), history.FORM_KEYS, means, reshape.result_sides)


@query(
    "q_rolling_form_10_all",
    f"""WITH {FULL_HISTORY} SELECT {_KEYS}, {Q.means(Q.FORM, [(m, 10) for m in Q.LONG + Q.SHORT], digits=6)} FROM history""",
)
def rolling_form_10_all(t):
    return _rolled(t, t.matches_with_measures(), history.FORM_KEYS, history.TEAM_MEANS_10_ALL)


@query(
    "q_venue_form",
    f"""WITH {HISTORY} SELECT {_KEYS}, {Q.means(Q.FORM + ", venue", Q.VENUE_WANTED, "_venue", 6)} FROM history""",
)
def venue_form(t):
    return _rolled(t, t.matches(), history.VENUE_KEYS, history.VENUE_MEANS, reshape.result_sides)


def _rolled(t, matches, keys, means, sides=reshape.match_sides):
    rows = history.rolling_mean(sides(matches), keys, history.EVENT_ORDER, means)
    return rounded(rows.select(*HISTORY_KEYS, *means))


_XG_ORDER = "kickoff, match_id, xg, xg_against"


@query(
    "q_rolling_xg",
    f"""WITH {XG_MATCHES} SELECT match_id, league, team, venue,
        {Q.means("league, team", [("xg", 5), ("xg_against", 5)], digits=6, order=_XG_ORDER)} FROM xg_history""",
)
def rolling_xg(t):
    rows = history.xg_features(_xg_history(t))
    return rounded(rows.select("match_id", "league", "team", "venue", *history.XG_MEANS))


@query(
    "q_rolling_min_periods",
    f"""WITH {Q.MATCHES}, seen AS (
        SELECT match_id, kickoff, "HomeTeam" AS team, market_home_prob_fair AS win_prob FROM matches
        UNION ALL SELECT match_id, kickoff, "AwayTeam", market_away_prob_fair FROM matches)
        SELECT match_id, team, round(CASE WHEN count(win_prob) OVER w >= 3 THEN avg(win_prob) OVER w END, 6) AS win_prob_avg_10
        FROM seen WINDOW w AS (PARTITION BY team ORDER BY kickoff, match_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def rolling_min_periods(t):
    rows = reshape.to_sides(
        t.matches(),
        ("match_id", "kickoff"),
        {"win_prob": reshape.swapped("market_home_prob_fair", "market_away_prob_fair")},
    )
    rolled = history.rolling_mean(
        rows, ("team",), history.EVENT_ORDER, {"win_prob_avg_10": ("win_prob", 10)},
        include_current=True, min_count=3,
    )
    return rounded(rolled.select("match_id", "team", "win_prob_avg_10"))


def _form_ctes() -> str:
    return f"""{FULL_HISTORY},
form AS (
  SELECT *, epoch(kickoff - previous_kickoff) / 86400 AS rest_days,
    {Q.means(Q.FORM, Q.TEAM_WANTED)}, {Q.means(Q.FORM + ", venue", Q.VENUE_WANTED, "_venue")}
  FROM (SELECT *, lag(kickoff) OVER (PARTITION BY {Q.FORM} ORDER BY kickoff, match_id) AS previous_kickoff FROM history)
)"""


def prematch_select(round_digits: int | None) -> str:
    out = []
    names = ["rest_days"] + [f"{m}_last_{s}" for m, s in Q.TEAM_WANTED]
    venue_names = [f"{m}_venue_last_{s}" for m, s in Q.VENUE_WANTED]
    wrap = (lambda x: f"round({x}, {round_digits})") if round_digits else (lambda x: x)
    for side in ("home", "away"):
        out += [f"{wrap(f'{side}.{n}')} AS {side}_{n}" for n in names]
        out += [f"{wrap(f'{side}.{n}')} AS {side}_{n.replace('_venue_', f'_{side}_')}" for n in venue_names]
    out.append(f"{wrap('home.points_last_5 - away.points_last_5')} AS points_difference_last_5")
    out.append(f"{wrap('home.goals_for_last_5 - away.goals_for_last_5')} AS goals_difference_last_5")
    return ",\n".join(out)


SIDE_JOINS = """LEFT JOIN form home ON home.season = m.season AND home.league = m.league AND home.match_id = m.match_id AND home.venue = 'home'
LEFT JOIN form away ON away.season = m.season AND away.league = m.league AND away.match_id = m.match_id AND away.venue = 'away'"""

PREMATCH_SQL = f"""WITH {_form_ctes()} SELECT m.season, m.league, m.match_id, m."HomeTeam", m."AwayTeam", {prematch_select(6)}
FROM matches m {SIDE_JOINS}"""


@query("q_prematch_table", PREMATCH_SQL)
def prematch_table(t):
    table = features.prematch_table(t.matches_with_measures())
    sides = [f"{v}_{c.replace('_venue_', f'_{v}_')}" for v in reshape.VENUES for c in features.FORM_COLUMNS]
    return rounded(
        table.select(
            "season", "league", "match_id", "HomeTeam", "AwayTeam", *sides,
            "points_difference_last_5", "goals_difference_last_5",
        )
    )


@query(
    "q_differences",
    f"""WITH {HISTORY}, form AS (SELECT *, lag(kickoff) OVER (PARTITION BY {Q.FORM} ORDER BY kickoff, match_id) AS previous,
        {Q.means(Q.FORM, [("points", 5), ("goals_for", 5), ("goals_against", 5)])} FROM history)
        SELECT m.match_id,
          round(home.points_last_5 - away.points_last_5, 6) AS points_difference_last_5,
          round(home.goals_for_last_5 - away.goals_for_last_5, 6) AS goals_difference_last_5,
          round(home.goals_against_last_5 - away.goals_against_last_5, 6) AS goals_against_difference_last_5,
          round(epoch(home.kickoff - home.previous) / 86400 - epoch(away.kickoff - away.previous) / 86400, 6) AS rest_days_diff
        FROM matches m {SIDE_JOINS}""",
)
def differences(t):
    means = {f"{m}_last_5": (m, 5) for m in history.LONG_MEASURES}
    rows = history.rolling_mean(
        reshape.result_sides(t.matches()), history.FORM_KEYS, history.EVENT_ORDER, means
    )
    rows = history.rest_days(rows, history.FORM_KEYS, history.EVENT_ORDER)
    wanted = {
        "points_difference_last_5": "points_last_5",
        "goals_difference_last_5": "goals_for_last_5",
        "goals_against_difference_last_5": "goals_against_last_5",
        "rest_days_diff": "rest_days",
    }
    keys = t.matches().select("season", "league", "match_id")
    joined = rejoin_sides(keys, rows, (*means, "rest_days"))
    return rounded(
        joined.select(
            "match_id",
            *[
                S.difference(F.col(f"home_{source}"), F.col(f"away_{source}")).alias(name)
                for name, source in wanted.items()
            ],
        )
    )
