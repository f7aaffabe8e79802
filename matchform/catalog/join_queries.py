"""Crosswalk, joins, pivots and the model-ready table."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchform.catalog import sql_common as Q
from matchform.catalog.history_queries import XG_MATCHES, prematch_select
from matchform.catalog.registry import query, rounded
from matchform.functions import scalars as S
from matchform.operators import assemble, crosswalk, history, reshape
from matchform.operators.scoring import add_scores
from matchform.plans import features

CODES = f"{Q.MATCHES}, {Q.XG}, {Q.CURATED}, {Q.CROSSWALK}"
_LOOKUPS = """LEFT JOIN crosswalk h ON m."HomeTeam" = h.team_name LEFT JOIN crosswalk a ON m."AwayTeam" = a.team_name"""


@query(
    "q_crosswalk_seed",
    f"WITH {Q.RAW}, {Q.XG} SELECT home_team AS team_name, home_team_code AS team_code, count(*) AS count FROM xg GROUP BY ALL",
)
def crosswalk_seed(t):
    return crosswalk.seed_crosswalk(t.xg())


@query(
    "q_crosswalk_conflicts",
    f"""WITH {Q.RAW}, {Q.XG}, odd AS (SELECT home_team, CASE WHEN match_id % 37 = 0 THEN 'ALT' ELSE home_team_code END AS code FROM xg)
        SELECT home_team, count(*) AS codes FROM (SELECT DISTINCT home_team, code FROM odd) GROUP BY home_team HAVING count(*) > 1""",
)
def crosswalk_conflicts(t):
    code = F.when(F.col("match_id") % 37 == 0, "ALT").otherwise(F.col("home_team_code"))
    return crosswalk.crosswalk_conflicts(t.xg().withColumn("home_team_code", code))


@query("q_crosswalk_merge", f"WITH {Q.RAW}, {Q.XG}, {Q.CURATED}, {Q.CROSSWALK} SELECT * FROM crosswalk")
def crosswalk_merge(t):
    return _crosswalk(t)


def _crosswalk(t):
    return crosswalk.merge_crosswalk(crosswalk.seed_crosswalk(t.xg()), t.curated_codes())


@query(
    "q_attach_codes",
    f"""WITH {CODES} SELECT match_id, "HomeTeam", "AwayTeam", h.team_code AS home_team_code, a.team_code AS away_team_code
        FROM matches m {_LOOKUPS}""",
)
def attach_codes(t):
    rows = t.matches().select("match_id", "HomeTeam", "AwayTeam")
    return crosswalk.attach_codes(rows, _crosswalk(t)).select(
        "match_id", "HomeTeam", "AwayTeam", "home_team_code", "away_team_code"
    )


KEYED = f"""{CODES},
keyed AS (
  SELECT m.*, concat(cast(kickoff AS DATE), '_', h.team_code, '_', a.team_code) AS match_concat
  FROM matches m {_LOOKUPS}
),
xg_keyed AS (
  SELECT cast(try_cast(date AS DATE) AS VARCHAR) || '_' || home_team_code || '_' || away_team_code AS match_concat,
         home_xg, away_xg FROM xg
)"""


@query(
    "q_join_key_inner",
    f"""WITH {KEYED} SELECT match_id, match_concat, home_xg, away_xg FROM keyed JOIN xg_keyed USING (match_concat)""",
)
def join_key_inner(t):
    coded = crosswalk.attach_codes(t.matches().select("match_id", "kickoff", "HomeTeam", "AwayTeam"), _crosswalk(t))
    key = S.match_key(F.col("kickoff"), F.col("home_team_code"), F.col("away_team_code"))
    joined = assemble.join_xg(coded.select("match_id", key.alias("match_concat")), t.xg())
    return joined.select("match_id", "match_concat", "home_xg", "away_xg")


@query(
    "q_duplicate_keys",
    f"""WITH {Q.RAW}, {Q.XG} SELECT match_concat, count(*) AS rows FROM (
        SELECT cast(try_cast(date AS DATE) AS VARCHAR) || '_' || home_team_code || '_' || away_team_code AS match_concat FROM xg)
        WHERE match_concat IS NOT NULL GROUP BY match_concat HAVING count(*) > 1""",
)
def duplicate_keys(t):
    key = S.xg_key(F.col("date"), F.col("home_team_code"), F.col("away_team_code"))
    keys = t.xg().select(key.alias("match_concat")).filter(F.col("match_concat").isNotNull())
    return assemble.duplicate_keys(keys, ["match_concat"])


@query(
    "q_rolling_xg_table",
    f"""WITH {XG_MATCHES}, rolled AS (SELECT *, {Q.means("league, team", [("xg", 5), ("xg_against", 5)], order="kickoff, match_id, xg, xg_against")} FROM xg_history)
        SELECT m.match_id, round(h.xg_last_5, 6) AS home_xg_last_5, round(h.xg_against_last_5, 6) AS home_xg_against_last_5,
               round(a.xg_last_5, 6) AS away_xg_last_5, round(a.xg_against_last_5, 6) AS away_xg_against_last_5
        FROM matches m LEFT JOIN rolled h ON m.match_id = h.match_id AND h.venue = 'home'
        LEFT JOIN rolled a ON m.match_id = a.match_id AND a.venue = 'away'""",
)
def rolling_xg_table(t):
    joined = t.matches().join(t.xg().select("match_id", "home_xg", "away_xg"), "match_id")
    table = features.rolling_xg_table(t.matches().select("match_id"), joined)
    return rounded(
        table.select(
            "match_id", "home_xg_last_5", "home_xg_against_last_5", "away_xg_last_5", "away_xg_against_last_5"
        )
    )


@query(
    "q_join_one_to_one",
    f"""WITH {Q.MATCHES}, {Q.PREDICTIONS} SELECT p.match_id, round("model_prob_H", 6) AS "model_prob_H", m.kickoff, m.season,
        m."HomeTeam", m."AwayTeam", m."FTR" FROM predictions p LEFT JOIN matches m ON p.match_id = m.match_id""",
)
def join_one_to_one(t):
    probs = t.predictions().select("match_id", "model_prob_H")
    info = t.matches().select("match_id", "kickoff", "season", "HomeTeam", "AwayTeam", "FTR")
    return rounded(assemble.join_one_to_one(probs, info, "match_id"))


@query(
    "q_attach_best_odds",
    f"""WITH {Q.SCORED_ALL} SELECT s.match_id, s.model_pick, round(m."MaxH", 6) AS best_odds_home,
        round(m."MaxD", 6) AS best_odds_draw, round(m."MaxA", 6) AS best_odds_away
        FROM scored s LEFT JOIN matches m ON s.match_id = m.match_id""",
)
def attach_best_odds(t):
    scored = add_scores(t.predictions()).select("match_id", "model_pick")
    return rounded(assemble.attach_best_odds(scored, best_odds(t)))


def best_odds(t):
    """Best prices under their model-table names."""
    return t.raw().withColumnsRenamed(assemble.BEST_ODDS)


def model_sql() -> str:
    """The whole feature build with plain windows and a join per side."""
    picked = {"match_id": "f.match_id", "best_odds_home": 'f."MaxH"', "best_odds_draw": 'f."MaxD"',
              "best_odds_away": 'f."MaxA"', "rest_days_diff": "f.home_rest_days - f.away_rest_days"}
    xg = {"home_xg_last_5": "h.xg_last_5", "away_xg_last_5": "a.xg_last_5",
          "home_xg_against_last_5": "h.xg_against_last_5", "away_xg_against_last_5": "a.xg_against_last_5"}
    exact = ("match_id", "kickoff", "HomeTeam", "AwayTeam", "Div", "season", "FTR", "Referee")
    columns = []
    for name in assemble.MODEL_COLUMNS:
        source = picked.get(name) or xg.get(name) or f'f."{name}"'
        columns.append(f'{source} AS "{name}"' if name in exact else f'round({source}, 6) AS "{name}"')
    side_joins = " ".join(
        f"LEFT JOIN form {v} ON {v}.season = m.season AND {v}.league = m.league AND {v}.match_id = m.match_id AND {v}.venue = '{v}'"
        for v in ("home", "away")
    )
    return f"""WITH {Q.FULL_MATCHES}, {Q.XG}, {Q.CURATED}, {Q.CROSSWALK},
coded AS (
  SELECT m.* EXCLUDE (match_id), m.match_id AS source_id,
         row_number() OVER (PARTITION BY season, league ORDER BY kickoff, "HomeTeam", "AwayTeam", m.match_id) - 1 AS match_id,
         concat(cast(kickoff AS DATE), '_', h.team_code, '_', a.team_code) AS match_concat
  FROM matches m {_LOOKUPS}
),
{Q.sides("coded")},
form AS (
  SELECT *, epoch(kickoff - previous_kickoff) / 86400 AS rest_days,
    {Q.means(Q.FORM, Q.TEAM_WANTED)}, {Q.means(Q.FORM + ", venue", Q.VENUE_WANTED, "_venue")}
  FROM (SELECT *, lag(kickoff) OVER (PARTITION BY {Q.FORM} ORDER BY kickoff, match_id) AS previous_kickoff FROM history)
),
prematch AS (SELECT m.*, {prematch_select(None)} FROM coded m {side_joins}),
feats AS (
  SELECT * EXCLUDE (match_id), row_number() OVER (ORDER BY kickoff NULLS LAST, league, match_id, season) AS match_id FROM prematch
),
xg_keyed AS (
  SELECT cast(try_cast(date AS DATE) AS VARCHAR) || '_' || home_team_code || '_' || away_team_code AS match_concat,
         home_xg, away_xg FROM xg
),
feats_xg AS (SELECT f.*, x.home_xg, x.away_xg FROM feats f JOIN xg_keyed x USING (match_concat)),
xg_hist AS (
  SELECT match_id, kickoff, league, "HomeTeam" AS team, 'home' AS venue, home_xg AS xg, away_xg AS xg_against FROM feats_xg
  UNION ALL SELECT match_id, kickoff, league, "AwayTeam", 'away', away_xg, home_xg FROM feats_xg
),
xg_rolled AS (SELECT *, {Q.means("league, team", [("xg", 5), ("xg_against", 5)], order="kickoff, match_id, xg, xg_against")} FROM xg_hist)
SELECT {", ".join(columns)} FROM feats f
LEFT JOIN xg_rolled h ON f.match_id = h.match_id AND h.venue = 'home'
LEFT JOIN xg_rolled a ON f.match_id = a.match_id AND a.venue = 'away'"""


@query("q_model_table", model_sql())
def model_table(t):
    raw = t.raw_with_measures().withColumnRenamed("match_id", "source_id")
    return rounded(features.build_features(raw, t.xg(), t.curated_codes(), ties=("source_id",)))


@query(
    "q_union_by_name",
    """SELECT o_orderkey AS match_id, o_orderpriority AS "Referee", o_totalprice FROM orders
       UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders""",
)
def union_by_name(t):
    with_referee = t.orders.select(
        F.col("o_orderkey").alias("match_id"), F.col("o_orderpriority").alias("Referee"), "o_totalprice"
    )
    without = t.orders.select("o_totalprice", F.col("o_orderkey").alias("match_id"))
    return reshape.union_by_name([with_referee, without])


_XG_ROLLED = XG_MATCHES[len(Q.MATCHES) + 1 :] + f""",
rolled AS (SELECT *, {Q.means("league, team", [("xg", 5), ("xg_against", 5)], order="kickoff, match_id, xg, xg_against")} FROM xg_history)"""


@query(
    "q_entity_view",
    f"""WITH {Q.MATCHES}, {Q.sides(measures=False)},
        form AS (SELECT *, avg(points) {Q.over(Q.FORM + ", venue", 5)} AS points_venue_last_5 FROM history),
        {_XG_ROLLED}
        SELECT m.match_id, m.kickoff, m.season, m."Div", m."FTR", v.team, v.venue,
          CASE v.venue WHEN 'home' THEN "AwayTeam" ELSE "HomeTeam" END AS opponent,
          round(CASE v.venue WHEN 'home' THEN h.xg_last_5 ELSE a.xg_last_5 END, 6) AS xg_last_5,
          round(CASE v.venue WHEN 'home' THEN market_home_prob_fair ELSE market_away_prob_fair END, 6) AS win_prob,
          round(v.points_venue_last_5, 6) AS points_venue_last_5
        FROM form v JOIN matches m ON v.match_id = m.match_id
        LEFT JOIN rolled h ON m.match_id = h.match_id AND h.venue = 'home'
        LEFT JOIN rolled a ON m.match_id = a.match_id AND a.venue = 'away'""",
)
def entity_view(t):
    means = {"points_venue_last_5": ("points", 5)}
    sides = history.rolling_mean(
        reshape.result_sides(t.matches()), history.VENUE_KEYS, history.EVENT_ORDER, means
    )
    table = assemble.rejoin_sides(t.matches(), sides, tuple(means))
    joined = t.matches().join(t.xg().select("match_id", "home_xg", "away_xg"), "match_id")
    return rounded(reshape.team_view(features.rolling_xg_table(table, joined)))


@query("q_entity_union_distinct", f'WITH {Q.RAW} SELECT "HomeTeam" AS team FROM raw UNION SELECT "AwayTeam" FROM raw ORDER BY 1')
def entity_union_distinct(t):
    return reshape.entities(t.raw())


@query(
    "q_outcome_shares",
    f"""WITH {Q.RAW} SELECT "Div", {", ".join(f"round(avg(CASE WHEN \"FTR\" = '{o}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS \"{o}\"" for o in "HDA")}
        FROM raw WHERE "FTR" IS NOT NULL GROUP BY "Div" """,
)
def outcome_shares(t):
    return rounded(reshape.outcome_shares(t.raw()))


LEAGUES = ("L0", "L1", "L2", "L3", "L4")


@query(
    "q_season_counts",
    f"""WITH {Q.RAW} SELECT season, {", ".join(f"count(*) FILTER (\"Div\" = '{c}') AS \"{c}\"" for c in LEAGUES)}, count(*) AS "Total"
        FROM raw GROUP BY season""",
)
def season_counts(t):
    return reshape.season_counts(t.raw())
