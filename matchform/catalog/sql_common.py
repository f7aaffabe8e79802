"""Shared SQL for the oracles: the same binding of the test tables, written independently."""

from __future__ import annotations

_TEAM_NAME = """CASE WHEN {n} % 20 = 19 THEN 'AC ' WHEN {n} % 4 = 0 THEN 'Club ' ELSE 'FC ' END || ({n})"""
_TEAM_CODE = """'C' || CASE WHEN {n} % 40 = 39 THEN {n} - 5 ELSE {n} END"""

RAW = f"""
numbered AS (
  SELECT *, o_orderkey AS match_id, o_custkey // 10 AS home_no,
         o_custkey // 10 + 5 * (1 + o_orderkey % 7) AS away_no,
         'L' || ((o_custkey // 10) % 5) AS league,
         cast(floor(o_totalprice) AS BIGINT) % 5 AS g_home,
         cast(floor(o_totalprice / 7) AS BIGINT) % 4 AS g_away,
         cast(1.2 AS DOUBLE) + (o_orderkey % 37) / cast(10 AS DOUBLE) AS "AvgH",
         cast(3.0 AS DOUBLE) + (o_orderkey % 11) / cast(10 AS DOUBLE) AS "AvgD",
         cast(1.5 AS DOUBLE) + (o_orderkey % 53) / cast(10 AS DOUBLE) AS "AvgA"
  FROM orders
),
raw AS (
  SELECT match_id, league, league AS "Div",
         year(o_orderdate) || '/' || lpad(cast((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') AS season,
         CASE WHEN match_id % 211 = 0 THEN 'postponed' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS "Date",
         CASE WHEN match_id % 17 <> 0 THEN (12 + match_id % 8) || ':' ||
              lpad(cast(match_id % 4 * 15 AS VARCHAR), 2, '0') END AS "Time",
         {_TEAM_NAME.format(n="home_no")} AS "HomeTeam",
         {_TEAM_NAME.format(n="away_no")} AS "AwayTeam",
         g_home AS "FTHG", g_away AS "FTAG",
         CASE WHEN match_id % 307 = 0 THEN NULL WHEN g_home > g_away THEN 'H'
              WHEN g_home = g_away THEN 'D' ELSE 'A' END AS "FTR",
         CASE WHEN league = 'L0' THEN o_orderpriority END AS "Referee",
         "AvgH", "AvgD", "AvgA",
         "AvgH" * cast(1.05 AS DOUBLE) AS "MaxH", "AvgD" * cast(1.05 AS DOUBLE) AS "MaxD",
         "AvgA" * cast(1.05 AS DOUBLE) AS "MaxA"
  FROM numbered
)"""


def _side(status: str, side: str) -> str:
    flag = f"l_linestatus = '{status}'"
    return f"""
         cast(sum(cast(l_quantity AS BIGINT)) FILTER ({flag}) AS BIGINT) AS "{side}S",
         count(*) FILTER ({flag}) AS n_{side},
         cast(sum(l_linenumber) FILTER ({flag}) AS BIGINT) AS "{side}F",
         cast(max(l_linenumber) FILTER ({flag}) AS BIGINT) AS "{side}C",
         cast(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) FILTER ({flag}) AS BIGINT) AS "{side}Y",
         cast(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) FILTER ({flag}) AS BIGINT) AS "{side}R\""""


MEASURES = f"""
line_measures AS (
  SELECT l_orderkey AS match_id, {_side("O", "H")}, {_side("F", "A")}
  FROM lineitem GROUP BY l_orderkey
),
raw_measures AS (
  SELECT raw.*, m.* EXCLUDE (match_id, n_H, n_A), nullif(n_H, 0) AS "HST", nullif(n_A, 0) AS "AST"
  FROM raw LEFT JOIN line_measures m USING (match_id)
)"""


def matches(source: str = "raw", name: str = "matches") -> str:
    return f"""
{name}_implied AS (
  SELECT *, try_strptime("Date" || ' ' || coalesce("Time", '00:00'), '%d/%m/%Y %H:%M') AS kickoff,
         1 / "AvgH" AS market_home_prob, 1 / "AvgD" AS market_draw_prob, 1 / "AvgA" AS market_away_prob
  FROM {source}
),
{name} AS (
  SELECT *,
    market_home_prob / (market_home_prob + market_draw_prob + market_away_prob) AS market_home_prob_fair,
    market_draw_prob / (market_home_prob + market_draw_prob + market_away_prob) AS market_draw_prob_fair,
    market_away_prob / (market_home_prob + market_draw_prob + market_away_prob) AS market_away_prob_fair
  FROM {name}_implied
)"""


MATCHES = RAW + "," + matches()
FULL_MATCHES = RAW + "," + MEASURES + "," + matches("raw_measures")

XG = f"""
xg_sides AS (
  SELECT l_orderkey, sum(l_quantity) FILTER (l_linestatus = 'O') AS h,
         sum(l_quantity) FILTER (l_linestatus = 'F') AS a
  FROM lineitem GROUP BY l_orderkey
),
xg AS (
  SELECT match_id,
         CASE WHEN match_id % 223 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
         'Club ' || home_no AS home_team, 'Club ' || away_no AS away_team,
         {_TEAM_CODE.format(n="home_no")} AS home_team_code,
         {_TEAM_CODE.format(n="away_no")} AS away_team_code,
         h / cast(10 AS DOUBLE) AS home_xg, a / cast(10 AS DOUBLE) AS away_xg, league
  FROM numbered JOIN xg_sides ON match_id = l_orderkey WHERE h IS NOT NULL AND a IS NOT NULL
)"""

CURATED = f"""
curated AS (
  SELECT c_custkey AS position,
         CASE WHEN c_custkey % 10 = 5 THEN 'Club ' ELSE 'FC ' END || (c_custkey // 10) AS team_name,
         CASE WHEN c_custkey % 10 = 0 THEN {_TEAM_CODE.format(n="(c_custkey // 10)")}
              ELSE 'X' || c_custkey END AS team_code
  FROM customer
)"""

CROSSWALK = """
seed AS (
  SELECT home_team AS team_name, home_team_code AS team_code, count(*) AS count FROM xg GROUP BY ALL
),
crosswalk AS (
  SELECT * FROM seed
  UNION ALL
  SELECT team_name, arg_min(team_code, position), cast(NULL AS BIGINT)
  FROM curated WHERE team_name NOT IN (SELECT team_name FROM seed) GROUP BY team_name
)"""

PREDICTIONS = """
model_implied AS (
  SELECT *, 1 / ("AvgH" + (match_id % 7) / cast(10 AS DOUBLE)) AS ih,
         1 / ("AvgD" + (match_id % 5) / cast(10 AS DOUBLE)) AS id,
         1 / ("AvgA" + (match_id % 9) / cast(10 AS DOUBLE)) AS ia
  FROM matches
),
predictions AS (
  SELECT match_id,
         CASE WHEN match_id % 401 <> 0 THEN ih / (ih + id + ia) END AS "model_prob_H",
         CASE WHEN match_id % 401 <> 0 THEN id / (ih + id + ia) END AS "model_prob_D",
         CASE WHEN match_id % 401 <> 0 THEN ia / (ih + id + ia) END AS "model_prob_A",
         kickoff, season, "Div", "HomeTeam", "AwayTeam", "FTR",
         market_home_prob_fair, market_draw_prob_fair, market_away_prob_fair
  FROM model_implied
)"""

_MODEL = ('"model_prob_H"', '"model_prob_D"', '"model_prob_A"')
_MARKET = ("market_home_prob_fair", "market_draw_prob_fair", "market_away_prob_fair")


def log_loss(probs, eps: str = "1e-15", result: str = '"FTR"') -> str:
    h, d, a = probs
    chosen = f"(CASE {result} WHEN 'H' THEN {h} WHEN 'D' THEN {d} WHEN 'A' THEN {a} END) / ({h} + {d} + {a})"
    return f"-ln(greatest(least({chosen}, cast(1 AS DOUBLE)), cast({eps} AS DOUBLE)))"


def brier(probs, result: str = '"FTR"') -> str:
    total = "(" + " + ".join(probs) + ")"
    gaps = [f"({p} / {total} - CASE WHEN {result} = '{o}' THEN 1 ELSE 0 END)" for p, o in zip(probs, "HDA")]
    return f"(CASE WHEN {result} IS NOT NULL THEN " + " + ".join(f"{g} * {g}" for g in gaps) + " END)"


def pick(probs) -> str:
    h, d, a = probs
    return f"CASE WHEN {h} >= {d} AND {h} >= {a} THEN 'H' WHEN {d} >= {a} THEN 'D' ELSE 'A' END"


MODEL, MARKET = _MODEL, _MARKET

SCORED = f"""
scored AS (
  SELECT *, {log_loss(_MODEL)} AS model_log_loss, {log_loss(_MARKET)} AS market_log_loss,
         {brier(_MODEL)} AS model_brier, {brier(_MARKET)} AS market_brier,
         {pick(_MODEL)} AS model_pick, {pick(_MARKET)} AS market_pick
  FROM predictions
  WHERE "model_prob_H" IS NOT NULL AND "model_prob_D" IS NOT NULL AND "model_prob_A" IS NOT NULL
    AND market_home_prob_fair IS NOT NULL AND market_draw_prob_fair IS NOT NULL
    AND market_away_prob_fair IS NOT NULL AND "FTR" IS NOT NULL
)"""

SCORED_ALL = MATCHES + "," + PREDICTIONS + "," + SCORED


def sides(source: str = "matches", measures: bool = True, name: str = "history") -> str:
    """Both perspectives of ``source`` as a UNION ALL."""
    extra = {
        "home": '"HF" AS fouls_for, "HC" AS corners_for, "HY" AS yellow_cards_for, "HR" AS red_cards_for, '
        '"HS" AS shots_for, "HST" AS shots_on_target_for,',
        "away": '"AF", "AC", "AY", "AR", "AS", "AST",',
    }
    parts = []
    for venue, team, gf, ga, pts in (
        ("home", '"HomeTeam"', '"FTHG"', '"FTAG"', (3, 1, 0)),
        ("away", '"AwayTeam"', '"FTAG"', '"FTHG"', (0, 1, 3)),
    ):
        more = extra[venue] if measures else ""
        parts.append(
            f"""SELECT season, league, match_id, kickoff, {team} AS team, '{venue}' AS venue,
            {gf} AS goals_for, {ga} AS goals_against, {more}
            cast(CASE "FTR" WHEN 'H' THEN {pts[0]} WHEN 'D' THEN {pts[1]} WHEN 'A' THEN {pts[2]} END AS BIGINT) AS points
            FROM {source}"""
        )
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


def over(keys: str, size: int, order: str = "kickoff, match_id") -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING)"


def means(keys: str, wanted, suffix: str = "", digits: int | None = None, order: str = "kickoff, match_id") -> str:
    """``avg`` columns for ``(measure, size)`` pairs."""
    out = []
    for measure, size in wanted:
        text = f"avg({measure}) {over(keys, size, order)}"
        text = f"round({text}, {digits})" if digits else text
        out.append(f"{text} AS {measure}{suffix}_last_{size}")
    return ",\n".join(out)


LONG = ("points", "goals_for", "goals_against")
SHORT = ("shots_for", "shots_on_target_for", "fouls_for", "corners_for", "yellow_cards_for", "red_cards_for")
TEAM_WANTED = [(m, s) for m in LONG for s in (5, 10)] + [(m, 5) for m in SHORT]
VENUE_WANTED = [(m, s) for m in LONG for s in (5, 10)]
FORM = "season, league, team"
