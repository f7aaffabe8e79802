"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchform.catalog import sql_common as Q
from matchform.catalog.registry import query, rounded
from matchform.functions import scalars as S
from matchform.operators import filters, summaries
from matchform.operators.enrich import with_market_probs


@query(
    "q_season_codes",
    """SELECT y AS start_year, lpad(cast(y % 100 AS VARCHAR), 2, '0') || lpad(cast((y + 1) % 100 AS VARCHAR), 2, '0') AS code,
       y || '/' || lpad(cast((y + 1) % 100 AS VARCHAR), 2, '0') AS label
       FROM (SELECT unnest(generate_series(min(year(o_orderdate)), max(year(o_orderdate)))) AS y FROM orders)""",
)
def season_codes(t):
    years = t.orders.agg(
        F.min(F.year("o_orderdate")).alias("first"), (F.max(F.year("o_orderdate")) + 1).alias("end")
    )
    year = F.col("start_year")
    span = F.sequence(F.col("first").cast("bigint"), F.col("end").cast("bigint") - 1)
    return years.select(F.explode(span).alias("start_year")).select("start_year", S.season_code(year).alias("code"), S.season_label(year).alias("label"))


@query(
    "q_category_index",
    f"""WITH {Q.RAW} SELECT "HomeTeam", dense_rank() OVER (ORDER BY "HomeTeam") - 1 AS category_index
        FROM (SELECT DISTINCT "HomeTeam" FROM raw)""",
)
def category_index(t):
    return summaries.category_index(t.raw(), "HomeTeam")


@query(
    "q_parse_kickoff",
    f"""WITH {Q.RAW} SELECT match_id, "Date" AS date_text, "Time" AS time_text,
        try_strptime("Date" || ' ' || coalesce("Time", '00:00'), '%d/%m/%Y %H:%M') AS kickoff FROM raw""",
)
def parse_kickoff(t):
    return t.raw().select(
        "match_id",
        F.col("Date").alias("date_text"),
        F.col("Time").alias("time_text"),
        S.parse_kickoff(F.col("Date"), F.col("Time")).alias("kickoff"),
    )


@query(
    "q_match_key",
    f"""WITH {Q.MATCHES} SELECT match_id, concat(cast(kickoff AS DATE), '_', nullif("HomeTeam", 'FC 1'), '_',
        CASE WHEN match_id % 5 <> 0 THEN "AwayTeam" END) AS match_concat FROM matches""",
)
def match_key(t):
    away = F.when(F.col("match_id") % 5 != 0, F.col("AwayTeam"))
    home = F.nullif(F.col("HomeTeam"), F.lit("FC 1"))
    return t.matches().select("match_id", S.match_key(F.col("kickoff"), home, away).alias("match_concat"))


@query(
    "q_xg_key",
    f"""WITH {Q.RAW}, {Q.XG} SELECT match_id, cast(try_cast(date AS DATE) AS VARCHAR) || '_' ||
        home_team_code || '_' || nullif(away_team_code, 'C9') AS match_concat FROM xg""",
)
def xg_key(t):
    away = F.nullif(F.col("away_team_code"), F.lit("C9"))
    return t.xg().select(
        "match_id", S.xg_key(F.col("date"), F.col("home_team_code"), away).alias("match_concat")
    )


@query(
    "q_implied_prob",
    f"""WITH {Q.MATCHES} SELECT match_id, round(market_home_prob, 6) AS market_home_prob,
        round(market_draw_prob, 6) AS market_draw_prob, round(market_away_prob, 6) AS market_away_prob FROM matches""",
)
def implied_prob(t):
    return rounded(
        t.raw().transform(with_market_probs).select(
            "match_id", "market_home_prob", "market_draw_prob", "market_away_prob"
        )
    )


@query(
    "q_fair_probs",
    f"""WITH {Q.MATCHES} SELECT match_id, round(market_home_prob_fair, 6) AS market_home_prob_fair,
        round(market_draw_prob_fair, 6) AS market_draw_prob_fair,
        round(market_away_prob_fair, 6) AS market_away_prob_fair FROM matches""",
)
def fair_probs(t):
    return rounded(t.raw().transform(with_market_probs).select("match_id", *Q.MARKET))


@query(
    "q_overround",
    f"""WITH {Q.MATCHES} SELECT match_id, round(market_home_prob + market_draw_prob + market_away_prob, 6) AS overround,
        round(market_home_prob + market_draw_prob + market_away_prob - 1, 6) + 0.0 AS margin FROM matches""",
)
def overround(t):
    total = S.overround(F.col("market_home_prob"), F.col("market_draw_prob"), F.col("market_away_prob"))
    return rounded(
        t.raw().transform(with_market_probs).select(
            "match_id", total.alias("overround"), (total - 1).alias("margin")
        )
    )


@query(
    "q_points",
    f"""WITH {Q.RAW} SELECT match_id,
        cast(CASE "FTR" WHEN 'H' THEN 3 WHEN 'D' THEN 1 WHEN 'A' THEN 0 END AS BIGINT) AS home_points,
        cast(CASE "FTR" WHEN 'H' THEN 0 WHEN 'D' THEN 1 WHEN 'A' THEN 3 END AS BIGINT) AS away_points FROM raw""",
)
def points(t):
    result = F.col("FTR")
    return t.raw().select(
        "match_id",
        S.points(result, "home").alias("home_points"),
        S.points(result, "away").alias("away_points"),
    )


@query(
    "q_season_year",
    f"""WITH {Q.RAW} SELECT season, cast(regexp_extract(season, '([0-9]{{4}})', 1) AS INTEGER) AS start_year,
        count(*) AS matches FROM raw GROUP BY ALL""",
)
def season_year(t):
    return t.raw().groupBy("season", S.season_year(F.col("season")).alias("start_year")).agg(
        F.count("*").alias("matches")
    )


@query(
    "q_outcome_code",
    f"""WITH {Q.RAW} SELECT match_id, "FTR",
        cast(CASE "FTR" WHEN 'H' THEN 0 WHEN 'D' THEN 1 WHEN 'A' THEN 2 END AS INTEGER) AS outcome FROM raw""",
)
def outcome_code(t):
    return t.raw().select("match_id", "FTR", S.encode_outcome(F.col("FTR")).alias("outcome"))


@query(
    "q_complete_rows",
    f"""WITH {Q.MATCHES} SELECT match_id, season, "FTR", kickoff, "Referee" FROM matches
        WHERE match_id IS NOT NULL AND season IS NOT NULL AND "FTR" IS NOT NULL AND kickoff IS NOT NULL
          AND "Referee" IS NOT NULL""",
)
def complete_rows(t):
    columns = ["match_id", "season", "FTR", "kickoff", "Referee"]
    return filters.complete_rows(t.matches(), columns).select(*columns)


@query(
    "q_scope_filter",
    f"""WITH {Q.MATCHES} SELECT match_id, "Div", season, kickoff FROM matches
        WHERE "Div" IN ('L0', 'L3') AND season >= '1996/97' AND season <= '1999/00'""",
)
def scope_filter(t):
    return filters.scope(t.matches(), ["L0", "L3"], "1996/97", "1999/00").select(
        "match_id", "Div", "season", "kickoff"
    )


@query(
    "q_involving_entity",
    f"""WITH {Q.RAW} SELECT match_id, "HomeTeam", "AwayTeam" FROM raw
        WHERE "HomeTeam" = 'FC 11' OR "AwayTeam" = 'FC 11'""",
)
def involving_entity(t):
    return filters.involving(t.raw(), "FC 11").select("match_id", "HomeTeam", "AwayTeam")


@query(
    "q_filter_with_fallback",
    """WITH hit AS (SELECT o_orderkey, o_orderpriority, coalesce(contains(lower(o_orderpriority), 'medium'), false) AS a,
         coalesce(contains(lower(o_orderpriority), 'premier'), false) AS b FROM orders)
       SELECT 'present' AS rule, o_orderkey, o_orderpriority FROM hit WHERE a OR NOT (SELECT bool_or(a) FROM hit)
       UNION ALL
       SELECT 'absent', o_orderkey, o_orderpriority FROM hit WHERE b OR NOT (SELECT bool_or(b) FROM hit)""",
)
def filter_with_fallback(t):
    log = t.orders.select("o_orderkey", "o_orderpriority")
    found = [
        filters.filter_competition(log, name, "o_orderpriority").select(F.lit(rule).alias("rule"), "*")
        for rule, name in (("present", "Medium-Priority"), ("absent", "Premier-League"))
    ]
    return found[0].unionByName(found[1])


_LOG = """log AS (SELECT match_id, season AS "Season",
    CASE WHEN match_id % 13 = 0 THEN '' WHEN match_id % 211 = 0 THEN NULL ELSE "FTR" END AS "Result",
    CASE WHEN match_id % 23 = 0 THEN 'Date' WHEN match_id % 29 = 0 THEN '2000-02-30'
         WHEN match_id % 31 = 0 THEN '1999' ELSE strftime(try_strptime("Date", '%d/%m/%Y'), '%Y-%m-%d') END AS "Date"
    FROM raw)"""


def _log(t):
    key = F.col("match_id")
    return t.matches().select(
        "match_id",
        F.col("season").alias("Season"),
        F.when(key % 13 == 0, "").when(key % 211 == 0, F.lit(None)).otherwise(F.col("FTR")).alias("Result"),
        F.when(key % 23 == 0, "Date")
        .when(key % 29 == 0, "2000-02-30")
        .when(key % 31 == 0, "1999")
        .otherwise(F.date_format("kickoff", "yyyy-MM-dd"))
        .alias("Date"),
    )


@query(
    "q_played_only",
    f"""WITH {Q.RAW}, {_LOG} SELECT match_id, "Result" FROM log WHERE "Result" IS NOT NULL AND "Result" <> ''""",
)
def played_only(t):
    return filters.played_only(_log(t)).select("match_id", "Result")


@query(
    "q_lenient_dates",
    f"""WITH {Q.RAW}, {_LOG} SELECT match_id, "Season", try_cast("Date" AS DATE) AS "Date" FROM log
        ORDER BY "Season", "Date" NULLS LAST""",
)
def lenient_dates(t):
    return filters.clean_log(_log(t).select("match_id", "Season", "Date"))
