"""Folds, correlations, data checks and the backtest."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from matchform.catalog import sql_common as Q
from matchform.catalog.history_queries import FULL_HISTORY, HISTORY, HISTORY_KEYS
from matchform.catalog.join_queries import best_odds
from matchform.catalog.registry import query, rounded
from matchform.operators import assemble, backtest, checks, folds, history, reshape, scoring
from matchform.operators.ordering import global_order

_SEASONS = f"""{Q.RAW}, seasons AS (SELECT season, cast(left(season, 4) AS INTEGER) AS start_year,
  row_number() OVER (ORDER BY season) AS n, count(*) OVER () AS total FROM (SELECT DISTINCT season FROM raw))"""


@query("q_ordered_seasons", f"WITH {_SEASONS} SELECT season, start_year FROM seasons ORDER BY start_year")
def ordered_seasons(t):
    return folds.seasons_with_year(t.raw()).orderBy("start_year")


@query(
    "q_outer_folds",
    f"""WITH {_SEASONS} SELECT cast(v.n - 2 AS INTEGER) AS fold, s.season, CASE WHEN s.n = v.n THEN 'validation' ELSE 'train' END AS role
        FROM seasons v JOIN seasons s ON s.n <= v.n WHERE v.n > 2 AND v.n < v.total""",
)
def outer_folds(t):
    return folds.fold_relation(t.raw(), first=2, held_out=1)


@query(
    "q_inner_folds",
    f"""WITH {_SEASONS} SELECT cast(v.n - 1 AS INTEGER) AS fold, s.season, CASE WHEN s.n = v.n THEN 'validation' ELSE 'train' END AS role
        FROM seasons v JOIN seasons s ON s.n <= v.n WHERE v.n > 1""",
)
def inner_folds(t):
    return folds.fold_relation(t.raw(), first=1, held_out=0)


@query(
    "q_fold_sizes",
    f"""WITH {_SEASONS}, counts AS (SELECT season, count(*) AS c FROM raw WHERE "FTR" IS NOT NULL AND "Referee" IS NOT NULL GROUP BY season)
        SELECT cast(v.n - 2 AS INTEGER) AS fold, cast(sum(c) FILTER (s.n < v.n) AS BIGINT) AS train_rows,
               cast(sum(c) FILTER (s.n = v.n) AS BIGINT) AS validation_rows
        FROM seasons v JOIN seasons s ON s.n <= v.n JOIN counts ON counts.season = s.season
        WHERE v.n > 2 AND v.n < v.total GROUP BY v.n""",
)
def fold_sizes(t):
    return folds.fold_sizes(t.raw(), ["FTR", "Referee"])


NUMERIC = ("FTHG", "FTAG", "HS", "AS", "HST", "AST", "HF", "AF", "HC", "AC", "AvgH", "AvgD")


def _correlation_sql() -> str:
    parts = [
        f"""SELECT '{a}' AS "left", '{b}' AS "right", round(abs(corr("{a}", "{b}")), 6) AS correlation FROM train"""
        for a, b in combinations(NUMERIC, 2)
    ]
    return f"""WITH {Q.RAW}, {Q.MEASURES}, train AS (SELECT * FROM raw_measures WHERE season < (SELECT max(season) FROM raw))
    {" UNION ALL ".join(parts)}"""


@query("q_correlation_pairs", _correlation_sql())
def correlation_pairs(t):
    train, _ = folds.season_holdout(t.raw_with_measures())
    return rounded(folds.correlation_pairs(train, NUMERIC))


@query(
    "q_check_chronology",
    f"""WITH {Q.MATCHES}, feats AS (SELECT kickoff, row_number() OVER (ORDER BY kickoff NULLS LAST, league, match_id) AS match_id FROM matches),
        moved AS (SELECT match_id, CASE WHEN match_id % 37 = 0 THEN kickoff - INTERVAL 9 DAY ELSE kickoff END AS kickoff FROM feats),
        stored AS (SELECT * FROM moved UNION ALL SELECT * FROM moved WHERE match_id % 97 = 0),
        seen AS (SELECT match_id, kickoff, lag(kickoff) OVER (ORDER BY match_id) AS before FROM stored)
        SELECT count(*) FILTER (kickoff < before) AS backward_steps, count(*) - count(DISTINCT match_id) AS repeated_keys FROM seen""",
)
def check_chronology(t):
    rows = t.matches().select("kickoff", "league", "match_id")
    ordered = global_order(rows, ("kickoff", "league", "match_id")).select("match_id", "kickoff")
    # Some matches are moved to an earlier day and some are stored twice, so that there is something to find.
    early = F.when(F.col("match_id") % 37 == 0, F.expr("kickoff - INTERVAL 9 DAYS")).otherwise(F.col("kickoff"))
    moved = ordered.withColumn("kickoff", early)
    return checks.check_chronology(moved.union(moved.filter("match_id % 97 = 0")))


@query(
    "q_check_prob_sum",
    f"""WITH {Q.MATCHES} SELECT count(*) AS violations FROM matches
        WHERE abs(market_home_prob_fair * (CASE WHEN match_id % 50 = 7 THEN 0.9::DOUBLE ELSE 1 END) + market_draw_prob_fair + market_away_prob_fair - 1) > 1e-9""",
)
def check_prob_sum(t):
    # One match in fifty has its home probability cut, so that there is something to find.
    cut = F.when(F.col("match_id") % 50 == 7, F.lit(0.9)).otherwise(F.lit(1.0))
    damaged = t.matches().withColumn("market_home_prob_fair", F.col("market_home_prob_fair") * cut)
    return checks.check_prob_sum(damaged, scoring.MARKET_PROBS)


@query(
    "q_check_no_leakage",
    f"""WITH {HISTORY}, f AS (SELECT *, {Q.means(Q.FORM, [(m, 5) for m in Q.LONG])},
          row_number() OVER (PARTITION BY {Q.FORM} ORDER BY kickoff, match_id) AS event FROM history)
        SELECT count(*) AS violations FROM f WHERE event = 1 AND
          (points_last_5 IS NOT NULL OR goals_for_last_5 IS NOT NULL OR goals_against_last_5 IS NOT NULL OR match_id % 10 = 3)""",
)
def check_no_leakage(t):
    means = {f"{m}_last_5": (m, 5) for m in history.LONG_MEASURES}
    form = history.rolling_mean(
        reshape.result_sides(t.matches()), history.FORM_KEYS, history.EVENT_ORDER, means
    )
    # One match in ten knows its own goals, so that there is something to find.
    leaked = F.when(F.col("match_id") % 10 == 3, F.coalesce("goals_for_last_5", F.lit(1.0))).otherwise(F.col("goals_for_last_5"))
    return checks.check_no_leakage(form.withColumn("goals_for_last_5", leaked), tuple(means))


@query(
    "q_manual_recompute",
    f"""WITH {FULL_HISTORY} SELECT {", ".join(HISTORY_KEYS)}, round(avg(shots_for) {Q.over(Q.FORM, 5)}, 6) AS shots_for_last_5 FROM history""",
)
def manual_recompute(t):
    found = checks.manual_mean(
        reshape.match_sides(t.matches_with_measures()),
        history.FORM_KEYS, history.EVENT_ORDER, "shots_for", 5, "shots_for_last_5",
    )
    return rounded(found.select(*HISTORY_KEYS, "shots_for_last_5"))


_EDGES = [f"({m} - {k})" for m, k in zip(Q.MODEL, Q.MARKET)]
_EVS = [f"({m} * {o} - 1)" for m, o in zip(Q.MODEL, ("best_odds_home", "best_odds_draw", "best_odds_away"))]


def _choice(strategy: str, picked: str, condition: str) -> str:
    return f"""SELECT '{strategy}' AS strategy, match_id, kickoff, "Div", "HomeTeam", "AwayTeam", "FTR", {picked} AS pick,
    best_odds_home, best_odds_draw, best_odds_away FROM priced WHERE {condition}"""


BETS = f"""{Q.SCORED_ALL},
priced AS (SELECT s.*, m."MaxH" AS best_odds_home, m."MaxD" AS best_odds_draw, m."MaxA" AS best_odds_away
           FROM scored s JOIN matches m ON s.match_id = m.match_id WHERE m."MaxH" IS NOT NULL),
chosen AS (
  {_choice("Model favourite", Q.pick(Q.MODEL), "true")} UNION ALL
  {_choice("Value edge", Q.pick(_EDGES), f"greatest({', '.join(_EDGES)}) >= 0.05::DOUBLE")} UNION ALL
  {_choice("Positive expected value", Q.pick(_EVS), f"greatest({', '.join(_EVS)}) >= 0.0::DOUBLE")}
),
bets AS (SELECT * EXCLUDE (best_odds_home, best_odds_draw, best_odds_away),
         CASE pick WHEN 'H' THEN best_odds_home WHEN 'D' THEN best_odds_draw ELSE best_odds_away END AS odds FROM chosen),
settled AS (SELECT *, pick = "FTR" AS won, CASE WHEN pick = "FTR" THEN 10.0::DOUBLE * (odds - 1) ELSE -10.0::DOUBLE END AS profit FROM bets),
pnl AS (SELECT *, sum(profit) OVER (PARTITION BY strategy ORDER BY kickoff NULLS LAST, match_id ROWS UNBOUNDED PRECEDING) AS cumulative_profit FROM settled)"""

_BET_SQL = """match_id, kickoff, "Div", "HomeTeam", "AwayTeam", "FTR", pick, round(odds, 6) AS odds"""


def _priced(t):
    scored = scoring.add_scores(t.predictions())
    return assemble.attach_best_odds(scored, best_odds(t))


@query("q_bets_favourite", f"WITH {BETS} SELECT {_BET_SQL} FROM bets WHERE strategy = 'Model favourite'")
def bets_favourite(t):
    return rounded(backtest.place_bets(_priced(t), backtest.favourite()))


@query("q_bets_value_edge", f"WITH {BETS} SELECT {_BET_SQL} FROM bets WHERE strategy = 'Value edge'")
def bets_value_edge(t):
    return rounded(backtest.place_bets(_priced(t), backtest.value_edge()))


@query("q_bets_positive_ev", f"WITH {BETS} SELECT {_BET_SQL} FROM bets WHERE strategy = 'Positive expected value'")
def bets_positive_ev(t):
    return rounded(backtest.place_bets(_priced(t), backtest.positive_ev()))


@query("q_settle_bets", f"WITH {BETS} SELECT strategy, {_BET_SQL}, won, round(profit, 6) AS profit FROM settled")
def settle_bets(t):
    return rounded(backtest.settled_bets(_priced(t)))


@query(
    "q_cumulative_pnl",
    f"WITH {BETS} SELECT strategy, match_id, kickoff, round(profit, 6) AS profit, round(cumulative_profit, 6) + 0.0 AS cumulative_profit FROM pnl",
)
def cumulative_pnl(t):
    pnl = backtest.cumulative_pnl(backtest.settled_bets(_priced(t)))
    return rounded(pnl.select("strategy", "match_id", "kickoff", "profit", "cumulative_profit"))


@query(
    "q_bet_summary",
    f"""WITH {BETS}, peaks AS (SELECT *, greatest(0.0::DOUBLE, max(cumulative_profit) OVER
          (PARTITION BY strategy ORDER BY kickoff NULLS LAST, match_id ROWS UNBOUNDED PRECEDING)) AS peak FROM pnl)
        SELECT strategy, count(*) AS bets, round(avg(CASE WHEN won THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS win_rate,
          round(10.0::DOUBLE * count(*), 4) AS total_staked, round(sum(profit), 4) AS total_profit,
          round(sum(profit) / (10.0::DOUBLE * count(*)), 4) AS roi, round(max(peak - cumulative_profit), 4) AS max_drawdown
        FROM peaks GROUP BY strategy""",
)
def bet_summary(t):
    return rounded(backtest.bet_summary(backtest.settled_bets(_priced(t))), 4)


@query(
    "q_pnl_long",
    f"WITH {BETS} SELECT kickoff, strategy, match_id, round(cumulative_profit, 6) + 0.0 AS cumulative_profit FROM pnl",
)
def pnl_long(t):
    return rounded(backtest.pnl_long(backtest.cumulative_pnl(backtest.settled_bets(_priced(t)))))
