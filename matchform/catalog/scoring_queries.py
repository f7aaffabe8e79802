"""Losses, calibration, baselines and slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchform.catalog import sql_common as Q
from matchform.catalog.registry import query, rounded
from matchform.functions import scalars as S
from matchform.operators import folds, ordering, scoring
from matchform.operators.filters import complete_rows

EPS = "2.220446049250313e-16"


def _r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) AS {name}"


def _scored(t):
    return scoring.add_scores(t.predictions())


@query(
    "q_row_log_loss",
    f"WITH {Q.SCORED_ALL} SELECT match_id, {_r('model_log_loss', 'model_log_loss', 9)}, {_r('market_log_loss', 'market_log_loss', 9)} FROM scored",
)
def row_log_loss(t):
    return rounded(_scored(t).select("match_id", "model_log_loss", "market_log_loss"), 9)


@query(
    "q_mean_log_loss",
    f"""WITH {Q.MATCHES} SELECT season, {_r(f'avg({Q.log_loss(Q.MARKET, EPS)})', 'log_loss')} FROM matches
        WHERE "FTR" IS NOT NULL GROUP BY season""",
)
def mean_log_loss(t):
    loss = S.row_log_loss(*[F.col(c) for c in Q.MARKET], F.col("FTR"), scoring.MEAN_EPS)
    known = t.matches().filter(F.col("FTR").isNotNull())
    return rounded(known.groupBy("season").agg(F.avg(loss).alias("log_loss")))


@query(
    "q_brier",
    f"WITH {Q.MATCHES} SELECT {_r(f'avg({Q.brier(Q.MARKET)})', 'brier_score')} FROM matches",
)
def brier(t):
    return rounded(scoring.mean_brier(t.matches(), scoring.MARKET_PROBS))


@query("q_pick", f"WITH {Q.MATCHES} SELECT match_id, {Q.pick(Q.MARKET)} AS pick FROM matches")
def pick(t):
    return t.matches().select("match_id", S.pick(*[F.col(c) for c in Q.MARKET]).alias("pick"))


@query(
    "q_accuracy",
    f"""WITH {Q.SCORED_ALL} SELECT {_r('''avg(CASE WHEN model_pick = "FTR" THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)''', 'accuracy')} FROM scored""",
)
def accuracy(t):
    return rounded(scoring.accuracy(_scored(t), scoring.MODEL_PROBS))


_SCORES = ("model_log_loss", "market_log_loss", "model_brier", "market_brier")


@query(
    "q_add_scores",
    f"WITH {Q.SCORED_ALL} SELECT match_id, {', '.join(_r(c, c, 9) for c in _SCORES)}, model_pick, market_pick FROM scored",
)
def add_scores(t):
    # Row scores are often exact decimals with a 5 in the seventh place; nine places avoid that tie.
    return rounded(_scored(t).select("match_id", *_SCORES, "model_pick", "market_pick"), 9)


_SUMMARY_SQL = f"""summary AS (SELECT count(*) AS matches, {', '.join(f'avg({c}) AS {c}' for c in _SCORES)},
  avg(CASE WHEN model_pick = "FTR" THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS model_accuracy,
  avg(CASE WHEN market_pick = "FTR" THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS market_accuracy FROM scored)"""


@query(
    "q_score_summary",
    f"""WITH {Q.SCORED_ALL}, {_SUMMARY_SQL} SELECT matches,
        {', '.join(_r(c, c) for c in (*_SCORES, 'model_accuracy', 'market_accuracy'))},
        {', '.join(_r(f'model_{m} - market_{m}', f'{m}_delta') for m in ('log_loss', 'brier', 'accuracy'))} FROM summary""",
)
def score_summary(t):
    return rounded(scoring.score_summary(_scored(t)))


@query(
    "q_losses_by_league",
    f"""WITH {Q.SCORED_ALL} SELECT "Div", {_r('avg(model_log_loss)', 'model_log_loss')}, {_r('avg(market_log_loss)', 'market_log_loss')},
        {_r('least(avg(model_log_loss), avg(market_log_loss))', 'lowest')},
        {_r('greatest(avg(model_log_loss), avg(market_log_loss))', 'highest')} FROM scored GROUP BY "Div" """,
)
def losses_by_league(t):
    return rounded(scoring.losses_by(_scored(t)))


def _calibration_sql() -> str:
    cases = " UNION ALL ".join(
        f"""SELECT '{source}' AS source, '{outcome}' AS outcome, {column} AS p,
        CASE WHEN "FTR" = '{outcome}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM scored"""
        for source, columns in (("model", Q.MODEL), ("market", Q.MARKET))
        for column, outcome in zip(columns, "HDA")
    )
    steps = " + ".join(f"CASE WHEN p > {k} * 0.1::DOUBLE THEN 1 ELSE 0 END" for k in range(1, 10))
    return f"""WITH {Q.SCORED_ALL}, cases AS ({cases}), binned AS (SELECT *, cast(1 + {steps} AS INTEGER) AS bin FROM cases)
    SELECT source, outcome, bin, {_r('avg(p)', 'predicted')}, {_r('avg(y)', 'observed')}, count(*) AS matches
    FROM binned GROUP BY ALL HAVING count(*) >= 10"""


@query("q_calibration", _calibration_sql().replace("GROUP BY ALL", "GROUP BY source, outcome, bin"))
def calibration(t):
    return rounded(scoring.calibration(_scored(t)))


_TRAIN_TEST = f"""{Q.MATCHES}, last AS (SELECT max(season) AS s FROM matches),
train AS (SELECT * FROM matches WHERE season < (SELECT s FROM last) AND "FTR" IS NOT NULL),
test AS (SELECT * FROM matches WHERE season = (SELECT s FROM last) AND "FTR" IS NOT NULL),
priors AS (SELECT {', '.join(f"avg(CASE WHEN \"FTR\" = '{o}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS prior_{o}" for o in "HDA")} FROM train)"""
_PRIORS = ("prior_H", "prior_D", "prior_A")


@query(
    "q_class_priors",
    f"WITH {_TRAIN_TEST} SELECT match_id, {', '.join(_r(p, p) for p in _PRIORS)} FROM test CROSS JOIN priors",
)
def class_priors(t):
    train, test = folds.season_holdout(t.matches())
    known = test.filter(F.col("FTR").isNotNull()).select("match_id")
    return rounded(scoring.with_priors(known, train))


@query(
    "q_prior_baseline",
    f"""WITH {_TRAIN_TEST} SELECT count(*) AS matches, {_r(f'avg({Q.log_loss(_PRIORS, EPS)})', 'log_loss')},
        {_r(f'avg({Q.brier(_PRIORS)})', 'brier_score')} FROM test CROSS JOIN priors""",
)
def prior_baseline(t):
    return rounded(scoring.prior_baseline(*folds.season_holdout(t.matches())))


@query(
    "q_majority_baseline",
    f"""WITH {_TRAIN_TEST}, top AS (SELECT "FTR" AS majority FROM train GROUP BY "FTR" ORDER BY count(*) DESC, 1 DESC LIMIT 1)
        SELECT majority, {_r('''avg(CASE WHEN "FTR" = majority THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)''', 'accuracy')}
        FROM test CROSS JOIN top GROUP BY majority""",
)
def majority_baseline(t):
    return rounded(scoring.majority_accuracy(*folds.season_holdout(t.matches())))


@query(
    "q_gap_closed",
    f"""WITH {Q.SCORED_ALL}, p AS (SELECT {', '.join(f"avg(CASE WHEN \"FTR\" = '{o}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS prior_{o}" for o in "HDA")} FROM scored),
        m AS (SELECT avg({Q.log_loss(_PRIORS, EPS)}) AS naive, avg(model_log_loss) AS model, avg(market_log_loss) AS market FROM scored CROSS JOIN p)
        SELECT {_r('naive', 'naive')}, {_r('model', 'model')}, {_r('market', 'market')}, {_r('(naive - model) / (naive - market)', 'gap_closed', 4)} FROM m""",
)
def gap_closed(t):
    scored = _scored(t)
    probs = [F.col(p) for p in _PRIORS]
    means = scoring.with_priors(scored, scored).agg(
        F.avg(S.row_log_loss(*probs, F.col("FTR"), scoring.MEAN_EPS)).alias("naive"),
        F.avg("model_log_loss").alias("model"),
        F.avg("market_log_loss").alias("market"),
    )
    share = scoring.gap_closed(F.col("naive"), F.col("model"), F.col("market"))
    return rounded(means.withColumn("gap_closed", F.round(share, 4)))


@query(
    "q_market_baseline",
    f"""WITH {Q.MATCHES}, kept AS (SELECT *, row_number() OVER (ORDER BY match_id) AS n, count(*) OVER () AS total
          FROM matches WHERE "FTR" IS NOT NULL AND market_home_prob_fair IS NOT NULL)
        SELECT count(*) AS match_count, '80%' AS start_percentile, '100%' AS end_percentile,
          round(avg({Q.log_loss(Q.MARKET, EPS)}), 4) AS market_log_loss, round(avg({Q.brier(Q.MARKET)}), 4) AS market_brier_score
        FROM kept WHERE n > cast(floor(total * 0.8::DOUBLE) AS BIGINT) AND n <= cast(floor(total * 1.0::DOUBLE) AS BIGINT)""",
)
def market_baseline(t):
    return scoring.market_baseline(t.matches())


@query(
    "q_cumulative_advantage",
    f"""WITH {Q.SCORED_ALL} SELECT match_id, kickoff, round(sum(market_log_loss - model_log_loss)
        OVER (ORDER BY kickoff NULLS LAST, match_id ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS cumulative_advantage FROM scored""",
)
def cumulative_advantage(t):
    return rounded(
        scoring.cumulative_advantage(_scored(t)).select("match_id", "kickoff", "cumulative_advantage")
    )


@query(
    "q_latest_matches",
    f"""WITH {Q.SCORED_ALL} SELECT match_id, kickoff, "HomeTeam" || ' vs ' || "AwayTeam" AS "Match", "FTR",
        {_r('model_log_loss', 'model_log_loss')} FROM scored ORDER BY kickoff DESC NULLS LAST, match_id""",
)
def latest_matches(t):
    return rounded(
        scoring.match_log(_scored(t)).select("match_id", "kickoff", "Match", "FTR", "model_log_loss")
    )


_ORDERED = f"""{Q.MATCHES}, kept AS (SELECT match_id, kickoff, "FTR", row_number() OVER (ORDER BY kickoff NULLS LAST, match_id) AS n,
  count(*) OVER () AS total FROM matches WHERE "FTR" IS NOT NULL)"""


def _known(t):
    return complete_rows(t.matches(), ["FTR"]).select("match_id", "kickoff", "FTR")


@query(
    "q_temporal_split",
    f"""WITH {_ORDERED} SELECT match_id, CASE WHEN n <= cast(floor(total * 0.8::DOUBLE) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM kept""",
)
def temporal_split(t):
    train, test = ordering.temporal_split(_known(t), 0.8, ("kickoff", "match_id"))
    named = [df.select("match_id", F.lit(part).alias("part")) for df, part in ((train, "train"), (test, "test"))]
    return named[0].unionByName(named[1])


@query(
    "q_temporal_slice",
    f"""WITH {_ORDERED} SELECT match_id, kickoff FROM kept
        WHERE n > cast(floor(total * 0.25::DOUBLE) AS BIGINT) AND n <= cast(floor(total * 0.7::DOUBLE) AS BIGINT)""",
)
def temporal_slice(t):
    return ordering.temporal_slice(_known(t), 0.25, 0.7, ("kickoff", "match_id")).select("match_id", "kickoff")


@query(
    "q_season_holdout",
    f"""WITH {_TRAIN_TEST} SELECT match_id, season, CASE WHEN season = (SELECT s FROM last) THEN 'test' ELSE 'train' END AS part FROM matches""",
)
def season_holdout(t):
    train, test = folds.season_holdout(t.matches().select("match_id", "season"))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
