"""Aggregates, coverage and fold losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchform.catalog import sql_common as Q
from matchform.catalog.registry import query, rounded
from matchform.operators import assemble, folds, history, reshape, scoring, summaries

# Feature groups over columns the test matches have, with quite different coverage.
GROUPS = {
    "teams": ("HomeTeam", "AwayTeam", "Div"),
    "shots": ("HS", "AS", "HST", "AST"),
    "home_shots": ("HS", "HST"),
    "referee": ("Referee", "HomeTeam"),
}


def _used_sql() -> str:
    parts = []
    for name, columns in GROUPS.items():
        present = " AND ".join(f'"{c}" IS NOT NULL' for c in ("FTR", "season", *columns))
        parts.append(f"SELECT '{name}' AS grouping, count(*) FILTER ({present}) AS matches_used FROM raw_measures")
    return " UNION ALL ".join(parts)


USED = f"{Q.RAW}, {Q.MEASURES}, used AS ({_used_sql()})"


@query(
    "q_kpis",
    f"""WITH {Q.RAW} SELECT count(*) AS matches, count(DISTINCT season) AS seasons, count(DISTINCT "Div") AS leagues,
        round(avg(CASE WHEN "FTR" = 'H' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS home_win_rate FROM raw""",
)
def kpis(t):
    return rounded(summaries.kpis(t.raw()))


@query("q_rows_used_per_group", f"WITH {USED} SELECT * FROM used")
def rows_used_per_group(t):
    return summaries.matches_used(t.raw_with_measures(), GROUPS)


@query(
    "q_coverage_flag",
    f"""WITH {USED} SELECT min(matches_used) AS lowest, max(matches_used) AS highest,
        CASE WHEN min(matches_used) < 0.9 * max(matches_used) THEN 'warn'
             WHEN min(matches_used) < max(matches_used) THEN 'note' ELSE 'even' END AS flag FROM used""",
)
def coverage_flag(t):
    return summaries.coverage_flag(summaries.matches_used(t.raw_with_measures(), GROUPS))


@query(
    "q_coverage_gap",
    f"""WITH {Q.MATCHES}, {Q.XG}, {Q.sides(measures=False)},
        f AS (SELECT match_id, avg(points) {Q.over(Q.FORM, 5)} AS home_points_last_5, venue FROM history)
        SELECT count(*) AS rows FROM f LEFT JOIN xg USING (match_id)
        WHERE f.venue = 'home' AND home_xg IS NULL AND home_points_last_5 IS NOT NULL""",
)
def coverage_gap(t):
    means = {"points_last_5": ("points", 5)}
    sides = history.rolling_mean(
        reshape.result_sides(t.matches()), history.FORM_KEYS, history.EVENT_ORDER, means
    )
    table = assemble.rejoin_sides(t.matches().select("season", "league", "match_id"), sides, tuple(means))
    return summaries.coverage_gap(
        table.join(t.xg().select("match_id", "home_xg"), "match_id", "left"), "home_xg", "home_points_last_5"
    )


# Losses per league stand in for those of feature groups: one value per league and season.
LOSSES = f"""{Q.SCORED_ALL}, ranked AS (SELECT DISTINCT season, dense_rank() OVER (ORDER BY season) AS n,
  (SELECT count(DISTINCT season) FROM scored) AS total FROM scored),
fold_losses AS (
  SELECT "Div" AS grouping, s.season AS validation_season, avg(model_log_loss) AS log_loss
  FROM scored s JOIN ranked r ON s.season = r.season WHERE r.n > 2 AND r.n < r.total GROUP BY ALL
)"""


def _cv_summary(t):
    scored = scoring.add_scores(t.predictions())
    valid = folds.fold_relation(scored, 2, 1).filter("role = 'validation'").select("season")
    means = scored.join(valid, "season").groupBy("Div", "season").agg(F.avg("model_log_loss").alias("loss"))
    ordered = F.array_sort(F.collect_list(F.struct("season", "loss")))
    return means.groupBy(F.col("Div").alias("grouping")).agg(ordered.alias("all")).select(
        "grouping",
        F.col("all.season").alias("validation_seasons"),
        F.col("all.loss").alias("fold_log_losses"),
    )


@query(
    "q_fold_losses_long",
    f"WITH {LOSSES} SELECT grouping, validation_season, round(log_loss, 6) AS log_loss FROM fold_losses",
)
def fold_losses_long(t):
    return rounded(reshape.fold_losses(_cv_summary(t)))


@query(
    "q_fold_mean_loss",
    f"WITH {LOSSES} SELECT grouping, round(avg(log_loss), 6) AS mean_log_loss FROM fold_losses GROUP BY grouping",
)
def fold_mean_loss(t):
    return rounded(summaries.cv_mean(reshape.fold_losses(_cv_summary(t))))


@query(
    "q_best_group",
    f"""WITH {LOSSES} SELECT grouping, round(avg(log_loss), 6) AS mean_log_loss FROM fold_losses GROUP BY grouping
        ORDER BY avg(log_loss), grouping LIMIT 1""",
)
def best_group(t):
    return rounded(summaries.best_group(summaries.cv_mean(reshape.fold_losses(_cv_summary(t)))))
