"""Flat-stake strategies over scored matches.

The rules are not published in full. What was filled in is all here: matches without best odds
are not bet; the largest edge or expected value wins with ties in H, D, A order; thresholds are
inclusive; a winning bet earns ``stake * (odds - 1)``, a losing one costs the stake; profits
accumulate by kickoff and match; drawdown is measured from the running peak, which starts at 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchform.functions import scalars as S
from matchform.operators.ordering import ascending, cut_blocks, running_sums
from matchform.operators.scoring import MARKET_PROBS, MODEL_PROBS
from matchform.session import checkpointed

BEST_ODDS = ("best_odds_home", "best_odds_draw", "best_odds_away")
FAVOURITE = "Model favourite"
VALUE_EDGE = "Value edge"
POSITIVE_EV = "Positive expected value"
STRATEGIES = (FAVOURITE, VALUE_EDGE, POSITIVE_EV)

BET_COLUMNS = ("match_id", "kickoff", "Div", "HomeTeam", "AwayTeam", "pick", "FTR", "odds")
PNL_ORDER = ("kickoff", "match_id")


def _with_odds(scored: DataFrame) -> DataFrame:
    return scored.dropna(subset=list(BEST_ODDS))


def _odds_of(pick: Column) -> Column:
    home, draw, away = [F.col(name) for name in BEST_ODDS]
    return F.when(pick == "H", home).when(pick == "D", draw).otherwise(away)


@dataclass(frozen=True)
class Rule:
    """What a strategy bets on a match, and whether it bets at all."""

    pick: Column
    keep: Column


def favourite() -> Rule:
    """The model's pick of every match."""
    return Rule(S.pick(*[F.col(name) for name in MODEL_PROBS]), F.lit(True))


def value_edge(edge_threshold: float = 0.05) -> Rule:
    """The outcome whose model probability exceeds the market's most, if by enough."""
    edges = [F.col(model) - F.col(market) for model, market in zip(MODEL_PROBS, MARKET_PROBS)]
    return Rule(S.pick(*edges), F.greatest(*edges) >= F.lit(edge_threshold))


def positive_ev(ev_threshold: float = 0.0) -> Rule:
    """The outcome with the largest ``probability * odds - 1``, if large enough."""
    values = [F.col(model) * F.col(odds) - 1.0 for model, odds in zip(MODEL_PROBS, BEST_ODDS)]
    return Rule(S.pick(*values), F.greatest(*values) >= F.lit(ev_threshold))


def place_bets(scored: DataFrame, rule: Rule) -> DataFrame:
    """One strategy's bets."""
    return (
        _with_odds(scored)
        .filter(rule.keep)
        .withColumn("pick", rule.pick)
        .withColumn("odds", _odds_of(F.col("pick")))
        .select(*BET_COLUMNS)
    )


def settle(bets: DataFrame, stake: float = 10.0) -> DataFrame:
    """Whether each bet won, and its profit."""
    won = F.col("pick") == F.col("FTR")
    gain = F.lit(stake) * (F.col("odds") - 1.0)
    return bets.withColumn("won", won).withColumn(
        "profit", F.when(won, gain).otherwise(F.lit(-stake))
    )


def settled_bets(
    scored: DataFrame, stake: float = 10.0, edge_threshold: float = 0.05, ev_threshold: float = 0.0
) -> DataFrame:
    """Settled bets of all strategies, stacked; the scored rows are read once for all of them."""
    rules = dict(
        zip(STRATEGIES, (favourite(), value_edge(edge_threshold), positive_ev(ev_threshold)))
    )
    choices = [
        F.when(
            rule.keep,
            F.struct(
                F.lit(name).alias("strategy"),
                rule.pick.alias("pick"),
                _odds_of(rule.pick).alias("odds"),
            ),
        )
        for name, rule in rules.items()
    ]
    others = [name for name in BET_COLUMNS if name not in ("pick", "odds")]
    bets = (
        _with_odds(scored)
        .select(*others, F.explode(F.array(*choices)).alias("bet"))
        .filter(F.col("bet").isNotNull())
        .select(*others, "bet.*")
    )
    return settle(bets, stake)


def cumulative_pnl(settled: DataFrame, **limits) -> DataFrame:
    """Running profit per strategy.

    A handful of strategies share all bets, so their groups are cut into blocks. The sort reads its input
    twice, so the bets are written first.
    """
    return running_sums(
        checkpointed(settled), ("strategy",), PNL_ORDER, {"cumulative_profit": F.col("profit")}, hot=True, **limits
    )


def bet_summary(settled: DataFrame, stake: float = 10.0, block_rows: int | None = None) -> DataFrame:
    """Bets, win rate, stakes, profit, return and largest fall from the peak, per strategy.

    The fall is merged from four numbers per day (sum, highest, lowest and inner fall of the day's own running
    sum), so days are summed where they lie and only one row per day is ordered across days. ``block_rows`` takes
    blocks of so many rows of the sorted bets in place of days, for days larger than a task should bear.
    """
    bets = settled.select("strategy", *PNL_ORDER, "won", "profit")
    if block_rows is None:
        parts = bets.withColumn("__block", F.to_date(PNL_ORDER[0]))
        window = Window.partitionBy("strategy", "__block").orderBy(*ascending(*PNL_ORDER))
    else:
        blocks = cut_blocks(checkpointed(bets), ("strategy",), PNL_ORDER, block_rows)
        parts, window = blocks.rows, blocks.window
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    inner = parts.withColumn("run", F.sum("profit").over(so_far)).withColumn("peak", F.max("run").over(so_far))
    block = inner.groupBy("__block", "strategy").agg(
        F.count("*").alias("bets"),
        F.sum(F.when(F.col("won"), 1).otherwise(0)).alias("wins"),
        F.sum("profit").alias("total"),
        F.max("run").alias("high"),
        F.min("run").alias("low"),
        F.max(F.col("peak") - F.col("run")).alias("fall"),
    )
    before = Window.partitionBy("strategy").orderBy(*ascending("__block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = block.withColumn("offset", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    carried = carried.withColumn(
        "peak_before",
        F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("offset") + F.col("high")).over(before), F.lit(0.0))),
    )
    deepest = F.greatest(F.col("fall"), F.col("peak_before") - F.col("offset") - F.col("low"), F.lit(0.0))
    found = carried.groupBy("strategy").agg(
        F.sum("bets").alias("bets"),
        F.sum("wins").alias("wins"),
        F.sum("total").alias("total_profit"),
        F.max(deepest).alias("max_drawdown"),
    )
    names = settled.sparkSession.createDataFrame([(name,) for name in STRATEGIES], "strategy string")
    staked = F.lit(float(stake)) * F.col("bets")
    return (
        names.join(found, "strategy", "left")
        .na.fill(0, ["bets", "wins"])
        .na.fill(0.0, ["total_profit", "max_drawdown"])
        .select(
            "strategy",
            "bets",
            F.try_divide(F.col("wins").cast("double"), F.col("bets").cast("double")).alias("win_rate"),
            staked.alias("total_staked"),
            "total_profit",
            F.try_divide(F.col("total_profit"), staked).alias("roi"),
            "max_drawdown",
        )
    )


def pnl_long(cumulative: DataFrame) -> DataFrame:
    """Running profit in long form."""
    return cumulative.select("kickoff", "strategy", "match_id", "cumulative_profit")
