"""Scalar expressions: dates, keys, prices, outcomes and seasons."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Day first, one or two digits each; surrounding and repeated blanks are accepted.
KICKOFF_PATTERN = r"^\s*(\d{1,2})/(\d{1,2})/(\d{1,4})\s+(\d{1,2}):(\d{1,2})\s*$"
ISO_DATE_PATTERN = r"^\s*\d{1,4}-\d{1,2}-\d{1,2}(\s*|[ T].*)$"
SEASON_YEAR_PATTERN = r"(\d{4})"

OUTCOMES = ("H", "D", "A")


def parse_kickoff(date: Column, time: Column) -> Column:
    """Naive timestamp from ``dd/MM/yyyy`` and ``HH:mm`` texts; NULL when it is not a real moment.

    Built from its parts, so the session time zone never touches the value.
    """
    text = F.concat(date, F.lit(" "), F.coalesce(time, F.lit("00:00")))
    numbers = F.split(F.regexp_replace(text, KICKOFF_PATTERN, "$3,$2,$1,$4,$5"), ",")
    year, month, day, hour, minute = [F.get(numbers, F.lit(i)).try_cast("int") for i in range(5)]
    return F.call_function("try_make_timestamp_ntz", year, month, day, hour, minute, F.lit(0))


def lenient_date(text: Column) -> Column:
    """Date from an ISO text; NULL instead of an error, and NULL for a bare year."""
    return F.when(text.rlike(ISO_DATE_PATTERN), text.try_cast("date"))


def match_key(kickoff: Column, home_code: Column, away_code: Column) -> Column:
    """``date_home_away`` with missing parts left empty."""
    return F.concat_ws(
        "", kickoff.cast("date").cast("string"), F.lit("_"), home_code, F.lit("_"), away_code
    )


def xg_key(date: Column, home_code: Column, away_code: Column) -> Column:
    """``date_home_away``; NULL as soon as one part is missing."""
    return F.concat(
        lenient_date(date).cast("string"), F.lit("_"), home_code, F.lit("_"), away_code
    )


def implied_prob(odds: Column) -> Column:
    """``1 / odds``; a price of zero gives infinity, as in IEEE arithmetic."""
    odds = odds.cast("double")
    return F.when(odds == 0.0, F.lit(float("inf"))).otherwise(F.lit(1.0) / odds)


def overround(home: Column, draw: Column, away: Column) -> Column:
    """Sum of three implied probabilities; the bookmaker's margin is this minus one."""
    return home + draw + away


def fair_probs(home: Column, draw: Column, away: Column) -> tuple[Column, Column, Column]:
    """The three implied probabilities with the margin removed."""
    total = overround(home, draw, away)
    return home / total, draw / total, away / total


def points(result: Column, venue: str) -> Column:
    """League points of one side; NULL for an unknown result."""
    won, lost = ("H", "A") if venue == "home" else ("A", "H")
    return F.when(result == won, 3).when(result == "D", 1).when(result == lost, 0).cast("bigint")


def rest_days(kickoff: Column, previous: Column) -> Column:
    """Days between two moments, with the fraction."""
    return (_micros(kickoff) - _micros(previous)) / F.lit(86_400_000_000.0)


def _micros(moment: Column) -> Column:
    # From the calendar parts: a naive timestamp has no zone to convert through.
    days = F.datediff(moment, F.lit("1970-01-01").cast("date")).cast("bigint")
    minutes = (days * 24 + F.hour(moment)) * 60 + F.minute(moment)
    seconds = F.extract(F.lit("SECOND"), moment).cast("decimal(8,6)")
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def difference(home: Column, away: Column) -> Column:
    """Home minus away; NULL when one side has no history."""
    return home - away


def season_year(season: Column) -> Column:
    """Start year of a season label: its first four digits. A label without any is an error."""
    text = season.cast("string")
    year = F.regexp_extract(text, SEASON_YEAR_PATTERN, 1)
    return F.when(text.isNull(), F.lit(None)).when(
        year == "", F.raise_error(F.concat(F.lit("no start year in season "), text))
    ).otherwise(year).cast("int")


def season_code(year: Column) -> Column:
    """``2019`` -> ``1920``."""
    return F.concat(_two_digits(year), _two_digits(year + 1))


def season_label(year: Column) -> Column:
    """``2019`` -> ``2019/20``."""
    return F.concat(year.cast("string"), F.lit("/"), _two_digits(year + 1))


def _two_digits(year: Column) -> Column:
    return F.lpad((year % 100).cast("string"), 2, "0")


def encode_outcome(result: Column) -> Column:
    """H, D, A as 0, 1, 2."""
    code = F.lit(None).cast("int")
    for index, outcome in reversed(list(enumerate(OUTCOMES))):
        code = F.when(result == outcome, F.lit(index)).otherwise(code)
    return code


def pick(home: Column, draw: Column, away: Column) -> Column:
    """Most probable outcome; ties go to the first of H, D, A."""
    return (
        F.when((home >= draw) & (home >= away), F.lit("H"))
        .when(draw >= away, F.lit("D"))
        .otherwise(F.lit("A"))
    )


def normalised(home: Column, draw: Column, away: Column) -> tuple[Column, Column, Column]:
    """Three probabilities rescaled to sum to one."""
    return fair_probs(home, draw, away)


def row_log_loss(
    home: Column, draw: Column, away: Column, result: Column, eps: float = 1e-15
) -> Column:
    """Minus log of the probability given to what happened, clipped to ``[eps, 1]``."""
    chosen = F.when(result == "H", home).when(result == "D", draw).when(result == "A", away)
    share = chosen / overround(home, draw, away)
    return -F.ln(F.greatest(F.least(share, F.lit(1.0)), F.lit(eps)))


def row_brier(home: Column, draw: Column, away: Column, result: Column) -> Column:
    """Squared distance between the three probabilities and the outcome's indicator."""
    total = None
    for prob, outcome in zip(normalised(home, draw, away), OUTCOMES):
        gap = prob - F.when(result == outcome, F.lit(1.0)).otherwise(F.lit(0.0))
        total = gap * gap if total is None else total + gap * gap
    return F.when(result.isNotNull(), total)
