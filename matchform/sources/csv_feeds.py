"""CSV feeds: one file per league and season, each with its own header."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from matchform.functions.fixed_values import XG_PREFIXES
from matchform.operators.reshape import union_by_name
from matchform.sources.files import by_first_line, missing

ENCODING = "ISO-8859-1"
# A UTF-8 byte-order mark as it reads in the feeds' own encoding, and as itself.
BYTE_ORDER_MARKS = ("ï»¿", "﻿")

COUNT_COLUMNS = ("FTHG", "FTAG", "HS", "AS", "HST", "AST", "HF", "AF", "HC", "AC", "HY", "AY", "HR", "AR")
PRICE_COLUMNS = ("AvgH", "AvgD", "AvgA", "MaxH", "MaxD", "MaxA")
TEXT_COLUMNS = ("Div", "Date", "Time", "HomeTeam", "AwayTeam", "FTR", "Referee")
MATCH_COLUMNS = (*TEXT_COLUMNS, *COUNT_COLUMNS, *PRICE_COLUMNS)

XG_COLUMNS = ("date", "home_team", "away_team", "home_team_code", "away_team_code", "home_xg", "away_xg")


def _file_part(group: int) -> Column:
    """Of a file's path its folder's name (1) or its own without the ending (2)."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/([^/]+)\.csv$", group)


def season_codes(start: int, end: int) -> list[str]:
    """``19, 21`` -> ``["1920", "2021"]``; the end is not included."""
    return [f"{year % 100:02d}{(year + 1) % 100:02d}" for year in range(start, end)]


def season_label(code: str) -> str:
    """``1920`` -> ``2019/20``."""
    return f"20{code[:2]}/{code[2:]}"


def check_season(code: str | int) -> str:
    """The code as text, if it has four digits."""
    text = str(code)
    if len(text) != 4 or not text.isdigit():
        raise ValueError(f"a season code has four digits, like 2526; got {text!r}")
    return text


def _clean_header(names: Sequence[str]) -> list[str]:
    cleaned = []
    for name in names:
        for mark in BYTE_ORDER_MARKS:
            name = name.removeprefix(mark)
        cleaned.append(name)
    return cleaned


def _read_by_header(spark: SparkSession, paths: Sequence[str], tags: dict[str, Column]) -> DataFrame:
    """Read files with one scan per header shape, stacked by name, with the columns ``tags``.

    Reading all of them at once would give every file the first one's header. Tags are expressions
    over the file's path.
    """
    if lost := missing(spark, paths):
        raise FileNotFoundError(f"no such feed file: {', '.join(lost[:5])}")
    frames = []
    for shape in by_first_line(spark, paths):
        frame = spark.read.csv(shape, header=True, encoding=ENCODING, enforceSchema=False)
        frame = frame.toDF(*_clean_header(frame.columns))
        frames.append(frame.select("*", *[tag.alias(name) for name, tag in tags.items()]))
    return union_by_name(frames)


def _count(column: Column) -> Column:
    # Counts of a file with gaps may be written as decimals.
    return F.coalesce(column.try_cast("bigint"), column.try_cast("double").try_cast("bigint"))


def _typed(df: DataFrame, wanted: Sequence[str], counts: Sequence[str], prices: Sequence[str]) -> list[Column]:
    columns = []
    for name in wanted:
        value = F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")
        if name in counts:
            value = _count(value)
        elif name in prices:
            value = value.try_cast("double")
        columns.append(value.alias(name))
    return columns


def read_matches(
    spark: SparkSession, root: str, leagues: Sequence[str], seasons: Sequence[str | int], keep_all: bool = False
) -> DataFrame:
    """Match files ``root/<league>/<season>.csv`` with ``league``, ``season`` and typed columns.

    ``keep_all`` also keeps the columns the feature build does not use, as text. Every line with a field
    is a row; the reader itself skips blank lines.
    """
    files = [f"{root}/{league}/{code}.csv" for league in leagues for code in map(check_season, seasons)]
    if not files:
        raise ValueError("a match feed needs at least one league and one season")
    code = _file_part(2)
    label = F.concat(F.lit("20"), F.substring(code, 1, 2), F.lit("/"), F.substring(code, 3, 2))
    df = _read_by_header(spark, files, {"league": _file_part(1), "season": label})
    typed = _typed(df, MATCH_COLUMNS, COUNT_COLUMNS, PRICE_COLUMNS)
    others = [F.col(f"`{c}`") for c in df.columns if c not in (*MATCH_COLUMNS, "league", "season")]
    return df.select(*typed, *(others if keep_all else []), "league", "season")


def read_xg(spark: SparkSession, root: str, leagues: Sequence[str], start: int, end: int) -> DataFrame:
    """xG files ``root/<prefix>/<prefix>_<season>.csv`` of the given leagues, tagged with the league."""
    unknown = [league for league in leagues if league not in XG_PREFIXES]
    if unknown:
        raise ValueError(f"no xG feed is known for {', '.join(unknown)}; there is one for {', '.join(XG_PREFIXES)}")
    files = [f"{root}/{p}/{p}_{code}.csv" for p in map(XG_PREFIXES.get, leagues) for code in season_codes(start, end)]
    if not files:
        raise ValueError("an xG feed needs at least one league and one season")
    by_prefix = F.create_map(*[F.lit(x) for league in leagues for x in (XG_PREFIXES[league], league)])
    df = _read_by_header(spark, files, {"league": by_prefix[_file_part(1)]})
    return df.select(*_typed(df, XG_COLUMNS, (), ("home_xg", "away_xg")), "league")


def write_xg(df: DataFrame, path: str) -> int:
    """Replace the combined xG table at ``path`` and return its row count."""
    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").csv(path, header=True)
    return seen.get["rows"]


def load_xg(spark: SparkSession, path: str) -> DataFrame:
    """The combined xG table."""
    df = spark.read.csv(path, header=True)
    return df.select(*_typed(df, XG_COLUMNS, (), ("home_xg", "away_xg")), "league")
