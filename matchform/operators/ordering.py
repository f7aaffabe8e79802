"""Positions, running sums and bounded look-back over orders of any size.

A plain window puts each group into one task and is lazy; it is what a caller gets. A caller whose
groups are larger than a task should bear says ``hot=True``: the rows are then range sorted on the
whole key (so a hot group spreads over many tasks), numbered, and cut into blocks of equal size;
windows run inside blocks and small per-block totals carry the rest over. Nothing is measured and
nothing switches by itself. Both ways give the same rows; sums of doubles are added block by block,
in the same order whenever the blocks are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from matchform.session import checkpointed

BLOCK_ROWS = 1_000_000

_ROW_MASK = (1 << 33) - 1
_POSITION = "__position"
_BLOCK = "__block"
_OWN_BLOCK = "__own_block"
_GROUP = "__group"


def ascending(*names: str) -> list[Column]:
    """Ascending sort keys with missing values last."""
    return [F.col(name).asc_nulls_last() for name in names]


@dataclass(frozen=True)
class Placed:
    """Rows with their 1-based position in a total order, and how many there are."""

    rows: DataFrame
    total: int
    column: str


def place(df: DataFrame, order: Sequence[Column], column: str = _POSITION) -> Placed:
    """Number all rows by ``order`` with one range shuffle and no global window.

    ``order`` must end in a unique column. The sorted rows go to the checkpoint folder first:
    a row's number is its partition's offset plus its place inside the partition, and both
    must not change when a task is run again. Only one count per partition reaches the driver.
    """
    ranked = checkpointed(df.orderBy(*order)).select(
        "*",
        F.spark_partition_id().alias("__part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_MASK)).alias("__row"),
    )
    counts = {row["__part"]: row["count"] for row in ranked.groupBy("__part").count().collect()}
    offsets, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(part, 0)
    start = F.get(F.array(*map(F.lit, offsets)), F.col("__part")) if offsets else F.lit(0)
    rows = ranked.withColumn(column, (start + F.col("__row") + 1).cast("bigint"))
    return Placed(rows.drop("__part", "__row"), total, column)


def with_lookback(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lookback: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    hot: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Window columns that look at most ``lookback`` rows back within ``keys``.

    ``build`` receives the partitioned and ordered window and may only use frames (or ``lag``)
    that end at the current row and start no more than ``lookback`` rows before it.
    """
    if not hot:
        return df.withColumns(build(Window.partitionBy(*keys).orderBy(*ascending(*order))))
    return in_blocks(df, keys, order, lookback, build, block_rows)


def in_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lookback: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``with_lookback`` by blocks: the last rows of a block are repeated ahead of the next."""
    if block_rows <= lookback:
        raise ValueError("block_rows must exceed lookback")
    placed = place(df, ascending(*keys, *order)).rows
    index = F.col(_POSITION) - 1
    own = F.floor(index / F.lit(block_rows)).cast("bigint")
    in_tail = index % block_rows >= block_rows - lookback
    blocks = placed.withColumn(_OWN_BLOCK, own).withColumn(
        _BLOCK,
        F.explode(
            F.when(in_tail, F.array(F.col(_OWN_BLOCK), F.col(_OWN_BLOCK) + 1)).otherwise(
                F.array(F.col(_OWN_BLOCK))
            )
        ),
    )
    window = Window.partitionBy(_BLOCK, *keys).orderBy(_POSITION)
    return (
        blocks.withColumns(build(window))
        .filter(F.col(_BLOCK) == F.col(_OWN_BLOCK))
        .drop(_BLOCK, _OWN_BLOCK, _POSITION)
    )


@dataclass(frozen=True)
class Blocks:
    """Placed rows cut into blocks, with the group keys packed into one null-safe column."""

    rows: DataFrame
    window: WindowSpec

    def carried(self, totals: dict[str, Column]) -> DataFrame:
        """Per block and group, the sums over all earlier blocks of the same group."""
        before = (
            Window.partitionBy(_GROUP).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        )
        per_block = self.rows.groupBy(_BLOCK, _GROUP).agg(
            *[F.sum(term).alias(name) for name, term in totals.items()]
        )
        return per_block.select(
            _BLOCK, _GROUP, *[F.sum(name).over(before).alias(name) for name in totals]
        )


def cut_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block_rows: int = BLOCK_ROWS
) -> Blocks:
    """Sort, number and cut ``df``; windows on the result never exceed one block."""
    placed = place(df, ascending(*keys, *order)).rows
    group = F.struct(*[F.col(key) for key in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = placed.select(
        "*",
        F.floor((F.col(_POSITION) - 1) / F.lit(block_rows)).cast("bigint").alias(_BLOCK),
        group.alias(_GROUP),
    )
    return Blocks(rows, Window.partitionBy(_BLOCK, _GROUP).orderBy(_POSITION))


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    hot: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add inclusive running sums per group; without ``keys`` the whole table is one group, always in blocks."""
    if keys and not hot:
        window = (
            Window.partitionBy(*keys)
            .orderBy(*ascending(*order))
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        return df.withColumns({name: F.sum(term).over(window) for name, term in sums.items()})
    blocks = cut_blocks(df, keys, order, block_rows)
    offsets = blocks.carried({f"__before_{name}": term for name, term in sums.items()})
    window = blocks.window.rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocks.rows.join(offsets, [_BLOCK, _GROUP])
        .withColumns(
            {
                name: F.coalesce(F.col(f"__before_{name}"), F.lit(0)) + F.sum(term).over(window)
                for name, term in sums.items()
            }
        )
        .drop(_BLOCK, _GROUP, _POSITION, *[f"__before_{name}" for name in sums])
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    column: str,
    start: int = 1,
    hot: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Consecutive numbers per group, from ``start``.

    In the sorted order a group's rows lie together, so in blocks a number is the row's position
    minus its group's first one. Those come from one row per block and group; they are joined by
    block, never by the group alone.
    """
    if not hot:
        window = Window.partitionBy(*keys).orderBy(*ascending(*order))
        number = F.row_number().over(window).cast("bigint")
        return df.withColumn(column, number + F.lit(start - 1) if start != 1 else number)
    blocks = cut_blocks(df, keys, order, block_rows)
    first = F.min("__first").over(Window.partitionBy(_GROUP))
    firsts = (
        blocks.rows.groupBy(_BLOCK, _GROUP)
        .agg(F.min(_POSITION).alias("__first"))
        .select(_BLOCK, _GROUP, first.alias("__first"))
    )
    return (
        blocks.rows.join(firsts, [_BLOCK, _GROUP])
        .withColumn(column, F.col(_POSITION) - F.col("__first") + F.lit(start))
        .drop(_BLOCK, _GROUP, _POSITION, "__first")
    )


def global_order(df: DataFrame, order: Sequence[str], column: str = "match_id") -> DataFrame:
    """Renumber all rows 1..N by ``order``; ``column`` may itself be one of the sort keys."""
    placed = place(df, ascending(*order), "__new_id").rows
    return placed.drop(column).withColumnRenamed("__new_id", column)


def chronological_number(
    df: DataFrame, moment: str, then: Sequence[str], column: str, hot: bool = False
) -> DataFrame:
    """Number all rows 1..N by ``moment`` (missing last) and ``then``, without running anything yet.

    A row's number is its place among its day's rows plus the rows of all earlier days. Only one row
    per day (and per first tie-break value of rows without a moment) is ordered in one place, and these
    are broadcast, so the rows move once. With ``hot``
    a day may hold any share of the rows: they are range sorted on the whole key, and that runs at once.
    """
    if hot:
        return global_order(df, (moment, *then), column)
    day = F.to_date(moment)
    undated = F.when(F.col(moment).isNull(), F.col(then[0]).cast("string"))
    rows = df.withColumns({"__day": day, "__undated": undated})
    before = Window.orderBy(*ascending("__day", "__undated")).rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("__day", "__undated").agg(F.count("*").alias("__rows"))
    offsets = days.select(
        F.col("__day").alias("__of"), F.col("__undated").alias("__of_undated"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before")
    )
    place_of_day = F.row_number().over(Window.partitionBy("__day", "__undated").orderBy(*ascending(moment, *then)))
    same = F.col("__day").eqNullSafe(F.col("__of")) & F.col("__undated").eqNullSafe(F.col("__of_undated"))
    return (
        rows.withColumn("__place", place_of_day)
        .join(F.broadcast(offsets), same)
        .withColumn(column, (F.col("__before") + F.col("__place")).cast("bigint"))
        .drop("__day", "__undated", "__of", "__of_undated", "__before", "__place")
    )


# A cut is looked for among this many parts of the leading sort key's range; so many counts reach the driver.
PARTS = 4096


@dataclass(frozen=True)
class Cut:
    """How many rows there are, and the sort keys of the last row of a leading part of them."""

    total: int
    last: tuple | None

    def leading(self, order: Sequence[str]) -> Column:
        """Whether a row lies in the leading part; missing values come last in every key."""
        if self.last is None:
            return F.lit(False)
        before, tied = F.lit(False), F.lit(True)
        for name, value in zip(order, self.last):
            column, bound = F.col(name), F.lit(value)
            less = column.isNotNull() if value is None else F.coalesce(column < bound, F.lit(False))
            before = before | (tied & less)
            tied = tied & column.eqNullSafe(bound)
        return before | tied


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
_PART = "__part"


def _measure(name: str, kind: str) -> Column | None:
    """The leading key as a number in the same order (not strictly), or None for kinds that have none."""
    if kind.startswith(NUMBERS):
        return F.col(name).cast("double")
    if kind.startswith(("timestamp", "date")):
        return F.datediff(F.to_date(name), F.lit("1970-01-01")).cast("double")
    return None


def _by_part(keys: DataFrame, measure: Column) -> tuple[DataFrame, dict]:
    """The keys with a part of the leading one's range, and the rows of every part."""
    finite = measure.isNotNull() & (measure > float("-inf")) & (measure < float("inf"))
    low, high = keys.agg(F.min(F.when(finite, measure)), F.max(F.when(finite, measure))).first()
    width = ((high - low) / PARTS or 1.0) if low is not None else 1.0
    inside = F.least(F.floor((measure - F.lit(low or 0.0)) / F.lit(width)), F.lit(PARTS - 1))
    # Before all: minus infinity; behind all: infinity, then NaN, then missing keys.
    part = (
        F.when(measure.isNull(), PARTS + 2).when(F.isnan(measure), PARTS + 1).when(finite, inside)
        .when(measure > 0, PARTS).otherwise(-1).cast("int")
    )
    parted = keys.withColumn(_PART, part)
    return parted, {row[_PART]: row["count"] for row in parted.groupBy(_PART).count().collect()}


def find_cuts(df: DataFrame, order: Sequence[str], places: Callable[[int], Sequence[int]]) -> list[Cut]:
    """The cuts after the row numbers that ``places`` gives for the number of rows.

    The sort keys are written once, so the source runs once. Rows are counted in equal parts of the leading key's
    range (at most 4096 counts reach the driver, whatever the key), and only the part that holds a cut is sorted; a
    key without a measure, like a text, is sorted as a whole, over all tasks. ``order`` ends in a unique key.
    """
    keys = checkpointed(df.select(*order))
    measure = _measure(order[0], dict(df.dtypes)[order[0]])
    if measure is None:
        parted, counts = keys.withColumn(_PART, F.lit(0)), {0: keys.count()}
    else:
        parted, counts = _by_part(keys, measure)
    total, cuts, sorted_parts = sum(counts.values()), [], {}
    for wanted in places(total):
        seen, last = 0, None
        for part in sorted(counts):
            if 0 < wanted <= seen + counts[part]:
                if part not in sorted_parts:
                    sorted_parts[part] = place(parted.filter(F.col(_PART) == part).select(*order), ascending(*order))
                placed = sorted_parts[part]
                last = tuple(placed.rows.filter(F.col(placed.column) == wanted - seen).select(*order).first())
                break
            seen += counts[part]
        cuts.append(Cut(total, last))
    return cuts


def temporal_split(
    df: DataFrame, fraction: float, order: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """The first ``int(n * fraction)`` rows by ``order``, and the rest: two filters of ``df``."""
    if not 0 < fraction < 1:
        raise ValueError("the leading share must lie strictly between 0 and 1")
    (cut,) = find_cuts(df, order, lambda total: [int(total * fraction)])
    return df.filter(cut.leading(order)), df.filter(~cut.leading(order))


def temporal_slice(df: DataFrame, start: float, end: float, order: Sequence[str]) -> DataFrame:
    """Rows ``[int(n * start), int(n * end))`` by ``order``, as a filter; an empty slice is an error."""
    if not 0 <= start < end <= 1:
        raise ValueError("a slice needs shares with 0 <= start < end <= 1")
    first, last = find_cuts(df, order, lambda total: [int(total * start), int(total * end)])
    if int(first.total * start) >= int(first.total * end):
        raise ValueError(f"there are no rows between the shares {start} and {end}")
    return df.filter(last.leading(order) & ~first.leading(order))
