"""Match logs from web pages: tables (also commented-out ones), comments, links and cleaning."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from matchform.operators.filters import clean_log, filter_competition, played_only
from matchform.session import checkpointed

# Columns of a match log, in their published order.
EXPECTED_COLUMNS = (
    "Date", "Time", "Comp", "Round", "Day", "Venue", "Result", "GF", "GA",
    "Opponent", "xG", "xGA", "Poss", "Attendance", "Captain", "Formation",
    "Opp Formation", "Referee", "Match Report", "Notes",
)
LOG_COLUMNS = ("Season", "Team", *EXPECTED_COLUMNS)
NEEDED_COLUMNS = ("Date", "Opponent", "Result")

CELL_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("table_no", T.IntegerType()),
        T.StructField("table_id", T.StringType()),
        T.StructField("in_comment", T.BooleanType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("header", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

ROWS_PER_FRAME = 10_000

LOG_SCHEMA = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("row", T.IntegerType())]
    + [T.StructField(name, T.StringType()) for name in LOG_COLUMNS]
)

COMMENT_PATTERN = r"(?s)<!--(.*?)-->"
HIDDEN_PATTERN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
# An address may stand in double quotes, in single ones or in none.
LINK_PATTERN = r"""(?is)<a\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?</a>"""
TAG_PATTERN = r"""(?s)</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>"""
HREF_PATTERN = r"""(?is)^<a\b(?:[^>"']|"[^"]*"|'[^']*')*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


# Splits a page into texts and, between them, what the parser looks at: comments, scripts, styles and tags of tables.
_SPLIT = re.compile(
    r"""(?is)(<(?:/?t(?:[rdh]|able|head|body|foot)\b(?:[^>"']+|"[^"]*"|'[^']*')*+>"""
    r"""|!--.*?(?:-->|\Z)|script\b.*?</script\s*>|style\b.*?</style\s*>))"""
)
_NAME = re.compile(r"(?i)</?([a-z]+)(.*)>\Z", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?i)\b(id|colspan|rowspan)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_TAG = re.compile(r"<[^>]*>")
CLOSING, OPENING, HIDDEN = range(3)


class Token(NamedTuple):
    """A tag as the parser needs it; equal tags are read once."""

    kind: int
    name: str
    id: str | None = None
    span: int = 1
    down: int = 1


@lru_cache(maxsize=1 << 14)
def _token(text: str) -> Token:
    name, attributes = _NAME.match(text).groups()
    name = name.lower()
    if name in ("script", "style"):
        return Token(HIDDEN, name)
    if text[1] == "/":
        return Token(CLOSING, name)
    found = {key.lower(): one or two or three for key, one, two, three in _ATTRIBUTE.findall(attributes)}
    return Token(OPENING, name, found.get("id"), _span(found.get("colspan")), _span(found.get("rowspan")))


def _span(value: str | None) -> int:
    return max(int(value), 1) if value and value.isdigit() else 1


class Cell:
    """A cell with the numbers of the texts between its tags."""

    __slots__ = ("tag", "places")

    def __init__(self, tag: Token):
        self.tag, self.places = tag, []

    def text(self, texts: Sequence[str]) -> str:
        whole = texts[self.places[0]] if len(self.places) == 1 else "".join([texts[p] for p in self.places])
        return _kept_plain(whole) if len(whole) <= KEPT_TEXT else _plain(whole)


def _plain(text: str) -> str:
    """A cell's text without tags, character references and runs of white space."""
    if "<" in text:
        text = _TAG.sub("", text)
    return " ".join((unescape(text) if "&" in text else text).split())


# Names and short values recur from page to page.
KEPT_TEXT = 32
_kept_plain = lru_cache(maxsize=1 << 14)(_plain)


class Table:
    """A table's rows as (part, cells); ``part`` is thead, tbody, tfoot or None."""

    __slots__ = ("id", "rows", "part", "cell")

    def __init__(self, id: str | None):
        self.id, self.rows, self.part, self.cell = id, [], None, None


# What stands for a comment among the tags, whatever it says.
_COMMENT = "<!-->"
# Pages of up to so many tags are read by a layout that is kept for the next page with the same tags.
KEPT_TAGS = 512


def _tables(tags: Sequence[str]) -> list[Table]:
    """Tables of a text between whose pieces these tags stand; nested tables follow their outer one."""
    tables, opened = [], []
    for place, text in enumerate(tags):
        table = opened[-1] if opened else None
        if table is not None and table.cell is not None:
            table.cell.places.append(place)
        if text == _COMMENT:
            continue
        token = _token(text)
        kind, name = token.kind, token.name
        if kind == OPENING and name == "table":
            tables.append(Table(token.id))
            opened.append(tables[-1])
        elif table is None or kind == HIDDEN:
            continue
        elif name in ("td", "th"):
            if kind == CLOSING:
                table.cell = None
                continue
            if not table.rows:
                table.rows.append((table.part, []))
            table.cell = Cell(token)
            table.rows[-1][1].append(table.cell)
        elif name == "tr":
            table.cell = None
            if kind == OPENING:
                table.rows.append((table.part, []))
        elif name == "table":
            opened.pop()
        else:
            table.part = name if kind == OPENING else None
    return tables


def _grid(rows: Sequence[Sequence[Cell]]) -> list[list[Cell]]:
    """Cells by column, repeated over the columns and rows they span."""
    if not any(cell.tag.span > 1 or cell.tag.down > 1 for cells in rows for cell in cells):
        return [list(cells) for cells in rows]
    grid, hanging = [], {}
    for cells in rows:
        across: list[Cell] = []
        below: dict[int, tuple[int, Cell]] = {}

        def take_hanging():
            while len(across) in hanging:
                left, cell = hanging.pop(len(across))
                if left > 1:
                    below[len(across)] = (left - 1, cell)
                across.append(cell)

        for cell in cells:
            take_hanging()
            for _ in range(cell.tag.span):
                if cell.tag.down > 1:
                    below[len(across)] = (cell.tag.down - 1, cell)
                across.append(cell)
        take_hanging()
        hanging = below
        grid.append(across)
    return grid


class Layout(NamedTuple):
    """Where a table's names and body stand among the texts of its page."""

    id: str | None
    head: list[list[Cell]]
    body: list[list[Cell]]


def _layouts(tags: Sequence[str]) -> list[Layout]:
    """The layout of every table; only the tags decide it."""
    found = []
    for table in _tables(tags):
        rows = [row for row in table.rows if row[1]]
        head = [row for row in rows if row[0] == "thead"]
        if not head and rows and all(cell.tag.name == "th" for cell in rows[0][1]):
            head = rows[:1]
        body = [cells for row in rows if not any(row is one for one in head) for cells in (row[1],)]
        found.append(Layout(table.id, _grid([cells for _, cells in head]), _grid(body)))
    return found


_kept_layouts = lru_cache(maxsize=256)(_layouts)


def _texts(rows: Sequence[Sequence[Cell]], texts: Sequence[str]) -> list[list[str]]:
    return [[cell.text(texts) for cell in cells] for cells in rows]


@lru_cache(maxsize=1 << 10)
def _kept_names(head: tuple[tuple[str, ...], ...]) -> list[str]:
    return flatten_header(head)


def flatten_header(rows: Sequence[Sequence[str]]) -> list[str]:
    """One name per column: the lowest header row's text, or the first row's where that is empty."""
    width = max((len(row) for row in rows), default=0)
    padded = [list(row) + [""] * (width - len(row)) for row in rows]
    return [padded[-1][i] or padded[0][i] for i in range(width)]


def _read_text(html: str) -> tuple[list[str], list[Layout], list[str]]:
    """Texts between the tags of a page or comment, the layouts of its tables, and its comments."""
    parts = _SPLIT.split(html)
    tags, comments = parts[1::2], []
    for place, text in enumerate(tags):
        if text[1] == "!":
            comments.append(text[4:-3] if text.endswith("-->") and len(text) >= 7 else text[4:])
            tags[place] = _COMMENT
    return parts[::2], _kept_layouts(tuple(tags)) if len(tags) <= KEPT_TAGS else _layouts(tags), comments


def _read_page(html: str) -> Iterator[tuple[Layout, list[str], bool]]:
    """Tables of the page itself, then those inside its comments, each with the texts its cells refer to."""
    texts, layouts, comments = _read_text(html or "")
    yield from ((layout, texts, False) for layout in layouts)
    for comment in comments:
        if "<table" in comment.lower():
            texts, layouts, _ = _read_text(comment)
            yield from ((layout, texts, True) for layout in layouts)


def _names(layout: Layout, texts: Sequence[str]) -> list[str]:
    return _kept_names(tuple(map(tuple, _texts(layout.head, texts))))


def _cells(page_id: int, html: str, columns: list[list]) -> None:
    """Add the body cells of a page's tables to the columns of ``CELL_SCHEMA``."""
    for table_no, (layout, texts, in_comment) in enumerate(_read_page(html)):
        names = _names(layout, texts)
        for row_no, own in enumerate(_texts(layout.body, texts)):
            size = len(own)
            header = names[:size] if size <= len(names) else [*names, *map(str, range(len(names), size))]
            same = (page_id, table_no, layout.id, in_comment, row_no)
            values = [*([value] * size for value in same), range(size), header, [text or None for text in own]]
            for column, value in zip(columns, values):
                column.extend(value)


def _log_of(html: str) -> tuple[list[str], Layout, list[str]] | None:
    """Names, layout and texts of the first table that has the needed columns; the bodies of others are not read."""
    for layout, texts, _ in _read_page(html):
        names = _names(layout, texts)
        if all(name in names for name in NEEDED_COLUMNS):
            return names, layout, texts
    return None


def _log_rows(page_id: int, season: str, team: str, html: str, columns: list[list]) -> None:
    """Add the rows of a page's log to the columns of ``LOG_SCHEMA``."""
    found = _log_of(html)
    if found is None:
        return
    names, layout, texts = found
    places = [names.index(name) if name in names else None for name in EXPECTED_COLUMNS]
    for row_no, own in enumerate(_texts(layout.body, texts)):
        values = [own[p] or None if p is not None and p < len(own) else None for p in places]
        for column, value in zip(columns, (page_id, row_no, season, team, *values)):
            column.append(value)


def _reader(parse, inputs: Sequence[str], schema: T.StructType):
    """A batch function that parses pages and hands on batches of a bounded number of rows."""
    arrow, names = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string()}, schema.fieldNames()
    kinds = [arrow[field.dataType] for field in schema]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in names]

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for values in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in inputs)):
                parse(*values, columns)
                if len(columns[0]) >= ROWS_PER_FRAME:
                    yield batch_of()
                    columns = [[] for _ in names]
        if columns[0]:
            yield batch_of()

    return read


# Tasks a core has of pages: parsing outweighs reading, so one task more than cores would double the time.
TASKS_A_CORE = 4


def _dealt(pages: DataFrame) -> DataFrame:
    """Pages dealt out by their id; a few large files would keep few tasks busy."""
    return pages.repartition(TASKS_A_CORE * pages.sparkSession.sparkContext.defaultParallelism, "page_id")


def _with_tables(pages: DataFrame) -> DataFrame:
    """Pages worth handing to Python, dealt out."""
    return _dealt(pages.filter(F.lower("html").contains("<table")))


def html_tables(pages: DataFrame) -> DataFrame:
    """Every body cell of every table, commented-out tables included, with its column's name."""
    return _with_tables(pages.select("page_id", "html")).mapInArrow(_reader(_cells, ("page_id", "html"), CELL_SCHEMA), CELL_SCHEMA)


def html_comments(pages: DataFrame) -> DataFrame:
    """Comment bodies in page order."""
    bodies = F.regexp_extract_all("html", F.lit(COMMENT_PATTERN), 1)
    return pages.select("page_id", F.posexplode(bodies).alias("position", "comment"))


def link_harvest(pages: DataFrame, pattern: str, id_group: int = 1, slug_group: int = 2) -> DataFrame:
    """Links whose address matches ``pattern``: id, slug and text of the first with a text, per page and id.

    Comments, scripts and styles hold no links. An id whose links are all without text has no row.
    """
    visible = F.regexp_replace("html", HIDDEN_PATTERN, "")
    anchors = F.regexp_extract_all(visible, F.lit(LINK_PATTERN), 0)
    href = F.concat(*[F.regexp_extract("anchor", HREF_PATTERN, group) for group in (1, 2, 3)])
    plain = F.regexp_replace("anchor", TAG_PATTERN, "")
    links = (
        pages.select("page_id", F.posexplode(anchors).alias("position", "anchor"))
        .select("page_id", "position", href.alias("href"), plain.alias("text"))
        .select("page_id", "position", decoded_links("href", "text").alias("link"))
        .select("page_id", "position", "link.href", F.regexp_replace("link.text", r"^\s+|\s+$", "").alias("text"))
        .filter(F.col("href").rlike(pattern) & (F.col("text") != ""))
        .select(
            "page_id",
            F.regexp_extract("href", pattern, id_group).alias("link_id"),
            F.struct("position", F.regexp_extract("href", pattern, slug_group).alias("slug"), "text").alias("link"),
        )
    )
    first = links.groupBy("page_id", "link_id").agg(F.min_by("link", "link.position").alias("link"))
    return first.select("page_id", "link_id", "link.slug", "link.text")


def decoded(texts: pd.Series) -> pd.Series:
    """Texts with every character reference of HTML replaced; a no-break space becomes a plain one."""
    return texts.map(lambda text: unescape(text).replace("\xa0", " ") if text and "&" in text else text)


@F.pandas_udf(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())]))
def decoded_links(href: pd.Series, text: pd.Series) -> pd.DataFrame:
    """Both texts of a link, decoded before anything is matched against them."""
    return pd.DataFrame({"href": decoded(href), "text": decoded(text)})


def log_tables(cells: DataFrame) -> DataFrame:
    """Per page the first table that has the columns a match log needs."""
    has = [F.max(F.col("header") == name) for name in NEEDED_COLUMNS]
    complete = has[0] & has[1] & has[2]
    tables = cells.groupBy("page_id", "table_no").agg(complete.alias("complete"))
    return tables.filter("complete").groupBy("page_id").agg(F.min("table_no").alias("table_no"))


def match_logs(pages: DataFrame) -> DataFrame:
    """One row per row of each page's match log, in the fixed columns.

    A page is read as a whole, so its log table is chosen and shaped where it is parsed and
    nothing is shuffled. A column a page lacks is NULL; where a header repeats, the first counts.
    """
    inputs = ("page_id", "Season", "Team", "html")
    return _with_tables(pages.select(*inputs)).mapInArrow(_reader(_log_rows, inputs, LOG_SCHEMA), LOG_SCHEMA)


def pages_without_log(pages: DataFrame) -> DataFrame:
    """``page_id`` of the pages that ``match_logs`` has no rows for because none of their tables is a match log."""

    def missing(page_id: int, html: str, columns: list[list]) -> None:
        if _log_of(html) is None:
            columns[0].append(page_id)

    schema = T.StructType([T.StructField("page_id", T.LongType())])
    return _dealt(pages.select("page_id", "html")).mapInArrow(_reader(missing, ("page_id", "html"), schema), schema)


def empty_log(spark: SparkSession) -> DataFrame:
    """A match log without rows, in the fixed columns."""
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in LOG_COLUMNS]))


def clean_match_log(logs: DataFrame, competition: str | None = None, only_played: bool = True) -> DataFrame:
    """One competition's played matches with real dates, by season and date.

    Whether any row matches the competition has to be known before rows are dropped; the parsed
    log is written once so that the pages are not read twice for it.
    """
    if competition:
        logs = checkpointed(logs)
        logs = filter_competition(logs, competition, "Comp")
    if only_played:
        logs = played_only(logs)
    return clean_log(logs)
