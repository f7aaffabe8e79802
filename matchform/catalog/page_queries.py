"""Web pages: comments, links, tables and match logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchform.catalog import sql_common as Q
from matchform.catalog.registry import query
from matchform.operators import weblog

LINK = r"^/([^/?#]+)/?([^?#]*)"
# A comment, script or style holds no links.
HIDDEN_SQL = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"


@query(
    "q_html_comments",
    r"""SELECT page_id, cast(i - 1 AS INTEGER) AS position, bodies[i] AS comment FROM (
          SELECT page_id, regexp_extract_all(html, '(?s)<!--(.*?)-->', 1) AS bodies FROM pages),
        LATERAL (SELECT unnest(generate_series(1, len(bodies))) AS i)""",
)
def html_comments(t):
    return weblog.html_comments(t.pages)


# Links that the pages lack: in single quotes, in none, with an address that begins with a character reference, without a text before one with, and never with a text.
INJECTED = (
    """<a href='/single/{}'>Single</a><a rel=x href=/bare/b>Bare &amp; short</a><a href="/logo/first"><img alt=">"></a>"""
    """<a href="/logo/second"> Name&nbsp;&eacute; </a><a href="/void/z"> </a><A title='a>b' HREF = "/odd/q">&lt;odd&gt;</A><a href="&#47;coded/c&amp;d">Coded</a>"""
).split("{}")
_TAG_SQL = r"""(?s)</?[a-zA-Z](?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
_LINK_SQL = r"""(?is)<a\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>.*?</a>"""
_HREF_SQL = r"""(?is)^<a\b(?:[^>"'']|"[^"]*"|''[^'']*'')*?\shref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""


def _plain(expression: str) -> str:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#47;", "/"), ("&nbsp;", " "), ("&eacute;", "é"), ("&amp;", "&")):
        expression = f"replace({expression}, '{entity}', '{plain}')"
    return expression


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "q_link_harvest",
    rf"""WITH more AS (SELECT page_id, html || {_quoted(INJECTED[0])} || page_id || {_quoted(INJECTED[1])} AS html FROM pages),
        anchors AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '{HIDDEN_SQL}', '', 'g'), '{_LINK_SQL}') AS found FROM more),
        links AS (SELECT page_id, i, found[i] AS anchor,
            regexp_extract(found[i], '{_HREF_SQL}', 1) || regexp_extract(found[i], '{_HREF_SQL}', 2) || regexp_extract(found[i], '{_HREF_SQL}', 3) AS href
          FROM anchors, LATERAL (SELECT unnest(generate_series(1, len(found))) AS i)),
        parts AS (SELECT page_id, i, regexp_extract({_plain("href")}, '{LINK}', 1) AS link_id, regexp_extract({_plain("href")}, '{LINK}', 2) AS slug,
          regexp_replace({_plain(f"regexp_replace(anchor, '{_TAG_SQL}', '', 'g')")}, '^\s+|\s+$', '', 'g') AS text
          FROM links WHERE regexp_matches({_plain("href")}, '{LINK}'))
        SELECT page_id, link_id, arg_min(slug, i) AS slug, arg_min(text, i) AS text FROM parts WHERE text <> '' GROUP BY page_id, link_id""",
)
def link_harvest(t):
    html = F.concat("html", F.lit(INJECTED[0]), F.col("page_id").cast("string"), F.lit(INJECTED[1]))
    return weblog.link_harvest(t.pages.select("page_id", html.alias("html")), LINK)


def log_pages(t):
    """A page per match with its log table, on odd matches inside a comment.

    The first table of every page has a two-row header and none of the log's columns.
    """
    m = t.matches()
    cell = lambda *values: F.concat(*[F.concat(F.lit("<td>"), v, F.lit("</td>")) for v in values])
    squad = F.concat(
        F.lit('<table id="gates"><thead><tr><th rowspan="2">Row</th><th>Club</th><th colspan="2">Goals</th></tr>'
              "<tr><th></th><th>Scored</th><th>Let in</th></tr></thead><tbody><tr>"),
        cell(F.lit("1"), F.col("HomeTeam"), F.col("FTHG").cast("string"), F.col("FTAG").cast("string")),
        F.lit("</tr></tbody></table>"),
    )
    log = F.concat(
        F.lit('<table id="season_log"><thead><tr><th>Date</th><th>Comp</th><th>Result</th><th>GF</th>'
              "<th>Opponent</th></tr></thead><tbody><tr>"),
        cell(
            F.coalesce(F.date_format("kickoff", "yyyy-MM-dd"), F.lit("unknown")),
            F.lit("League &amp; Cup"),
            F.coalesce(F.col("FTR"), F.lit("")),
            F.col("FTHG").cast("string"),
            F.concat(F.lit("<b>"), F.col("AwayTeam"), F.lit("</b>")),
        ),
        F.lit("</tr></tbody></table>"),
    )
    hidden = F.when(F.col("match_id") % 2 == 1, F.concat(F.lit("<!--\n"), log, F.lit("\n-->"))).otherwise(log)
    return m.select(
        F.col("match_id").alias("page_id"),
        F.col("season").alias("Season"),
        F.col("HomeTeam").alias("Team"),
        F.concat(F.lit("<html><body><div>"), squad, hidden, F.lit("</div></body></html>")).alias("html"),
    )


_CELLS = """cells AS (
  SELECT match_id AS page_id, 0 AS table_no, 'gates' AS table_id, false AS in_comment, c.col, c.header, c.text FROM matches,
    LATERAL (SELECT unnest([0, 1, 2, 3]) AS col, unnest(['Row', 'Club', 'Scored', 'Let in']) AS header,
             unnest(['1', "HomeTeam", cast("FTHG" AS VARCHAR), cast("FTAG" AS VARCHAR)]) AS text) c
  UNION ALL
  SELECT match_id, 1, 'season_log', match_id % 2 = 1, c.col, c.header, c.text FROM matches,
    LATERAL (SELECT unnest([0, 1, 2, 3, 4]) AS col, unnest(['Date', 'Comp', 'Result', 'GF', 'Opponent']) AS header,
             unnest([coalesce(strftime(kickoff, '%Y-%m-%d'), 'unknown'), 'League & Cup', "FTR", cast("FTHG" AS VARCHAR), "AwayTeam"]) AS text) c
)"""


@query(
    "q_html_tables",
    f"""WITH {Q.MATCHES}, {_CELLS} SELECT page_id, cast(table_no AS INTEGER) AS table_no, table_id, in_comment,
        cast(0 AS INTEGER) AS row, cast(col AS INTEGER) AS col, header, text FROM cells""",
)
def html_tables(t):
    return weblog.html_tables(log_pages(t))


@query(
    "q_log_tables",
    f"WITH {Q.MATCHES} SELECT match_id AS page_id, cast(1 AS INTEGER) AS table_no FROM matches",
)
def log_tables(t):
    return weblog.log_tables(weblog.html_tables(log_pages(t)))


@query(
    "q_match_logs",
    f"""WITH {Q.MATCHES} SELECT match_id AS page_id, cast(0 AS INTEGER) AS row, season AS "Season", "HomeTeam" AS "Team",
        CASE WHEN kickoff IS NOT NULL THEN cast(kickoff AS DATE) END AS "Date", "FTR" AS "Result",
        cast("FTHG" AS VARCHAR) AS "GF", "AwayTeam" AS "Opponent", 'League & Cup' AS "Comp",
        {", ".join(f'cast(NULL AS VARCHAR) AS "{c}"' for c in weblog.EXPECTED_COLUMNS if c not in ("Date", "Result", "GF", "Opponent", "Comp"))}
        FROM matches WHERE "FTR" IS NOT NULL""",
)
def match_logs(t):
    return weblog.clean_match_log(weblog.match_logs(log_pages(t)), "League-One")


@query("q_pages_without_log", f"WITH {Q.MATCHES} SELECT match_id AS page_id FROM matches WHERE match_id % 3 = 0")
def pages_without_log(t):
    """Every third page's log table lacks one of the columns that make it one."""
    other = F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit("<th>Result</th>"), F.lit("<th>Score</th>"))).otherwise(F.col("html"))
    return weblog.pages_without_log(log_pages(t).withColumn("html", other))
