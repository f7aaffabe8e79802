from matchform.operators import weblog

# A log with the columns in reverse order and a page heading above it, and a table of ground names kept in a comment.
LOG_VALUES = {"Date": "2024-02-30", "Comp": "Harbour League", "Result": "D", "GF": "0", "Opponent": "Salt &amp; Anchor"}
LOG_NAMES = list(reversed(weblog.EXPECTED_COLUMNS))
LOG = f"""<table class=stats id=season_log><caption>Log</caption>
<thead><tr>{''.join(f'<th scope="col">{name}</th>' for name in LOG_NAMES)}</tr></thead>
<tr>{''.join(f"<td>{LOG_VALUES.get(name, '')}</td>" for name in LOG_NAMES)}</tr></table>"""
GROUNDS = """<table><thead><tr><th rowspan="2">Ground</th><th colspan="2">Capacity</th></tr><tr><th>Seats</th><th></th></tr></thead>
<tbody><tr><th>Pier <i>Park</i></th><td>4,200</td><td>900</td></tr><tr><td>Dunes</td><td>11</td></tr></tbody></table>"""
PAGE = f"<html><h1>Season</h1>{LOG}<p>more</p><!-- kept for later {GROUNDS} --></html>"


def pages(spark, *htmls):
    return spark.createDataFrame(
        [(i, "2023-2024", f"Team {i}", html) for i, html in enumerate(htmls)],
        "page_id bigint, Season string, Team string, html string",
    )


def test_visible_and_hidden_tables(spark):
    cells = weblog.html_tables(pages(spark, PAGE)).collect()
    assert {(c["table_no"], c["table_id"], c["in_comment"]) for c in cells} == {(0, "season_log", False), (1, None, True)}
    log = {c["header"]: c["text"] for c in cells if c["table_no"] == 0}
    assert list(log) and {k: v for k, v in log.items() if v} == {**LOG_VALUES, "Opponent": "Salt & Anchor"}
    grounds = {(c["row"], c["header"]): c["text"] for c in cells if c["in_comment"]}
    assert grounds == {
        (0, "Ground"): "Pier Park", (0, "Seats"): "4,200", (0, "Capacity"): "900", (1, "Ground"): "Dunes", (1, "Seats"): "11",
    }


def test_spans_and_nested_tables(spark):
    html = """<table><tr><th>a</th><th>b</th></tr><tr><td rowspan=2>x</td><td>1</td></tr><tr><td>2
      <table id="in"><tr><td data-x="a>b">deep</td></tr></table></td></tr></table><script>"<table><tr><td>no</td></tr></table>"</script>"""
    cells = weblog.html_tables(pages(spark, html)).collect()
    outer = {(c["row"], c["header"]): c["text"] for c in cells if c["table_no"] == 0}
    assert outer == {(0, "a"): "x", (0, "b"): "1", (1, "a"): "x", (1, "b"): "2"}
    assert [c["text"] for c in cells if c["table_no"] == 1] == ["deep"] and len(cells) == 5


def test_log_choice_and_columns(spark):
    short = "<table><tr><th>Opponent</th><th>Date</th><th>Result</th></tr><tr><td>B</td><td>2024-01-01</td><td>L</td></tr></table>"
    rows = {r["page_id"]: r for r in weblog.match_logs(pages(spark, PAGE, "<p>none</p>", short)).collect()}
    assert set(rows) == {0, 2}
    assert rows[0]["Opponent"] == "Salt & Anchor" and rows[0]["Notes"] is None and rows[0]["Team"] == "Team 0"
    assert [r["page_id"] for r in weblog.pages_without_log(pages(spark, PAGE, "<p>none</p>", short, GROUNDS)).orderBy("page_id").collect()] == [1, 3]
    assert rows[2]["Opponent"] == "B" and rows[2]["Comp"] is None
    chosen = weblog.log_tables(weblog.html_tables(pages(spark, PAGE, short))).collect()
    assert {(r["page_id"], r["table_no"]) for r in chosen} == {(0, 0), (1, 0)}


def test_cleaning(spark):
    dated, open_ = PAGE.replace("2024-02-30", "2024-02-28"), PAGE.replace("<td>D</td>", "<td></td>")
    logs = weblog.match_logs(pages(spark, dated, PAGE, open_))
    kept = weblog.clean_match_log(logs, "Harbour-Cup").collect()
    assert [r["page_id"] for r in kept] == [0, 1] and kept[1]["Date"] is None
    assert len(weblog.clean_match_log(logs, "Inland League", only_played=False).collect()) == 3


def test_empty_log(spark):
    assert weblog.empty_log(spark).columns == list(weblog.LOG_COLUMNS)


def test_links_of_all_forms_first_with_text_per_id(spark):
    html = """<!-- <a href="/club/1/hidden">hidden</a> --><a class='k' href="/club/9/otters"><img alt=">"></a>
      <A HREF='/club/9/second'> <b>Second</b> one </A><a href=/club/12/plain data-x="1">Caf&eacute;&nbsp;&#8364;</a>
      <a data-href="/club/5/no">no</a><a href="/club/7/empty"> </a><a title="a>b" href="/club/8/x?y=1&amp;z">&lt;8&gt;</a><a href="/other">o</a>"""
    found = weblog.link_harvest(pages(spark, html), r"^/club/([0-9]+)/(.*)").collect()
    assert {(r["link_id"], r["slug"], r["text"]) for r in found} == {("9", "second", "Second one"), ("12", "plain", "Café €"), ("8", "x?y=1&z", "<8>")}


def test_addresses_are_decoded_before_they_are_matched(spark):
    html = """<a href="&#47;club/3/coded">Coded</a><a href="/club&#x2F;4/half">Half</a><a href="&amp;#47;club/5/twice">no</a>"""
    found = weblog.link_harvest(pages(spark, html), r"^/club/([0-9]+)/(.*)").collect()
    assert {(r["link_id"], r["slug"], r["text"]) for r in found} == {("3", "coded", "Coded"), ("4", "half", "Half")}


def test_commented_tables_in_capitals(spark):
    html = "<!-- <TABLE ID=up><TR><TH>Name</TH></TR><TR><TD>Otters</TD></TR></TABLE> -->"
    (row,) = weblog.html_tables(pages(spark, html)).collect()
    assert (row["table_id"], row["in_comment"], row["header"], row["text"]) == ("up", True, "Name", "Otters")


def test_comments_span_lines(spark):
    found = weblog.html_comments(pages(spark, "<!--a\nb--><p></p><!-- c -->")).orderBy("position").collect()
    assert [r["comment"] for r in found] == ["a\nb", " c "]


def test_pages_with_the_same_tags_share_a_layout():
    """Tags are laid out once, whatever the texts and comments say; long pages are not kept."""
    page = '<table id="t"><tr><th>Date</th><th>Opponent</th><th>Result</th></tr><tr><td rowspan=2>{0}</td><td>a<b>{0}</b></td><td>W</td></tr><tr><td>x &amp; {0}</td></tr></table><!--{1}-->'
    weblog._kept_layouts.cache_clear()
    for k in range(50):
        inner = "<table><tr><td>%d</td></tr></table>" % k if k % 2 else "nothing"
        columns = [[] for _ in weblog.CELL_SCHEMA]
        weblog._cells(k, page.format(k, inner), columns)
        assert columns[7] == [str(k), f"a{k}", "W", str(k), f"x & {k}"] + [str(k)] * (k % 2)
        assert columns[3] == [False] * 5 + [True] * (k % 2) and columns[6][:5] == ["Date", "Opponent", "Result", "Date", "Opponent"]
    assert weblog._kept_layouts.cache_info().misses == 2
    columns = [[] for _ in weblog.CELL_SCHEMA]
    weblog._cells(1, "<table>" + "<tr><td>v</td></tr>" * weblog.KEPT_TAGS + "</table>", columns)
    assert columns[4] == list(range(weblog.KEPT_TAGS)) and weblog._kept_layouts.cache_info().misses == 2
