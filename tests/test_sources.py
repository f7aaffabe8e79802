import pytest

from matchform.sources import csv_feeds, feature_store

PLAIN = "Div,Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,FTR,HS,AS,AvgH,AvgD,AvgA"
WITH_REFEREE = "Div,Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,FTR,Referee,HS,AS,AvgH,AvgD,AvgA"


@pytest.fixture
def feeds(tmp_path):
    def put(path, text):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text)
        return target

    put("m/E0/2526.csv", b"\xef\xbb\xbf" + f"{WITH_REFEREE}\nE0,01/08/2025,15:00,A,B,2,0,H,T Bramall,10,5.0,2,3.5,0\n".encode())
    put("m/E0/2627.csv", f"{WITH_REFEREE}\nE0,02/08/2026,,B,A,,,,,,,,,\n".encode())
    put("m/D1/2526.csv", f"{PLAIN}\nD1,bad,15:00,C\xf6ln,D,1,1,D,7,8,1.5,4,6\n".encode("latin-1"))
    header = ",".join(csv_feeds.XG_COLUMNS)
    put("x/eng/eng_2526.csv", f"{header}\n2025-08-01,A,B,AAA,BBB,1.5,0.5\n".encode())
    put("x/ger/ger_2526.csv", f"{header}\n2025-08-02,C,D,CCC,DDD,2.5,x\n".encode())
    return str(tmp_path)


def test_headers_of_different_shape(spark, feeds):
    df = csv_feeds.read_matches(spark, f"{feeds}/m", ["E0", "D1"], ["2526"])
    rows = {r["league"]: r for r in df.collect()}
    assert set(rows) == {"E0", "D1"}
    assert rows["E0"]["Div"] == "E0" and rows["E0"]["Referee"] == "T Bramall" and rows["E0"]["HS"] == 10
    assert rows["E0"]["AS"] == 5 and rows["E0"]["AvgA"] == 0.0 and rows["E0"]["MaxH"] is None
    assert rows["D1"]["Referee"] is None and rows["D1"]["HS"] == 7 and rows["D1"]["HomeTeam"] == "Cöln"
    assert rows["D1"]["season"] == "2025/26"


def test_seasons_are_tagged_by_path(spark, feeds):
    df = csv_feeds.read_matches(spark, f"{feeds}/m", ["E0"], [2526, 2627])
    assert {(r["season"], r["HomeTeam"]) for r in df.collect()} == {("2025/26", "A"), ("2026/27", "B")}


def test_lines_without_text_are_rows(spark, feeds):
    from pathlib import Path

    Path(f"{feeds}/m/E0/2728.csv").write_text(f"{PLAIN}\n,,,,,3,1,,,,2.5,,\n\n,,,,,,,,9,,,,\n,,,,,,,,,,,,\n")
    rows = csv_feeds.read_matches(spark, f"{feeds}/m", ["E0"], ["2728"]).collect()
    assert sorted(((r["FTHG"], r["HS"], r["AvgH"], r["season"]) for r in rows), key=repr) == [
        (3, None, 2.5, "2027/28"), (None, 9, None, "2027/28"), (None, None, None, "2027/28")
    ]


def test_many_files_of_three_shapes(spark, tmp_path):
    shapes = [PLAIN, WITH_REFEREE, f"{PLAIN},MaxH"]
    names = [f"{a:02d}{b:02d}" for a in range(100) for b in range(20)]
    (tmp_path / "E0").mkdir()
    for i, name in enumerate(names):
        header = shapes[i % 3]
        cells = {"Div": "E0", "HomeTeam": f"club {i}", "FTHG": str(i % 7), "Referee": f"whistle {i}", "MaxH": "2.5"}
        (tmp_path / "E0" / f"{name}.csv").write_text(f"{header}\n{','.join(cells.get(c, '') for c in header.split(','))}\n")
    found = csv_feeds.read_matches(spark, str(tmp_path), ["E0"], names).select("HomeTeam", "FTHG", "Referee", "MaxH").collect()
    expected = {(f"club {i}", i % 7, f"whistle {i}" if i % 3 == 1 else None, 2.5 if i % 3 == 2 else None) for i in range(2000)}
    assert len(found) == 2000 and set(map(tuple, found)) == expected


def test_bad_requests(spark, feeds):
    with pytest.raises(ValueError, match="four digits"):
        csv_feeds.read_matches(spark, f"{feeds}/m", ["E0"], ["25"])
    with pytest.raises(FileNotFoundError):
        csv_feeds.read_matches(spark, f"{feeds}/m", ["D1"], ["2627"])
    with pytest.raises(ValueError, match="no xG feed"):
        csv_feeds.read_xg(spark, f"{feeds}/x", ["N1"], 25, 26)
    with pytest.raises(ValueError, match="at least one"):
        csv_feeds.read_xg(spark, f"{feeds}/x", ["E0"], 25, 25)


def test_xg_feed(spark, feeds):
    rows = {r["league"]: r for r in csv_feeds.read_xg(spark, f"{feeds}/x", ["E0", "D1"], 25, 26).collect()}
    assert rows["E0"]["home_xg"] == 1.5 and rows["D1"]["away_xg"] is None and rows["D1"]["home_team"] == "C"


def test_combined_xg_round_trip(spark, feeds):
    df = csv_feeds.read_xg(spark, f"{feeds}/x", ["E0", "D1"], 25, 26)
    assert csv_feeds.write_xg(df, f"{feeds}/combined") == 2
    back = csv_feeds.load_xg(spark, f"{feeds}/combined")
    assert back.schema == df.schema and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_season_codes():
    assert csv_feeds.season_codes(19, 22) == ["1920", "2021", "2122"]
    assert csv_feeds.season_codes(99, 100) == ["9900"]
    assert csv_feeds.season_label("1920") == "2019/20"


def test_feature_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "2019", "B", "A", "E0", None, "H"), (2, "2020", "A", "C", "E0", "R", "D")],
        "match_id bigint, season string, HomeTeam string, AwayTeam string, Div string, Referee string, FTR string",
    )
    path = str(tmp_path / "features")
    assert feature_store.write_features(df, path) == 2
    back = feature_store.load_features(spark, path, with_categories=True)
    assert dict(back.dtypes)["season"] == "string"
    codes = {r["HomeTeam"]: (r["index_HomeTeam"], r["index_Referee"]) for r in back.collect()}
    assert codes == {"A": (0, 0), "B": (1, None)}
    assert feature_store.write_features(df.filter("match_id = 1"), path) == 1
    assert feature_store.load_features(spark, path).count() == 1


def test_saved_csv_features(spark, tmp_path):
    df = spark.createDataFrame([(1, "2019-08-01 15:00:00", "2019/20", "A", 1.5)], "match_id int, kickoff string, season string, HomeTeam string, home_xg_last_5 double")
    df.write.csv(str(tmp_path / "f"), header=True)
    row = feature_store.load_features_csv(spark, str(tmp_path / "f")).first()
    assert row["home_xg_last_5"] == 1.5 and row["kickoff"].hour == 15 and row["match_id"] == 1
