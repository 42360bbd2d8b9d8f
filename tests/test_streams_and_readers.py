import datetime as dt
import json

from pyspark.sql import functions as F

from pitchside.sources import readers
from pitchside.streaming import streams

T0 = dt.datetime(2024, 1, 1, 6, 0)


def feed(spark, tmp_path, rows, schema):
    path = tmp_path.as_uri() + "/feed"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def drain(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_operational_days(spark, tmp_path):
    rows = [(T0 + dt.timedelta(hours=h),) for h in (0, 2, 20, 30, 100)]
    got = drain(streams.operational_days(feed(spark, tmp_path, rows, "ts timestamp"), "ts"), "complete", "days")
    assert {r["day"]["start"]: r["count"] for r in got} == {
        dt.datetime(2023, 12, 31, 7): 1, dt.datetime(2024, 1, 1, 7): 2, dt.datetime(2024, 1, 2, 7): 1, dt.datetime(2024, 1, 5, 7): 1,
    }


def test_near_duplicates_are_suppressed(spark, tmp_path):
    rows = [(1, T0), (1, T0 + dt.timedelta(minutes=10)), (2, T0)]
    got = drain(streams.without_near_duplicates(feed(spark, tmp_path, rows, "k long, ts timestamp"), "ts", ["k"]), "append", "dup")
    assert sorted(r["k"] for r in got) == [1, 2]


def test_latest_values(spark, tmp_path):
    rows = [(1, T0, 2.0), (1, T0 + dt.timedelta(hours=1), 3.0), (2, T0, 9.0)]
    got = drain(streams.latest_values(feed(spark, tmp_path, rows, "k long, ts timestamp, v double"), ["k"], "ts", "v"), "complete", "latest")
    assert {r["k"]: r["v"] for r in got} == {1: 3.0, 2: 9.0}


def test_rolling_state(spark, tmp_path):
    rows = [(1, T0 + dt.timedelta(hours=i), float(i)) for i in range(6)] + [(2, T0, 5.0)]
    got = drain(streams.rolling_state(feed(spark, tmp_path, rows, "k long, ts timestamp, v double"), "k", "ts", "v", 3), "append", "roll")
    mine = sorted((r["value"], r["n_before"], r["mean_before"]) for r in got if r["key"] == 1)
    assert [m[1] for m in mine] == [0, 1, 2, 3, 3, 3]
    assert mine[5][2] == (2 + 3 + 4) / 3


def test_expiry(spark):
    rows = [("PENDING", T0), ("PENDING", T0 + dt.timedelta(minutes=30)), ("WON", T0)]
    got = streams.expired(spark.createDataFrame(rows, "status string, placed_at timestamp"), "placed_at", T0 + dt.timedelta(minutes=61)).collect()
    assert [(r["status"], r["placed_at"]) for r in got] == [("VOID", T0)]


def test_football_files(spark, tmp_path):
    (tmp_path / "E0_2324.csv").write_text("Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,B365H,B365D\nE0,11/03/2026,Arsenal,Chelsea,2,1,1.90,\nE0,,X,Y,1,1,2,3\nE0,12/03/26,A, ,x,,2,3\n")
    got = readers.football_matches(readers.csv_rows(spark, tmp_path.as_uri())).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["season"], r["home_team"], r["home_score"], r["match_date"], r["odds"]) == ("2023-24", "Arsenal", 2, dt.date(2026, 3, 11), {"b365h": 1.9})


def test_odds_events(spark, tmp_path):
    event = {"id": "e1", "home_team": "A", "away_team": "B", "commence_time": "2026-03-11T15:00:00Z", "bookmakers": [{"key": "bk", "markets": [{"key": "h2h", "outcomes": [{"name": "A", "price": 1.9}, {"name": "Draw", "price": 3.5}]}]}]}
    (tmp_path / "x.json").write_text(json.dumps(event) + "\n{broken\n")
    got = readers.odds_events(spark, tmp_path.as_uri()).where(F.col("market") == "h2h").collect()
    assert sorted((r["selection"], r["odds"]) for r in got) == [("draw", 3.5), ("home", 1.9)]


def test_sheets(spark, tmp_path):
    import zipfile

    from pitchside.sources import sheets

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = f"<sst {ns}><si><t>Winner</t></si><si><t>Loser</t></si><si><t>Date</t></si><si><r><t>Fede</t></r><r><t>rer</t></r></si></sst>"
    sheet = f"""<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row>
<row><c r="A2" t="s"><v>3</v></c><c r="B2" t="inlineStr"><is><t>Nadal</t></is></c><c r="C2"><v>45000</v></c><c r="E2"><v>1.5</v></c></row><row><c r="A3" t="s"><v>3</v></c></row></sheetData></worksheet>"""
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", shared)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    (tmp_path / "b.xlsx").write_bytes(b"no archive")
    rows = sheets.xlsx_rows(spark, tmp_path.as_uri())
    assert rows.count() == 2
    got = sheets.tennis_sheets(rows).collect()
    assert [(r["source_file"], dict(r["cells"])) for r in got] == [("a.xlsx", {"Winner": "Federer", "Loser": "Nadal", "Date": "45000", "col_3": "", "col_4": "1.5"})]
