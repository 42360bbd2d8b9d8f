import pytest

from pitchside.sources import stats as S


def page(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


@pytest.mark.parametrize(
    ("sport", "html", "want"),
    [
        ("basketball", page(("Rk", "Team", "Pace", "MOV", "NRtg", "FG%"), ("1", "Boston Celtics*", "98.1", "11.3", "11.6", ".487"), ("", "Team", "Pace"), ("", "League Average", "99", "0", "0", ".4")), {"Boston Celtics": {"pace": 98.1, "net_rtg": 11.3, "fg_pct": 0.487}}),
        ("ice_hockey", page(("Team", "CF%", "PP%", "GF", "x"), ("Oilers*", "54.5", "", "3.5", "9"), ("Team", "CF%")), {"Oilers": {"corsi_for_pct": 54.5, "gf": 3.5}}),
        ("american_football", page(("Tm", "PF", "PA", "Y/P", "TO"), ("Chiefs+", "371", "294", "5.6", "28"), ("Bills*", "451", "311"), ("Avg Total", "1", "1"), ("League Total", "2", "2")), {"Chiefs": {"pts_for": 371, "pts_against": 294, "yards_per_play": 5.6, "turnovers": 28}, "Bills": {"pts_for": 451, "pts_against": 311}}),
        ("tennis", page(("Player", "Ace%", "1stIn%", "RPW%"), ("Jannik Sinner", "8.6%", "59.8%", "41.2"), ("Name", "1"), ("Nobody", "", "", "")), {"Jannik Sinner": {"ace_pct": 8.6, "first_serve_pct": 59.8, "return_pts_won_pct": 41.2}}),
        ("football", page(("Squad", "xG", "Poss"), ("Arsenal*", "2.1", "61.0")) + page(("no", "names"), ("1", "2")), {"Arsenal*": {"xg": 2.1, "possession_pct": 61.0}}),
    ],
)
def test_tables_of_five_sports(spark, sport, html, want):
    pages = spark.createDataFrame([(1, sport, html), (2, "chess", html), (3, sport, None)], "id int, sport string, html string")
    got = S.page_stats(pages, "sport", "html").collect()
    assert {r["team"]: r["stats"] for r in got} == want and {(r["id"], r["sport"]) for r in got} == {(1, sport)}
