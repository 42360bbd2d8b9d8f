from pitchside.operators import upkeep as U


def test_bridge_dispositions(spark):
    p = spark.createDataFrame(
        [(1, 1, 2.0, 5, True), (1, 2, 2.0, 5, True), (2, 3, None, 5, True), (3, 4, 2.0, 0, True), (4, 5, 2.0, 7, False), (5, 6, 2.0, 5, True), (6, 7, 2.0, 5, True), (7, 8, 2.0, 5, False), (8, 9, 0.0, None, None), (9, 10, 3.0, 4, None)],
        "match_id int, id int, best_odds double, stake int, ready boolean",
    )
    b = spark.createDataFrame([(5, "PENDING", "PAPER"), (6, "WON", "PAPER"), (7, "PENDING", "PAPER"), (5, "LOST", "REAL")], "match_id int, status string, ledger string")
    got = {r["id"]: (r["disposition"], r["ledger"], r["status"], r["ledger_delta"]) for r in U.bridged(p, b, ["match_id"], "id").collect()}
    assert got == {
        1: ("created", "REAL", "PENDING", 0), 2: ("skipped_existing", None, None, 0), 3: ("skipped_no_odds", None, None, 0), 4: ("skipped_no_odds", None, None, 0),
        5: ("created", "PAPER", "PLACED", -7), 6: ("updated_existing", "REAL", "PENDING", 0), 7: ("skipped_existing", "PAPER", "WON", 0), 8: ("skipped_existing", "PAPER", "PENDING", 0),
        9: ("skipped_no_odds", None, None, 0), 10: ("created", "PAPER", "PLACED", -4),
    }
    assert U.bridged(p.limit(0), b, ["match_id"], "id").count() == 0
    counts = {r["disposition"]: (r["n"], r["paid"]) for r in U.disposition_counts(U.bridged(p, b, ["match_id"], "id")).collect()}
    assert counts["created"] == (3, -11)


def test_equal_predictions_in_any_order(spark):
    kind = "match_id int, id int, best_odds double, stake int, ready boolean"
    rows = [(1, 1, 2.0, 9, True), (1, 1, 2.0, 7, False), (1, 1, 3.0, 5, False), (2, 4, 2.0, 3, True), (2, 4, 2.0, 3, False)]
    none = spark.createDataFrame([], "match_id int, status string, ledger string")
    each = []
    for given in (rows, rows[::-1]):
        fates = U.bridged(spark.createDataFrame(given, kind).coalesce(1), none, ["match_id"], "id").where("disposition = 'created'")
        each.append(sorted((r["match_id"], r["ledger"], r["status"], r["ledger_delta"]) for r in fates.collect()))
    assert each[0] == each[1] == [(1, "PAPER", "PLACED", -5), (2, "PAPER", "PLACED", -3)]
