"""Keeping tables of matches, bets and names: seeding, scores, reconciliation, placement, alias learning.

Every operator takes tables and gives the new table (or only the rows that are new), so that running
it twice gives the same: what is there already is not added, what is settled is not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.functions.matching import bare, candidate_pairs, ratios
from pitchside.functions.odds import expected_value
from pitchside.sources.scratch import cut

#: Short states of a fixture that is over.
FINAL = ("FT", "AET", "PEN", "AOT")
FIXTURE = """struct<fixture:struct<id:long,date:string,status:struct<short:string>>,id:long,date:string,
  teams:struct<home:struct<name:string>,away:struct<name:string>>,league:struct<name:string,country:string>,
  goals:struct<home:int,away:int>,scores:struct<home:string,away:string>>"""


def parsed_fixtures(raw: DataFrame, column: str = "fixture") -> DataFrame:
    """Matches of JSON fixtures of both layouts: id, teams, league with its country, start, scores, finished.

    Fixtures without both names or a readable start are left out.
    """
    j = F.from_json(column, FIXTURE)
    inner = j["fixture"]
    score = lambda s: F.coalesce(F.get_json_object(j["scores"][s], "$.total").try_cast("int"), j["scores"][s].try_cast("int"))
    layout = j["goals"]["home"].isNotNull()
    home = F.when(layout, j["goals"]["home"]).otherwise(score("home"))
    away = F.when(layout, F.coalesce(j["goals"]["away"], F.lit(0))).when(home.isNotNull(), F.coalesce(score("away"), F.lit(0)))
    return raw.select(
        F.coalesce(inner["id"], j["id"]).alias("fixture_id"),
        j["teams"]["home"]["name"].alias("home_team"), j["teams"]["away"]["name"].alias("away_team"),
        F.concat_ws(" ", F.nullif(j["league"]["country"], F.lit("")), F.coalesce(j["league"]["name"], F.lit("Unknown"))).alias("league"),
        F.try_to_timestamp(F.coalesce(inner["date"], j["date"])).alias("scheduled_at"),
        home.alias("home_score"), away.alias("away_score"), F.coalesce(inner["status"]["short"].isin(*FINAL), F.lit(False)).alias("finished"),
    ).where("home_team <> '' and away_team <> '' and scheduled_at is not null")


def seeded(matches: DataFrame, fixtures: DataFrame, start: Column, end: Column, minutes: int = 15) -> DataFrame:
    """The fixtures in the window from start to end that are new: no match of the same teams so close in time.

    Of fixtures of the same teams and day the earliest stands. Times fall into bins, so a pair of teams
    is compared with its own near matches only.
    """
    inside = fixtures.where((F.col("scheduled_at") >= start) & (F.col("scheduled_at") < end))
    first = inside.withColumn("n_", F.row_number().over(Window.partitionBy("home_team", "away_team", F.to_date("scheduled_at")).orderBy("scheduled_at", "fixture_id"))).where("n_ = 1").drop("n_")
    size = minutes * 60
    at = F.unix_seconds(F.col("scheduled_at").cast("timestamp"))
    bin_ = F.floor(at / size)
    new = first.withColumn("at_", at).withColumn("bin_", bin_)
    old = matches.select("home_team", "away_team", at.alias("old_"), F.explode(F.array(bin_ - 1, bin_, bin_ + 1)).alias("bin_"))
    near = [new["home_team"] == old["home_team"], new["away_team"] == old["away_team"], new["bin_"] == old["bin_"], F.abs(new["at_"] - old["old_"]) <= size]
    return new.join(old, near, "left_anti").drop("at_", "bin_")


def with_scores(matches: DataFrame, answers: DataFrame, stats: str = "stats") -> DataFrame:
    """matches with the scores, state, provenance and statistics of answers (match_id, home_score, away_score, finished, source, stats).

    A match that has a score keeps it; statistics are merged, the answer's values win.
    """
    a = answers.select("match_id", F.struct("home_score", "away_score", "finished", "source", stats).alias("a"))
    got = F.col("a").isNotNull() & F.col("home_score").isNull() & F.col("a.home_score").isNotNull()
    kept = F.map_filter(F.coalesce(stats, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))), lambda k, v: ~F.coalesce(F.map_contains_key(F.col(f"a.{stats}"), k), F.lit(False)))
    return matches.join(a, "match_id", "left").select(
        *[c for c in matches.columns if c not in ("home_score", "away_score", "state", "source", stats)],
        F.when(got, F.col("a.home_score")).otherwise(F.col("home_score")).alias("home_score"),
        F.when(got, F.col("a.away_score")).otherwise(F.col("away_score")).alias("away_score"),
        F.when(got & F.col("a.finished"), "finished").otherwise(F.col("state")).alias("state"),
        F.when(got, F.col("a.source")).otherwise(F.col("source")).alias("source"),
        F.when(F.col(f"a.{stats}").isNull(), F.col(stats)).otherwise(F.map_concat(kept, F.col(f"a.{stats}"))).alias(stats),
    )


def reconciled(matches: DataFrame, sources: list[tuple[str, DataFrame]], now: Column, hours: int = 6) -> DataFrame:
    """matches whose start is more than so many hours past and that are not finished: with the result of the first source that has one.

    sources: name and a table of match_id, home_score, away_score, finished, in order of priority. Gives
    match_id, home_score, away_score, source (null: still open).
    """
    due = matches.where((F.col("state") != "finished") & (F.col("scheduled_at") < now - F.expr(f"interval {hours} hours")))
    out = due.select("match_id", F.col("home_score").alias("own_"), F.col("away_score").alias("rival_"))
    for i, (name, table) in enumerate(sources):
        found = table.where("finished and home_score is not null").groupBy("match_id").agg(F.min(F.struct("home_score", "away_score")).alias("r_"))
        out = out.join(found.select("match_id", F.struct("r_.*", F.lit(name).alias("source")).alias(f"s{i}_")), "match_id", "left")
    got = F.when(F.col("own_").isNull(), F.coalesce(*[F.col(f"s{i}_") for i in range(len(sources))]))
    return out.withColumn("g_", got).select("match_id", F.coalesce("g_.home_score", "own_").alias("home_score"), F.coalesce("g_.away_score", "rival_").alias("away_score"), F.col("g_.source").alias("source"))


def placed_bets(bets: DataFrame, asks: DataFrame) -> DataFrame:
    """Answers to asks (bet_id, placed_by, actual_odds, actual_stake): status, odds, stake, value, what the ledger pays, warnings or an error.

    Only pending bets and those handed to a person are placed; of several asks for a bet the first by
    placed_by is, and the others get the error.
    """
    nth = F.row_number().over(Window.partitionBy("bet_id").orderBy("placed_by"))
    both = asks.withColumn("nth_", nth).join(bets.select("bet_id", "status", "odds", "stake", "p", F.lit(True).alias("there_")), "bet_id", "left")
    open_ = F.col("status").isin("PENDING", "PUSHED_TO_HUMAN")
    error = F.when(F.col("there_").isNull(), "not found").when(~open_, F.concat(F.lit("already "), F.col("status"))).when(F.col("nth_") > 1, "already PLACED")
    odds, stake = F.coalesce("actual_odds", "odds"), F.coalesce("actual_stake", "stake")
    ev = expected_value(F.col("p"), odds)
    warnings = F.concat_ws(",", F.when(ev < 0, "negative_ev"), F.when(F.col("actual_odds") < F.col("odds") * 0.95, "slippage"))
    ok = F.col("error").isNull()
    return both.withColumn("error", error).select(
        "bet_id", "placed_by", F.when(ok, "PLACED").otherwise(F.col("status")).alias("status"), F.when(ok, odds).alias("odds"), F.when(ok, stake).alias("stake"),
        F.when(ok, F.round(ev, 6)).alias("ev"), F.when(ok, -stake).alias("ledger_delta"), F.when(ok, warnings).alias("warnings"), "error",
    )


def bridged(predictions: DataFrame, bets: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What becomes of each approved prediction (keys, best_odds, stake, ready): keys, disposition, ledger, status, ledger_delta.

    Without odds or stake it is skipped; one that is not ready goes to PAPER. Where a bet of the keys is
    there already, a pending one in another ledger is moved (updated), any other stays (skipped); else a bet
    is created: REAL bets wait (PENDING), PAPER ones are PLACED and paid at once. Of predictions with equal
    keys the first by order is taken, the others find its bet; where order leaves several, the first by
    ledger, stake and odds, so that reruns agree.
    """
    ledger = F.when(F.col("ready"), "REAL").otherwise("PAPER")
    usable = (F.coalesce("best_odds", F.lit(0)) > 0) & (F.coalesce("stake", F.lit(0)) > 0)
    own = predictions.withColumn("usable_", usable).withColumn("to_", ledger)
    nth = F.row_number().over(Window.partitionBy(*keys, "usable_").orderBy(order, "to_", "stake", "best_odds"))
    there = bets.groupBy(*keys).agg(F.min(F.struct(F.col("status") != "PENDING", "ledger", "status")).alias("b_"))
    both = own.withColumn("nth_", nth).join(there, keys, "left")
    moved = (F.col("b_.status") == "PENDING") & (F.col("b_.ledger") != F.col("to_"))
    fate = F.when(~F.col("usable_"), "skipped_no_odds").when(F.col("b_").isNull() & (F.col("nth_") == 1), "created").when(moved & (F.col("nth_") == 1), "updated_existing").otherwise("skipped_existing")
    made = F.col("disposition") == "created"
    placed = made & (F.col("to_") == "PAPER")
    return both.withColumn("disposition", fate).select(
        *keys, order, "disposition", F.when(made | (F.col("disposition") == "updated_existing"), F.col("to_")).otherwise(F.col("b_.ledger")).alias("ledger"),
        F.when(placed, "PLACED").when(made, "PENDING").otherwise(F.col("b_.status")).alias("status"), F.when(placed, -F.col("stake")).otherwise(F.lit(0)).alias("ledger_delta"),
    )


def disposition_counts(fates: DataFrame) -> DataFrame:
    """How many predictions met each fate, and what the paper ledger pays."""
    return fates.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"), F.sum("ledger_delta").alias("paid"))


def learned_aliases(names: DataFrame, group: str, name: str, order: list[str], least: float = 0.88) -> DataFrame:
    """Canonical names learnt in order: group, key, canonical and how (abbreviation, fuzzy, new) of each distinct name.

    The first time a name's key is met in a group (a sport, say) it is the alias of the first known name it
    abbreviates, else of the first of those most like it (from least on), else a new canonical name. So a
    key is new if and only if no earlier new key is its partner, by abbreviation or likeness. That is
    settled in rounds over the graph of such partners: keys without open or new earlier partners are new,
    keys with a new one are aliases. The graph comes from blocks (last name and initial, rare pairs of
    letters), so no task sees a group, and the rounds follow the longest chain of partners.
    """
    @F.pandas_udf("string")
    def key(s: pd.Series) -> pd.Series:
        return s.map(bare, na_action="ignore")

    rows = names.where(F.trim(name) != "").select(F.col(group).alias("g"), key(F.col(name)).alias("name"), F.struct(*order, F.col(name).alias("name_")).alias("o"))
    first = cut(rows.groupBy("g", "name").agg(F.min("o").alias("o")))
    known = first.select("g", F.col("name").alias("canonical"))
    rank = lambda side: first.select("g", F.col("name").alias(side), F.struct("o", F.col("name").alias("tie")).alias(f"{side}_o"))

    def blocks(side: str, kinds: tuple[int, ...]) -> DataFrame:
        return first.select("g", F.col("name").alias(side), F.explode(F.filter(F.array(*[_block(F.col("name"), k) for k in kinds]), lambda b: b.isNotNull())).alias("block"))

    @F.pandas_udf("boolean")
    def short_of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([stands_for(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    shorts = blocks("name", (1, 2, 3)).join(blocks("canonical", (0,)), ["g", "block"]).select("g", "name", "canonical").distinct()
    shorts = shorts.where("name <> canonical").where(short_of("name", "canonical")).withColumn("ratio", F.lit(None).cast("double"))
    alike = ratios(candidate_pairs(first.select("g", "name"), known, ["g"], least).where("name <> canonical"), least)
    earlier = shorts.unionByName(alike).join(rank("name"), ["g", "name"]).join(rank("canonical"), ["g", "canonical"]).where("canonical_o < name_o")
    edges = cut(earlier.select("g", "name", "canonical", "ratio", F.col("canonical_o").alias("at")))
    state = cut(first.join(edges.select("g", "name").distinct(), ["g", "name"], "left_anti").select("g", "name", F.lit("new").alias("state")))
    while True:
        seen = edges.join(state.select("g", F.col("name").alias("canonical"), "state"), ["g", "canonical"], "left").join(state.select("g", "name"), ["g", "name"], "left_anti")
        fresh = seen.groupBy("g", "name").agg(F.bool_or(F.coalesce(F.col("state") == "new", F.lit(False))).alias("to_new"), F.bool_and(F.col("state").isNotNull()).alias("all_known"))
        fresh = cut(fresh.where("to_new or all_known").select("g", "name", F.when(F.col("to_new"), "alias").otherwise("new").alias("state")))
        if fresh.isEmpty():
            break
        state = cut(state.unionByName(fresh))
    spelt = first.select("g", F.col("name").alias("canonical"), F.trim(F.regexp_replace("o.name_", r"\s+", " ")).alias("spelling"))
    links = edges.join(state.where("state = 'new'").select("g", F.col("name").alias("canonical")), ["g", "canonical"])
    # an abbreviation first, by the order of the known names; then the likest, by that order
    best = links.groupBy("g", "name").agg(F.min_by(F.struct("canonical", "ratio"), F.struct(F.coalesce(-F.col("ratio"), F.lit(-9.0)), F.col("at"))).alias("b"))
    aliases = state.where("state = 'alias'").join(best, ["g", "name"]).select("g", "name", "b.canonical", F.when(F.col("b.ratio").isNull(), "abbreviation").otherwise("fuzzy").alias("how"))
    every = aliases.unionByName(state.where("state = 'new'").select("g", "name", F.col("name").alias("canonical"), F.lit("new").alias("how")))
    return every.join(spelt, ["g", "canonical"]).select(F.col("g").alias(group), F.col("name").alias("key"), F.col("spelling").alias("canonical"), "how")


def _block(c: Column, kind: int) -> Column:
    """Last name and first initial of a full name (0), of 'last, given' (1), 'l. last' (2) and 'last l.' (3); null for another form."""
    words = F.split(c, " ")
    both = lambda last, initial: F.concat_ws(" ", last, F.substring(initial, 1, 1))
    if kind == 0:
        return F.when(F.size(words) >= 2, both(F.element_at(words, -1), words[0]))
    if kind == 1:
        return F.when(F.contains(c, F.lit(",")), both(F.trim(F.substring_index(c, ",", 1)), F.trim(F.regexp_replace(c, "^[^,]*,", ""))))
    a, b = (words[0], words[1]) if kind == 2 else (words[1], words[0])
    return F.when((F.size(words) == 2) & F.contains(a, F.lit(".")), both(b, a))


def stands_for(short: str, full: str) -> bool:
    """Whether a key such as 'sinner j.', 'j. sinner' or 'sinner, jannik' abbreviates 'jannik sinner'."""
    parts = full.split(" ")
    if len(parts) < 2 or short == full:
        return False
    first, last = parts[0], parts[-1]
    if "," in short:
        name, _, given = (x.strip() for x in short.partition(","))
        given = given.rstrip(".")
        return name == last and (given == first or given == first[0])
    if "." not in short:
        return False
    words = short.split(" ")
    if len(words) != 2:
        return False
    initial, name = (words[0], words[1]) if words[0].endswith(".") else (words[1], words[0])
    return initial[:2] == first[0] + "." and name == last


def any_split(stats: Column, keys: tuple[str, ...]) -> Column:
    """Whether any of the keys has a value; without keys, always."""
    return F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: stats[k].isNotNull()) if keys else F.lit(True)


def digest(messages: DataFrame, at: str, text: str, most: int = 500, single: int = 2) -> DataFrame:
    """The messages of a batch to send: each by itself up to so many, else one of all, the earliest `most` in order."""
    kept = messages.orderBy(at, text).limit(most)
    lines = kept.agg(F.array_sort(F.collect_list(F.struct(at, text))).alias("m"))
    each = F.transform("m", lambda x: x[text])
    return lines.select(F.explode(F.when(F.size("m") <= single, each).otherwise(F.array(F.concat_ws("\n", F.format_string("%d alerts", F.size("m")), F.array_join(each, "\n"))))).alias("message"))


def stored_batches(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there now and appends it as Parquet, for jobs by the clock; a rerun adds nothing twice."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def dwelling(stream: DataFrame, key: str, at: str, state: str, states: tuple[str, ...], seconds: int = 120) -> DataFrame:
    """key, at and the seconds that a key has been in one of the states, for rows that reach so many; kept as keyed state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        name, since = kept.get if kept.exists else ("", 0.0)
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        out = []
        for t, s in zip(rows[at], rows[state], strict=True):
            if s != name:
                name, since = s, t.timestamp()
            if s in states and t.timestamp() - since >= seconds:
                out.append((k[0], t, s, t.timestamp() - since))
        kept.update((name, since))
        yield pd.DataFrame(out, columns=["key", "at", "state", "seconds"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"key {kind}, at timestamp, state string, seconds double", "state string, since double", "append", GroupStateTimeout.NoTimeout)
