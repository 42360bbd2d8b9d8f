"""Queries over names and texts: cleaning, parsing, token overlap, risk phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.functions import cleaning as C
from pitchside.functions import matching as M
from pitchside.plans.adapters import MATCHES, matches, table

#: A generated mess: what a CSV cell may hold, by part key.
_CELLS = (" 12 ", "3.75", "", "n/a", "-4.9", "1e3", "+7", "NaN", "Infinity", "12abc", "12d", "1.5f", "0x1p3", "1e19", "\t8\n")
CELL = "[' 12 ', '3.75', '', 'n/a', '-4.9', '1e3', '+7', 'NaN', 'Infinity', '12abc', '12d', '1.5f', '0x1p3', '1e19', ' 8 '][p_partkey % 15 + 1]"


def _one_of(values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def prj_01_safe_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01, PRJ-02: integers and numbers of cells, with defaults."""
    cell = _one_of(_CELLS)
    return _part(spark, sf_dir).select("p_partkey", C.safe_int(cell).alias("as_int"), F.coalesce(C.safe_float(cell), F.lit(-1.0)).alias("as_float"))


def prj_03_scraped_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("EUR "), F.col("p_size"), F.lit("."), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit(" net"))
    return _part(spark, sf_dir).select("p_partkey", C.scraped_number(text).alias("number"))


def prj_04_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in four ways, read by the first format that fits, and their seasons (PRJ-04, PRJ-06 to PRJ-09)."""
    day = F.to_date("scheduled_at")
    style = F.col("match_id") % 4
    text = F.when(style == 0, F.date_format(day, "dd/MM/yyyy")).when(style == 1, F.date_format(day, "yyyy-MM-dd")).when(style == 2, F.date_format(day, "yyyyMMdd")).otherwise("not a date")
    parsed = C.parsed_date(text)
    return matches(spark, sf_dir).select(
        "match_id", parsed.cast("timestamp_ntz").alias("day"),
        *[F.coalesce(C.season_of(parsed, m), F.lit("")).alias(n) for n, m in (("football", 7), ("nfl", 7), ("nba", 7), ("nhl", 7))],
        C.season_in_name(F.concat(F.lit("E0_"), F.when(style == 0, "2023-24").when(style == 1, "1998_99").when(style == 2, "2324").otherwise("20212022"), F.lit(".csv")), day).alias("named"),
    )


def prj_16_set_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda k: (F.col("p_partkey") * k % 8).cast("string")
    text = F.concat(d(3), F.lit("-"), d(5), F.lit(" "), d(7), F.lit("-"), d(1), F.lit("(5) ret"))
    s = C.set_score(text)
    return _part(spark, sf_dir).select("p_partkey", s["won"].alias("won"), s["lost"].alias("lost"))


_SELECTIONS = ("Over 2.50", "1", "x", "2", "Home Win", "under 3.00", "away", "H", "over-2.5", "Over 2.05", "Home -1.50", "away 3.0")
SELECTION = "['Over 2.50', '1', 'x', '2', 'Home Win', 'under 3.00', 'away', 'H', 'over-2.5', 'Over 2.05', 'Home -1.50', 'away 3.0'][p_partkey % 12 + 1]"


def prj_25_canonical_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections in one spelling, with direction and line (PRJ-25, PRJ-26)."""
    c = C.canonical_selection(_one_of(_SELECTIONS))
    d = C.direction_and_line(c)
    return _part(spark, sf_dir).select("p_partkey", c.alias("selection"), d["direction"].alias("direction"), F.coalesce(d["line"], F.lit(-1.0)).alias("line"))


def prj_22_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select(
        "p_partkey", F.array_join(F.array_sort(C.tokens(F.col("p_name"))), " ").alias("tokens"), C.last_name(F.col("p_name")).alias("last_name"),
        C.is_abbreviation(F.substring("p_name", 1, 3)).alias("is_short"), C.truncated(F.col("p_name"), 10).alias("cut"),
    )


def set_04_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand, type and size whose names share a word (SET-04)."""
    return M.sharing_pairs(_part(spark, sf_dir), ["p_brand", "p_type", "p_size"], "p_partkey", C.tokens(F.col("p_name")))


def prj_29_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("soccer_"), F.lower(F.regexp_replace("p_type", "[^A-Za-z]+", "_")))
    return _part(spark, sf_dir).select("p_partkey", C.title_of_key(key, "soccer").alias("league"), C.version_hash(F.col("p_brand"), F.col("p_type"), F.col("p_size")).alias("version"))


PHRASES = ["knee injury", "ruled out", "suspended", "illness", "no news"]
PATTERNS = ["knee injur(?:y|ies)", "ruled out", "suspended", "illness(?:es)?"]


def flt_15_risk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk phrases in news and the veto they lead to (FLT-15, FLT-17)."""
    news = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % 5 + 1).cast("int")), F.lit(" "), F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % 3 + 1).cast("int")))
    low = F.lower(news)
    hits = F.array_distinct(F.array_compact(F.array(*[F.nullif(F.regexp_extract(low, p, 0), F.lit("")) for p in PATTERNS])))
    n = F.size(hits)
    return table(spark, sf_dir, "documents").select("doc_id", hits.alias("h")).select(
        "doc_id", F.array_join("h", ",").alias("hits"), F.when(F.size("h") >= 2, "VETO").when(F.size("h") > 0, "NOTE").otherwise("OK").alias("decision")
    )


def flt_14_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(F.col("c_mktsegment").ilike("%build%")).select("c_custkey", "c_mktsegment")


def prj_30_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that glob patterns match (PRJ-30)."""
    patterns = spark.createDataFrame([("%1",), ("n%_5",), ("nation_07",), ("nation_7",)], "pattern string")
    n = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("key"))
    return n.join(F.broadcast(patterns), F.expr("key like pattern")).select("key").distinct()


def prj_31_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by their aliases, else as they are (PRJ-31)."""
    alias = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("alias"), F.concat(F.lit("Team "), F.initcap("n_name")).alias("shown"), "n_regionkey")
    raw = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.concat("n_name", F.lit(" B"))).otherwise(F.upper("n_name")).alias("raw"))
    return raw.join(F.broadcast(alias), F.lower("raw") == F.col("alias"), "left").select("s_suppkey", F.coalesce("shown", "raw").alias("name"))


def flt_03_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason against a fixture (FLT-03)."""
    m = matches(spark, sf_dir)
    return m.select("match_id", F.coalesce(C.first_failure(
        (F.length(F.col("home").cast("string")) > 1, "home_name"), (F.col("away") > 3, "away_name"), (F.col("scheduled_at") > F.lit("1992-06-01").cast("timestamp_ntz"), "time"),
        (F.col("league") != 7, "league"), (F.col("total") > 50_000, "odds"),
    ), F.lit("ok")).alias("reason"))


QUERIES = {
    "prj_01_safe_numbers": prj_01_safe_numbers,
    "prj_03_scraped_number": prj_03_scraped_number,
    "prj_04_dates": prj_04_dates,
    "prj_16_set_score": prj_16_set_score,
    "prj_25_canonical_selection": prj_25_canonical_selection,
    "prj_22_tokens": prj_22_tokens,
    "set_04_overlap": set_04_overlap,
    "prj_29_titles": prj_29_titles,
    "flt_15_risk_scan": flt_15_risk_scan,
    "flt_14_contains": flt_14_contains,
    "prj_30_globs": prj_30_globs,
    "prj_31_display_name": prj_31_display_name,
    "flt_03_gate": flt_03_gate,
}


def _season(first: int) -> str:
    y = f"(year(day) - (month(day) < {first})::INT)"
    return f"coalesce({y}::VARCHAR || '-' || lpad((({y} + 1) % 100)::VARCHAR, 2, '0'), '')"


_F = f"CASE WHEN isfinite(TRY_CAST(trim({CELL}) AS DOUBLE)) THEN TRY_CAST(trim({CELL}) AS DOUBLE) END"
_TOKENS = r"list_distinct(list_filter(string_split_regex(trim(p_name), '\s+'), lambda t: length(t) >= 3))"
_NEWS = "lower(coalesce(text, '') || ' ' || ['knee injury', 'ruled out', 'suspended', 'illness', 'no news'][doc_id % 5 + 1] || ' ' || ['knee injury', 'ruled out', 'suspended', 'illness', 'no news'][doc_id % 3 + 1])"
_HITS = ", ".join(f"nullif(regexp_extract(low, '{p}'), '')" for p in PATTERNS)
SQL = {
    "prj_01_safe_numbers": f"SELECT p_partkey, coalesce(TRY_CAST(trunc({_F}) AS BIGINT), 0) AS as_int, coalesce({_F}, -1.0) AS as_float FROM part",
    "prj_03_scraped_number": "SELECT p_partkey, (p_size || '.' || lpad((p_partkey % 100)::VARCHAR, 2, '0'))::DOUBLE AS number FROM part",
    "prj_04_dates": f"""WITH {MATCHES}, d AS (SELECT match_id, match_id % 4 AS style, scheduled_at::DATE AS real_day, CASE WHEN match_id % 4 < 3 THEN scheduled_at::DATE END AS day FROM matches)
SELECT match_id, day::TIMESTAMP AS day, {_season(7)} AS football, {_season(7)} AS nfl, {_season(7)} AS nba, {_season(7)} AS nhl,
  CASE WHEN style = 0 OR style = 2 THEN '2023-24' ELSE (SELECT {_season(7)} FROM (SELECT real_day AS day)) END AS named FROM d""",
    "prj_16_set_score": """SELECT p_partkey, ((a > b)::INT + (c > e)::INT) AS won, ((b > a)::INT + (e > c)::INT) AS lost
FROM (SELECT p_partkey, p_partkey * 3 % 8 AS a, p_partkey * 5 % 8 AS b, p_partkey * 7 % 8 AS c, p_partkey % 8 AS e FROM part)""",
    "prj_25_canonical_selection": f"""WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(trim({SELECTION})), '[\\s–]+', '_', 'g'), '([a-z])-([0-9])', '\\1_\\2', 'g') AS s FROM part),
k AS (SELECT p_partkey, CASE WHEN s IN ('1', 'h', 'home_win') THEN 'home' WHEN s IN ('x', 'd') THEN 'draw' WHEN s IN ('2', 'a', 'away_win') THEN 'away' ELSE s END AS s FROM s),
c AS (SELECT p_partkey, CASE WHEN regexp_matches(s, '_-?[0-9]+\\.[0-9]+$') THEN rtrim(rtrim(s, '0'), '.') ELSE s END AS s FROM k)
SELECT p_partkey, s AS selection, split_part(s, '_', 1) AS direction, coalesce(TRY_CAST(nullif(substr(s, length(split_part(s, '_', 1)) + 2), '') AS DOUBLE), -1.0) AS line FROM c""",
    "prj_22_tokens": f"""SELECT p_partkey, array_to_string(list_sort({_TOKENS}), ' ') AS tokens,
  CASE WHEN contains(p_name, ',') THEN trim(split_part(lower(p_name), ',', 1)) ELSE list_reduce(string_split_regex(trim(lower(p_name)), '\\s+'), lambda b, w: CASE WHEN length(w) > length(b) THEN w ELSE b END) END AS last_name,
  length(trim(substr(p_name, 1, 3))) < 4 AS is_short, CASE WHEN length(p_name) > 10 THEN p_name[:7] || '...' ELSE p_name END AS cut FROM part""",
    "set_04_overlap": f"""WITH p AS (SELECT *, {_TOKENS} AS t FROM part)
SELECT x.p_partkey AS a, y.p_partkey AS b, len(list_intersect(x.t, y.t)) AS n_shared FROM p x JOIN p y
ON x.p_brand = y.p_brand AND x.p_type = y.p_type AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey AND list_has_any(x.t, y.t)""",
    "prj_29_titles": """WITH p AS (SELECT *, string_split(replace(lower(regexp_replace(p_type, '[^A-Za-z]+', '_', 'g')), '_', ' '), ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), ' ') AS league, sha256(p_brand || '_' || p_type || '_' || p_size)[:12] AS version FROM p""",
    "flt_15_risk_scan": f"""WITH n AS (SELECT doc_id, {_NEWS} AS low FROM documents), h AS (SELECT doc_id, list_filter([{_HITS}], lambda x: x IS NOT NULL) AS h FROM n)
SELECT doc_id, array_to_string(h, ',') AS hits, CASE WHEN len(h) >= 2 THEN 'VETO' WHEN len(h) > 0 THEN 'NOTE' ELSE 'OK' END AS decision FROM h""",
    "flt_14_contains": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE '%build%'",
    "prj_30_globs": "SELECT DISTINCT lower(n_name) AS key FROM nation WHERE lower(n_name) LIKE '%1' OR lower(n_name) LIKE 'n%_5' OR lower(n_name) IN ('nation_07', 'nation_7')",
    "prj_31_display_name": """WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN n_name || ' B' ELSE upper(n_name) END AS raw FROM supplier JOIN nation ON s_nationkey = n_nationkey),
a AS (SELECT lower(n_name) AS alias, 'Team ' || array_to_string(list_transform(string_split(lower(n_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS shown FROM nation)
SELECT s_suppkey, coalesce(shown, raw) AS name FROM r LEFT JOIN a ON lower(raw) = alias""",
    "flt_03_gate": f"""WITH {MATCHES} SELECT match_id, CASE WHEN length(home::VARCHAR) <= 1 THEN 'home_name' WHEN away <= 3 THEN 'away_name'
  WHEN scheduled_at <= TIMESTAMP '1992-06-01' THEN 'time' WHEN league = 7 THEN 'league' WHEN total <= 50000 THEN 'odds' ELSE 'ok' END AS reason FROM matches""",
}
