"""Names that nearly agree: keys without accents, abbreviations, ratios, tables in HTML."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.functions.cleaning import last_name
from pitchside.sources.scratch import cut

LEAST_RATIO = 0.88
#: Frequencies of pairs of letters that are sent to every task.
COMMON = 20_000
#: Words of a side whose sets are keys of an index (15 sets); longer sides are compared by single words.
WORDS = 4
#: Rows of a key that are compared with as many others at once, pairs and rows for a task, and the most tasks (beyond them, tasks grow).
BLOCK, PAIRS, ROWS, MOST_TASKS = 1_000, 4_000_000, 250_000, 10_000


def bare(name: str | None) -> str | None:
    """Blanks collapsed, accents dropped, lower case."""
    if name is None:
        return None
    flat = unicodedata.normalize("NFKD", re.sub(r"\s+", " ", name.strip()))
    return "".join(c for c in flat if not unicodedata.combining(c)).lower()


def name_key(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(bare, na_action="ignore")

    return run(c)


def abbreviates(short: Column, full: Column) -> Column:
    """Whether keys such as 'sinner j.', 'j. sinner' or 'sinner, jannik' stand for 'jannik sinner'."""
    parts = F.split(F.trim(full), " ")
    first, last = parts[0], F.element_at(parts, -1)
    comma = F.regexp_extract(short, r"^([^,]+),\s*(.+)$", 1)
    given = F.regexp_replace(F.regexp_extract(short, r"^([^,]+),\s*(.+)$", 2), r"\.+$", "")
    after = F.regexp_extract(short, r"^(.+?)\s+([a-z])\.(?:[a-z]\.)*$", 1)
    after_initial = F.regexp_extract(short, r"^(.+?)\s+([a-z])\.(?:[a-z]\.)*$", 2)
    before = F.regexp_extract(short, r"^([a-z])\.\s*(.+)$", 2)
    before_initial = F.regexp_extract(short, r"^([a-z])\.\s*(.+)$", 1)
    initial = F.substring(first, 1, 1)
    return F.coalesce(
        F.when(F.size(parts) < 2, F.lit(False))
        .when(comma != "", (F.trim(comma) == last) & ((given == first) | ((F.length(given) == 1) & (given == initial))))
        .when(after != "", (after == last) & (after_initial == initial))
        .when(before != "", (before == last) & (before_initial == initial)),
        F.lit(False),
    )


def grams(c: Column) -> Column:
    """The pairs of neighbouring letters of a name, each with its number among equal ones; so the array is a set."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2)))
    numbered = F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda x: x == g)).cast("string")))
    return F.when(F.length(c) >= 2, numbered).otherwise(F.array().cast("array<string>"))


def _lost(own: Column, other: Column, least: float) -> Column:
    """How many pairs of letters of a name of length own may lack in a similar name of length other.

    A ratio of least leaves (1 - least) of both lengths as letters that have no partner; one of the
    name's own takes two of its pairs with it, one of the other name parts one.
    """
    apart = F.floor((1 - least) * (own + other) + 1e-9)
    return F.floor((3 * apart + own - other) / 2)


def candidate_pairs(names: DataFrame, canonical: DataFrame, keys: list[str], least: float = LEAST_RATIO) -> DataFrame:
    """keys, name and canonical: every two that can have a ratio of least, and few others.

    Names of keys and name, known names of keys and canonical, both distinct. Pairs of letters are in
    order of how rare they are; a name is looked up by its first ones only, as many as a similar name may
    lack and one more, so two similar names share one of those. Lengths bound it further, and what is
    left must have enough pairs in common. No frequent pair of letters gathers all names.
    """
    both = names.select(F.col("name").alias("n")).unionByName(canonical.select(F.col("canonical").alias("n"))).distinct()
    # the frequencies only order the pairs: the COMMON most frequent ones are enough, and bound what is broadcast
    counts = both.select(F.explode(grams(F.col("n"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    counts = F.broadcast(counts.orderBy(F.desc("often"), "gram").limit(COMMON))
    # the most that _lost can be for a name of length n: that of the shortest similar name, without rounding
    most = 1.5 * (1 - least) + 0.5 + (1.5 * (1 - least) - 0.5) * least / (2 - least)

    def indexed(rows: DataFrame, name: str) -> DataFrame:
        each = rows.select(*keys, name, F.explode(grams(F.col(name))).alias("gram")).join(counts, "gram", "left")
        every = each.groupBy(*keys, name).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram"))).alias("all"))
        n = F.length(name)
        first = F.slice("all", F.lit(1), F.floor(n * most + 1e-9).cast("int") + 1)
        return every.select(*keys, name, n.alias(f"{name}_n"), F.posexplode(first).alias(f"{name}_at", "first_")).select(*keys, name, f"{name}_n", f"{name}_at", "first_.gram")

    m, n = F.col("name_n"), F.col("canonical_n")
    near = F.abs(m - n) <= F.floor((1 - least) * (m + n) + 1e-9)
    found = (
        indexed(names, "name").join(indexed(canonical, "canonical"), [*keys, "gram"])
        .where(near & (F.col("name_at") <= _lost(m, n, least)) & (F.col("canonical_at") <= _lost(n, m, least)))
        .select(*keys, "name", "canonical").distinct()
    )
    x, y = F.length("name"), F.length("canonical")
    enough = F.size(F.array_intersect(grams(F.col("name")), grams(F.col("canonical")))) >= x - 1 - _lost(x, y, least)
    short = names.where(F.length("name") < 2).join(canonical.select(*keys, F.col("canonical"), F.col("canonical").alias("name")), [*keys, "name"])
    return found.where(enough).unionByName(short.select(*keys, "name", "canonical"))


def ratios(pairs: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """pairs with their ratio, where it is least or more."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(a, b, strict=True)], dtype=float)

    return pairs.withColumn("ratio", ratio("name", "canonical")).where(F.col("ratio") >= least)


def closest_names(names: DataFrame, canonical: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """name, canonical and ratio: the first of the most similar known names, if similar enough; a row for each of names.

    Each distinct name is looked up once, by candidate_pairs. Empty names and nulls have none.
    """
    known = canonical.select("canonical").where("canonical is not null").distinct()
    asked = names.select("name").where("name <> ''").distinct()
    scored = ratios(candidate_pairs(asked, known, [], least), least)
    found = scored.groupBy("name").agg(F.min_by(F.struct("canonical", "ratio"), F.struct(-F.col("ratio"), F.col("canonical"))).alias("r")).select("name", "r.*")
    return names.select("name").join(found, "name")


def _person_keys(c: Column) -> Column:
    """What a name is looked up by: itself, and last name with initial by each form it may have (as abbreviates reads them)."""
    words = F.split(F.trim(c), " ")
    of = lambda last, initial: F.when((last != "") & (initial != ""), F.concat_ws(" ", F.trim(last), F.substring(initial, 1, 1)))
    comma, after, before = r"^([^,]+),\s*(.+)$", r"^(.+?)\s+([a-z])\.(?:[a-z]\.)*$", r"^([a-z])\.\s*(.+)$"
    part = lambda p, i: F.regexp_extract(c, p, i)
    forms = [F.when(F.size(words) >= 2, of(F.element_at(words, -1), words[0])), of(part(comma, 1), part(comma, 2)), of(part(after, 1), part(after, 2)), of(part(before, 2), part(before, 1))]
    return F.array_distinct(F.array_compact(F.array(F.concat(F.lit("="), c), *forms)))


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"[\s,.]+"), lambda t: t != ""))


def event_matches(matches: DataFrame, events: DataFrame, least: int = 3, fixture_order: bool = False, passes: tuple[int, ...] = (-1, 0, 1, 2, 3)) -> DataFrame:
    """Each match with the event that names the same teams: match_id, event_id and tier.

    matches: match_id, day, home, away, and bound (an event id known already, or null); events:
    event_id, day, home, away (keys as of name_key). A bound event of any day comes first (tier -1).
    Then, among events of the same day: equal names (0), abbreviations (1), names that agree on both
    sides by shared words, or share a word while one is inside the other (2; the most shared words win),
    equal last names on both sides (3). Ties go to the least event_id. With fixture_order the first event
    by id that fits any pass wins. Only the tiers in passes count.

    Each pass looks a match up in an index of the events by keys that take in both sides: the names, last
    name and initial, words of each side, the last names. Events of one day and one pair of names are one
    (the least id). The third pass looks up sets of words: the largest two sets that an event holds are its
    score, so its index has one event for each two sets, and a frequent word pairs nothing. Sides of more
    than WORDS words have too many sets and are compared by single words. Without fixture_order only
    matches that no earlier pass placed go on to the next.
    """
    if "bound" not in matches.columns:
        matches = matches.withColumn("bound", F.lit(None).cast(events.schema["event_id"].dataType))
    rows = matches.select("match_id", "day", F.col("home").alias("mh"), F.col("away").alias("ma"))
    others = cut(events.groupBy("day", F.col("home").alias("eh"), F.col("away").alias("ea")).agg(F.min("event_id").alias("event_id")))
    mh, ma, eh, ea = (F.col(c) for c in ("mh", "ma", "eh", "ea"))
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda t: F.length(t) >= least))
    inside = lambda a, b: (F.contains(a, b) | F.contains(b, a)) & F.arrays_overlap(_words(a), _words(b))
    side = lambda a, b: F.greatest(F.size(F.array_intersect(words(a), words(b))), inside(a, b).cast("int"))
    same = lambda a, b: (a == b) | abbreviates(a, b) | abbreviates(b, a)
    both = lambda df, h, a: df.withColumn("key_h", F.explode(h)).withColumn("key_a", F.explode(a))
    keys = ["day", "key", "check"]

    def keyed(df: DataFrame, *rest: str) -> DataFrame:
        """rest, and 96 bits of both keys for the shuffle, which with the day stand for the keys."""
        return df.select("day", F.xxhash64("key_h", "key_a").alias("key"), F.hash("key_h", "key_a").alias("check"), *rest)

    def found(left: DataFrame, tier: int) -> DataFrame:
        if tier == 2:
            return by_words(left)
        if tier == 1:
            index = keyed(both(others, _person_keys(eh), _person_keys(ea)), "event_id", "eh", "ea")
            asks = keyed(both(left, _person_keys(mh), _person_keys(ma)), "match_id", "mh", "ma")
            pairs = asks.join(index.hint("shuffle_merge"), keys).where(same(mh, eh) & same(ma, ea))
        else:
            of = last_name if tier == 3 else lambda c: c
            index = others.groupBy("day", of(eh).alias("key_h"), of(ea).alias("key_a")).agg(F.min("event_id").alias("event_id"))
            pairs = left.withColumn("key_h", of(mh)).withColumn("key_a", of(ma)).join(index.hint("shuffle_merge"), ["day", "key_h", "key_a"])
        return pairs.select("match_id", "event_id", F.lit(tier).alias("tier"), F.lit(0).alias("score"))

    def within(left: DataFrame, own: str, other: str) -> DataFrame:
        """day, own and what: the names other of which one is inside the other, that share no long word."""
        m, e = F.col(own), F.col(other)
        odd = lambda c: F.filter(_words(c), lambda t: (F.length(t) < least) | ~F.array_contains(F.split(c, " "), t))
        names = lambda df, c, keys: df.select("day", c).distinct().withColumn("t", F.explode(keys))
        near = [names(left, own, f(m)).join(names(others, other, g(e)).hint("shuffle_merge"), ["day", "t"]) for f, g in ((odd, _words), (_words, odd))]
        only = inside(m, e) & (F.size(F.array_intersect(words(m), words(e))) == 0)
        return near[0].unionByName(near[1]).where(only).groupBy("day", own).agg(F.collect_set(other).alias(f"{own}_in"))

    def by_words(left: DataFrame) -> DataFrame:
        wide = lambda a, b: F.greatest(F.size(words(a)), F.size(words(b))) > WORDS
        # a set of words with its size; a name inside another counts as one word
        sets = lambda c: F.transform(_sets(words(c), 1 if fixture_order else WORDS), lambda t: F.struct(F.size(t).alias("n"), F.array_join(t, " ").alias("key")))
        name = lambda c: F.struct(F.lit(1).alias("n"), F.concat(F.lit(" "), c).alias("key"))
        odd = {c: cut(within(left, c, e)) for c, e in (("mh", "eh"), ("ma", "ea"))}
        odd = {c: d for c, d in odd.items() if not d.isEmpty()}
        asks, of_event, of_match = left.where(~wide(mh, ma)), {"mh": sets(eh), "ma": sets(ea)}, {"mh": sets(mh), "ma": sets(ma)}
        for c, e in (("mh", eh), ("ma", ea)):
            if c in odd:
                asks = asks.join(odd[c].hint("shuffle_merge"), ["day", c], "left")
                of_event[c] = F.concat(sets(e), F.array(name(e)))
                of_match[c] = F.concat(sets(F.col(c)), F.transform(F.coalesce(f"{c}_in", F.array().cast("array<string>")), name))
        index = keyed(both(others.where(~wide(eh, ea)), *of_event.values()), "event_id").groupBy(*keys).agg(F.min("event_id").alias("event_id"))
        got = both(asks, *of_match.values()).withColumn("score", (F.col("key_h.n") + F.col("key_a.n")).cast("byte"))
        got = keyed(got, "match_id", "score").join(index.hint("shuffle_merge"), keys).select("match_id", "event_id", F.lit(2).alias("tier"), F.col("score").cast("int").alias("score"))
        whole = lambda df, h, a: both(df, _words(h), _words(a))
        pairs = whole(left.where(wide(mh, ma)), mh, ma).join(whole(others, eh, ea).hint("shuffle_merge"), ["day", "key_h", "key_a"])
        pairs = pairs.unionByName(whole(left.where(~wide(mh, ma)), mh, ma).join(whole(others.where(wide(eh, ea)), eh, ea).hint("shuffle_merge"), ["day", "key_h", "key_a"]))
        home, away = side(mh, eh), side(ma, ea)
        return got.unionByName(pairs.where((home > 0) & (away > 0)).select("match_id", "event_id", F.lit(2).alias("tier"), (home + away).alias("score")))

    bound = matches.where("bound is not null").join(events.select(F.col("event_id").alias("bound")).hint("shuffle_merge"), "bound").select(
        "match_id", F.col("bound").alias("event_id"), F.lit(-1).alias("tier"), F.lit(0).alias("score")
    )
    got = [bound] if -1 in passes else []
    order = F.struct(F.col("tier") >= 0, "event_id", "tier") if fixture_order else F.struct("tier", (-F.col("score")).alias("s"), "event_id")
    best = lambda df: df.groupBy("match_id").agg(F.min_by(F.struct("event_id", "tier"), order).alias("r")).select("match_id", "r.*")
    if fixture_order:
        every = [*got, *[cut(best(found(rows, t).withColumn("tier", F.lit(t)))).withColumn("score", F.lit(0)) for t in range(4) if t in passes]]
        return best(reduce(DataFrame.unionByName, every))
    done: list[DataFrame] = []
    for t in range(-1, 4):
        if t not in passes:
            continue
        left = rows.join(reduce(DataFrame.unionByName, done).select("match_id").hint("shuffle_merge"), "match_id", "left_anti") if done else rows
        done.append(cut(best(bound if t < 0 else found(cut(left) if t == 2 else left, t))))
    return reduce(DataFrame.unionByName, done) if done else best(bound.where("false"))


def _sets(words: Column, most: int) -> Column:
    """The sets, in order, of one to most of at most WORDS words."""
    sizes = [i for i in range(1, 2**WORDS) if i.bit_count() <= most]
    some = lambda i: F.filter(words, lambda t, at: F.lit(i).bitwiseAND(F.pow(F.lit(2), at).cast("int")) != 0)
    every = F.array(*[F.when(F.size(words) >= i.bit_length(), some(i)) for i in sizes])
    return F.transform(F.array_compact(every), lambda t: F.array_sort(t))


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append("".join(self.cell).strip())
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_tables(c: Column) -> Column:
    """Tables, rows and cells of a page; empty rows and empty tables are left out."""

    @F.pandas_udf("array<array<array<string>>>")
    def run(s: pd.Series) -> pd.Series:
        def tables(page):
            p = _Tables()
            p.feed(page or "")
            found = [[r for r in t if r] for t in p.tables]
            return [t for t in found if t]

        return s.map(tables)

    return run(c)


def sharing_pairs(df: DataFrame, keys: list[str], i: str, words: Column, block: int = BLOCK) -> DataFrame:
    """a, b and n_shared of all rows of equal keys, a before b, whose distinct words have some in common.

    The rows of a key are dealt to blocks of bounded size, by words; blocks meet in pairs, each pair
    of them in one place, and tasks are as many as the pairs need, so neither a frequent key nor
    copies lengthen a task. Rows with the same words are one set there: sets are compared, and only
    those that share a word become pairs of rows.
    """
    rows = df.select(*keys, F.col(i).alias("i"), F.array_sort(words).alias("t")).dropna(subset=["i", *keys]).where("size(t) > 0")
    key = Window.partitionBy(*keys)
    block_of = lambda place: F.floor(place / block).cast("int")
    sets = rows.select("*", block_of(F.row_number().over(key.orderBy("t", "i")) - 1).alias("c"), block_of(F.count(F.lit(1)).over(key) - 1).alias("last"))
    sets = cut(sets.groupBy(*keys, "c", "last", "t").agg(F.collect_list("i").alias("i")))
    n = F.col("n").cast("double")
    total, pairs = sets.groupBy(*keys).agg(F.sum(F.size("i")).alias("n")).agg(F.sum(n), F.sum(n * n)).first()
    tasks = min(MOST_TASKS, 1 + int((total or 0) / ROWS + (pairs or 0) / PAIRS))
    at = [*keys, "cx", "cy"]
    x = sets.select(*keys, F.col("c").alias("cx"), F.explode(F.sequence("c", "last")).alias("cy"), F.col("t").alias("tx"), F.col("i").alias("ix"))
    y = sets.select(*keys, F.explode(F.sequence(F.lit(0), "c")).alias("cx"), F.col("c").alias("cy"), F.col("t").alias("ty"), F.col("i").alias("iy"))
    once = (F.col("cx") < F.col("cy")) | (F.col("tx") <= F.col("ty"))
    met = x.repartition(tasks, *at).join(y.repartition(tasks, *at), at).where(once & F.arrays_overlap("tx", "ty"))
    alone = (F.col("cx") == F.col("cy")) & (F.col("tx") == F.col("ty"))
    met = met.select(F.size(F.array_intersect("tx", "ty")).cast("long").alias("n_shared"), alone.alias("alone"), F.explode("ix").alias("a"), "iy").select("n_shared", "alone", "a", F.explode("iy").alias("b"))
    return met.where((F.col("a") < F.col("b")) | (~F.col("alone") & (F.col("a") > F.col("b")))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n_shared")
