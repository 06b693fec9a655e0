"""J14 and J5 by inverted indexes: matches are looked up by what both sides share, never by pairing all.

A phrase can only stand in a text that has the phrase's rarest three letters, and
a set of words only in one that has its rarest word, so every phrase and set is listed
once, under that key. Candidates are then tested by the full rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places
from ..functions.text import norm_match, words
from .lineage import cut
from .ordered import top_n
from .profiles import prepare

# Title scores by what a title shares with a term.
PHRASE, THREE, TWO, ONE, NO_TERMS = 55, 42, 32, 16, 20


def grams(text: Column) -> Column:
    """All distinct runs of one to three letters."""
    of = lambda n: F.when(
        F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def own_grams(text: Column) -> Column:
    """The keys a phrase may be listed under: its runs of three letters, or the whole of a shorter one."""
    return F.when(F.length(text) >= 3, F.filter(grams(text), lambda g: F.length(g) == 3)).otherwise(F.array(text))


def rarest(rows: DataFrame, by: list[str], key: str, counts: DataFrame) -> DataFrame:
    """One key for each group: the one that the fewest texts hold; groups with a key that no text holds are gone."""
    held = rows.join(counts, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    least = held.groupBy(*by).agg(F.min(F.struct("_n", key)).alias("_k"))
    return least.filter("_k._n > 0").select(*by, F.col(f"_k.{key}").alias(key))


def _shared_words(titles: DataFrame, terms: DataFrame, holders: DataFrame, k: int) -> DataFrame:
    """title, profile_id and score of terms that share one, two or three words with a title.

    For each word, pair and triple of words only the k first profiles count: who
    comes after them has k profiles of at least its score before it.
    """
    found = titles.select("title", F.explode("tokens").alias("t0"))
    listed = terms.select("norm", F.explode("tokens").alias("t0"))
    out = []
    for size, score in ((1, ONE), (2, TWO), (3, THREE)):
        keys = [f"t{j}" for j in range(size)]
        if size > 1:
            # Words that go on from what is shared already, in the order of letters.
            more = lambda rows, key: rows.select(key, F.col("t0").alias(keys[-1]))  # noqa: E731, B023
            found = found.join(more(one_found, "title"), "title").filter(F.col(keys[-1]) > F.col(keys[-2]))  # noqa: F821
            listed = listed.join(more(one_listed, "norm"), "norm").filter(F.col(keys[-1]) > F.col(keys[-2]))  # noqa: F821
        first = top_n(listed.join(holders, "norm").select(*keys, "profile_id").distinct(), keys, [F.asc("profile_id")], k)
        found = cut(found.join(listed.select(*keys).distinct(), keys, "left_semi"))
        out.append(found.join(first, keys).select("title", "profile_id", F.lit(score).alias("title_score")))
        if size == 1:
            one_found, one_listed = found, listed
    return reduce(DataFrame.unionByName, out)


def _phrases(titles: DataFrame, terms: DataFrame, holders: DataFrame) -> DataFrame:
    """title, profile_id and score of terms that stand in a title."""
    listed = terms.filter("norm <> ''").select("norm", F.explode(own_grams(F.col("norm"))).alias("g"))
    held = titles.select("title", F.explode(grams(F.col("title"))).alias("g"))
    held = cut(held.join(listed.select("g").distinct(), "g", "left_semi"))
    counts = held.groupBy("g").agg(F.count(F.lit(1)).alias("_n"))
    met = held.join(rarest(listed, ["norm"], "g", counts), "g").filter(F.col("title").contains(F.col("norm")))
    return met.select("title", "norm").join(holders, "norm").select("title", "profile_id", F.lit(PHRASE).alias("title_score"))


def top_profiles(postings: DataFrame, profiles: DataFrame, k: int = 10) -> DataFrame:
    """For every posting the k profiles whose targets fit its title best.

    posting_id, profile_id, title_score (above 0) and place; equal scores by
    profile_id. Titles and terms are looked at once each, however many postings
    and profiles have them.
    """
    ready = prepare(profiles).select("profile_id", "scoring_terms")
    named = cut(ready.select("profile_id", F.explode("scoring_terms").alias("t")).select("profile_id", "t.norm", "t.tokens").distinct())
    terms = named.select("norm", "tokens").distinct()
    holders = cut(top_n(named.select("norm", "profile_id").distinct(), ["norm"], [F.asc("profile_id")], k))
    titled = postings.select("posting_id", norm_match(F.col("title")).alias("title")).filter("title <> ''")
    titles = cut(titled.select("title").distinct().withColumn("tokens", words(F.col("title"))))
    open_ = ready.filter(F.size("scoring_terms") == 0).orderBy("profile_id").limit(k)
    # One row with k numbers at most, joined to every title.
    anyone = open_.agg(F.collect_list("profile_id").alias("_ids"))
    default = titles.select("title").join(F.broadcast(anyone), F.lit(True)).select("title", F.explode("_ids").alias("profile_id"), F.lit(NO_TERMS).alias("title_score"))
    found = _shared_words(titles, terms, holders, k).unionByName(_phrases(titles, terms, holders)).unionByName(default)
    best = found.groupBy("title", "profile_id").agg(F.max("title_score").alias("title_score"))
    listed = top_n(best, ["title"], [F.desc("title_score"), F.asc("profile_id")], k, rank="place")
    return titled.join(listed, "title").select("posting_id", "profile_id", "title_score", "place")


def match_locations(postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """J5 for long lists of places: posting_id, profile_id, place_match and its reason.

    Each (profile, location) is looked at once, and of a profile's places only
    those that share a country, region, city, rarest word or rarest letters with it.
    """
    wishes = prepare(profiles).select("profile_id", "wishes")
    listed = cut(wishes.select("profile_id", F.posexplode("wishes").alias("i", "wish")).filter("NOT wish.is_blank"))
    asked = cut(postings.select("profile_id", "location").distinct())
    parsed = cut(asked.select("location").distinct().withColumn("place", places.parse(F.col("location"))).filter("NOT place.is_blank"))
    p, w = (lambda f: F.col(f"place.{f}")), (lambda f: F.col(f"wish.{f}"))
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("key"))
    given = lambda kind, value: F.when(value != "", key(kind, value))
    both = lambda f: F.when((f("city") != "") & (f("region") != ""), F.concat(f("city"), F.lit("|"), f("region")))
    tokens = lambda c, n: words(c, n)

    # What a place can be met by.
    plain = F.array_compact(F.array(given("country", p("country")), given("region", p("region")), given("city", p("city")), F.when(both(p).isNotNull(), key("city+region", both(p)))))
    of_words = F.transform(tokens(p("normalized"), 2), lambda t: key("word", t))
    of_grams = F.transform(grams(p("normalized")), lambda g: key("letters", g))
    held = cut(parsed.select("location", F.explode(F.concat(plain, of_words, of_grams)).alias("x")).select("location", "x.kind", "x.key").distinct())
    counts = held.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("_n"))

    # What a wish asks for: its own rule, and one rare key for each of the looser ones.
    has_city, has_region = w("city") != "", w("region") != ""
    strict = F.array_compact(
        F.array(
            F.when(~has_city & ~has_region, given("country", w("country"))),
            F.when(has_region & ~has_city, key("region", w("region"))),
            F.when(has_city & has_region, key("city+region", both(w))),
            F.when(has_city & ~has_region, key("city", w("city"))),
        )
    )
    exact = listed.select("profile_id", "i", F.explode(strict).alias("x")).select("profile_id", "i", "x.kind", "x.key")
    loose = F.concat(
        F.transform(own_grams(w("normalized")), lambda g: F.struct(F.lit("phrase").alias("rule"), F.lit("letters").alias("kind"), g.alias("key"))),
        F.transform(tokens(w("normalized"), 2), lambda t: F.struct(F.lit("subset").alias("rule"), F.lit("word").alias("kind"), t.alias("key"))),
        F.transform(tokens(w("city"), 3), lambda t: F.struct(F.lit("city").alias("rule"), F.lit("word").alias("kind"), t.alias("key"))),
    )
    spread = listed.select("profile_id", "i", F.explode(loose).alias("x")).select("profile_id", "i", "x.rule", F.struct("x.kind", "x.key").alias("k"))
    rare = rarest(spread, ["profile_id", "i", "rule"], "k", counts.select(F.struct("kind", "key").alias("k"), "_n")).select("profile_id", "i", "k.kind", "k.key")
    sought = exact.unionByName(rare).distinct()
    met = asked.join(held, "location").join(sought, ["profile_id", "kind", "key"]).select("profile_id", "location", "i").distinct()
    tested = met.join(listed, ["profile_id", "i"]).join(parsed, "location").withColumn("why", places.match_reason(F.col("place"), F.col("wish")))
    first = tested.filter("why IS NOT NULL").groupBy("profile_id", "location").agg(F.min_by("why", "i").alias("why"))

    size = wishes.select("profile_id", (F.size("wishes") == 0).alias("_free"))
    rows = postings.select("posting_id", "profile_id", "location").join(size, "profile_id").join(first, ["profile_id", "location"], "left")
    blank = places.parse(F.col("location"))["is_blank"]
    reason = (
        F.when(F.col("_free"), F.lit("no preferred location set"))
        .when(blank, F.lit("blank job location"))
        .otherwise(F.coalesce("why", F.lit("no preferred location match")))
    )
    return rows.select("posting_id", "profile_id", (F.col("_free") | F.col("why").isNotNull()).alias("place_match"), reason.alias("place_match_reason"))
