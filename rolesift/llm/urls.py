"""URL filters: list rules first, then boosted trees on lexical features.

A rule is ``host/path`` with a verdict; it fits its host and all subdomains when
the path starts with its own, and the longest one wins. URLs that no rule fits
are judged by gradient-boosted trees on their letters alone: lengths, depth,
digit share, entropy, parameter counts, hyphens, and the block share of the
host's suffixes among the labelled URLs.

Everything is column expressions; the trees and the suffix shares come from all
labelled rows, and the shares are joined by key. Defined results: a null URL or one
without ``://`` has empty host and path, fits no rule and is judged by its
features like any other; repeated rows are judged each; without labels of both
kinds the method allows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import lower_ascii, written

#: Default rules, ``host/path`` and verdict.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Host words by which the default labels call a URL unwanted.
SEEDS = ["adult", "ads", "bets", "casino", "pills", "porn", "spam", "track", "xxx"]
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(urls: DataFrame) -> DataFrame:
    """page_id, url, host and path."""
    u = F.coalesce(F.col("url"), F.lit(""))
    return urls.select("page_id", u.alias("url"), lower_ascii(F.regexp_extract(u, PARTS, 1)).alias("host"), F.regexp_extract(u, PARTS, 2).alias("path"))


def rule(rules: list[tuple[str, str]], what: int) -> Column:
    """The longest fitting rule (``what`` 0) or its verdict (1); null if none fits."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda x: len(x[0])):
        host, _, path = r[0].partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        found = F.when(fits, F.lit(r[what])).otherwise(found)
    return found


def _count(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{letters}]", ""))


def _entropy(text: str) -> Column:
    """Bits a character of the letters' own distribution."""
    letters = F.filter(F.split(text, ""), lambda x: x != "")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    # The length without a letter tells how often it occurs.
    share = lambda x: (F.length(text) - F.length(F.replace(F.col(text), x, F.lit("")))) / n
    return F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda a, x: a - share(x) * F.log2(share(x)))


def _suffix(labels: int) -> Column:
    return F.substring_index("host", ".", -labels)


def features(rows: DataFrame, suffixes: DataFrame, base: float) -> DataFrame:
    """The rows with an array ``features``."""
    url, n = F.col("url"), F.greatest(F.length("url"), F.lit(1)).cast("double")
    query = F.regexp_extract("url", "(?s)\\?([^#]*)", 1)
    for k in (1, 2):
        own = suffixes.where(F.col("labels") == k).select(F.col("suffix").alias(f"_s{k}"), F.col("share").alias(f"_r{k}"), F.col("n").alias(f"_n{k}"))
        rows = rows.join(own, _suffix(k) == F.col(f"_s{k}"), "left")
    found = [
        F.length("url"), F.length("host"), F.length("path"), _count(F.col("path"), "/"), _count(F.col("host"), "."), _count(F.col("host"), "-"),
        _count(url, "0-9") / n, _count(F.col("host"), "0-9"), _count(F.col("path"), "-_"), _entropy("url"), _entropy("host"),
        _count(query, "="), F.length(query), _count(url, "%"), F.col("url").startswith("https").cast("int"), F.col("url").contains("#").cast("int"),
        _count(F.col("host"), "aeiou") / F.greatest(F.length("host"), F.lit(1)),
        F.coalesce("_r1", F.lit(base)), F.coalesce("_r2", F.lit(base)), F.log1p(F.coalesce("_n1", F.lit(0))), F.log1p(F.coalesce("_n2", F.lit(0))),
    ]
    return rows.withColumn("features", F.array(*[x.cast("double") for x in found])).drop("_s1", "_s2", "_r1", "_r2", "_n1", "_n2")


def seeded(rows: DataFrame, seeds: list[str] = SEEDS) -> DataFrame:
    """page_id, url, host, path and label: 1 where a word of the host is a seed."""
    words = F.split("host", "[^a-z0-9]+")
    return rows.withColumn("label", F.arrays_overlap(words, F.array(*map(F.lit, seeds))).cast("int"))


def train(labelled: DataFrame, n_trees: int = 10, depth: int = 3):
    """Model, suffix table and base share, from all of the rows (url, host, path, label)."""
    rows = written(labelled.select("url", "host", "path", "label"))
    base = float(rows.agg(F.avg("label")).first()[0] or 0.0)
    both = rows.select("label", F.explode(F.array(*[F.struct(F.lit(k).alias("labels"), _suffix(k).alias("suffix")) for k in (1, 2)])).alias("x"))
    counts = both.groupBy("x.labels", "x.suffix").agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n"))
    suffixes = written(counts.select("labels", "suffix", ((F.col("t") + 10 * base) / (F.col("n") + 10)).alias("share"), "n"))
    # Written: the trainer reads its rows several times.
    return trees.fit(written(features(rows, suffixes, base).select("features", "label")), n_trees, depth), suffixes, base


def judge(urls: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str]] | None = None, **training: int) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the method's probability of block) of every row."""
    rules = RULES if rules is None else rules
    rows = parts(urls)
    model, suffixes, base = train(seeded(rows) if labelled is None else labelled, **training)
    seen = features(rows, suffixes, base)
    if model is None:
        seen = seen.withColumn("score", F.lit(0.0))
    else:
        seen = model.transform(seen.withColumn("features", array_to_vector("features")))
        seen = seen.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return seen.select(
        "page_id", "host", "path", rule(rules, 0).alias("rule"), F.coalesce(rule(rules, 1), method).alias("verdict"), "score"
    )
