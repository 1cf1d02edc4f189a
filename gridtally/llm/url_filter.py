"""URL filters with DataFrame functions only: rules first, then a learned verdict.

A rule is a host and a path; it fits its host and all subdomains if the url's
path starts with the rule's.  The longest fitting rule decides.  A url that no
rule fits is judged by logistic regression on hashed character n-grams of host
and path, fitted here from a small labelled table by accelerated gradient
descent: each step is one aggregation over that table, and only the weights, of
which there are FEATURES, pass through the driver.

Defined results: a null url or one without "://" has an empty host and path, so
no n-grams, and gets the verdict of the intercept.  Repeated rows are judged
alike; an empty table gives an empty one; a very long url is one row, judged whole.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = 4096
GRAMS = (3, 4, 5)
STEPS = 30
RIDGE = 0.02
#: The labelled table is small by contract; a larger one is refused, not sampled.
MOST_LABELLED = 100_000
THRESHOLD = 0.55

#: Production rules, as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

# A small labelled table of invented urls, 1 for those to block.
LABELLED = [
    ("https://spam-blog.example.org/en/12", 1),
    ("http://spam-links.example.net/de/7?page=2", 1),
    ("http://link-farm.example.org/en/buy", 1),
    ("http://www.diet-pills.example.com/en/3", 1),
    ("https://cheap-meds.example.org/en/order", 1),
    ("http://pills-online.example.net/de/discount", 1),
    ("https://casino-bonus.example.org/en/spin", 1),
    ("http://best-casino.example.net/en/jackpot", 1),
    ("https://free-slots.example.org/de/casino", 1),
    ("http://poker-bonus.example.net/es/win", 1),
    ("https://adult-cams.example.org/en/xxx", 1),
    ("http://xxx-videos.example.net/en/1", 1),
    ("https://hot-sex.example.org/de/5", 1),
    ("http://porn-tube.example.net/en/watch", 1),
    ("https://warez-crack.example.org/en/keygen", 1),
    ("http://torrent-crack.example.net/en/serial", 1),
    ("https://payday-loan.example.org/en/apply", 1),
    ("http://fast-loan.example.net/en/cash", 1),
    ("https://replica-watch.example.org/en/rolex", 1),
    ("http://fake-rolex.example.net/en/cheap", 1),
    ("https://buy-followers.example.org/en/likes", 1),
    ("http://seo-backlinks.example.net/en/buy-links", 1),
    ("https://phish-login.example.org/en/verify-account", 1),
    ("http://account-verify.example.net/en/login", 1),
    ("http://online-bets.example.org/en/odds", 1),
    ("https://sports-betting.example.net/de/free-bet", 1),
    ("http://ad-tracker.example.org/en/click", 1),
    ("https://ads-server.example.net/en/banner", 1),
    ("https://casino-club.example.com/en/2", 1),
    ("http://win-casino.example.org/en/77", 1),
    ("http://spam-pages.example.com/en/8", 1),
    ("https://adult-chat.example.com/de/6", 1),
    ("http://x-adult.example.net/en/31", 1),
    ("http://farm-links.example.com/en/6", 1),
    ("https://weight-loss-miracle.example.org/en/diet-pills", 1),
    ("http://crypto-giveaway.example.net/en/double-coins", 1),
    ("https://news.example.org/en/2021/article", 0),
    ("http://www.example.org/en/334/", 0),
    ("https://blog.example.net/de/612", 0),
    ("http://m.example.org/fr/414", 0),
    ("https://docs.example.org/en/guide", 0),
    ("http://library.example.net/en/catalogue", 0),
    ("https://www.university.example.org/de/physics", 0),
    ("http://museum.example.net/de/history", 0),
    ("https://blog.there.example.org/es/978?page=2", 0),
    ("http://thother.example.org/en/453#top", 0),
    ("https://m.thinner.example.net/en/25", 0),
    ("http://blog.tion.example.net/en/960", 0),
    ("https://www.then.example.org/en/148.html", 0),
    ("http://theron.example.net/de/65.html", 0),
    ("https://thing.example.org/en/328/", 0),
    ("http://www.thou.example.net/en/101", 0),
    ("https://recipes.example.org/en/bread", 0),
    ("http://gardening.example.net/de/roses", 0),
    ("https://weather.example.org/en/today", 0),
    ("http://maps.example.net/de/city", 0),
    ("https://forum.example.org/en/thread/88", 0),
    ("http://code.example.net/en/project", 0),
    ("https://astronomy.example.org/en/planets", 0),
    ("http://music.example.net/de/choir", 0),
    ("https://parish.example.org/en/events", 0),
    ("http://school.example.net/en/timetable", 0),
    ("https://station.example.org/en/lines", 0),
    ("http://blog.motion.example.org/en/55", 0),
    ("https://www.table.example.org/en/809", 0),
    ("http://nation.example.com/de/41", 0),
    ("https://m.notable.example.com/en/7/", 0),
    ("http://heather.example.com/en/930.html", 0),
    ("https://another.example.com/fr/18", 0),
    ("http://m.thatha.example.net/en/1570", 0),
    ("https://theatre.example.org/fr/stage", 0),
    ("http://tiontion.example.org/en/66", 0),
    ("https://blog.thable.example.net/en/42#top", 0),
    ("http://hearth.example.org/en/20/", 0),
    ("https://www.onion.example.com/en/311", 0),
    ("http://m.tint.example.org/en/4", 0),
    ("https://stand.example.net/es/78", 0),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, of a url; both empty without "://"."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, form, 1), capitals, capitals.lower())
    return host, F.regexp_extract(text, form, 2)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as a string, and its verdict; null if none fits."""
    name = verdict = None
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = (F if name is None else name).when(fits, F.lit(rule_host + rule_path))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(what))
    empty = F.lit(None).cast("string")
    return (empty, empty) if name is None else (name, verdict)


def gram_features(host: Column, path: Column) -> Column:
    """Distinct hashed n-grams of host and path, each marked at its ends."""
    none = F.array().cast("array<int>")

    def hashed(mark: str, text: Column, n: int) -> Column:
        last = F.length(text) - (n - 1)
        grams = F.transform(
            F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
            lambda i: F.pmod(
                F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(n))), F.lit(FEATURES)
            ).cast("int"),
        )
        return F.when((last >= 1) & (host != ""), grams).otherwise(none)

    ended = F.concat(F.lit("^"), host, F.lit("$"))
    marked = [("h", ended), ("p", path)]
    return F.array_distinct(F.concat(*(hashed(m, t, n) for m, t in marked for n in GRAMS)))


def array_literal(values: list[float]) -> Column:
    """A constant array; Catalyst folds it before the job starts."""
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def margin(features: Column, weights: Column, intercept: float) -> Column:
    """Intercept plus the mean-square-normalised sum of the features' weights."""
    zero = F.lit(0.0)
    total = F.aggregate(features, zero, lambda s, f: s + F.get(weights, f))
    return F.lit(intercept) + total / F.sqrt(F.greatest(F.size(features), F.lit(1)))


def probability(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def labelled_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{url}', {label})" for url, label in LABELLED)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)")


def fit(labelled: DataFrame, steps: int = STEPS, ridge: float = RIDGE):
    """Weights and intercept from a table of url and label (1: block).

    Rows without a url or label are left out; classes are weighed alike.
    """
    host, path = url_parts(F.col("url"))
    rows = labelled.where("url IS NOT NULL AND label IN (0, 1)").select(
        gram_features(host, path).alias("features"), F.col("label").cast("double").alias("label")
    )
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if n > MOST_LABELLED:
        raise ValueError(f"{n} labelled urls; at most {MOST_LABELLED} are meant to be used")
    weights, bias = [0.0] * FEATURES, 0.0
    if not 0 < ones < n:
        return weights, math.log((ones + 0.5) / (n - ones + 0.5))
    balance = F.when(F.col("label") == 1, n / (2 * ones)).otherwise(n / (2 * (n - ones))) / n
    rows = rows.withColumn("share", balance).cache()
    before, before_bias = weights, bias
    rate, limit = 8.0, FEATURES
    for step in range(steps):
        push = step / (step + 3)  # Nesterov's look-ahead
        ahead = [w + push * (w - v) for w, v in zip(weights, before)]
        ahead_bias = bias + push * (bias - before_bias)
        gap = (probability(margin(F.col("features"), array_literal(ahead), ahead_bias))
               - F.col("label")) * F.col("share")
        slopes = (
            rows.withColumn("gap", gap)
            .withColumn("part", F.col("gap") / F.sqrt(F.greatest(F.size("features"), F.lit(1))))
            .select("part", "gap", F.explode(F.array_append("features", limit)).alias("feature"))
            .groupBy("feature")
            .agg(F.sum("part").alias("part"), F.sum("gap").alias("gap"))
            .collect()
        )
        slope, slope_bias = [0.0] * FEATURES, 0.0
        for row in slopes:
            if row.feature == limit:
                slope_bias = row.gap
            else:
                slope[row.feature] = row.part
        before, before_bias = weights, bias
        # rounded, so that the order in which Spark adds up cannot show in a verdict
        weights = [round(w - rate * (g + ridge / n * w), 9) for w, g in zip(ahead, slope)]
        bias = round(ahead_bias - rate / 4 * slope_bias, 9)
    rows.unpersist()
    return weights, bias


def judge(
    df: DataFrame, weights: list[float], bias: float, rules=RULES, url_col: str = "url"
) -> DataFrame:
    """df with host, path, rule, verdict and block_probability; clashing columns are replaced."""
    host, path = url_parts(F.col(url_col))
    rule, said = matched_rule(F.col("host"), F.col("path"), rules)
    learned = probability(
        margin(gram_features(F.col("host"), F.col("path")), array_literal(weights), bias)
    )
    return (
        df.withColumns({"host": host, "path": path})
        .withColumns({"rule": rule, "block_probability": learned, "verdict": said})
        .withColumn(
            "verdict",
            F.coalesce(
                "verdict",
                F.when(F.col("block_probability") >= THRESHOLD, F.lit("block")).otherwise("allow"),
            ),
        )
    )
