"""URL filters: host rules, then the ratio of two character language models.

Host rules judge what they fit. They also label the URLs from which two smoothed variable-order
Markov models are counted, one of accepted and one of rejected URLs: characters after up to
ORDER others, each order smoothed by the next lower one. A URL that no rule fits is judged by
the difference of its log-likelihoods per character; the threshold is calibrated on a fold of
the labelled URLs that the models have not seen.

Counts cover all labelled URLs outside that fold and are exact, one row a gram, so the models grow
with the corpus. They stay in Spark: the windows of all URLs, each a character and what stands
before it, are made distinct, each distinct window meets the counts of its grams and contexts in a
join and gets its log-likelihood difference once, and URLs join their windows. Only the letter
totals and the calibration histogram, bounded by its number of steps, reach the driver. Common
windows make large groups on one side of the last join only, which Spark splits.

Edge cases: a null or empty URL, or one without ://, has empty host and path and no rule, and a
score of 0; a URL is allowed where one of the models has no data; repeated rows each give a row;
an empty table gives an empty result; columns other than page_id and url are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table, text_or_empty

#: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
ORDER = 4
SMOOTHING = 2.0
ALPHABET = 64
FOLDS = 10
STEP = 0.01
STEPS = 3000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits; null where none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def model_text(url: Column) -> Column:
    """What the models read: what follows ://, in lower case, digits as 0, between ^ and $."""
    rest = F.regexp_replace(F.translate(url, UPPER, LOWER), r"(?s)^.*?://", "")
    return F.concat(F.lit("^"), F.regexp_replace(rest, "[0-9]", "0"), F.lit("$"))


def gram_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, accepted, rejected: how often each gram of up to order + 1 characters occurs."""
    s = F.col("model_text")
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length(s)),
            lambda i: F.transform(F.sequence(F.lit(0), F.least(F.lit(order), i - 1)), lambda k: F.substring(s, i - k, k + 1)),
        )
    )
    exploded = labelled.select("verdict", F.explode(grams).alias("gram"))
    return exploded.groupBy("gram").agg(F.count_if(F.col("verdict") == "allow").alias("accepted"), F.count_if(F.col("verdict") == "block").alias("rejected"))


def windows(text: Column, order: int = ORDER) -> Column:
    """Each character after the first with up to `order` before it."""
    at = lambda i: F.substring(text, F.greatest(i - order, F.lit(1)), F.least(i, F.lit(order + 1)))
    return F.when(F.length(text) > 2, F.transform(F.sequence(F.lit(2), F.length(text)), at)).otherwise(F.array().cast("array<string>"))


def window_ratios(rows: DataFrame, counts: DataFrame, letters: tuple[int, int], order: int = ORDER) -> DataFrame:
    """window and ratio, log p(rejected) - log p(accepted) of its last character after the others,
    for the distinct windows of rows.

    p of each length is smoothed by that of the next shorter one. A window asks for the counts of
    its grams, roles 0, 2, 4, …, and of their contexts, roles 1, 3, …; counts that are not there are 0.
    """
    w = F.col("window")
    n = F.length(w)
    gram = lambda k: F.struct((2 * k).alias("role"), F.substring(w, n - k, k + 1).alias("gram"))
    context = lambda k: F.struct((2 * k - 1).alias("role"), F.substring(w, n - k, k).alias("gram"))
    lengths = F.sequence(F.lit(0), n - 1)
    asked = rows.select("window").distinct().select("window", F.explode(F.concat(F.transform(lengths, gram), F.transform(F.filter(lengths, lambda k: k > 0), context))).alias("a"))
    met = asked.select("window", "a.role", "a.gram").join(counts, "gram", "left")
    of = lambda name, role: F.coalesce(F.max(F.when(F.col("role") == role, F.col(name))), F.lit(0)).cast("double").alias(f"{name}{role}")
    sides = tuple(zip(("accepted", "rejected"), letters))
    found = met.groupBy("window").agg(*(of(name, role) for name, _ in sides for role in range(2 * order + 1)))

    def likelihood(name: str, total: int) -> Column:
        p = F.lit(1 / ALPHABET)
        for k in range(order + 1):
            before = F.col(f"{name}{2 * k - 1}") if k else F.lit(float(total))
            p = F.when(n > k, (F.col(f"{name}{2 * k}") + SMOOTHING * p) / (before + SMOOTHING)).otherwise(p)
        return p

    accepted, rejected = (likelihood(name, total) for name, total in sides)
    return found.select("window", (F.log(rejected) - F.log(accepted)).alias("ratio"))


def scored(rows: DataFrame, counts: DataFrame, letters: tuple[int, int], order: int = ORDER) -> DataFrame:
    """url_hash and score of the distinct model texts of rows: the mean ratio of a text's windows,
    positive where the rejected model explains it better."""
    texts = rows.select("url_hash", "model_text").distinct()
    each = texts.select("url_hash", F.explode(windows(F.col("model_text"), order)).alias("window"))
    ratios = materialise(window_ratios(each, counts, letters, order))
    return each.join(ratios, "window").groupBy("url_hash").agg(F.round(F.avg("ratio"), 9).alias("score"))


def calibrate(held_out: DataFrame) -> float:
    """The threshold of best balanced accuracy on scored, labelled rows; ties by the middle.

    Scores are counted in STEPS steps each side of 0, so few rows reach the driver.
    """
    step = F.least(F.greatest(F.floor(F.col("score") / STEP), F.lit(-STEPS)), F.lit(STEPS)).cast("int")
    rows = held_out.groupBy(step.alias("step"), "verdict").count().collect()
    seen = np.zeros((2 * STEPS + 1, 2))
    for r in rows:
        seen[r["step"] + STEPS, int(r["verdict"] == "block")] += r["count"]
    totals = seen.sum(axis=0)
    if not totals.all():
        return 0.0
    below = np.vstack([[0, 0], np.cumsum(seen, axis=0)]) / totals
    right = below[:, 0] + 1 - below[:, 1]
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(best[len(best) // 2] - STEPS) * STEP


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page."""
    url = text_or_empty("url")
    read = pages.select("page_id", url.alias("url")).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    said = model_text(F.col("url"))
    ruled = read.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", "found.rule", "found.verdict", said.alias("model_text"), F.xxhash64(said).alias("url_hash"), (F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0).alias("held_out")
    )
    labelled = ruled.filter(F.col("verdict").isNotNull())
    learned = labelled.filter(~F.col("held_out"))
    letters = learned.agg(*(F.coalesce(F.sum(F.when(F.col("verdict") == v, F.length("model_text") - 1)), F.lit(0)) for v in ("allow", "block"))).first()
    shown = ruled.select("page_id", "host", "path", "rule", "verdict", "url_hash")
    if not all(letters):
        return shown.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    counts = materialise(gram_counts(learned))
    scores = materialise(scored(ruled, counts, tuple(letters)))
    discard(counts)
    held_out = labelled.filter("held_out").select("url_hash", "verdict").join(scores, "url_hash", "left")
    threshold = calibrate(held_out.select("verdict", F.coalesce("score", F.lit(0.0)).alias("score")))
    judged = shown.join(scores, "url_hash", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    ratio = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", ratio).alias("verdict"), "score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
