"""URL filter: host rules first, then a ratio of two character language models.

The models are smoothed variable-order Markov chains over URL characters, one learned from
URLs that a rule allows and one from URLs that a rule blocks. A URL without a rule is judged
by the difference of its two log-likelihoods per character against a calibrated threshold.

Defined results: a null URL, or one without ``://``, has an empty host and path, so no rule
fits. A null or empty URL has ratio 0. Where one of the classes has no URL there is nothing
to compare and every URL without a rule is allowed. Repeated URLs count as often as they
occur and get the same verdict. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .frames import SMALL, UPPER

#: (verdict, host, path): of the rules that fit, the longest decides.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@dataclass(frozen=True)
class ModelOptions:
    order: int = 5  # longest context
    smoothing: float = 4.0  # weight of the shorter context
    alphabet: float = 256.0
    seed: int = 17


BROADCAST_STRINGS = 20_000  # rows of a string of at most six characters and two numbers, some 3 MB; up to eleven tables at once
TASK_CHARACTERS = 500_000  # that a task writes out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, SMALL)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text of the longest fitting rule and its verdict, both null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _grams(urls: DataFrame, options: ModelOptions, *keep: str) -> DataFrame:
    """A row for each character: ``g`` is the character and its context, padded at the start."""
    width = options.order + 1
    padded = F.concat(F.lit("\x02" * options.order), F.col("url"))
    at = F.explode(F.sequence(F.lit(1), F.length("url")))
    return urls.where(F.length("url") > 0).select(*keep, padded.alias("_p"), at.alias("_i")).select(
        *keep, F.substring(F.col("_p"), F.col("_i"), F.lit(width)).alias("g")
    )


def count_strings(labelled: DataFrame, options: ModelOptions) -> DataFrame:
    """Occurrences of every string of 1 to order + 1 characters per class: (s, a, b).

    ``labelled``: (url, n, allowed). All strings are kept, however rare.
    """
    width = options.order + 1
    whole = _grams(labelled, options, "n", "allowed").groupBy("g").agg(
        F.sum(F.when(F.col("allowed"), F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("allowed"), F.lit(0)).otherwise(F.col("n"))).alias("b"),
    )
    parts = F.explode(F.array(*[F.substring("g", width - k, k + 1) for k in range(width)]))
    return whole.select(parts.alias("s"), "a", "b").groupBy("s").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")
    )


def _side(df: DataFrame) -> DataFrame:
    """Broadcast up to a bound on its counted rows, and shuffled beyond, however short its file."""
    return F.broadcast(df) if df.count() <= BROADCAST_STRINGS else df.hint("merge")


def rate_strings(grams: DataFrame, strings: DataFrame, options: ModelOptions, totals: tuple[int, int]) -> DataFrame:
    """``grams`` with ``v``: log P(accepted) - log P(rejected) of the last character of each distinct string ``g`` after the others.

    Both models go from the plain frequency of the character to the longest context, each step
    smoothed by the one before. A distinct string is rated once, however many URLs hold it.
    """
    n = options.order + 1
    contexts = strings.groupBy(F.expr("substring(s, 1, length(s) - 1)").alias("x")).agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")
    ).where(F.length("x") > 0)
    contexts = written(contexts, "url-contexts")
    rows = grams
    for k in range(n):
        side = strings.where(F.length("s") == k + 1).select(F.col("s").alias(f"s{k}"), F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}"))
        rows = rows.join(_side(side), F.substring(F.col("g"), F.lit(n - k), F.lit(k + 1)) == F.col(f"s{k}"), "left").drop(f"s{k}")
        if k:
            side = contexts.where(F.length("x") == k).select(F.col("x").alias(f"x{k}"), F.col("a").alias(f"ca{k}"), F.col("b").alias(f"cb{k}"))
            rows = rows.join(_side(side), F.substring(F.col("g"), F.lit(n - k), F.lit(k)) == F.col(f"x{k}"), "left").drop(f"x{k}")

    def chain(seen: str, total: int) -> Column:
        s = F.lit(options.smoothing)
        p = (F.coalesce(F.col(f"{seen}0"), F.lit(0)) + s / options.alphabet) / (F.lit(total) + s)
        for k in range(1, n):
            p = (F.coalesce(F.col(f"{seen}{k}"), F.lit(0)) + s * p) / (F.coalesce(F.col(f"c{seen}{k}"), F.lit(0)) + s)
        return p

    return rows.select(*grams.columns, (F.log(chain("a", totals[0])) - F.log(chain("b", totals[1]))).alias("v"))


def score(urls: DataFrame, strings: DataFrame, options: ModelOptions, totals: tuple[int, int]) -> DataFrame:
    """(url, ratio): mean over the characters of log P(accepted) - log P(rejected).

    A short table of rated strings is broadcast, so no character is shuffled. Of a longer one
    the frequent strings are, as some are in every URL: fewer than the bound have more than an
    even share of that many. The others meet their characters by a shuffle, and no string of
    them has more than such a share.
    """
    rows = _grams(urls, options, "url")
    times = rows.groupBy("g").agg(F.count("*").alias("times"))
    rated = written(rate_strings(times, strings, options, totals), "url-rated")
    facts = rated.agg(F.count("*").alias("n"), F.sum("times").alias("times")).first()
    if facts["n"] <= BROADCAST_STRINGS:
        return rows.join(F.broadcast(rated.select("g", "v")), "g").groupBy("url").agg(F.avg("v").alias("ratio"))
    often = F.col("times") * F.lit(BROADCAST_STRINGS) > F.lit(facts["times"])
    few, many = rated.where(often).select("g", "v"), rated.where(~often).select("g", "v")
    near = rows.join(F.broadcast(few), "g")
    far = rows.join(F.broadcast(few.select("g")), "g", "left_anti").join(many.hint("merge"), "g")
    sums = [x.groupBy("url").agg(F.sum("v").alias("v"), F.count("*").alias("n")) for x in (near, far)]
    return sums[0].unionByName(sums[1]).groupBy("url").agg((F.sum("v") / F.sum("n")).alias("ratio"))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    options: ModelOptions = ModelOptions(),
) -> DataFrame:
    """(page_id, url, host, path, rule, ratio, verdict) for every page."""
    host, path = url_parts(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, ruled = apply_rules(F.col("host"), F.col("path"), rules)
    judged = judged.select("*", rule.alias("rule"), ruled.alias("ruled"))
    urls = judged.where(F.col("url").isNotNull()).groupBy("url").agg(
        F.count("*").alias("n"), F.first("ruled").alias("ruled")
    )
    urls = written(urls, "urls")
    # a table of URLs is short, but every character becomes a row
    characters = urls.agg(F.sum(F.length("url"))).first()[0] or 0
    urls = urls.repartition(max(1, -(-characters // TASK_CHARACTERS)), "url")
    held = F.pmod(F.xxhash64("url", F.lit(options.seed)), F.lit(5)) == 0
    learned = urls.where(F.col("ruled").isNotNull() & ~held).select("url", "n", (F.col("ruled") == "allow").alias("allowed"))
    sums = learned.groupBy().agg(
        F.sum(F.when(F.col("allowed"), F.col("n") * F.length("url"))).alias("a"),
        F.sum(F.when(~F.col("allowed"), F.col("n") * F.length("url"))).alias("b"),
    ).first()
    totals = (sums["a"] or 0, sums["b"] or 0)
    strings = written(count_strings(learned, options), "url-strings")
    rated = written(score(urls.select("url"), strings, options, totals), "url-ratios")
    side = _side(rated)
    threshold = calibrate(side.join(urls.where(F.col("ruled").isNotNull() & held), "url"))
    out = judged.join(side, "url", "left")
    ratio = F.coalesce(F.col("ratio"), F.lit(0.0))
    by_model = F.when(F.lit(threshold is None), F.lit("allow")).when(ratio >= F.lit(threshold or 0.0), F.lit("allow")).otherwise(F.lit("block"))
    return out.select("page_id", "url", "host", "path", "rule", ratio.alias("ratio"), F.coalesce("ruled", by_model).alias("verdict"))


def calibrate(rated: DataFrame) -> float | None:
    """Where two normal curves, fitted to the ratios of held-out URLs of both classes, balance."""
    side = {r["ruled"]: r for r in rated.groupBy("ruled").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("ratio")) / F.sum("n")).alias("m"),
        (F.sum(F.col("n") * F.col("ratio") * F.col("ratio")) / F.sum("n")).alias("q"),
    ).collect()}  # one row for each class
    if len(side) < 2:
        return None
    (ma, sa), (mb, sb) = [(r["m"], max(1e-6, max(0.0, r["q"] - r["m"] ** 2) ** 0.5)) for r in (side["allow"], side["block"])]
    return (ma * sb + mb * sa) / (sa + sb)
