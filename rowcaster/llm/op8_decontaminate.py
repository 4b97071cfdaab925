"""Benchmark decontamination by winnowing.

Every text is a sequence of words. In every window of ``span`` words the smallest hash of a
k-gram is kept as fingerprint, on both sides. Equal windows have equal fingerprints, so each
span of at least ``span`` common words yields a common fingerprint. Documents with a
fingerprint of the benchmark are extended: their windows are compared word by word with
those of the items, and all words inside a common window are hit. An item shorter than a
window is one window of its own length, and its fingerprint the hash of all its words; the
same pass over the documents looks for it among their runs of that length.

Defined results: a null or wordless text has no words and no hit; a null or wordless item has
no window. Repeated items count separately by ``item_id``; a null ``item_id`` is left out of
the item list but its words are hit. Repeated documents, also under one ``doc_id``, each keep
their row; a null ``doc_id`` is judged like any other. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .frames import ascii_lower

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what lies between words, A-Z being lower-cased
SPAN, GRAM = 10, 5
BROADCAST_WINDOWS = 500_000  # rows of about 100 bytes


def words_of(text: str) -> Column:
    """What the gaps leave; to split takes a sixth of the time that matching the words does."""
    found = F.array_remove(F.split(ascii_lower(F.col(text)), GAP), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def runs(w: str, length: int) -> Column:
    """Hashes of every run of ``length`` words."""
    return F.transform(
        F.sequence(F.lit(0), F.col("_n") - length),
        lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(length)]),
    )


def fingerprints(w: str, span: int = SPAN, k: int = GRAM) -> tuple[Column, Column]:
    """Hashes of the k-grams of the words, and the smallest of each window (over ``_g``)."""
    kept = F.transform(
        F.sequence(F.lit(0), F.col("_n") - span),
        lambda i: F.least(*[F.get(F.col("_g"), i + j) for j in range(span - k + 1)]),
    )
    return runs(w, k), kept


def windows(w: str, length: int) -> Column:
    """Every run of ``length`` words as one string; a word holds no blank.

    The words are named one by one: an array that a lambda uses once is worked out anew for
    every element.
    """
    if length == 1:
        return F.col(w)
    return F.transform(
        F.sequence(F.lit(0), F.size(w) - length),
        lambda i: F.concat_ws(" ", *[F.get(F.col(w), i + j) for j in range(length)]),
    )


def _with_words(df: DataFrame, *keep: str) -> DataFrame:
    return df.withColumn("_w", words_of("text")).withColumn("_n", F.size("_w")).select(*keep, "_w", "_n")


def _near(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a counted table of the benchmark; beyond the bound Spark joins by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_WINDOWS else df


def find_hits(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, item windows, sizes): (_key, pos, length, window), (window, item_id), (_key, n_words).

    ``documents`` holds ``_key`` and ``text``; equal rows share a key.
    """
    items = written(_with_words(benchmark, "item_id"), "bench-words")
    short = sorted(r["_n"] for r in items.where(F.col("_n").between(1, span - 1)).select("_n").distinct().collect())  # below span
    lengths = [span, *short]
    grams, kept = fingerprints("_w", span, k)
    owned, prints = [], []
    for n in lengths:
        of = items.where(F.col("_n") >= span if n == span else F.col("_n") == n)
        owned.append(of.select("item_id", F.explode(windows("_w", n)).alias("window")))
        marks = kept if n == span else runs("_w", n)
        prints.append(of.withColumn("_g", grams).select(F.explode(marks).alias("_f"), F.lit(n).alias("_length")))
    owned = written(reduce(DataFrame.unionByName, owned).distinct(), "bench-windows")
    known = written(owned.select("window").distinct(), "bench-distinct")
    n_known = known.count()  # no fewer than the prints
    prints = written(reduce(DataFrame.unionByName, prints).distinct(), "bench-prints")

    marks = [F.when(F.col("_n") >= n, kept if n == span else runs("_w", n)) for n in lengths]
    marks = F.array_distinct(F.concat(*[F.coalesce(m, F.array().cast("array<bigint>")) for m in marks]))
    docs = _with_words(documents, "_key").withColumn("_g", F.when(F.col("_n") >= span, grams))
    rows = docs.select("_key", "_n", F.explode_outer(marks).alias("_f")).join(_near(prints, n_known), "_f", "left")
    met = [F.max(F.col("_length") == n).alias(f"_met{n}") for n in lengths]
    sizes = written(rows.groupBy("_key").agg(F.max("_n").alias("n_words"), *met), "doc-words")

    # written, or the windows of all documents would be worked out ahead of the join to tell whether there are any
    suspects = sizes.where(reduce(Column.__or__, [F.coalesce(f"_met{n}", F.lit(False)) for n in lengths])).drop("n_words")
    few = documents.join(_near(suspects, suspects.count()), "_key")
    few = written(_with_words(few, "_key", *[f"_met{n}" for n in lengths]), "suspect-words")

    def exact(n: int) -> DataFrame:
        # a run of k words may be the gram of a longer item
        found = few.where(F.col(f"_met{n}") & (F.col("_n") >= n)).select("_key", F.posexplode_outer(windows("_w", n)).alias("pos", "window"))
        return found.join(_near(known, n_known), "window", "left_semi").select("_key", "pos", F.lit(n).alias("length"), "window")

    hits = reduce(DataFrame.unionByName, [exact(n) for n in lengths])
    return written(hits.distinct(), "hits"), owned, sizes.select("_key", "n_words")


def decontaminate(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and ``_key``."""
    keyed = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"))
    hits, owned, sizes = find_hits(keyed.select("_key", "text"), benchmark, span, k)
    order = Window.partitionBy("_key").orderBy("pos", "length")
    reached = F.max(F.col("pos") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("pos") + F.col("length") - F.greatest("pos", F.coalesce(reached, F.lit(0))))
    words = hits.withColumn("_new", fresh).groupBy("_key").agg(F.sum("_new").alias("n_hit"))
    pairs = hits.select("_key", "window").distinct().join(
        _near(owned, owned.count()).where(F.col("item_id").isNotNull()), "window"
    ).select("_key", "item_id").distinct()
    # a document's list holds the items found in it, which its own length bounds
    listed = pairs.groupBy("_key").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("_items"))
    found = words.join(listed, "_key", "left")
    out = keyed.select("doc_id", "_key").join(sizes.join(found, "_key", "left"), "_key", "left")
    names = F.coalesce("_items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "_key",
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a hit, all columns as they are."""
    keyed = documents.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("_key"))
    hits, _, _ = find_hits(keyed.select("_key", "row.text"), benchmark)
    return keyed.join(hits.select("_key").distinct(), "_key", "left_anti").select("row.*")
