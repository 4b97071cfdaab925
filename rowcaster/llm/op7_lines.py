"""Line dedup by pairwise alignment.

Every line with a word has a home, the first document that holds it. A later document is
compared with the homes of all its lines, however many documents hold them. Where that leaves
a line that an earlier document holds, it is compared with every earlier document that shares
a line of at most ``RARE`` holders, and at last, for the frequent lines still left, with one
earlier document of every kind that holds them. The two sequences of line hashes are aligned
by patience diff: lines that occur once in either are matched, the longest increasing run of
matches is kept, and the gaps between them are aligned likewise, after the equal lines at
both ends. All aligned lines go from the later document.

Documents that share none but frequent lines with another align with it by their frequent
lines, their lines without a word and the gaps between them alone. So documents alike in these
are of one kind, and one of them stands for all: many holders of a line need no pairs with
each other. Kinds are tried in order, twice as many in each round, until a line goes or no
kind is left; a kind whose first document shares a rare line with the later one is stood for
by another of its documents. So a line stays only if no earlier document aligns it.

Of documents with equal sequences the first stands for all, and the others lose every line.
Holders counted are those that stand.

Defined results: lines are split at ``\\n``; lines without a word are kept and not counted.
Null text has no lines. Documents are in order of ``doc_id``, null last, and then of a hash
of the text; rows equal in both are one document and do not remove each other's lines. Other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .frames import join_small

RARE = 100  # holders of a line up to which all of them are compared; beyond, one of each kind
DEALT = 256  # tasks that the pairs of one earlier document can go to
LAST = (1 << 63) - 1


def line_hashes(text: str) -> Column:
    """A 128-bit hash of each line, null for a line without a word."""
    worded = r"[^\x20\x09-\x0D]"
    return F.transform(
        F.split(F.col(text), "\n"),
        lambda x: F.when(x.rlike(worded), F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"))),
    )


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose second entries increase."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(y)
            at.append(i)
        else:
            tops[k], at[k] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(old: list, new: list) -> list[int]:
    """Places of ``new`` that patience diff aligns with equal entries of ``old``; None is no line."""
    found = []
    todo = [(0, len(old), 0, len(new))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and old[a] == new[c]:
            found.append(c)
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
            found.append(d)
        if a >= b or c >= d:
            continue
        ones, twos = Counter(old[a:b]), Counter(new[c:d])
        place = {x: i for i, x in enumerate(old[a:b], a) if ones[x] == 1}
        matches = [(i, place[x]) for i, x in enumerate(new[c:d], c) if x is not None and twos[x] == 1 and x in place]
        previous = (c - 1, a - 1)
        run = increasing(matches)
        for i, j in run:
            found.append(i)
            todo.append((previous[1] + 1, j, previous[0] + 1, i))
            previous = (i, j)
        if run:
            todo.append((previous[1] + 1, b, previous[0] + 1, d))
    return sorted(i for i in found if new[i] is not None)


def _numbered(sides: list[pa.Array]) -> list[list[list]]:
    """Sequences of line hashes as sequences of small numbers, None for no line."""
    flat = [side.flatten() for side in sides]
    hashes = np.concatenate([np.stack([pc.fill_null(pc.struct_field(f, c), 0).to_numpy(zero_copy_only=False) for c in "ab"], 1) for f in flat])
    valid = np.concatenate([f.is_valid().to_numpy(zero_copy_only=False) for f in flat])
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    number = np.zeros(len(hashes), np.int64)
    number[order[1:]] = np.cumsum((hashes[order[1:]] != hashes[order[:-1]]).any(axis=1))
    values = [x if ok else None for x, ok in zip(number.tolist(), valid.tolist())]
    out, at = [], 0
    for side in sides:
        out.append([])
        for n in pc.list_value_length(side).to_pylist():
            out[-1].append(values[at : at + n])
            at += n
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        uid, gone = [], []
        for u, old, new in zip(batch.column("uid").to_pylist(), *_numbered([batch.column("before"), batch.column("lines")])):
            hit = align(old, new)
            if hit:
                uid.append(u)
                gone.append(hit)
        yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["uid", "gone"])


def _gone(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """(uid, gone): places of lines that any of the pairs (uid, old) aligns."""
    dealt = pairs.withColumn("deal", F.pmod(F.xxhash64("uid"), F.lit(DEALT)))
    olds = dealt.select("old", "deal").distinct().join(sequences.select(F.col("uid").alias("old"), F.col("lines").alias("before")), "old")
    both = dealt.join(olds, ["old", "deal"]).join(sequences.select("uid", "lines"), "uid").select("uid", "before", "lines")
    return _merged(both.mapInArrow(_aligned, "uid long, gone array<int>"))


def _merged(gone: DataFrame) -> DataFrame:
    return gone.groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def _copies(sequences: DataFrame) -> DataFrame:
    """(uid) of documents whose sequence an earlier one has."""
    whole = F.transform("lines", lambda x: F.coalesce(x, F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))))
    keys = written(sequences.select("uid", "rank", F.xxhash64(whole).alias("p"), F.xxhash64(F.lit(1), whole).alias("q")), "line-keys")
    first = keys.groupBy("p", "q").agg(F.min(F.struct("rank", "uid")).alias("first"), F.count("*").alias("n")).where("n > 1")
    met = join_small(keys, written(first, "line-firsts"), ["p", "q"], "uid")
    return written(met.where(F.col("first.uid") != F.col("uid")).select("uid"), "line-copies")


def _rest(held: DataFrame, gone: DataFrame) -> DataFrame:
    """The lines (uid, rank, a, b, at) of which a place is not gone yet, with the places left."""
    left = F.array_except("at", F.coalesce("gone", F.array().cast("array<int>")))
    # places that repeat make short files of long arrays, which Spark would broadcast by the file's size
    joined = held.join(gone.hint("merge"), "uid", "left").withColumn("at", left).drop("gone")
    return joined.where(F.size("at") > 0)


def _kinds(frequent: DataFrame, sequences: DataFrame) -> DataFrame:
    """(uid, rank, p, q) of the documents with frequent lines: two hashes of what the others see of them."""
    own = frequent.groupBy("uid").agg(F.collect_set(F.struct("a", "b")).alias("own"))
    blank, gap = (F.struct(F.lit(k).cast("long").alias("a"), F.lit(k).cast("long").alias("b")) for k in (0, 1))
    seen = F.transform("lines", lambda x: F.when(x.isNull(), blank).when(F.array_contains("own", x), x).otherwise(gap))
    rows = sequences.join(own, "uid").select("uid", "rank", seen.alias("seen"))
    # gaps that follow each other are one
    short = F.filter("seen", lambda x, i: ~((x == gap) & (i > 0) & (F.get("seen", i - 1) == gap)))
    return rows.select("uid", "rank", F.xxhash64(short).alias("p"), F.xxhash64(F.lit(1), short).alias("q"))


def _by_kinds(frequent: DataFrame, left: DataFrame, rare_pairs: DataFrame, done: DataFrame, sequences: DataFrame) -> list[DataFrame]:
    """(uid, gone) parts from one earlier document of each kind. ``frequent``, ``left``: (uid, rank, a, b, at), all and still there."""
    kinds = written(_kinds(frequent, sequences), "line-kinds")
    first = kinds.groupBy("p", "q").agg(F.min(F.struct("rank", "uid")).alias("first"))
    held = join_small(kinds, written(first, "line-kind-firsts"), ["p", "q"], "uid")
    holders = frequent.select("uid", "a", "b").join(held.select("uid", "p", "q", "first"), "uid").select("a", "b", "p", "q", "first").distinct()
    order = Window.partitionBy("a", "b").orderBy("first")
    holders = written(holders.withColumn("place", F.row_number().over(order) - 1), "line-kind-holders")
    most = holders.agg(F.max("place")).first()[0]
    parts, low = [], 0
    while most is not None and low <= most:
        tried = holders.where(F.col("place").between(low, 2 * low))
        low = 2 * low + 1
        met = left.join(tried, ["a", "b"]).where(F.col("first") < F.struct("rank", "uid"))
        met = written(met.select("uid", "rank", "p", "q", F.col("first.uid").alias("old")).distinct(), "line-kinds-met")
        if not met.limit(1).count():
            if not left.limit(1).count():
                break
            continue
        plain = met.join(rare_pairs, ["uid", "old"], "left_anti").select("uid", "old")
        close = met.join(rare_pairs, ["uid", "old"], "left_semi").select("uid", "rank", "p", "q")
        others = close.join(kinds.select("p", "q", F.col("uid").alias("old"), F.col("rank").alias("_rank")), ["p", "q"])
        others = others.where(F.struct("_rank", "old") < F.struct("rank", "uid")).join(rare_pairs, ["uid", "old"], "left_anti")
        others = others.groupBy("uid", "p", "q").agg(F.min(F.struct("_rank", "old")).alias("o")).select("uid", F.col("o.old").alias("old"))
        pairs = written(plain.unionByName(others).distinct().join(done, ["uid", "old"], "left_anti"), "line-pairs")
        parts.append(written(_gone(pairs, sequences), "line-gone"))
        left = written(_rest(left, parts[-1]), "line-left")
    return parts


def _removed(sequences: DataFrame) -> DataFrame:
    """(uid, gone): places of the lines that go from each document."""
    copies = _copies(sequences)
    stand = sequences.join(copies, "uid", "left_anti")
    placed = stand.select("uid", "rank", F.posexplode("lines").alias("i", "x")).where(F.col("x").isNotNull())
    lines = placed.groupBy("uid", "rank", "x.a", "x.b").agg(F.array_sort(F.collect_list("i")).alias("at"))
    lines = written(lines, "lines")
    homes = lines.groupBy("a", "b").agg(F.min(F.struct("rank", "uid")).alias("home"), F.count("*").alias("df")).where("df > 1")
    shared = written(lines.join(written(homes, "line-homes"), ["a", "b"]), "line-holders")
    met = shared.where(F.col("home.uid") != F.col("uid")).select("uid", "rank", "a", "b", "at", "df", F.col("home.uid").alias("old"))
    pairs = written(met.select("uid", "old").distinct(), "line-pairs")
    gone = written(_gone(pairs, sequences), "line-gone")
    left = written(_rest(met.drop("old"), gone), "line-left")
    some = left.select("uid").distinct()
    few = shared.where(F.col("df") <= RARE).select("uid", "rank", "a", "b")
    before = few.select("a", "b", F.col("rank").alias("_rank"), F.col("uid").alias("old"))
    rare_pairs = few.join(some, "uid", "left_semi").join(before, ["a", "b"]).where(F.struct("_rank", "old") < F.struct("rank", "uid"))
    rare_pairs = written(rare_pairs.select("uid", "old").distinct(), "line-rare-pairs")
    again = written(_gone(rare_pairs.join(pairs, ["uid", "old"], "left_anti"), sequences), "line-gone")
    frequent = shared.where(F.col("df") > RARE).select("uid", "rank", "a", "b", "at")
    left = written(_rest(left.where(F.col("df") > RARE).drop("df"), again), "line-left")
    parts = [gone, again]
    if left.limit(1).count():
        parts += _by_kinds(frequent, left, rare_pairs, pairs.unionByName(rare_pairs), sequences)
    every = F.filter(F.transform("lines", lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
    parts.append(sequences.join(copies, "uid", "left_semi").select("uid", every.alias("gone")))
    return _merged(reduce(lambda x, y: x.unionByName(y), parts))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept): ``kept`` is the text without the removed lines."""
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    rows = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"), rank.alias("rank"))
    sequences = rows.where(F.col("text").isNotNull()).select("uid", "rank", line_hashes("text").alias("lines"))
    sequences = written(sequences.dropDuplicates(["uid"]), "line-sequences")
    gone = _removed(sequences)
    out = rows.join(gone.withColumnRenamed("uid", "_u"), F.col("uid") == F.col("_u"), "left")
    none = F.array().cast("array<int>")
    removed = F.coalesce("gone", none)
    split = F.split("text", "\n")
    kept = F.when(F.size(removed) == 0, F.col("text")).otherwise(
        F.array_join(F.filter(split, lambda x, i: ~F.array_contains(removed, i)), "\n")
    )
    n_lines = F.size(F.filter(F.coalesce(split, F.array().cast("array<string>")), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return out.select("doc_id", n_lines.cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), kept.alias("kept"))
