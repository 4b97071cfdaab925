"""Spelling variant grouping: words one edit apart, found by k-d trees over letter counts.

Words are counted over all documents; an edit of one letter changes the vector of letter
counts by an L1 distance of at most two: a replaced letter takes one away and adds one, an
inserted letter adds one. So for each pair of lengths (L, L) and (L, L + 1) near words lie in a
box of letter counts around the word.

The words of a length are dealt over cells, the leaves of a k-d tree whose cuts come from a
sample of that length (``SAMPLE`` words over all lengths; the cuts only place the words, every
word is indexed in its own cell). A word goes as a query to the other cells its box meets: of
its own length those with a larger number, and of the next length all. A cell builds a k-d tree
of its own over its words, prunes its leaves by their bounding boxes, compares letter counts
within the leaves that are left, and verifies the order of letters for the pairs that pass. It
sends one row per word with partners in it (their number, and the most frequent), for both
sides of each pair, so pairs themselves never leave the task.

Defined results: a null text has no words, a null ``doc_id`` is hashed as an empty string.
Repeated rows count as often as they are there. Words of any length are compared. Ties of the
most frequent near word go to the smallest in code-point order. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .frames import SMALL, UPPER, Sent

LETTERS = 26 + 64  # a-z, then U+00C0 to U+00FF
SAMPLE = 100_000  # words that the cuts are learned from
CELL_BYTES = 160_000  # letters of the words of a cell, about
LEAF = 64  # words of a leaf of a cell's own tree
QUERIES = 4096  # words compared with a cell at once
COLUMNS = 2048  # letters with their repetitions up to which shared letters are a matrix product


@dataclass(frozen=True)
class VariantOptions:
    least_length: int = 7
    least_count: int = 2
    every: int = 31  # a run whose hash this divides loses a letter
    ratio: int = 10  # by which the form of a word is more frequent


def word_counts(documents: DataFrame, options: VariantOptions) -> DataFrame:
    """(w, n): words in Latin-1 bytes, whose order is that of code points, and their numbers."""
    # shorter runs cannot lead to words; the longest match is always a maximal run
    pattern = F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{options.least_length},}}+")
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("run"))
    low = F.when(F.col("run").rlike("[\\u00C0-\\u00DE]"), F.translate("run", UPPER, SMALL)).otherwise(F.lower("run"))
    runs = runs.select("doc_id", low.alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % options.every == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= options.least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= options.least_count).select(F.encode("word", "ISO-8859-1").alias("w"), "n")


# --- letter counts -----------------------------------------------------------------------

PLACE = np.zeros(256, np.int64)
PLACE[97:123] = np.arange(26)
PLACE[0xC0:] = np.arange(26, LETTERS)


def codes(words: pa.Array, length: int) -> np.ndarray:
    """Letters of words of one length, a row for each."""
    return np.frombuffer(b"".join(words.to_pylist()), np.uint8).reshape(-1, length)


def letter_counts(rows: np.ndarray) -> np.ndarray:
    n = len(rows)
    flat = PLACE[rows] + LETTERS * np.arange(n)[:, None]
    return np.bincount(flat.ravel(), minlength=n * LETTERS).reshape(n, LETTERS).astype(np.int32)


def split(counts: np.ndarray, ids: np.ndarray) -> tuple[int, int] | None:
    """Letter and count up to which words go left: the widest letter, nearest to its middle."""
    part = counts[ids]
    letter = int(np.argmax(part.var(axis=0)))
    column = part[:, letter]
    low, high = int(column.min()), int(column.max())
    if low == high:
        return None
    return letter, min(max(int(np.median(column)), low), high - 1)


@dataclass
class Cut:
    letter: int
    most: int
    left: "Cut | int"
    right: "Cut | int"  # leaves are numbers of cells


def grown(counts: np.ndarray, ids: np.ndarray, least: int, numbers: Iterator[int]) -> "Cut | int":
    found = split(counts, ids) if len(ids) >= 2 * least else None
    if found is None:
        return next(numbers)
    goes = counts[ids, found[0]] <= found[1]
    return Cut(*found, grown(counts, ids[goes], least, numbers), grown(counts, ids[~goes], least, numbers))


def own_cells(tree: "Cut | int", counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts), np.int64)
    todo = [(tree, np.arange(len(counts)))]
    while todo:
        node, ids = todo.pop()
        if not isinstance(node, Cut):
            out[ids] = node
        elif len(ids):
            goes = counts[ids, node.letter] <= node.most
            todo += [(node.left, ids[goes]), (node.right, ids[~goes])]
    return out


def met_cells(tree: "Cut | int", counts: np.ndarray, fewer: int, more: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, cell) for cells that may hold words with up to so many letters taken away and added."""
    words, cells = [], []
    # the box of a node, and what each word must lose and gain to be in it
    todo = [(tree, np.arange(len(counts)), {})]
    while todo:
        node, ids, box = todo.pop()
        if not len(ids):
            continue
        if not isinstance(node, Cut):
            words.append(ids)
            cells.append(np.full(len(ids), node, np.int64))
            continue
        low, high = box.get(node.letter, (0, 1 << 30))
        for child, bounds in ((node.left, (low, min(high, node.most))), (node.right, (max(low, node.most + 1), high))):
            inside = box | {node.letter: bounds}
            lose, gain = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for letter, (a, b) in inside.items():
                column = counts[ids, letter]
                lose += np.maximum(column - b, 0)
                gain += np.maximum(a - column, 0)
            todo.append((child, ids[(lose <= fewer) & (gain <= more)], inside))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *words]), np.concatenate([none, *cells])


# --- within a cell -----------------------------------------------------------------------


def leaves(counts: np.ndarray) -> list[np.ndarray]:
    """Words of a cell by the leaves of its own k-d tree; only words with equal counts fill more than ``LEAF``."""
    out, todo = [], [np.arange(len(counts))]
    while todo:
        ids = todo.pop()
        found = split(counts, ids) if len(ids) > LEAF else None
        if found is None:
            out += np.array_split(ids, -(-len(ids) // (4 * LEAF))) if len(ids) else []
            continue
        goes = counts[ids, found[0]] <= found[1]
        todo += [ids[goes], ids[~goes]]
    return out


class Shared:
    """Number of letters that words share with others, as a product of 0/1 vectors where these are short."""

    def __init__(self, counts: np.ndarray):
        self.most = counts.max(axis=0) if len(counts) else np.zeros(LETTERS, np.int32)
        self.used = np.flatnonzero(self.most)
        self.wide = int(self.most.sum()) > COLUMNS

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        counts = counts[:, self.used]
        if self.wide:
            return counts
        return np.concatenate([counts[:, [j]] > np.arange(m)[None] for j, m in enumerate(self.most[self.used])], axis=1).astype(np.float32)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not self.wide:
            return a @ b.T
        return np.stack([np.minimum(a, row).sum(axis=1) for row in b], axis=1)


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether one letter taken from the longer word gives the shorter one."""
    head = np.cumprod(short == long[:, :-1], axis=1).sum(axis=1)
    tail = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= short.shape[1]


class Cell:
    """The words of a cell, and the partners found so far of them and of the queries."""

    def __init__(self, words: pa.Array, n: np.ndarray, length: int):
        self.length = length
        self.rows = codes(words, length)
        self.n = n
        counts = letter_counts(self.rows)
        self.shared = Shared(counts)
        self.leaves = leaves(counts)
        self.vectors = self.shared.vectors(counts)
        # what any word of a leaf has at most, and what all have at least
        self.tops = self.shared.vectors(np.array([counts[i].max(axis=0) for i in self.leaves]).reshape(-1, LETTERS))
        self.floors = self.shared.vectors(np.array([counts[i].min(axis=0) for i in self.leaves]).reshape(-1, LETTERS))
        self.floor_sizes = np.array([counts[i].min(axis=0).sum() for i in self.leaves])

    def pairs(self, rows: np.ndarray, itself: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) one edit apart. ``itself``: the queries are the cell's own words from there on."""
        length = rows.shape[1]
        fewer = 1 if length == self.length else 0
        counts = letter_counts(rows)
        vectors = self.shared.vectors(counts)
        # a query must lose what it has above the box, and gain what it lacks below
        near = (self.shared.numbers(vectors, self.tops) >= length - fewer) & (self.shared.numbers(vectors, self.floors) >= self.floor_sizes - 1)
        asks, finds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j, ids in enumerate(self.leaves):
            q = np.flatnonzero(near[:, j])
            if not len(q):
                continue
            x, y = np.nonzero(self.shared.numbers(vectors[q], self.vectors[ids]) >= self.length - 1)
            x, y = q[x], ids[y]
            if itself is not None:
                x, y = x[y > x + itself], y[y > x + itself]
            ok = replaced(rows[x], self.rows[y]) if fewer else inserted(rows[x], self.rows[y])
            asks.append(x[ok])
            finds.append(y[ok])
        return np.concatenate(asks), np.concatenate(finds)


class Partners:
    """Number of partners and the most frequent partner of each word, ties by the words' order."""

    def __init__(self, words: list[bytes]):
        self.words = words
        order = sorted(range(len(words)), key=words.__getitem__)
        self.by_rank = np.array(order, np.int64)
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.by_rank] = np.arange(len(words))
        self.count = np.zeros(len(words), np.int64)
        self.best_n = np.zeros(len(words), np.int64)
        self.best = np.full(len(words), len(words), np.int64)  # rank

    def add(self, who: np.ndarray, other: np.ndarray, n: np.ndarray) -> None:
        np.add.at(self.count, who, 1)
        order = np.lexsort((self.rank[other], -n, who))
        who, other, n = who[order], other[order], n[order]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        who, rank, n = who[first], self.rank[other[first]], n[first]
        better = (n > self.best_n[who]) | ((n == self.best_n[who]) & (rank < self.best[who]))
        self.best_n[who[better]], self.best[who[better]] = n[better], rank[better]

    def table(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.count)
        forms = self.by_rank[self.best[some]]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.words[i] for i in some], pa.binary()), pa.array(self.count[some]), pa.array(self.best_n[some]), pa.array([self.words[i] for i in forms], pa.binary())],
            ["w", "n_near", "best_n", "best"],
        )


FOUND = "w binary, n_near long, best_n long, best binary"


def search(group: pa.Table) -> pa.Table:
    """Partners within one cell: between its words, and of the queries sent to it."""
    words, n, own = group.column("w").combine_chunks(), group.column("n").to_numpy(), group.column("own").to_numpy(zero_copy_only=False)
    sizes = np.array([len(w) for w in words.to_pylist()], np.int64)
    inside = np.flatnonzero(own)
    if not len(inside):  # nobody lives here
        return pa.Table.from_batches([], schema=pa.schema([("w", pa.binary()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.binary())]))
    length = int(sizes[inside[0]])
    cell, found = Cell(words.take(pa.array(inside)), n[inside], length), Partners(words.to_pylist())

    def note(asks: np.ndarray, finds: np.ndarray) -> None:
        found.add(np.concatenate([asks, finds]), np.concatenate([finds, asks]), np.concatenate([n[finds], n[asks]]))

    step = max(1, min(QUERIES, (QUERIES * 64) // length))
    for a in range(0, len(inside), step):
        x, y = cell.pairs(cell.rows[a : a + step], a)
        note(inside[x + a], inside[y])
    for size in (length, length - 1):
        asking = np.flatnonzero(~own & (sizes == size))
        for a in range(0, len(asking), step):
            part = asking[a : a + step]
            x, y = cell.pairs(codes(words.take(pa.array(part)), size))
            note(part[x], inside[y])
    return pa.Table.from_batches([found.table()])


# --- over all words ----------------------------------------------------------------------


def learned_cells(words: DataFrame) -> dict[int, "Cut | int"]:
    """Cuts for every length whose words need more than one cell, from a sample bounded in all."""
    sizes = words.groupBy(F.length("w").alias("l")).agg(F.count("*").alias("c")).where(F.col("c") * F.col("l") > CELL_BYTES).collect()
    total = sum(r["c"] for r in sizes)
    if not total:
        return {}
    # hashes are even, so a share of their range is a share of the words
    shares = words.where(F.length("w").isin([r["l"] for r in sizes])).where(F.pmod(F.xxhash64("w"), F.lit(total)) < SAMPLE)
    by_length: dict[int, list[bytes]] = {}
    for r in shares.select("w").limit(2 * SAMPLE).collect():
        by_length.setdefault(len(r["w"]), []).append(bytes(r["w"]))
    out = {}
    for r in sizes:
        sample = by_length.get(r["l"], [])
        if sample:
            counts = letter_counts(codes(pa.array(sample, pa.binary()), r["l"]))
            least = max(8, len(sample) * CELL_BYTES // (r["c"] * r["l"]) // 2)
            out[r["l"]] = grown(counts, np.arange(len(sample)), least, iter(range(len(sample))))
    return out


def dealt(words: DataFrame, trees: Sent) -> DataFrame:
    """(length, cell, own, w, n): every word in its cell, and as a query in the cells it may have partners in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = trees.get()
        for batch in batches:
            column, n = batch.column("w"), batch.column("n")
            sizes = np.array([len(w) for w in column.to_pylist()], np.int64)
            for size in np.unique(sizes):
                size = int(size)
                ids = np.flatnonzero(sizes == size)
                counts = letter_counts(codes(column.take(pa.array(ids)), size))
                own = own_cells(cuts.get(size, 0), counts)
                x, cells = met_cells(cuts.get(size, 0), counts, 1, 1)
                later = cells > own[x]
                y, longer = met_cells(cuts.get(size + 1, 0), counts, 0, 1)
                for rows, where, length, lives in ((ids, own, size, True), (ids[x[later]], cells[later], size, False), (ids[y], longer, size + 1, False)):
                    if len(rows):
                        at = pa.array(rows)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), length, np.int64)), pa.array(where), pa.array(np.full(len(rows), lives)), column.take(at), n.take(at)],
                            ["length", "cell", "own", "w", "n"],
                        )

    return words.mapInArrow(run, "length long, cell long, own boolean, w binary, n long")


def near_words(words: DataFrame) -> DataFrame:
    """(w, n_near, best_n, best) for words with a near word; ``words``: (w, n), distinct, in the shared folder."""
    trees = Sent(words.sparkSession, learned_cells(words))  # at most SAMPLE / 8 cuts
    found = dealt(words, trees).groupBy("length", "cell").applyInArrow(search, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b")
    return found.groupBy("w").agg(F.sum("n_near").alias("n_near"), best).select("w", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(w, root) of words with a form: the last of the chain. Counts grow along it, so it ends."""
    table = written(forms.select("w", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = table.select(F.col("w").alias("_w"), F.col("root").alias("_r"))
        jumped = table.join(ahead, F.col("root") == F.col("_w"), "left").select("w", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved"))
        jumped = written(jumped, "variant-roots")
        table = jumped.select("w", "root")
        if not jumped.where("moved").limit(1).count():
            return table


def plain(word: Column) -> Column:
    return F.decode(word, "ISO-8859-1")


def spelling_variants(documents: DataFrame, options: VariantOptions = VariantOptions()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = written(word_counts(documents.select("doc_id", "text"), options), "variant-words")
    near = words.join(near_words(words), "w", "left")
    clear = F.col("best_n") >= options.ratio * F.col("n")
    near = written(near.select("w", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(clear, F.col("best")).alias("form"), F.when(clear, F.col("best_n")).alias("form_n")), "variant-near")
    chains = roots(near.where(F.col("form").isNotNull()))
    return near.join(chains, "w", "left").select(
        plain(F.col("w")).alias("word"), plain(F.col("form")).alias("form"), plain(F.coalesce("root", "w")).alias("root"), "n", "n_near", "form_n"
    )
