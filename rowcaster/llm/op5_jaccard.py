"""N-gram Jaccard join with a token-group matrix.

Tokens are 64-bit hashes of shingles; a document's set is sorted by hash. Similar documents
are partitioned into groups; a group stores the union of its members' tokens, and each member
as places in that union. For two groups that share a prefix token, the union bounds how much
a query of one can overlap with any member of the other; only where the bound reaches the
threshold is the group opened and its members compared, all at once as a product of 0/1
matrices. So a large group of near copies is compared in blocks, and what leaves a block are
its components, not its pairs.

Before that, documents that cannot have a link are put aside: two linked sets share a known
number of tokens among a known number of their smallest hashes, so a document with fewer such
tokens in any other document has none. Equal sets are one node throughout.

Defined results: a text without words has an empty set and is linked with nothing; a text
with fewer words than a shingle has one token. Null text is empty. Rows with one ``doc_id``
are joined by their texts like any other rows. A component's id is the smallest ``doc_id`` in
it; a null ``doc_id`` is never the smallest unless alone. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import text as T
from .frames import bounded, join_small
from .graph import components

BUCKET_BYTES = 16 << 20  # of text for each bucket of tokens
FLUSH_TOKENS = 1 << 19  # a flush takes about 90 bytes a token
FAN_OUT = 2048  # buckets that a task packs rows for at once; more are reached by a second split
GROUP_TOKENS, GROUP_ROWS = 1 << 16, 256
PIECE_BYTES = 1 << 18  # of text whose tokens are made at once
COLUMNS = 1 << 13  # of the 0/1 matrices that are multiplied at once
NEAR_ROWS = 1_000_000  # ids that are broadcast, 8 MB
SAMPLED, COMMON = 10_000, 100_000  # nodes and tokens that only decide which tokens count as rare


@dataclass(frozen=True)
class JoinOptions:
    words: int = 4
    above: int = 85  # a link needs below * overlap >= above * union
    below: int = 100

    def slack(self, n):
        """Tokens of a set of ``n`` that a linked set may lack."""
        return n * (self.below - self.above) // self.below

    def needed(self, size: str):
        """Tokens that linked sets of at least ``size`` share among their 2 * slack + 1 first."""
        return F.expr(f"({size} * {self.below - self.above}) div {self.below} + 1")


def token_sets(b: T.Batch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of each text, end to end, and where each text's begin."""
    w = T.words(b)
    h = T.span_hash(b.data, w.start, w.end, seed=3)
    runs, begins = T.run_hash(h, k, seed=3), np.flatnonzero(T.run_starts(w.first, k))
    tokens, owner = [runs[begins]], [w.text_of()[begins]]
    for j in range(1, k):  # shorter texts have one token
        short = np.flatnonzero(w.counts == j)
        if len(short):
            tokens.append(T.run_hash(h, j, seed=3 + j)[w.first[short]])
            owner.append(short)
    t, o = np.concatenate(tokens), np.concatenate(owner)
    order = np.lexsort((t, o))
    t, o = t[order], o[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
    t, o = t[new], o[new]
    return t, np.searchsorted(o, np.arange(len(b) + 1))


ROW = "bucket long, ids binary, places binary, tokens binary"


def _row(bucket: int, ids: bytes, places: bytes, tokens: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), *(pa.array([v], pa.binary()) for v in (ids, places, tokens))], ["bucket", "ids", "places", "tokens"])


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places first[i] .. first[i] + size[i], end to end."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size - first, size)


NOBODY = 0xFFFFFFFF  # place of a token that is not counted for a document


def packed(tokens: np.ndarray, owner: np.ndarray, ids: np.ndarray, bucket: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket: its tokens, and for each the place of its document among the row's ids. No owner: -1."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for i in np.flatnonzero(np.diff(edges)):
        part = order[edges[i] : edges[i + 1]]
        docs, at = np.unique(owner[part], return_inverse=True)
        if docs[0] < 0:
            docs, at = docs[1:], np.where(at == 0, NOBODY, at - 1)
        yield _row(int(i), ids[docs].tobytes(), at.astype("<u4").tobytes(), tokens[part].tobytes())


def unpacked(ids: pa.Array, places: pa.Array, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, owner, ids) of several packed rows."""
    all_ids, owner, all_tokens, before = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    for row_ids, row_places, row_tokens in zip(ids, places, tokens):
        own = np.frombuffer(row_ids.as_py(), np.int64)
        at = np.frombuffer(row_places.as_py(), "<u4").astype(np.int64)
        owner.append(np.where(at == NOBODY, -1, at + before))
        all_ids.append(own)
        all_tokens.append(np.frombuffer(row_tokens.as_py(), np.uint64))
        before += len(own)
    return np.concatenate(all_tokens), np.concatenate(owner), np.concatenate(all_ids)


def prefix_rows(rows: DataFrame, options: JoinOptions, buckets: int) -> DataFrame:
    """Packed (bucket, ids, places, tokens): each task's prefix tokens by bucket.

    Negative buckets have for each document its id, set size and the number of prefix tokens
    that another document of the same task has. Such a token is sent once, without a document,
    so a token of very many documents costs each task one entry. A task packs rows for
    ``FAN_OUT`` buckets at most; where there are more, those are dealt over as many finer ones
    by a second hash after a shuffle of the packed rows.
    """
    fine = -(-buckets // FAN_OUT)
    coarse = -(-buckets // fine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            uid, doc, null, size, count, tokens = (np.concatenate(c) for c in zip(*held))
            held.clear()
            owner = np.repeat(np.arange(len(uid), dtype=np.int32), count)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            new = np.ones(len(tokens), bool)
            new[1:] = tokens[1:] != tokens[:-1]
            many = ~new
            many[:-1] |= many[1:]
            shared = np.bincount(owner[many], minlength=len(uid))
            yield _row(-1 - int(uid[0] % buckets), uid.tobytes(), np.stack([doc, null, size, shared], axis=1).astype(np.int64).tobytes(), b"")
            tokens, owner = tokens[new], np.where(many, -1, owner)[new]
            yield from packed(tokens, owner, uid, (tokens % np.uint64(coarse)).astype(np.int64), coarse)

        for batch in batches:
            for piece in T.slices(batch, "text", PIECE_BYTES):
                tokens, first = token_sets(T.batch_of(piece.column("text"), lower=True), options.words)
                size = np.diff(first)
                slack = options.slack(size)
                count = np.minimum(size, 2 * slack + 1)
                doc = piece.column("doc_id")
                held.append((piece.column("uid").to_numpy(), doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), size, count, tokens[_ranges(first[:-1], count)]))
                waiting += int(count.sum()) + len(size)
                if waiting >= FLUSH_TOKENS:
                    yield from flush()
                    waiting = 0
        if held:
            yield from flush()

    first = bounded(rows).mapInArrow(run, ROW)
    if fine == 1:
        return first

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, parts in held.items():
                tokens, owner, ids = unpacked(*zip(*parts))
                second = (T.mix(tokens) % np.uint64(fine)).astype(np.int64)
                for batch in packed(tokens, owner, ids, second, fine):
                    at = batch.column("bucket").to_numpy() * coarse + bucket
                    yield batch.set_column(0, "bucket", pa.array(at, pa.int64()))
            held.clear()

        for batch in batches:
            for bucket, *cells in zip(*(batch.column(c) for c in ("bucket", "ids", "places", "tokens"))):
                if bucket.as_py() < 0:
                    yield _row(bucket.as_py(), *(c.as_py() for c in cells))
                    continue
                held.setdefault(bucket.as_py(), []).append(cells)
                waiting += len(cells[2].as_buffer()) // 8
                if waiting >= FLUSH_TOKENS:
                    yield from flush()
                    waiting = 0
        if held:
            yield from flush()

    return first.repartition(coarse, "bucket").mapInArrow(again, ROW)


PARTS = "uid long, doc_id long, size long, n long"


def _shared_counts(key: tuple, table: pa.Table) -> pa.Table:
    """(uid, doc_id, size, n): prefix tokens in this bucket that a document of another task
    has; a size for each document of a negative bucket, null else."""
    if key[0].as_py() < 0:
        facts = [np.frombuffer(p.as_py(), np.int64).reshape(-1, 4) for p in table.column("places")]
        uid, facts = np.concatenate([np.frombuffer(i.as_py(), np.int64) for i in table.column("ids")]), np.concatenate(facts)
        return pa.table({"uid": pa.array(uid), "doc_id": pa.array(facts[:, 0], mask=facts[:, 1] > 0), "size": pa.array(facts[:, 2]), "n": pa.array(facts[:, 3])})
    t, owner, ids = unpacked(*(table.column(c) for c in ("ids", "places", "tokens")))
    order = np.argsort(t, kind="stable")
    t = t[order]
    same = np.zeros(len(t), bool)
    same[1:] = t[1:] == t[:-1]
    same[:-1] |= same[1:].copy()
    owner = owner[order]
    uid, n = np.unique(ids[owner[same & (owner >= 0)]], return_counts=True)
    return pa.table({"uid": pa.array(uid, pa.int64()), "doc_id": pa.nulls(len(uid), pa.int64()), "size": pa.nulls(len(uid), pa.int64()), "n": pa.array(n, pa.int64())})


def nodes_of(rows: DataFrame, chosen: DataFrame, n_chosen: int, options: JoinOptions) -> DataFrame:
    """(uid, doc_id, digest, size, tokens) of the chosen documents."""
    keys = F.broadcast(chosen) if n_chosen <= NEAR_ROWS else chosen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.slices(batch, "text", PIECE_BYTES):
                tokens, first = token_sets(T.batch_of(piece.column("text"), lower=True), options.words)
                cells = [tokens[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("uid"), piece.column("doc_id"), pa.array([hashlib.md5(c, usedforsecurity=False).digest() for c in cells], pa.binary()), pa.array(np.diff(first), pa.int64()), pa.array(cells, pa.binary())],
                    ["uid", "doc_id", "digest", "size", "tokens"],
                )

    return bounded(rows.join(keys, "uid", "left_semi")).mapInArrow(run, "uid long, doc_id long, digest binary, size long, tokens binary")


def common_tokens(nodes: DataFrame, n: int) -> np.ndarray:
    """Tokens that several of a bounded sample of nodes have, the most common last.

    They only decide the order in which tokens are tried; any order gives the same links.
    """
    rank = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("tokens"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(cell.as_py(), np.int64))], ["token"])

    found = nodes.where(rank < SAMPLED / max(n, 1)).select("tokens").mapInArrow(run, "token long").groupBy("token").count()
    top = found.where(F.col("count") >= 3).orderBy(F.desc("count"), "token").limit(COMMON).collect()
    return np.array([r["token"] for r in reversed(top)], np.int64).astype(np.uint64)


def build_groups(nodes: DataFrame, options: JoinOptions, common: np.ndarray) -> DataFrame:
    """The matrix: (gid, least, most, prefix, nodes, sizes, union, members), a row per group.

    Nodes with one smallest rare token are similar. A node of which most tokens are common is
    a copy of something frequent, and what is rare in it is its own; such nodes are taken
    together by their commonest token. A large set is dealt over groups of bounded size by a
    hash.
    """
    order = np.argsort(common)
    sorted_common, rank = common[order], order + 1

    def commonness(tokens: np.ndarray) -> np.ndarray:
        if not len(sorted_common):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(sorted_common, tokens), len(sorted_common) - 1)
        return np.where(sorted_common[at] == tokens, rank[at], 0)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell in batch.column("tokens"):
                tokens = np.frombuffer(cell.as_py(), np.uint64)
                rank = commonness(tokens)
                at = np.argmax(rank) if 2 * np.count_nonzero(rank) > len(rank) else np.argmin(rank)
                out.append(int(tokens[at].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "key"])

    keyed = written(nodes.mapInArrow(keys, "node long, size long, tokens binary, key long"), "join-keyed")
    big = keyed.groupBy("key").agg(F.sum("size").alias("_t"), F.count("*").alias("_c"))
    big = big.select("key", F.greatest(F.ceil(F.col("_t") / GROUP_TOKENS), F.ceil(F.col("_c") / GROUP_ROWS)).alias("_parts")).where("_parts > 1")
    placed = join_small(keyed, written(big, "join-big"), ["key"], "node")
    part = F.pmod(F.xxhash64("node", F.lit(6)), F.coalesce("_parts", F.lit(1)))
    placed = placed.select("node", "size", "tokens", F.xxhash64("key", part).alias("gid"))

    def pack(table: pa.Table) -> pa.Table:
        _, once = np.unique(table.column("node").to_numpy(), return_index=True)  # repeated rows are one node
        table = table.take(pa.array(once))
        cells = [np.frombuffer(c.as_py(), np.uint64) for c in table.column("tokens")]
        sizes = np.array([len(c) for c in cells])
        union, members = np.unique(np.concatenate(cells), return_inverse=True)
        prefix = []
        for c, slack in zip(cells, options.slack(sizes)):
            prefix.append(c[np.argsort(commonness(c), kind="stable")[: 2 * slack + 1]])
        return pa.table({
            "gid": table.column("gid").slice(0, 1), "least": pa.array([int(sizes.min())], pa.int64()), "most": pa.array([int(sizes.max())], pa.int64()),
            "prefix": pa.array([np.unique(np.concatenate(prefix)).astype(np.int64)], pa.list_(pa.int64())),
            "nodes": pa.array([table.column("node").to_pylist()], pa.list_(pa.int64())), "sizes": pa.array([sizes.astype("<u4").tobytes()], pa.binary()),
            "union": pa.array([union.tobytes()], pa.binary()), "members": pa.array([members.astype("<u4").tobytes()], pa.binary()),
        })

    return placed.groupBy("gid").applyInArrow(
        pack, "gid long, least long, most long, prefix array<bigint>, nodes array<bigint>, sizes binary, union binary, members binary"
    )


def _cells(members: np.ndarray, sizes: np.ndarray, which: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the tokens of the chosen members that both unions have, by column."""
    first = np.cumsum(sizes) - sizes
    cells = column[members[_ranges(first[which], sizes[which])]]
    row = np.repeat(np.arange(len(which), dtype=np.int32), sizes[which])
    ok = np.flatnonzero(cells >= 0)
    order = ok[np.argsort(cells[ok], kind="stable")]
    return row[order], cells[order]


def _overlaps(left: tuple, n: int, right: tuple, m: int, width: int) -> np.ndarray:
    """Shared tokens of each pair, as a sum of products of 0/1 matrices over blocks of columns."""
    out = np.zeros((n, m), np.float32)
    for a in range(0, width, COLUMNS):
        parts = []
        for (row, column), rows in ((left, n), (right, m)):
            x, y = np.searchsorted(column, [a, a + COLUMNS])
            block = np.zeros((rows, min(COLUMNS, width - a)), np.float32)
            block[row[x:y], column[x:y] - a] = 1
            parts.append(block)
        out += parts[0] @ parts[1].T
    return out


def open_groups(left: tuple, right: tuple, options: JoinOptions) -> list[tuple[int, int]]:
    """Links between two groups (or inside one): each linked node with the least of its block."""
    nodes1, sizes1, union1, members1 = left
    nodes2, sizes2, union2, members2 = right
    at = np.minimum(np.searchsorted(union2, union1), len(union2) - 1)
    common = union2[at] == union1
    column1 = np.where(common, np.cumsum(common) - 1, -1)
    column2 = np.full(len(union2), -1)
    column2[at[common]] = column1[common]
    width = int(common.sum())

    def qualify(sizes: np.ndarray, members: np.ndarray, column: np.ndarray) -> np.ndarray:
        bound = np.add.reduceat(column[members] >= 0, np.cumsum(sizes) - sizes, dtype=np.int64)
        return np.flatnonzero(options.below * bound >= options.above * sizes)

    q1, q2 = qualify(sizes1, members1, column1), qualify(sizes2, members2, column2)
    if not len(q1) or not len(q2):
        return []
    overlap = _overlaps(_cells(members1, sizes1, q1, column1), len(q1), _cells(members2, sizes2, q2, column2), len(q2), width)
    union = sizes1[q1][:, None] + sizes2[q2][None, :] - overlap
    linked = options.below * overlap.astype(np.int64) >= options.above * union.astype(np.int64)
    linked &= nodes1[q1][:, None] != nodes2[q2][None, :]
    names = np.concatenate([nodes1[q1], nodes2[q2]])
    label, before = names.copy(), None
    top = np.iinfo(np.int64).max
    rows, columns = label[: len(q1)], label[len(q1) :]  # views
    while before is None or (before != label).any():
        before = label.copy()
        rows[:] = np.minimum(rows, np.where(linked, columns[None, :], top).min(axis=1))
        columns[:] = np.minimum(columns, np.where(linked, rows[:, None], top).min(axis=0))
    return [(int(a), int(b)) for a, b in zip(names, label) if a != b]


def opened(groups: DataFrame, pairs: DataFrame, options: JoinOptions) -> DataFrame:
    """(a, b) of linked nodes in the pairs (gid, gid2) of groups, enough for their components."""
    packed = groups.select("gid", F.struct("nodes", "sizes", "union", "members").alias("g1"))
    second = groups.select(F.col("gid").alias("gid2"), F.struct("nodes", "sizes", "union", "members").alias("g2"))
    both = pairs.join(packed, "gid").join(second, "gid2").select("g1", "g2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(g: dict) -> tuple:
            return (
                np.array(g["nodes"], np.int64), np.frombuffer(g["sizes"], "<u4").astype(np.int64),
                np.frombuffer(g["union"], np.uint64), np.frombuffer(g["members"], "<u4"),
            )

        for batch in batches:
            for g1, g2 in zip(batch.column("g1"), batch.column("g2")):
                found = open_groups(read(g1.as_py()), read(g2.as_py()), options)
                if found:
                    a, b = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def find_links(groups: DataFrame, options: JoinOptions) -> DataFrame:
    """(a, b) of linked nodes, enough for the components.

    Many groups may hold near copies of one text, and all meet in their tokens. So every group
    is first opened alone and with the first group of each token it has; what that links is
    labelled, and groups whose members all have one label need not meet others of that label
    any more. All other groups that share enough prefix tokens are opened against each other.
    """
    post = groups.select(F.explode("prefix").alias("token"), "gid", "least", "most")
    fits = (F.col("most") * options.below >= F.col("least2") * options.above) & (F.col("most2") * options.below >= F.col("least") * options.above)
    enough = F.col("n") >= options.needed("_p")
    counted = [F.count("*").alias("n"), F.min(F.least("least", "least2")).alias("_p")]
    first = post.groupBy("token").agg(F.min(F.struct("gid", "least", "most")).alias("f"), F.count("*").alias("_c")).where("_c > 1")
    # tokens of one group alone lead nowhere
    post = written(post.join(written(first, "join-first").select("token", "f"), "token"), "join-post")
    stars = post.select("*", F.col("f.gid").alias("gid2"), F.col("f.least").alias("least2"), F.col("f.most").alias("most2"))
    stars = stars.where((F.col("gid") != F.col("gid2")) & fits).groupBy("gid", "gid2").agg(*counted).where(enough)
    alone = groups.where(F.size("nodes") > 1).select("gid", F.col("gid").alias("gid2"))
    stars = written(stars.select("gid", "gid2").unionByName(alone), "join-stars")
    links = written(opened(groups, stars, options), "join-links")
    labels = components(links)
    members = groups.select("gid", F.explode("nodes").alias("node"))
    named = members.join(labels, "node", "left").select("gid", F.coalesce("label", "node").alias("label"))
    classes = named.groupBy("gid").agg(F.min("label").alias("_l"), F.max("label").alias("_m"))
    # a class is a label, or the group itself
    classes = written(classes.select("gid", (F.col("_l") == F.col("_m")).alias("one"), F.when(F.col("_l") == F.col("_m"), F.col("_l")).otherwise(F.col("gid")).alias("class")), "join-classes")
    post = written(post.drop("f").join(classes, "gid"), "join-classed")
    several = post.groupBy("token").agg(F.min(F.struct("one", "class")).alias("_a"), F.max(F.struct("one", "class")).alias("_b")).where("_a <> _b").select("token")
    post = post.join(several, "token")
    other = post.select("token", *[F.col(c).alias(f"{c}2") for c in ("gid", "least", "most", "one", "class")])
    apart = ~(F.col("one") & F.col("one2") & (F.col("class") == F.col("class2")))
    met = post.join(other, "token").where((F.col("gid") < F.col("gid2")) & fits & apart)
    pairs = met.groupBy("gid", "gid2").agg(*counted).where(enough).select("gid", "gid2")
    # what a star has opened, in whichever order, needs no second look
    done = stars.select(F.least("gid", "gid2").alias("gid"), F.greatest("gid", "gid2").alias("gid2"))
    rest = written(pairs.join(done, ["gid", "gid2"], "left_anti"), "join-pairs")
    return links.unionByName(opened(groups, rest, options))


def jaccard_components(documents: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """(uid, doc_id, n_shingles, component_id, label): a row per document; ``label`` is equal
    for the documents of a component."""
    rows = documents.select(F.xxhash64("doc_id", "text").alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, math.ceil(total / BUCKET_BYTES))
    parts = prefix_rows(rows, options, buckets).groupBy("bucket").applyInArrow(_shared_counts, PARTS)
    parts = written(parts, "join-parts")
    facts = parts.where(F.col("size").isNotNull()).select("uid", "doc_id", "size")
    partner = F.expr(f"(size * {options.above} + {options.below - 1}) div {options.below}")
    chosen = parts.groupBy("uid").agg(F.sum("n").alias("n"), F.max("size").alias("size")).where("size > 0").withColumn("_p", partner)
    chosen = written(chosen.where(F.col("n") >= options.needed("_p")).select("uid"), "join-chosen")
    sets = written(nodes_of(rows, chosen, chosen.count(), options), "join-sets")
    equal = written(sets.groupBy("digest").agg(F.min("uid").alias("node")), "join-equal")
    n_nodes = equal.count()
    first = equal.select(F.col("node").alias("uid"))
    nodes = sets.join(F.broadcast(first) if n_nodes <= NEAR_ROWS else first, "uid", "left_semi").select(F.col("uid").alias("node"), "size", "tokens")
    common = common_tokens(nodes, n_nodes)
    groups = written(build_groups(nodes, options, common), "join-groups")
    links = written(find_links(groups, options), "join-links")
    labels = components(links)
    whole = sets.select("uid", "doc_id", "digest").distinct().join(equal, "digest").join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    whole = written(whole.select("uid", "doc_id", F.coalesce("label", "node").alias("label")), "join-labels")
    # written, so that the join can split the rows of a large component
    least = written(whole.groupBy("label").agg(F.min("doc_id").alias("component_id")), "join-least")
    found = whole.join(least, "label").select(F.col("uid").alias("_u"), "component_id", "label")
    out = facts.join(found, F.col("uid") == F.col("_u"), "left")
    return out.select("uid", "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("label", "uid").alias("label"))


def keep_first(documents: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """One row of each component, that with the smallest ``doc_id``; all columns as they are.

    Rows equal in ``doc_id`` and text are one document. Documents without words are linked
    with nothing, so each stays.
    """
    found = jaccard_components(documents, options)
    first = found.groupBy("label").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "uid")).alias("f"))
    keep = written(first.select(F.col("f.uid").alias("_uid")), "join-keep")
    keyed = documents.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("_uid"))
    kept = keyed.join(F.broadcast(keep) if keep.count() <= NEAR_ROWS else keep, "_uid", "left_semi")
    return kept.dropDuplicates(["_uid"]).select("row.*")
