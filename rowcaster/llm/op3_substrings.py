"""Substring dedup by relative Lempel-Ziv parsing against an index of all earlier documents.

A document is factored from left to right against the documents before it: a factor is a run
of words that an earlier document has in one place (``source`` and ``source_at``), extended
as far as that source goes on in the same way. The index is dealt over blocks by what the
text says, not by document, as every document must meet every block and the pairs of document
and block of documents would grow with the square of the corpus: in every window of ``span``
words the least hash of a k-gram is its anchor, the windows that follow each other with one
anchor form a phrase, and a block holds the phrases of all documents that begin with its
anchors. Phrases depend on their words alone, so parsing a document against all blocks means
one look-up per phrase, which answers with the first document that has it and the place there.
Phrases whose places continue each other make up the factors.

Where a factor ends, inside a phrase whose anchor is known but whose words differ, its end is
checked window by window: those windows are looked up one by one, by a 128-bit hash, among all
such windows, and extend a factor or make one of their own. Every factor has at least ``span``
words; all words inside factors are removed.

Every window of a document lies in one phrase. If the phrase occurs in a smaller document, so
does the window. If not, the window can only occur in a smaller document inside a phrase with
the same anchor and other words, and the first document with that phrase is looked up too. So
exactly the windows of smaller documents are found.

Equal phrases of a task are sent once, so a passage of very many documents costs each task
one entry. Hashes of a phrase have 96 bits besides the block.

Defined results: null text has no words; texts shorter than a window lose nothing. Windows
are judged by ``doc_id``: rows with one ``doc_id`` do not remove each other's words, and a
null ``doc_id`` counts as larger than all others (as a source it is the largest long). Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import text as T
from .frames import bounded

SPAN, GRAM = 13, 7
BLOCK_BYTES = 48 << 20  # of text for each block of the index
FLUSH = 1 << 21  # entries that a task holds before it sends them
FAN_OUT = 2048  # blocks that a task packs rows for at once; more are reached by a second split
LAST = (1 << 63) - 1


@dataclass
class Parsed:
    words: T.Words
    windows: np.ndarray  # hash of the window at each word, whichever texts it lies in
    anchor: np.ndarray  # hash of each phrase's anchor
    body: np.ndarray  # hash of each phrase's words
    begin: np.ndarray  # first window of each phrase, and one after the last window
    starts: np.ndarray  # windows, by their first word, in order
    first: np.ndarray  # number of the first phrase of each text, and the number of phrases
    hashes: np.ndarray  # of the words


def parse(b: T.Batch, span: int = SPAN, k: int = GRAM) -> Parsed:
    w = T.words(b)
    h = T.span_hash(b.data, w.start, w.end, seed=7)
    grams, windows = T.run_hash(h, k, seed=7), T.run_hash(h, span, seed=8)
    starts = np.flatnonzero(T.run_starts(w.first, span))
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return Parsed(w, windows, none, none, np.zeros(1, np.int64), starts, np.zeros(len(b) + 1, np.int64), h)
    least, at = grams[starts], starts.copy()
    for j in range(1, span - k + 1):
        other = grams[starts + j]
        less = other < least
        least = np.where(less, other, least)
        at[less] = starts[less] + j
    new = np.ones(len(starts), bool)
    new[1:] = at[1:] != at[:-1]
    begin = np.flatnonzero(new)
    edges = np.append(begin, len(starts))
    within = np.arange(len(starts)) - np.repeat(begin, np.diff(edges))
    place = (starts - at + span).astype(np.int64)  # of the anchor in the window
    with np.errstate(over="ignore"):
        spread = T.constants(9, 2 * span)
        body = np.add.reduceat(windows[starts] * spread[place], begin) + within[edges[1:] - 1].astype(np.uint64)
    owner = np.searchsorted(w.first, starts[begin], "right") - 1
    return Parsed(w, windows, least[begin], T.mix(body), edges, starts, np.searchsorted(owner, np.arange(len(b) + 1)), h)


def second_hash(p: Parsed, at: np.ndarray) -> np.ndarray:
    return T.run_hash(p.hashes, SPAN, seed=21)[at]


#: A known phrase or window: its first word, and the document and first word where it is known from.
FOUND = np.dtype([("at", "<u4"), ("source_at", "<u4"), ("source", "<i8")])

#: Packed entries of a block: for some documents, two hashes and the first word of each entry.
#: A negative block has documents and what their task has found already.
ENTRIES = "block int, ids binary, one binary, two binary, doc binary, number binary"
COLUMNS = ["block", "ids", "one", "two", "doc", "number"]


class Sender:
    """Collects entries of a task and deals them over blocks, equal ones once."""

    def __init__(self, blocks: int):
        self.blocks, self.held, self.waiting = blocks, [], 0

    def add(self, uid: np.ndarray, doc: np.ndarray, owner: np.ndarray, one: np.ndarray, two: np.ndarray, number: np.ndarray) -> None:
        self.held.append((uid, doc, owner, one, two, number))
        self.waiting += len(owner) + len(uid)

    def full(self) -> bool:
        return self.waiting >= FLUSH

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Entries whose two hashes a smaller document of this task has go back as known."""
        sizes = np.cumsum([0, *(len(x[0]) for x in self.held)])
        owner = np.concatenate([x[2] + s for x, s in zip(self.held, sizes)])
        uid, doc, one, two, number = (np.concatenate([x[i] for x in self.held]) for i in (0, 1, 3, 4, 5))
        self.held, self.waiting = [], 0
        order = np.lexsort((number, doc[owner], two, one))
        owner, one, two, number = owner[order], one[order], two[order], number[order]
        known, found = later(one, two, doc[owner], number)
        told = list(each_owner(owner[known], found))
        if told:
            who = uid[np.array([i for i, _ in told])]
            empty = pa.array([b""] * len(told), pa.binary())
            cells = [pa.array([u.tobytes() for u in who.astype("<i8")], pa.binary()), empty, empty, empty, pa.array([n.tobytes() for _, n in told], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(-1 - who % self.blocks, pa.int32()), *cells], COLUMNS)
        owner, one, two, number = owner[~known], one[~known], two[~known], number[~known]
        block = (one % np.uint64(self.blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        edges = np.searchsorted(block[order], np.arange(self.blocks + 1))
        for i in range(self.blocks):
            part = order[edges[i] : edges[i + 1]]
            if len(part):
                part = part[np.lexsort((number[part], owner[part]))]
                docs, place = np.unique(owner[part], return_inverse=True)
                yield packed_row(i, uid[docs], doc[docs], (one[part] // np.uint64(self.blocks)), two[part], place, number[part])


def packed_row(block: int, uid: np.ndarray, doc: np.ndarray, one=(), two=(), place=(), number=()) -> pa.RecordBatch:
    cells = [
        np.stack([uid, doc], axis=1).astype("<i8"), np.asarray(one, "<u8"), np.asarray(two, "<u8"), np.asarray(place, "<u4"), np.asarray(number, "<u4"),
    ]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], COLUMNS)


def later(one: np.ndarray, two: np.ndarray, doc: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks entries that are equal to one of a smaller document, and where that is; in order of (one, two, doc, number)."""
    if not len(one):
        return np.zeros(0, bool), np.zeros(0, FOUND)
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    known = doc > doc[lead]
    found = np.zeros(int(known.sum()), FOUND)
    found["at"], found["source_at"], found["source"] = number[known], number[lead[known]], doc[lead[known]]
    return known, found


def each_owner(owner: np.ndarray, number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(owner, kind="stable")
    owner, number = owner[order], number[order]
    edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    for a, z in zip(edges, np.append(edges[1:], len(owner))):
        yield int(owner[a]), number[a:z]


def unpack(table: pa.Table) -> tuple[np.ndarray, ...]:
    """uid, doc, one, two, number of all entries of a block, in order of (one, two, doc, number)."""
    uid, doc, rest = [], [], [[], [], []]
    for ids, one, two, place, number in zip(*(table.column(c) for c in ("ids", "one", "two", "doc", "number"))):
        pairs = np.frombuffer(ids.as_py(), "<i8").reshape(-1, 2)
        at = np.frombuffer(place.as_py(), "<u4")
        uid.append(pairs[at, 0])
        doc.append(pairs[at, 1])
        for c, cell, kind in zip(rest, (one, two, number), ("<u8", "<u8", "<u4")):
            c.append(np.frombuffer(cell.as_py(), kind))
    uid, doc, one, two, number = map(np.concatenate, (uid, doc, *rest))
    order = np.lexsort((number, doc, two, one))
    return uid[order], doc[order], one[order], two[order], number[order]


REPLY = "uid long, known binary, open binary"


def replies(uid: np.ndarray, known: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """A row per document with what is known of it, and the first words of entries still open."""
    rows: dict[int, list[bytes]] = {}
    for which, (who, values) in enumerate((known, (more[0], more[1].astype("<u4")))):
        for u, part in each_owner(who, values):
            rows.setdefault(u, [b"", b""])[which] = part.tobytes()
    return pa.table({
        "uid": pa.array(list(rows), pa.int64()), "known": pa.array([r[0] for r in rows.values()], pa.binary()), "open": pa.array([r[1] for r in rows.values()], pa.binary()),
    })


def answer_phrases(table: pa.Table) -> pa.Table:
    uid, doc, one, two, number = unpack(table)
    known, found = later(one, two, doc, number)
    # anchors with phrases of several kinds: the first documents of each kind are looked at closer
    anchors = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
    kinds = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
    several = np.repeat(np.add.reduceat(kinds.astype(np.int64), anchors) > 1, np.diff(np.append(anchors, len(one))))
    more = several & ~known
    return replies(uid, (uid[known], found), (uid[more], number[more]))


def answer_windows(table: pa.Table) -> pa.Table:
    uid, doc, one, two, number = unpack(table)
    known, found = later(one, two, doc, number)
    return replies(uid, (uid[known], found), (uid[:0], number[:0]))


def _columns(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return piece.column("uid").to_numpy(), piece.column("rank").to_numpy()


def send_phrases(blocks: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(blocks)
        for batch in batches:
            for piece in T.slices(batch, "text"):
                p = parse(T.batch_of(piece.column("text")))
                owner = np.repeat(np.arange(piece.num_rows), np.diff(p.first))
                at = p.starts[p.begin[:-1]] if len(owner) else np.zeros(0, np.int64)
                sender.add(*_columns(piece), owner, p.anchor, p.body, at - p.words.first[owner])
                if sender.full():
                    yield from sender.flush()
        if sender.held:
            yield from sender.flush()

    return run


def _flat(cell, kind) -> np.ndarray:
    """Entries of a list of packed cells."""
    return np.frombuffer(b"".join(cell.as_py() or ()), kind)


def split_again(coarse: int, fine: int) -> Callable:
    """Deals the entries of a coarse block over ``fine`` blocks, so that rows stay long however many blocks there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for block, parts in held.items():
                uid, doc, one, two, number = unpack(pa.Table.from_batches(parts))
                which = (one % np.uint64(fine)).astype(np.int64)
                order = np.argsort(which, kind="stable")
                edges = np.searchsorted(which[order], np.arange(fine + 1))
                for i in np.flatnonzero(np.diff(edges)):
                    part = order[edges[i] : edges[i + 1]]
                    who, first, place = np.unique(uid[part], return_index=True, return_inverse=True)
                    yield packed_row(int(i) * coarse + block, who, doc[part[first]], one[part] // np.uint64(fine), two[part], place, number[part])
            held.clear()

        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                row = batch.slice(i, 1)
                if block < 0:
                    yield row
                    continue
                held.setdefault(block, []).append(row)
                waiting += len(row.column("number")[0].as_buffer()) // 4
                if waiting >= FLUSH:
                    yield from flush()
                    waiting = 0
        yield from flush()

    return run


def dealt(entries: DataFrame, coarse: int, fine: int) -> DataFrame:
    return entries if fine == 1 else entries.repartition(coarse, "block").mapInArrow(split_again(coarse, fine), ENTRIES)


def phrases_at(p: Parsed, i: int, at: np.ndarray) -> np.ndarray:
    """Numbers of the phrases of a text that begin at these words."""
    begins = p.starts[p.begin[p.first[i] : p.first[i + 1]]] - p.words.first[i]
    return p.first[i] + np.searchsorted(begins, at)


def phrase_windows(p: Parsed, i: int, at: np.ndarray) -> np.ndarray:
    """First words of the windows of some phrases of a text."""
    which = phrases_at(p, i, at)
    size = p.begin[which + 1] - p.begin[which]
    ends = np.cumsum(size)
    return p.starts[np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size - p.begin[which], size)]


def factors(p: Parsed, i: int, phrases: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """(at, length, source, source_at) of the factors of a text: phrases and windows that continue each other in one source."""
    which = phrases_at(p, i, phrases["at"].astype(np.int64))
    length = np.append(p.begin[which + 1] - p.begin[which] + SPAN - 1, np.full(len(windows), SPAN))
    found = np.append(phrases, windows)
    at, source_at = found["at"].astype(np.int64), found["source_at"].astype(np.int64)
    order = np.lexsort((source_at, at))
    at, source_at, source, end = at[order], source_at[order], found["source"][order], (at + length)[order]
    new = np.ones(len(at), bool)
    new[1:] = (source[1:] != source[:-1]) | (source_at[1:] - at[1:] != source_at[:-1] - at[:-1]) | (at[1:] > end[:-1])
    first = np.flatnonzero(new)
    out = np.zeros(len(first), FACTOR)
    if len(first):
        out["at"], out["source"], out["source_at"] = at[first], source[first], source_at[first]
        out["length"] = np.maximum.reduceat(end, first) - at[first]
    return out


FACTOR = np.dtype([("at", "<i4"), ("length", "<i4"), ("source", "<i8"), ("source_at", "<i4")])
FACTORS = "array<struct<at:int,length:int,source:long,source_at:int>>"


def inside(spans: np.ndarray, total: int) -> np.ndarray:
    """Marks the words inside any of the (begin, end) spans."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, spans[:, 0], 1)
    np.add.at(step, spans[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def send_windows(blocks: int) -> Callable:
    """The windows at factor boundaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(blocks)
        for batch in batches:
            for piece in T.slices(batch, "text"):
                more = [_flat(c, "<u4").astype(np.int64) for c in piece.column("open")]
                if not any(map(len, more)):
                    continue
                p = parse(T.batch_of(piece.column("text")))
                parts = [(i, phrase_windows(p, i, numbers)) for i, numbers in enumerate(more) if len(numbers)]
                owner = np.concatenate([np.full(len(s), i) for i, s in parts])
                at = np.concatenate([s for _, s in parts])
                sender.add(*_columns(piece), owner, p.windows[at], second_hash(p, at), at - p.words.first[owner])
                if sender.full():
                    yield from sender.flush()
        if sender.held:
            yield from sender.flush()

    return run


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the factors together and removes their words."""
    for batch in batches:
        for piece in T.slices(batch, "text"):
            b = T.batch_of(piece.column("text"))
            known, more = [[_flat(x, FOUND) for x in piece.column(c)] for c in ("known", "found")]
            parsed = [np.zeros(0, FACTOR)] * len(b)
            if any(map(len, known)) or any(map(len, more)):
                p = parse(b)
                w = p.words
                parsed = [factors(p, i, x, y) if len(x) or len(y) else parsed[i] for i, (x, y) in enumerate(zip(known, more))]
                spans = [np.stack([w.first[i] + f["at"], w.first[i] + f["at"] + f["length"]], axis=1) for i, f in enumerate(parsed) if len(f)]
                gone = inside(np.concatenate(spans), len(w.start))
            else:
                w = T.words(b)
                gone = np.zeros(len(w.start), bool)
            kept = np.flatnonzero(~gone)
            size = w.end[kept] - w.start[kept] + 1
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            at = np.arange(total) - np.repeat(ends - size - w.start[kept], size)
            joined = b.data[np.minimum(at, max(len(b.data) - 1, 0))] if total else np.zeros(0, np.uint8)
            joined = joined.copy()
            joined[ends - 1] = 0x20
            edges = np.append(0, ends)[np.searchsorted(kept, w.first)]
            body = memoryview(joined.tobytes())
            texts = [bytes(body[a : max(a, z - 1)]) for a, z in zip(edges[:-1], edges[1:])]
            flat = np.concatenate([np.zeros(0, FACTOR), *parsed])
            fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[n])) for n in FACTOR.names], list(FACTOR.names))
            found = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parsed)]), pa.int32()), fields)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(w.counts, pa.int64()), pa.array(T.per_text(gone, w.first), pa.int64()), pa.array([t.decode() for t in texts], pa.string()), found],
                ["doc_id", "n_words", "n_removed", "kept", "factors"],
            )


def dedup_substrings(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, factors): ``kept`` are the words left, joined by one blank; a factor has its first
    word and length, and the document and word that it is a copy from."""
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    rows = documents.select(F.xxhash64("doc_id", "text").alias("uid"), rank.alias("rank"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(16, math.ceil(total / BLOCK_BYTES))
    fine = -(-wanted // FAN_OUT)
    blocks = -(-wanted // fine)

    answers = dealt(bounded(rows).mapInArrow(send_phrases(blocks), ENTRIES), blocks, fine).groupBy("block").applyInArrow(_block_of(answer_phrases), REPLY)
    status = answers.groupBy("uid").agg(F.collect_list("known").alias("known"), F.collect_list("open").alias("open"))
    status = written(status, "phrase-status")
    placed = rows.select("doc_id", "rank", "uid", "text").join(status.withColumnRenamed("uid", "_u"), F.col("uid") == F.col("_u"), "left").drop("_u")
    sent = dealt(placed.mapInArrow(send_windows(blocks), ENTRIES), blocks, fine)
    answers = sent.groupBy("block").applyInArrow(_block_of(answer_windows), REPLY)
    found = answers.groupBy("uid").agg(F.collect_list("known").alias("found"))
    whole = placed.join(found.select(F.col("uid").alias("_u"), "found"), F.col("uid") == F.col("_u"), "left")
    # the same columns as above, so that one shuffle of the texts serves both
    return whole.select("doc_id", "rank", "uid", "text", "known", "open", "found").mapInArrow(cut, f"doc_id long, n_words long, n_removed long, kept string, factors {FACTORS}")


def _block_of(answer: Callable) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= 0:
            return answer(table)
        uid = [int(np.frombuffer(c.as_py(), "<i8")[0]) for c in table.column("ids")]
        return pa.table({"uid": pa.array(uid, pa.int64()), "known": table.column("number"), "open": pa.array([b""] * len(uid), pa.binary())})

    return run
