"""Language-model scores: likelihood of a text over all segmentations into subwords.

The pieces are those of an existing vocabulary. Their starting weights follow from its
scores (which order the pieces), and expectation-maximisation over the words of all training
documents, round after round until the likelihood stands still, turns them into probabilities. A word's probability is the sum
over all its segmentations, by a forward recursion in log space over byte positions; words
of a batch advance together. Single bytes are pieces too, so no word has probability 0.

Counts are made per chunk of documents, summed per word over the corpus, and joined back to
the words of each chunk, so no vocabulary is held as a whole in one place.

Defined results: a null or empty text is the end token alone. A null ``doc_id`` is learned
from, not held out. Without training documents all counts are 0 and the pieces keep their
starting weights. Rows with one ``doc_id`` are scored one by one. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import text as T

CHUNK_BYTES = 24 << 20
END = ""  # no word is empty
WORDS_AT_ONCE = 20_000
STILL = 1e-3  # relative gain of the training words' log-likelihood below which learning ends
MOST_ROUNDS = 30


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


# --- pieces ------------------------------------------------------------------------------


def load_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces and starting weights: ``^`` before the bytes of a piece that begins a word, `` ``
    before one that goes on; the word mark alone, single bytes and the end are always there."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = "▁"
    weight: dict[bytes, float] = {}
    ranked = sorted(range(model.get_piece_size()), key=lambda i: -model.get_score(i))
    for rank, i in enumerate(ranked):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or mark in piece[1:]:
            continue
        body = b"^" + piece[1:].encode() if piece.startswith(mark) else b" " + piece.encode()
        body = body[:1] + bytes(c + 32 if 65 <= c < 91 else c for c in body[1:])  # texts are in lower case
        weight[body] = weight.get(body, 0.0) + 1.0 / (rank + 100.0)
    for c in range(256):
        weight.setdefault(b" " + bytes([c]), 1e-6)
    weight.setdefault(b"^", 1e-3)
    weight[b"$"] = 1e-3
    names = sorted(weight)
    p = np.array([weight[n] for n in names])
    return names, p / p.sum()


class Lattice:
    """Forward (and backward) sums over the segmentations of words."""

    def __init__(self, names: list[bytes], logp: np.ndarray):
        self.logp = logp
        self.longest = max(len(n) - 1 for n in names)  # bytes of a piece
        self.index = {n: i for i, n in enumerate(names)}
        self.table = T.mix(np.arange(256, dtype=np.uint64) + np.uint64(99 << 16))
        self.power = np.ones(self.longest + 1, np.uint64)
        self.power[1:] = T.constants(99, 1)[0]
        np.multiply.accumulate(self.power, out=self.power)
        self.tables = {kind: self._lookup(names, kind) for kind in (b"^", b" ")}

    def _lookup(self, names: list[bytes], kind: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length: hashes of the pieces' prefixes, sorted, and the piece or -1."""
        found: list[dict[bytes, int]] = [{} for _ in range(self.longest + 1)]
        for i, name in enumerate(names):
            if name[:1] == kind and len(name) > 1:
                for n in range(1, len(name) - 1):
                    found[n].setdefault(name[1 : n + 1], -1)
                found[len(name) - 1][name[1:]] = i
        out = []
        for n, entries in enumerate(found):
            keys = np.frombuffer(b"".join(entries), np.uint8).reshape(len(entries), n) if n and entries else np.zeros((0, max(n, 1)), np.uint8)
            h = (self.table[keys] * self.power[: keys.shape[1]]).sum(axis=1, dtype=np.uint64)
            order = np.argsort(h)
            out.append((h[order], np.fromiter(entries.values(), np.int64, len(entries))[order]))
        return out

    def arcs(self, data: np.ndarray, at: np.ndarray, room: np.ndarray, kind: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, entries of ``at``, pieces) of all pieces that match there."""
        live = np.arange(len(at))
        h = np.zeros(len(at), np.uint64)
        for n in range(1, self.longest + 1):
            keys, pieces = self.tables[kind][n]
            ok = room[live] >= n
            live, h = live[ok], h[ok]
            if not len(keys) or not len(live):
                return
            h = h + self.table[data[at[live] + n - 1]] * self.power[n - 1]
            slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            ok = keys[slot] == h
            live, h, slot = live[ok], h[ok], slot[ok]
            whole = pieces[slot] >= 0
            yield n, live[whole], pieces[slot[whole]]

    def run(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probability of each word and, with weights, the expected use of each piece."""
        size = (end - start).astype(np.int64)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        first = np.cumsum(size + 1) - (size + 1)  # the nodes of a word lie together
        nodes = int((size + 1).sum())
        forward = np.full(nodes, -np.inf)
        forward[first] = self.logp[self.index[b"^"]]
        owner = np.repeat(np.arange(len(size)), size)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        at = start[owner] + within
        node = first[owner] + within
        inner = [(n, node[i], p) for n, i, p in self.arcs(data, at, (size[owner] - within), b" ")]
        begin = [(n, first[i], p) for n, i, p in self.arcs(data, start, size, b"^")]
        # arcs by the place in the word that they start from, so that words advance together
        cells = np.concatenate([np.stack([v, v + n, p]) for n, v, p in inner], axis=1) if inner else np.zeros((3, 0), np.int64)
        place = np.zeros(nodes, np.int64)
        place[node] = within
        key = place[cells[0]]
        cells = cells[:, np.argsort(key, kind="stable")]
        steps = np.searchsorted(np.sort(key), np.arange((int(size[0]) if len(size) else 0) + 1))
        steps = np.append(steps, cells.shape[1])
        for n, v, p in begin:
            np.logaddexp.at(forward, v + n, self.logp[p])
        for t in range(len(steps) - 1):
            v, to, p = cells[:, steps[t] : steps[t + 1]]
            if len(v):
                np.logaddexp.at(forward, to, forward[v] + self.logp[p])
        total = forward[first + size]
        out = np.empty(len(size))
        out[order] = total
        if weights is None:
            return out, None
        backward = np.full(nodes, -np.inf)
        backward[first + size] = 0.0
        for t in range(len(steps) - 2, -1, -1):
            v, to, p = cells[:, steps[t] : steps[t + 1]]
            if len(v):
                np.logaddexp.at(backward, v, backward[to] + self.logp[p])
        w = weights[order]
        use = np.zeros(len(self.logp))
        word_of = np.zeros(nodes, np.int64)
        word_of[np.concatenate([first, node + 1])] = np.concatenate([np.arange(len(size)), owner])
        v, to, p = cells
        use += np.bincount(p, weights=w[word_of[v]] * np.exp(forward[v] + self.logp[p] + backward[to] - total[word_of[v]]), minlength=len(use))
        for n, v, p in begin:
            use += np.bincount(p, weights=w[word_of[v]] * np.exp(self.logp[p] + backward[v + n] - total[word_of[v]]), minlength=len(use))
        use[self.index[b"^"]] += float((w * np.exp(self.logp[self.index[b"^"]] + backward[first] - total)).sum())
        return out, use


def _words_column(batch: pa.RecordBatch) -> Iterator[tuple[T.Batch, slice]]:
    for at in range(0, batch.num_rows, WORDS_AT_ONCE):
        part = batch.slice(at, WORDS_AT_ONCE)
        yield T.batch_of(part.column("word")), slice(at, at + part.num_rows)


def refine(counts: DataFrame, names: list[bytes], p: np.ndarray) -> tuple[np.ndarray, float]:
    """One round: expected uses of the pieces in the training words, summed over all tasks, and the words' log-likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, use, total = Lattice(names, np.log(p)), np.zeros(len(p)), 0.0
        for batch in batches:
            c = batch.column("c").to_numpy().astype(float)
            for b, where in _words_column(batch):
                own, used = lattice.run(b.data, b.offsets[:-1], b.offsets[1:], c[where])
                use += used
                total += float((own * c[where]).sum())
        seen = np.flatnonzero(use)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(use[seen], total))], ["piece", "use"])

    used = counts.where((F.col("c") > 0) & (F.col("word") != END)).mapInArrow(run, "piece int, use double")
    use, total = np.full(len(p), 0.1), 0.0  # a trace for pieces that no word uses
    for r in used.groupBy("piece").agg(F.sum("use").alias("use")).collect():  # one row per piece
        if r["piece"] < 0:
            total = r["use"]
        else:
            use[r["piece"]] += r["use"]
    return use, total


def learn(counts: DataFrame, names: list[bytes], p: np.ndarray, ends: int) -> np.ndarray:
    """Probabilities of the pieces, learned until the likelihood of the training words stands still."""
    before = None
    for _ in range(MOST_ROUNDS):
        use, total = refine(counts, names, p)
        use[names.index(b"$")] += ends
        p = use / use.sum()
        if before is not None and total - before <= STILL * abs(before):
            break
        before = total
    return p


# --- jobs --------------------------------------------------------------------------------


def chunk_words(chunks: DataFrame) -> DataFrame:
    """(chunk, word, n): the distinct words of each chunk and their count in training."""

    def run(table: pa.Table) -> pa.Table:
        h, n, data, spans, ends = [], [], [], [], 0
        for batch in table.combine_chunks().to_batches():
            for piece in T.slices(batch, "text"):
                b = T.batch_of(piece.column("text"), lower=True)
                w = T.words(b)
                keep = ~piece.column("held").to_numpy(zero_copy_only=False)
                ends += int(keep.sum())
                hashes = T.span_hash(b.data, w.start, w.end)
                distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
                h.append(distinct)
                n.append(np.bincount(place, weights=keep[w.text_of()].astype(float), minlength=len(distinct)).astype(np.int64))
                spans.append(T.string_array(b.data, w.start[first], w.end[first]))
        chunk = table.column("chunk")[0].as_py()
        if h:
            distinct, first, place = np.unique(np.concatenate(h), return_index=True, return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate(n).astype(float), minlength=len(distinct)).astype(np.int64)
            found = pa.chunked_array(spans).combine_chunks().take(pa.array(first))
        else:
            counts, found = np.zeros(0, np.int64), pa.array([], pa.string())
        words = pa.chunked_array([found, pa.array([END], pa.string())])
        return pa.table({"chunk": pa.array([chunk] * len(words), pa.int32()), "word": words, "n": pa.array(np.append(counts, ends), pa.int64())})

    return chunks.groupBy("chunk").applyInArrow(run, "chunk int, word string, n long")


def lm_scores(documents: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(1, math.ceil(total / CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int")
    chunks = documents.select(chunk.alias("chunk"), "doc_id", held_out().alias("held"), "text")
    own = written(chunk_words(chunks), "lm-words")
    counts = written(own.groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.max(F.when(F.col("word") == END, F.col("c"))).alias("e")).first()
    n, v, ends = sums["n"] or 0, sums["v"], sums["e"] or 0
    names, p = load_pieces(model_path)
    if n:
        p = learn(counts, names, p, ends)
    logp = np.log(p)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(names, logp)
        for batch in batches:
            scores = [lattice.run(b.data, b.offsets[:-1], b.offsets[1:])[0] for b, _ in _words_column(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("c"), pa.array(np.concatenate(scores) / math.log(10))], ["word", "c", "lp"]
            )

    rated = counts.where(F.col("word") != END).mapInArrow(rate, "word string, c long, lp double")
    rated = written(rated, "lm-rated")
    known = own.where(F.col("word") != END).select(F.col("chunk").alias("_chunk"), "word").join(rated, "word").select("_chunk", "word", "c", "lp")
    end_lp = float(logp[names.index(b"$")] / math.log(10))
    bottom = n + 0.1 * (v + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        r = T.batch_of(right.column("word"))
        keys = T.span_hash(r.data, r.offsets[:-1], r.offsets[1:])
        order = np.argsort(keys)
        keys = keys[order]
        c_of = right.column("c").to_numpy()[order]
        lp_of = right.column("lp").to_numpy()[order]
        base_of = np.log10((c_of + 0.1) / bottom) if bottom else np.zeros(0)
        out: list[list[np.ndarray]] = [[] for _ in range(4)]
        for batch in left.combine_chunks().to_batches():
            for piece in T.slices(batch, "text"):
                b = T.batch_of(piece.column("text"), lower=True)
                w = T.words(b)
                at = np.searchsorted(keys, T.span_hash(b.data, w.start, w.end))
                doc = w.text_of()
                out[0].append(w.counts + 1)
                out[1].append(np.bincount(doc, weights=(c_of[at] > 0).astype(float), minlength=len(b)).astype(np.int64) + (ends > 0))
                out[2].append(np.bincount(doc, weights=base_of[at], minlength=len(b)) + math.log10((ends + 0.1) / bottom))
                out[3].append(np.bincount(doc, weights=lp_of[at], minlength=len(b)) + end_lp)
        tokens, known_, base, own_score = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held"), "n_tokens": pa.array(tokens, pa.int64()),
            "n_known": pa.array(known_, pa.int64()), "train_tokens": pa.array(np.full(len(tokens), n), pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(own_score, pa.float64()),
        })

    return chunks.groupBy("chunk").cogroup(known.groupBy("_chunk")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
