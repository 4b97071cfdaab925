"""Token ids in files: byte-level BPE, then a static range asymmetric numeral system.

Texts are cut into pre-tokens with array operations, every distinct pre-token of a worker is
encoded once by the tokenizer, and its ids are put back in place. Documents are dealt in
ascending ``doc_id`` order over parts; the ids of a part are cut into blocks of whole
documents. One frequency table over the ids of all documents, scaled to 2 ** 20, is
shared by all blocks. A block is coded alone: interleaved lanes (symbol i belongs to lane i
mod lanes) write to one stream of 32-bit words. Every ``SECTION_ROWS`` rows of lanes there
is a checkpoint, the lanes' states and the place in the stream, from which decoding can
begin, and a checksum of the ids up to the next one.

File format: Parquet files in a folder for each shard, a row for each block: its part and
number, its documents, their lengths, and the payload described at ``encode_block``. Shard -1
holds the frequency table. Shard, part and block ascend with ``doc_id``; any block can be
decoded with the table alone.

Defined results: a null or empty text has the end id alone. Null ids come first. Rows with
one ``doc_id`` each keep their own entry, in an order that follows their ids alone. A very
long text is tokenized in parts, cut where a pre-token is sure to begin. An empty table gives
files without blocks. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_path, recorded, remove, written
from . import text as T
from .frames import bounded

END_ID = 2
SCALE = 20
LANES, SECTION_ROWS = 2048, 256
BLOCK_TOKENS = 1 << 20
SHARDS, PART_BYTES = 64, 32 << 20  # folders, and bytes of ids of a part
LOW = np.uint64(1 << 31)
MAGIC = b"RBK1"
TABLE = -1  # shard of the row that holds the frequency table
BLOCKS = "part int, block int, docs array<bigint>, lengths array<int>, payload binary, shard int"


# --- pre-tokens and ids ------------------------------------------------------------------

LETTER, NUMBER, BLANK, OTHER, UNSURE = range(5)


def class_table(model: str, top: int = 0x20000) -> np.ndarray:
    """Class of each code point below ``top``, as the tokenizer itself cuts around it; the last entry stands for all others."""
    from tokenizers import Tokenizer

    cutter = Tokenizer.from_str(model).pre_tokenizer
    points = np.array([c for c in range(top) if not 0xD800 <= c < 0xE000])
    table = np.full(top + 1, UNSURE, np.uint8)
    for part in np.array_split(points, 32):
        # a letter goes with the a, a number with the 1, any other mark with the !
        probe = "".join(f"a{chr(c)}1!{chr(c)}1\n" for c in part)
        begins = np.zeros(len(probe) + 1, bool)
        begins[[start for _, (start, _) in cutter.pre_tokenize_str(probe)]] = True
        at = 7 * np.arange(len(part)) + 1
        table[part] = np.select([~begins[at], ~begins[at + 3], ~begins[at + 1]], [LETTER, OTHER, NUMBER], BLANK)
    table[0x20] = BLANK  # goes with the 1 that follows
    return table


def pre_tokens(points: np.ndarray, edges: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places where a pre-token begins. ``points``: code points, ``edges``: starts of texts."""
    n = len(points)
    kind = np.append(table[np.minimum(points, len(table) - 1)], UNSURE)
    joint = np.zeros(n + 1, bool)
    joint[edges] = True
    joint[n] = True
    begin = joint.copy()
    begin[1:n] |= kind[1:n] != kind[: n - 1]
    # the last blank before something else stands alone, or a space goes with what follows
    close = np.flatnonzero(begin[1:] & ~joint[1:] & (kind[:n] == BLANK)) + 1
    begin[close - 1] = True
    begin[close[points[close - 1] == 0x20]] = False
    # a mark that begins a pre-token and is followed by one of seven endings
    mark = np.flatnonzero((points == 0x27) & begin[:n])
    mark = mark[(mark + 1 < n)]
    mark = mark[~joint[mark + 1] & (kind[mark + 1] == LETTER)]
    if len(mark):
        after = points[np.minimum(mark + 1, n - 1)]
        second = points[np.minimum(mark + 2, n - 1)]
        inside = (mark + 2 < n) & ~joint[np.minimum(mark + 2, n)]
        one = np.isin(after, [ord(c) for c in "stmd"])
        two = inside & (((after == ord("r")) | (after == ord("v"))) & (second == ord("e")) | (after == ord("l")) & (second == ord("l")))
        for which, size in ((one, 1), (two & ~one, 2)):
            at = mark[which]
            begin[at + 1] = False
            rest = at + 1 + size
            begin[rest[(rest < n)]] = True
    return np.flatnonzero(begin[:n])


def safe_cuts(data: np.ndarray, most: int) -> list[int]:
    """Places about ``most`` bytes apart before a space between two printed ASCII characters: a pre-token always begins there."""
    printed = (data > 0x20) & (data < 0x7F)
    places = np.flatnonzero(printed[:-2] & (data[1:-1] == 0x20) & printed[2:]) + 1
    out, last = [], 0
    while len(data) - last > most:
        i = int(np.searchsorted(places, last + most, "right")) - 1
        if i < 0 or places[i] <= last:  # no place so near
            i += 1
            if i >= len(places):
                break
        last = int(places[i])
        out.append(last)
    return out


class Encoder:
    """Ids of text batches; keeps the ids of the pre-tokens that it has met.

    With ``added`` the strings of the tokenizer's added tokens in a text become their ids, as
    in plain encoding; texts that hold one, or a code point outside the table, go to the
    tokenizer itself.
    """

    MOST = 2_000_000  # kept pre-tokens, after which it starts anew
    LONG = 4 << 20  # bytes above which a text is encoded in parts
    JOINED = 1024  # pre-tokens that go to the tokenizer in one string

    def __init__(self, model: str, table: np.ndarray, added: bool = False):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model)
        self.model.encode_special_tokens = not added
        contents = [t.content for t in self.model.get_added_tokens_decoder().values()] if added else []
        self.added = [c.encode() for c in contents]
        self.whole = any(" " in c for c in contents)  # then no place is safe to cut at
        self.table = table
        self.newline = self.model.encode("\n", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def learn(self, hashes: np.ndarray, strings: list[str]) -> None:
        """``hashes`` ascend and are new. No string holds white space, but for a space at its start."""
        joined = ["\n".join([*strings[a : a + self.JOINED], ""]) for a in range(0, len(strings), self.JOINED)]
        found = [np.array(e.ids, np.uint16) for e in self.model.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.uint16), *found])
        # the ids of a string end with that of its line feed, which no other pre-token has
        last = np.flatnonzero(flat == self.newline[0])
        self._keep(hashes, flat, np.diff(last, prepend=-1) - 1, last)

    def learn_blanks(self, hashes: np.ndarray, strings: list[str]) -> None:
        found = [np.array(e.ids, np.uint16) for e in self.model.encode_batch_fast(strings, add_special_tokens=False)]
        size = np.array([len(f) for f in found], np.int64)
        self._keep(hashes, np.concatenate([np.zeros(0, np.uint16), *found]), size, np.cumsum(size))

    def _keep(self, hashes: np.ndarray, flat: np.ndarray, size: np.ndarray, end: np.ndarray) -> None:
        at = np.searchsorted(self.known, hashes)
        self.begin = np.insert(self.begin, at, end - size + len(self.ids))
        self.size = np.insert(self.size, at, size)
        self.known = np.insert(self.known, at, hashes)
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, the end id last."""
        b = T.batch_of(texts)
        out = []
        short = np.diff(b.offsets) <= self.LONG
        if short.all():
            flat, bounds = self._encode(b)
            return [np.append(flat[x:y], np.uint16(END_ID)) for x, y in zip(bounds[:-1], bounds[1:])]
        for i in range(len(b)):
            data = b.data[b.offsets[i] : b.offsets[i + 1]]
            edges = [0, *([] if self.whole else safe_cuts(data, T.PIECE_BYTES)), len(data)]
            parts = [self._encode(T.Batch(data[x:y], np.array([0, y - x])))[0] for x, y in zip(edges[:-1], edges[1:])]
            out.append(np.concatenate([*parts, np.array([END_ID], np.uint16)]))
        return out

    def _encode(self, b: T.Batch) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin."""
        points = np.frombuffer(b.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.append(np.flatnonzero(T.LEADS[b.data]), len(b.data))
        edges = np.searchsorted(lead, b.offsets)
        unsure = self.with_added(b) | (T.per_text(self.table[np.minimum(points, len(self.table) - 1)] == UNSURE, edges) > 0)
        if unsure.any():
            flat, sizes = [], []
            for i in range(len(b)):
                data = b.data[b.offsets[i] : b.offsets[i + 1]]
                if unsure[i]:
                    flat.append(np.array(self.model.encode(data.tobytes().decode("utf-8"), add_special_tokens=False).ids, np.uint16))
                else:
                    flat.append(self._encode(T.Batch(data, np.array([0, len(data)])))[0])
                sizes.append(len(flat[-1]))
            return np.concatenate(flat), np.append(0, np.cumsum(sizes))
        if len(points) == 0:
            return np.zeros(0, np.uint16), np.zeros(len(b) + 1, np.int64)
        begin = pre_tokens(points, edges[:-1][np.diff(edges) > 0], self.table)
        after = np.append(begin[1:], len(points))
        start, end = lead[begin], lead[after]
        h = T.span_hash(b.data, start, end, seed=5)
        order = np.argsort(h)
        ranked = h[order]
        new = np.ones(len(h), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        distinct, first = ranked[new], order[new]
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        if len(self.known) + len(distinct) > self.MOST:
            self.clear()
        at = np.searchsorted(self.known, distinct)
        fresh = np.ones(len(distinct), bool)
        fresh[at < len(self.known)] = self.known[at[at < len(self.known)]] != distinct[at < len(self.known)]
        if fresh.any():
            blank = self.table[points[after[first] - 1]] == BLANK
            for rows, learn in ((fresh & ~blank, self.learn), (fresh & blank, self.learn_blanks)):
                if rows.any():
                    learn(distinct[rows], T.string_array(b.data, start[first[rows]], end[first[rows]]).to_pylist())
            at = np.searchsorted(self.known, distinct)
        size = self.size[at][which]
        ends = np.cumsum(size)
        flat = self.ids[np.arange(int(ends[-1])) - np.repeat(ends - size - self.begin[at][which], size)]
        return flat, np.append(0, ends)[np.searchsorted(start, b.offsets)]

    def with_added(self, b: T.Batch) -> np.ndarray:
        """Marks texts in which the string of an added token begins."""
        out = np.zeros(len(b), bool)
        data = b.data.tobytes()
        for content in self.added:
            at = data.find(content)
            while at >= 0:
                i = int(np.searchsorted(b.offsets, at, "right")) - 1
                out[i] = True
                at = data.find(content, int(b.offsets[i + 1]))
        return out


def kept_encoder(model: str, table: bytes) -> Encoder:
    """The encoder of this worker process, which tasks after each other share."""
    import sys
    import types

    holder = sys.modules.setdefault("_kept_encoder", types.ModuleType("_kept_encoder"))
    if getattr(holder, "model", None) != model:
        holder.model, holder.encoder = model, Encoder(model, np.frombuffer(table, np.uint8), added=True)
    return holder.encoder


# --- the coder ---------------------------------------------------------------------------


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2 ** SCALE, at least 1 for each id that occurs."""
    total = int(counts.sum())
    out = np.zeros(len(counts), np.int64)
    if total == 0:
        return out
    seen = counts > 0
    out[seen] = np.maximum(1, counts[seen] * (1 << SCALE) // total)
    over = int(out.sum()) - (1 << SCALE)
    order = np.argsort(-out, kind="stable")
    while over:  # the most frequent ids bear the difference
        for i in order:
            step = min(over, out[i] - max(1, out[i] // 2)) if over > 0 else over
            out[i] -= step
            over -= step
            if not over:
                break
    return out


def encode_section(ids: np.ndarray, lanes: int, freq: np.ndarray, cum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States at the section's start, and its words in reading order."""
    x = np.full(lanes, LOW, np.uint64)
    words = []
    limit = np.uint64(((1 << 31) >> SCALE) << 32)
    for row in range((len(ids) - 1) // lanes, -1, -1):
        symbols = ids[row * lanes : (row + 1) * lanes]
        k = len(symbols)
        f, c, s = freq[symbols], cum[symbols], x[:k]
        full = s >= limit * f
        words.append((s[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        s = np.where(full, s >> np.uint64(32), s)
        quotient = s // f
        x[:k] = (quotient << np.uint64(SCALE)) + (s - quotient * f) + c
    return x, np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)


def decode_section(x: np.ndarray, words: np.ndarray, n: int, freq: np.ndarray, cum: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    lanes, at = len(x), 0
    x = x.copy()
    out = np.zeros(n, np.uint16)
    mask = np.uint64((1 << SCALE) - 1)
    for begin in range(0, n, lanes):
        k = min(lanes, n - begin)
        s = x[:k]
        slot = s & mask
        ids = symbol[slot]
        out[begin : begin + k] = ids
        s = freq[ids] * (s >> np.uint64(SCALE)) + slot - cum[ids]
        low = np.flatnonzero(s < LOW)
        s[low] = (s[low] << np.uint64(32)) | words[at : at + len(low)].astype(np.uint64)
        at += len(low)
        x[:k] = s
    return out


def coder(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cum = np.cumsum(freq) - freq
    return freq.astype(np.uint64), cum.astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.uint16), freq)


def encode_block(ids: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> bytes:
    """Payload: magic; lanes, ids, sections (uint32 each); for each section its ids, words,
    checksum of the ids and states; then all words; last the checksum of all before it."""
    lanes = int(np.clip(len(ids) // 64, 1, LANES))
    per = lanes * SECTION_ROWS
    parts, body = [], []
    for begin in range(0, len(ids), per):
        piece = ids[begin : begin + per]
        x, words = encode_section(piece, lanes, freq, cum)
        parts.append(struct.pack("<III", len(piece), len(words), zlib.crc32(piece.astype("<u2").tobytes())) + x.astype("<u8").tobytes())
        body.append(words.astype("<u4").tobytes())
    data = MAGIC + struct.pack("<III", lanes, len(ids), len(parts)) + b"".join(parts) + b"".join(body)
    return data + struct.pack("<I", zlib.crc32(data))


def block_sections(data: bytes) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray]], int]:
    """(ids, checksum, states, words) of each section: all that decoding from it needs."""
    if data[:4] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("damaged block")
    lanes, n, count = struct.unpack_from("<III", data, 4)
    at, heads = 16, []
    for _ in range(count):
        size, words, crc = struct.unpack_from("<III", data, at)
        heads.append((size, words, crc, np.frombuffer(data, "<u8", lanes, at + 12).astype(np.uint64)))
        at += 12 + 8 * lanes
    out = []
    for size, words, crc, x in heads:
        out.append((size, crc, x, np.frombuffer(data, "<u4", words, at)))
        at += 4 * words
    return out, n


def decode_block(data: bytes, table: tuple[np.ndarray, np.ndarray, np.ndarray], only: int | None = None) -> np.ndarray:
    """Ids of a block, or of one of its sections alone."""
    freq, cum, symbol = table
    sections, _ = block_sections(data)
    out = []
    for size, crc, x, words in sections if only is None else sections[only : only + 1]:
        ids = decode_section(x, words, size, freq, cum, symbol)
        if zlib.crc32(ids.astype("<u2").tobytes()) != crc:
            raise ValueError("damaged section")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint16)


# --- Spark jobs --------------------------------------------------------------------------


def tokenize(documents: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian 16-bit numbers."""
    # the vocabulary file, some MB, and a number for each code point
    shared = documents.sparkSession.sparkContext.broadcast((model, class_table(model).tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = None
        for batch in batches:
            for piece in T.slices(batch, "text"):
                encoder = encoder or kept_encoder(*shared.value)
                ids = [i.astype("<u2").tobytes() for i in encoder.encode(piece.column("text"))]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bounded(rows).mapInArrow(run, "doc_id long, ids binary")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each of the 65,536 ids occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), "<u2"), minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    total = np.zeros(1 << 16, np.int64)
    for r in tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[r["id"]] = r["n"]
    return total


def write_tokens(documents: DataFrame, model: str, path: str) -> None:
    """Write the ids of all documents below ``path``. ``model``: text of a tokenizer file.

    The ids are written once as they come. Their number sets the number of parts, ranges of
    ``doc_id`` of about ``PART_BYTES`` of ids each; rows of an id that fills several parts are
    dealt over them by a hash of their ids. A task streams its part in order and codes block
    after block, so it holds one block at a time, however the ids are spread.
    """
    spark = documents.sparkSession
    with recorded() as made:
        tokens = written(tokenize(documents, model), "token-ids", codec="zstd")
    total = count_ids(tokens)
    freq = frequencies(total)
    n_parts = max(1, -(-2 * int(total.sum()) // PART_BYTES))
    shared = spark.sparkContext.broadcast(freq.astype("<u4").tobytes())  # 65,536 numbers

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, cum, _ = coder(np.frombuffer(shared.value, "<u4").astype(np.int64))
        docs: list = []
        pieces: list[np.ndarray] = []
        part, held, number = 0, 0, 0

        def block() -> pa.RecordBatch:
            payload = encode_block(np.concatenate(pieces), f, cum)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([docs], pa.list_(pa.int64())),
                 pa.array([[len(p) for p in pieces]], pa.list_(pa.int32())), pa.array([payload], pa.binary())],
                ["part", "block", "docs", "lengths", "payload"],
            )

        for batch in batches:
            for doc, where, cell in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("ids")):
                docs.append(doc)
                pieces.append(np.frombuffer(cell.as_py(), "<u2"))
                part, held = where, held + len(pieces[-1])
                if held >= BLOCK_TOKENS:
                    yield block()
                    docs, pieces, held, number = [], [], 0, number + 1
        if docs:
            yield block()

    # nulls come first in both orders
    tie = F.xxhash64("ids")
    parts = tokens.withColumn("tie", tie).repartitionByRange(n_parts, "doc_id", "tie").withColumn("part", F.spark_partition_id())
    ordered = parts.sortWithinPartitions("part", "doc_id", "tie", "ids").select("doc_id", "part", "ids")
    blocks = ordered.mapInArrow(code, "part int, block int, docs array<bigint>, lengths array<int>, payload binary")
    many = F.lit(-(-n_parts // SHARDS))
    stored = blocks.withColumn("shard", F.floor(F.col("part") / many).cast("int"))
    first = spark.createDataFrame([(0, 0, [], [], bytearray(zlib.compress(freq.astype("<u4").tobytes())), TABLE)], BLOCKS)
    for rows, mode in ((stored, "errorifexists"), (first.coalesce(1), "append")):
        rows.write.mode(mode).partitionBy("shard").option("compression", "uncompressed").parquet(path)
    for table in made:
        remove(spark, table)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files: ids as little-endian 32-bit numbers."""
    stored = spark.read.schema(BLOCKS).parquet(path)
    table = spark.sparkContext.broadcast(stored.where(F.col("shard") == TABLE).first()["payload"])  # at most 65,536 numbers
    blocks = stored.where(F.col("shard") != TABLE)
    totals = blocks.groupBy("shard", "part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n)).alias("_n"))
    # one row per shard is ordered as a whole, one row per part inside its shard
    shards = totals.groupBy("shard").agg(F.sum("_n").alias("_n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_a"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("shard", "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_b"))
    begins = parts.join(F.broadcast(shards), "shard").select("shard", "part", (F.col("_a") + F.col("_b")).alias("_start"))
    earlier = Window.partitionBy("shard", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("shard", "part", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n).alias("_n"))
    sizes = sizes.select("shard", "part", "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_at"))
    begins = sizes.join(begins, ["shard", "part"]).select("shard", "part", "block", (F.col("_start") + F.col("_at")).alias("_start"))
    placed = blocks.join(begins, ["shard", "part", "block"]).select("docs", "lengths", "payload", "_start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for batch in batches:
            tables = tables or coder(np.frombuffer(zlib.decompress(table.value), "<u4").astype(np.int64))
            for docs, lengths, payload, start in zip(*(batch.column(i) for i in range(4))):
                ids = decode_block(payload.as_buffer().to_pybytes(), tables).astype("<u4")
                size = lengths.values.to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(size)
                cells = [ids[e - n : e].tobytes() for e, n in zip(ends, size)]
                yield pa.RecordBatch.from_arrays(
                    [docs.values.cast(pa.int64()), pa.array(start.as_py() + ends - size, pa.int64()), pa.array(size, pa.int64()), pa.array(cells, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_output(documents: DataFrame, model_path: str, path: str | None = None) -> DataFrame:
    """Write the files and read them back."""
    spark = documents.sparkSession
    path = path or new_path(spark, "tokens")
    with open(model_path, encoding="utf-8") as f:
        write_tokens(documents, f.read(), path)
    return read_tokens(spark, path)
