"""Models, coders and the mix against brute force, exact round trips and held-out rows."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowcaster.llm import op1_urls, op2_tokens, op4_mix, op9_lattice, op10_quality
from rowcaster.llm import text as T
from rowcaster.llm.queries import PIECES, TOKENIZER, tokenizer_path

from .fixture import LOW, SCHEMA, collected, frame, rows, sentence, words

# --- 1: URLs -----------------------------------------------------------------------------


def parts_brute(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    stop = min([tail.index(c) for c in "?#" if c in tail], default=len(tail))
    return rest[:end].translate(LOW), tail[:stop]


def rule_brute(host: str, path: str) -> tuple[str | None, str | None]:
    fits = [(len(h + p), h + p, kind) for kind, h, p in op1_urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def url_rows() -> list[tuple]:
    r = random.Random(1)
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1", "http://com/", "https://acom/x", "http://example.com", "x://example.com?q=/en/", "http://a.example.com/en", "http://b.net/es/1#x", "http://b.net/fr?/fr/", "http://É.com/é", "a://b://com/", "http://u@example.com:80/en/"]
    good = [f"https://{r.choice('abcd')}.example.com/{r.choice(['fr', 'de'])}/{r.randrange(900)}" for _ in range(150)]
    bad = [f"http://ads{r.randrange(9)}.track.net/{r.choice(['es', 'fr'])}/{r.randrange(900)}?click" for _ in range(150)]
    free = [f"https://{r.choice('abcd')}.example.org/de/{r.randrange(900)}" for _ in range(40)] + [f"http://ads{r.randrange(9)}.track.org/es/{r.randrange(900)}?click" for _ in range(40)]
    return list(enumerate(urls + good + bad + free + free[:5] + ["http://long.org/" + "a" * 5000]))


def ratio_brute(data: list[tuple], kept: set, strings: dict, o: op1_urls.ModelOptions, totals: tuple) -> dict:
    """Ratios by plain recursion over the counted strings."""
    contexts: dict = collections.defaultdict(lambda: [0, 0])
    for s, (a, b) in strings.items():
        contexts[s[:-1]][0] += a
        contexts[s[:-1]][1] += b
    out = {}
    for u in {u for _, u in data if u}:
        padded, logs = "\x02" * o.order + u, 0.0
        for i in range(len(u)):
            g = padded[i : i + o.order + 1]
            p = []
            for side in (0, 1):
                q = (strings.get(g[-1], (0, 0))[side] + o.smoothing / o.alphabet) / (totals[side] + o.smoothing)
                for k in range(1, o.order + 1):
                    q = (strings.get(g[-k - 1 :], (0, 0))[side] + o.smoothing * q) / (contexts.get(g[-k - 1 : -1], (0, 0))[side] + o.smoothing)
                p.append(q)
            logs += math.log(p[0]) - math.log(p[1])
        out[u] = logs / len(u)
    return out


def test_urls(spark):
    data = url_rows()
    pages = spark.createDataFrame(data, "page_id long, url string").withColumns({"host": F.lit("x"), "n": F.lit(1), "html": F.lit("")})
    got = {r["page_id"]: r for r in op1_urls.filter_urls(pages).collect()}
    assert len(got) == len(data)
    for i, u in data:
        host, path = parts_brute(u)
        rule, verdict = rule_brute(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        if verdict:
            assert got[i]["verdict"] == verdict
        elif u and ".org" in u and "long" not in u:
            assert got[i]["verdict"] == ("block" if "track" in u else "allow"), u


@pytest.mark.parametrize("bound", [200_000, 10])
def test_url_ratios(spark, monkeypatch, bound):
    monkeypatch.setattr(op1_urls, "BROADCAST_STRINGS", bound)  # broadcast, or shuffled under salts
    o = op1_urls.ModelOptions(order=3)
    data = [(i, u) for i, u in url_rows() if u and len(u) < 100]
    learned = [(u, rule_brute(*parts_brute(u))[1]) for _, u in data]
    counts: dict = collections.defaultdict(lambda: [0, 0])
    totals = [0, 0]
    for u, v in learned:
        if v:
            side = int(v == "block")
            totals[side] += len(u)
            padded = "\x02" * o.order + u
            for i in range(len(u)):
                for k in range(o.order + 1):
                    counts[padded[i + o.order - k : i + o.order + 1]][side] += 1
    df = spark.createDataFrame([(u, 1, v == "allow") for u, v in learned if v], "url string, n long, allowed boolean")
    strings = op1_urls.count_strings(df, o)
    found = {r["s"]: (r["a"], r["b"]) for r in strings.collect()}
    assert found == {k: tuple(v) for k, v in counts.items()}
    urls = spark.createDataFrame([(u,) for u in {u for _, u in data}], "url string")
    got = {r["url"]: r["ratio"] for r in op1_urls.score(urls, strings, o, tuple(totals)).collect()}
    want = ratio_brute(data, set(), found, o, tuple(totals))
    assert got.keys() == want.keys()
    assert all(abs(got[u] - want[u]) < 1e-9 for u in got)


def test_verdicts_do_not_change_with_the_size_of_the_table(spark):
    """Each URL ten times over: the same counts ten times, so nothing rare is left out of either class."""
    data = [(i, u) for i, u in url_rows() if u and len(u) < 100]
    pages = spark.createDataFrame(data, "page_id long, url string")
    few = {r["url"]: (r["ratio"], r["verdict"]) for r in op1_urls.filter_urls(pages, options=op1_urls.ModelOptions(smoothing=4.0)).collect()}
    tenfold = pages.crossJoin(spark.range(10).toDF("times"))
    many = {r["url"]: (r["ratio"], r["verdict"]) for r in op1_urls.filter_urls(tenfold, options=op1_urls.ModelOptions(smoothing=40.0)).collect()}
    assert few.keys() == many.keys() and all(abs(few[u][0] - many[u][0]) < 1e-9 and few[u][1] == many[u][1] for u in few)


def test_urls_without_a_class(spark):
    pages = spark.createDataFrame([(1, "http://x.org/"), (2, None), (None, "http://a.com/")], "page_id long, url string")
    assert {r["verdict"] for r in op1_urls.filter_urls(pages).collect()} == {"allow"}
    assert op1_urls.filter_urls(pages.limit(0)).count() == 0


# --- 2: tokens ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model() -> str:
    with open(tokenizer_path(TOKENIZER), encoding="utf-8") as f:
        return f.read()


def test_ids_equal_the_tokenizers(model):
    from tokenizers import Tokenizer

    r = random.Random(5)
    letters = "abs tmdrevl'' '  \n\t é Ñ1²3 .,!\"#☃漢 😀\x85\x1c\x0b\xa0\u2003\u0301٣ア\U0002000b"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["don't we've we'll I'm it's 'tis ''s he'd x'", "  a", " ", "", "  ", "\n\n a", "a\n\n", "'S 's 're're", "<|endoftext|>", "a" * 3000]
    plain = Tokenizer.from_str(model)
    plain.encode_special_tokens = True
    for text, ids in zip(texts, op2_tokens.Encoder(model, op2_tokens.class_table(model)).encode(pa.array(texts))):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids + [2], text


def test_added_tokens_in_texts(model):
    from tokenizers import Tokenizer

    mark = "<|endoftext|>"
    texts = ["a b", f"one{mark}two", mark, f" {mark} {mark}\n", "", f"é☃ {mark}x", mark[:-1], mark[:5], mark[5:], None, "c d"]
    plain = Tokenizer.from_str(model)
    found = op2_tokens.kept_encoder(model, op2_tokens.class_table(model).tobytes()).encode(pa.array(texts))
    for text, ids in zip(texts, found):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids + [2], text
    assert found[2].tolist() == [50256, 2]


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 5000, 200_000])
def test_coder_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 50_000).astype(np.uint16)
    freq = op2_tokens.frequencies(np.bincount(ids, minlength=1 << 16))
    assert freq.sum() == 1 << op2_tokens.SCALE
    table = op2_tokens.coder(freq)
    data = op2_tokens.encode_block(ids, *table[:2])
    assert (op2_tokens.decode_block(data, table) == ids).all()
    sections, total = op2_tokens.block_sections(data)
    assert total == n
    at = 0
    for i, s in enumerate(sections):  # every checkpoint is a place to begin
        assert (op2_tokens.decode_block(data, table, only=i) == ids[at : at + s[0]]).all()
        at += s[0]
    with pytest.raises(ValueError, match="damaged"):
        op2_tokens.decode_block(data[:20] + bytes([data[20] ^ 1]) + data[21:], table)


def test_coder_is_near_the_entropy():
    ids = np.random.default_rng(1).zipf(1.3, 300_000).clip(0, 50_000).astype(np.uint16)
    count = np.bincount(ids, minlength=1 << 16)
    p = count[count > 0] / len(ids)
    bits = -(p * np.log2(p)).sum() * len(ids) / 8
    table = op2_tokens.coder(op2_tokens.frequencies(count))
    assert len(op2_tokens.encode_block(ids, *table[:2])) < 1.08 * bits


def test_token_files(spark, model, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(op2_tokens, "BLOCK_TOKENS", 500)
    data = rows()
    out = op2_tokens.token_output(frame(spark, data), tokenizer_path(TOKENIZER), str(tmp_path / "ids"))
    got = sorted(out.collect(), key=lambda r: r["start"])
    plain = Tokenizer.from_str(model)
    want = collections.Counter()
    for i, t, *_ in data:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want[i, np.array(ids, "<u4").tobytes()] += 1
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert keys == sorted(keys)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    none = op2_tokens.token_output(spark.createDataFrame([], SCHEMA), tokenizer_path(TOKENIZER), str(tmp_path / "none"))
    assert none.count() == 0


@pytest.mark.parametrize("part_bytes", [32 << 20, 400])
def test_order_of_ids_at_any_number_of_parts(spark, tmp_path, monkeypatch, part_bytes):
    """One id with most rows, bunched ids and many nulls; the same data as one part and as many."""
    monkeypatch.setattr(op2_tokens, "PART_BYTES", part_bytes)
    data = [(5 if i % 3 else None if i % 2 else i * i * i, f"text {i} " * (i % 7), "en", "s") for i in range(600)]
    path = str(tmp_path / "ids")
    got = op2_tokens.token_output(frame(spark, data), tokenizer_path(TOKENIZER), path).collect()
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((x[0] for x in data), key=lambda i: (i is not None, i))
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    blocks = spark.read.schema(op2_tokens.BLOCKS).parquet(path).where(F.col("shard") >= 0)
    if part_bytes == 400:  # a third of the rows in one part at most
        assert blocks.groupBy("part").agg(F.sum(F.size("docs")).alias("n")).agg(F.max("n")).first()[0] < 200


def test_long_texts_in_parts(model, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(op2_tokens.Encoder, "LONG", 200)
    monkeypatch.setattr(op2_tokens.T, "PIECE_BYTES", 50)
    r = random.Random(3)
    texts = ["".join(r.choice("ab cd  e\n'st é漢.1 ") for _ in range(r.randrange(900))) for _ in range(200)]
    texts += ["a" * 500, " " * 500, "a b " * 200, "a <|endoftext|> b" * 40]
    encoder = op2_tokens.Encoder(model, op2_tokens.class_table(model), added=True)
    plain = Tokenizer.from_str(model)
    for text, ids in zip(texts, encoder.encode(pa.array(texts))):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids + [2], text
    assert len(op2_tokens.safe_cuts(np.frombuffer(b"a b " * 200, np.uint8), 50)) >= 8


# --- 4: mix ------------------------------------------------------------------------------


def targets_brute(sizes: dict, share: float, most: float, weights: tuple) -> dict:
    """Fill in rounds: what a full source leaves over goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        for s in full or open_:
            out[s] = most * sizes[s] if full else level * w[s]
        left -= sum(out[s] for s in full)
        open_ -= full or open_
    return out


def mix_rows() -> list[tuple]:
    r = random.Random(2)
    data = [(i, sentence(r, r.randrange(1, 80)), "en", f"s{min(i % 7, 4)}") for i in range(1500)]
    return data + rows() + [(9000, None, "en", "empty"), (9001, "a " * 4000, "en", "s2")]


def test_mix(spark):
    data = mix_rows()
    drawn = op4_mix.with_draws(frame(spark, data)).select("doc_id", "row.source", "size", "source_size", "target", F.size("draws").alias("n"))
    got = drawn.collect()
    sizes = collections.Counter()
    for _, t, _, s in data:
        sizes[s] += len(words(t))
    want = targets_brute(sizes, 1.5, 2.0, (3, 1, 2))
    taken = collections.Counter()
    assert collections.Counter((r["doc_id"], r["source"], r["size"]) for r in got) == collections.Counter((i, s, len(words(t))) for i, t, _, s in data)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["n"] <= 2
        taken[r["source"]] += r["n"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(12, 0.005 * want[s]), s
    again = op4_mix.with_draws(frame(spark, data, False).repartition(5)).select("doc_id", "row.source", "size", "source_size", "target", F.size("draws").alias("n"))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got))


@pytest.mark.parametrize("part_bytes", [16 << 20, 3000])
def test_mixed_rows_and_shards(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(op4_mix, "PART_BYTES", part_bytes)  # a shard in one part or in several
    df = frame(spark, mix_rows())
    mixed = op4_mix.mix(df)
    assert (mixed.rdd.getNumPartitions() > 16) == (part_bytes == 3000)
    assert mixed.columns == df.columns
    drawn = op4_mix.with_draws(df).select("doc_id", "row.source", "draws").collect()
    assert mixed.count() == sum(len(r["draws"]) for r in drawn)
    shards = collections.Counter(d["shard"] for r in drawn for d in r["draws"])
    assert len(shards) == 16
    assert max(shards.values()) < 2 * min(shards.values())


def test_hypergeometric_draws(spark):
    """By inversion: frequencies over evenly spaced units equal the exact probabilities."""
    big, good, draws, n = 60, 25, 18, 4000
    unit = (F.col("id") + 0.5) / n
    lits = [F.lit(v).cast("long") for v in (big, good, draws)]
    got = collections.Counter(r[0] for r in spark.range(n).select(op4_mix.hypergeometric(*lits, unit)).collect())
    for x in range(draws + 1):
        p = math.comb(good, x) * math.comb(big - good, draws - x) / math.comb(big, draws)
        assert abs(got[x] / n - p) < 1e-3


def test_quotas_are_exact(spark):
    data = [("a", 500), ("b", 3), (None, 77), ("c", 0)]
    df = spark.createDataFrame(data, "source string, blocks long")
    got = op4_mix.split_quotas(df, op4_mix.MixOptions(shards=5)).collect()
    sums = collections.Counter()
    shards = collections.Counter()
    for r in got:
        assert r["quota"] >= 0
        sums[r["source"]] += r["quota"]
        shards[r["shard"]] += r["quota"]
    assert sums == {s: n for s, n in data if n}
    assert len(shards) == 5 and max(shards.values()) - min(shards.values()) <= 2


def test_mix_of_nothing(spark):
    assert op4_mix.with_draws(spark.createDataFrame([], SCHEMA)).count() == 0
    one = op4_mix.with_draws(spark.createDataFrame([(1, None, "en", "s")], SCHEMA)).first()
    assert (one["size"], one["target"], len(one["draws"])) == (0, 0.0, 0)


# --- 9: language model -------------------------------------------------------------------


def test_lattice_sums_all_segmentations():
    names, p = [b" a", b" ab", b" b", b" bc", b" c", b"$", b"^", b"^a", b"^ab"], np.array([0.1, 0.05, 0.1, 0.15, 0.1, 0.1, 0.1, 0.2, 0.1])
    prob = dict(zip(names, p))
    lattice = op9_lattice.Lattice(names, np.log(p))

    def brute(word: bytes, head: bool = True) -> float:
        if not word:
            return 0.0 if head else 1.0
        total = 0.0
        for n in range(1, len(word) + 1):
            piece = prob.get((b"^" if head else b" ") + word[:n], 0.0)
            total += piece * brute(word[n:], False)
        return total + (prob[b"^"] * brute(word, False) if head else 0.0)

    texts = [b"a", b"abc", b"cab", b"abcabcabc", b"bcbcbcb", b"ab"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    start = end - [len(t) for t in texts]
    got, use = lattice.run(data, start, end, np.ones(len(texts)))
    assert np.exp(got) == pytest.approx([brute(t) for t in texts])
    # expected uses times lengths give back all bytes
    length = np.array([len(n) - 1 if n != b"$" else 0 for n in names])
    assert (use * length).sum() == pytest.approx(len(data))
    # the derivative of the log-probability by a piece's log-weight is its expected use
    for i in range(len(names)):
        step = np.log(p).copy()
        step[i] += 1e-6
        more = op9_lattice.Lattice(names, step).run(data, start, end)[0]
        assert (more - got).sum() / 1e-6 == pytest.approx(use[i], abs=1e-4)


def test_lm_scores(spark):
    data = rows()
    got = op9_lattice.lm_scores(frame(spark, data), tokenizer_path(PIECES)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    docs = [(i, [*words((t or "").translate(LOW)), ""]) for i, t, *_ in data]
    c = collections.Counter(w for i, ws in docs for w in ws if not held(i))
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for i, ws in docs:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        want[i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(base, 6)] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert op9_lattice.lm_scores(spark.createDataFrame([], SCHEMA), tokenizer_path(PIECES)).count() == 0


def test_learning_raises_the_likelihood(spark):
    names, p = op9_lattice.load_pieces(tokenizer_path(PIECES))
    r = random.Random(3)
    c = collections.Counter(w for _ in range(300) for w in words(sentence(r, 30)))
    counts = spark.createDataFrame(list(c.items()), "word string, c long")
    data = np.frombuffer("".join(c).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in c])
    start = np.concatenate([[0], end[:-1]])
    before = op9_lattice.Lattice(names, np.log(p)).run(data, start, end)[0] @ np.array(list(c.values()))
    use, total = op9_lattice.refine(counts, names, p)
    assert math.isclose(total, before, rel_tol=1e-9)
    after = op9_lattice.Lattice(names, np.log(use / use.sum())).run(data, start, end)[0] @ np.array(list(c.values()))
    assert after > before
    learned = op9_lattice.learn(counts, names, p, 300)
    use, total = op9_lattice.refine(counts, names, learned)
    use[names.index(b"$")] += 300
    last = op9_lattice.Lattice(names, np.log(use / use.sum())).run(data, start, end)[0] @ np.array(list(c.values()))
    assert total > before and abs(last - total) < 2 * op9_lattice.STILL * abs(total)  # it stands still


def test_every_piece_of_the_vocabulary_is_used():
    import sentencepiece

    names, _ = op9_lattice.load_pieces(tokenizer_path(PIECES))
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    longest = max((p for p in pieces if "▁" not in p[1:]), key=lambda p: len(p.replace("▁", "").encode()))
    body = (b"^" if longest.startswith("▁") else b" ") + longest.replace("▁", "").translate(LOW).encode()
    assert body in names and op9_lattice.Lattice(names, np.zeros(len(names))).longest == len(body) - 1


# --- 10: quality -------------------------------------------------------------------------


def labelled(n: int = 900) -> tuple[list[tuple], list[tuple]]:
    r = random.Random(7)
    data, labels = [], []
    for i in range(n):
        text = sentence(r, r.randrange(20, 120), 3000)
        bad = i % 4 == 0
        if bad:
            w = words(text)
            text = r.choice([" | ".join(w), " ".join(x + "%%%" for x in w), " ".join([w[0]] * 60), "!! ".join(x.upper() for x in w)])
        data.append((i, text, "en", "s"))
        labels.append((i, int(not bad), 0))
    return data, labels


def test_quality_on_held_out_rows(spark):
    data, labels = labelled()
    odd = [(5000, None, None, None), (5001, "", "en", "s"), (None, "some text", "en", "s")]
    table = spark.createDataFrame([*labels, (3, None, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in op10_quality.quality_scores(frame(spark, data + odd), table).collect()}
    assert len(got) == len(data) + 3
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    held = [i for i, *_ in data if zlib.crc32(str(i).encode()) % 3 == 1]
    assert [got[i]["held_out"] for i, *_ in data] == [i in set(held) for i, *_ in data]
    right = sum(got[i]["predicted"] == labels[i][1] for i in held)
    assert right >= 0.97 * len(held)


def test_an_id_of_many_rows_leaves_the_sample_bounded(spark, monkeypatch):
    data, labels = labelled(60)
    many = data + [(3, f"{data[3][1]} {i}", "en", "s") for i in range(3000)]
    sizes = []
    plain = op10_quality.train
    monkeypatch.setattr(op10_quality, "train", lambda x, y: sizes.append(len(x)) or plain(x, y))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert op10_quality.quality_scores(frame(spark, many), table, 40).count() == len(many)
    assert sizes and sizes[0] <= 80


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in op10_quality.quality_scores(frame(spark, rows()), labels).collect()} == {0.5}
    assert op10_quality.quality_scores(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_contexts_come_from_all_documents(spark, monkeypatch):
    """Units of documents without labels have context vectors, and sums are those of plain loops."""
    data, labels = labelled(60)
    data += [(9000, "seldom harbour lantern", "fr", "t")]
    learn, found = op10_quality.learn_contexts, []
    monkeypatch.setattr(op10_quality, "learn_contexts", lambda df: found.append(learn(df)) or found[-1])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    op10_quality.quality_scores(frame(spark, data), table)
    want = np.zeros((op10_quality.TABLE, op10_quality.DIM))
    for _, text, *_ in data:
        h, _ = op10_quality.units(T.batch_of(pa.array([text])))
        place, sign = op10_quality.index_vectors(h)
        for i in range(len(h)):
            for j in range(max(0, i - op10_quality.AROUND), min(len(h), i + op10_quality.AROUND + 1)):
                if i != j:
                    np.add.at(want[int(h[i] % np.uint64(op10_quality.TABLE))], place[j], sign[j])
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert len(found) == 1 and np.allclose(found[0], want, atol=1e-6)


def test_probabilities_are_calibrated():
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (4000, 6)).astype(np.float32)
    y = (r.random(4000) < 1 / (1 + np.exp(-x[:, 0] - 0.5 * x[:, 1]))).astype(int)
    net = op10_quality.train(x[:3000], y[:3000])
    s = net.score(x[3000:])
    for low in (0.0, 0.3, 0.7):
        part = (s >= low) & (s < low + 0.35)
        assert abs(s[part].mean() - y[3000:][part].mean()) < 0.12
