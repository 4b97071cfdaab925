"""Operators on rows and pairs of rows against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowcaster.llm import op3_substrings, op5_jaccard, op6_rules, op7_lines, op8_decontaminate
from rowcaster.llm import text as T

from .fixture import LOW, SCHEMA, collected, frame, rows, sentence, words


# --- words -------------------------------------------------------------------------------


def test_words_equal_the_pattern():
    texts = ["", None, " a", "a b c\x85d\x1ce f ", "\tx\n", "é" * 5, "a" * 5000]
    b = T.batch_of(pa.array(texts))
    w = T.words(b)
    found = [[b.data[s:e].tobytes().decode() for s, e in zip(w.start[x:y], w.end[x:y])] for x, y in zip(w.first[:-1], w.first[1:])]
    assert found == [words(t) for t in texts]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n else None for n in (5, 0, 100, 1, 1, 7)])], ["text"])
    parts = list(T.slices(batch, "text", 6))
    assert [p.num_rows for p in parts] == [2, 1, 2, 1]


# --- 3: substrings -----------------------------------------------------------------------


def cut_brute(data: list[tuple]) -> list[tuple]:
    first: dict[tuple, float] = {}
    key = lambda i: float("inf") if i is None else i
    for i, t, *_ in data:
        w = words(t)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, key(i)), key(i))
    out = []
    for i, t, *_ in data:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < key(i):
                gone[k : k + 13] = [True] * 13
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("flush,fan_out,block", [(1 << 21, 2048, 48 << 20), (40, 2048, 48 << 20), (60, 4, 3000)])
def test_substrings(spark, monkeypatch, flush, fan_out, block):
    monkeypatch.setattr(op3_substrings, "FLUSH", flush)
    monkeypatch.setattr(op3_substrings, "FAN_OUT", fan_out)  # a second split of the blocks
    monkeypatch.setattr(op3_substrings, "BLOCK_BYTES", block)
    assert collected(op3_substrings.dedup_substrings(frame(spark, rows())).drop("factors")) == cut_brute(rows())


def test_substrings_that_overlap_in_many_ways(spark):
    r = random.Random(3)
    base = [f"t{r.randrange(30)}" for _ in range(300)]
    data = []
    for i in range(60):  # pieces of one text, with some words changed, so that factors end anywhere
        a = r.randrange(200)
        piece = base[a : a + r.randrange(5, 90)]
        for _ in range(r.randrange(4)):
            piece[r.randrange(len(piece))] = "new"
        data.append((i, " ".join(piece + base[:20][:: r.choice([1, -1])]), "en", "s"))
    found = op3_substrings.dedup_substrings(frame(spark, data, False)).cache()
    assert collected(found.drop("factors")) == cut_brute(data)
    check_factors(data, found)


def check_factors(data: list[tuple], found) -> None:
    """Factors are copies of words of a smaller document, of a window at least, and together all that is removed."""
    text = {i: words(t) for i, t, *_ in data}
    for r in found.collect():
        own, gone = text[r["doc_id"]], set()
        for f in r["factors"]:
            assert f["source"] < r["doc_id"] and f["length"] >= 13
            assert own[f["at"] : f["at"] + f["length"]] == text[f["source"]][f["source_at"] : f["source_at"] + f["length"]]
            gone |= set(range(f["at"], f["at"] + f["length"]))
        assert len(gone) == r["n_removed"]


def test_factors_of_known_copies(spark):
    """A copy of a passage is one factor, whichever phrases it is cut into; two sources make two."""
    r = random.Random(21)
    a, b = ([f"{x}{r.randrange(10**6)}" for _ in range(120)] for x in "ab")
    new = [f"n{i}" for i in range(20)]
    data = [(1, " ".join(a), "en", "s"), (2, " ".join(b), "en", "s"), (3, " ".join(new + a[30:90] + new[:5] + b[10:100] + new), "en", "s")]
    data += [(4, " ".join(a[5:17]), "en", "s"), (5, " ".join(a[5:18]), "en", "s")]  # a word less than a window, and a window
    found = op3_substrings.dedup_substrings(frame(spark, data, False)).cache()
    check_factors(data, found)
    got = {r["doc_id"]: [(f["at"], f["length"], f["source"], f["source_at"]) for f in r["factors"]] for r in found.collect()}
    assert got == {1: [], 2: [], 3: [(20, 60, 1, 30), (85, 90, 2, 10)], 4: [], 5: [(0, 13, 1, 5)]}


# --- 5: Jaccard --------------------------------------------------------------------------


def join_brute(data: list[tuple], k: int, above: int, below: int) -> list[tuple]:
    sets = []
    for _, t, *_ in data:
        w = words((t or "").translate(LOW))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    up = list(range(len(data)))

    def top(a: int) -> int:
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and below * both >= above * (len(sets[a]) + len(sets[b]) - both):
                up[top(a)] = top(b)
    least: dict[int, list] = collections.defaultdict(list)
    for a, (i, *_) in enumerate(data):
        if i is not None:
            least[top(a)].append(i)
    return sorted(((i, len(sets[a]), min(least[top(a)], default=None)) for a, (i, *_) in enumerate(data)), key=repr)


@pytest.mark.parametrize("options", [op5_jaccard.JoinOptions(), op5_jaccard.JoinOptions(5, 80, 100), op5_jaccard.JoinOptions(1, 3, 5)])
def test_jaccard(spark, options):
    found = op5_jaccard.jaccard_components(frame(spark, rows()), options).select("doc_id", "n_shingles", "component_id")
    assert collected(found) == join_brute(rows(), options.words, options.above, options.below)


@pytest.mark.parametrize("fan_out,bucket", [(2048, 16 << 20), (4, 300)])
def test_jaccard_of_many_borderline_copies(spark, monkeypatch, fan_out, bucket):
    r = random.Random(4)
    monkeypatch.setattr(op5_jaccard, "FAN_OUT", fan_out)  # a second split of the buckets
    monkeypatch.setattr(op5_jaccard, "BUCKET_BYTES", bucket)
    base = [f"t{j}" for j in range(60)]
    data = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(60)] = f"x{r.randrange(1000)}"
        data.append((i, " ".join(w), "en", "s"))
    monkeypatch.setattr(op5_jaccard, "COLUMNS", 7)
    monkeypatch.setattr(op5_jaccard, "GROUP_ROWS", 16)  # many groups, many tasks' worth of tokens
    monkeypatch.setattr(op5_jaccard, "FLUSH_TOKENS", 200)
    found = op5_jaccard.jaccard_components(frame(spark, data, False)).select("doc_id", "n_shingles", "component_id")
    assert collected(found) == join_brute(data, 4, 85, 100)


def test_groups_of_one_component_meet_once(spark, monkeypatch):
    """Near copies of one text in many groups: stars link them, and few pairs are left to open."""
    r = random.Random(6)
    base = [f"t{j}" for j in range(200)]
    data = []
    for i in range(400):
        w = list(base)
        w[r.randrange(200)] = f"x{i}"
        data.append((i, " ".join(w), "en", "s"))
    data += [(1000 + i, " ".join(base[:160] + [f"y{i}{j}" for j in range(9)]), "en", "s") for i in range(5)]
    monkeypatch.setattr(op5_jaccard, "GROUP_ROWS", 8)
    rows_read = []
    plain = op5_jaccard.opened

    def counted(groups, pairs, options):
        rows_read.append((groups.count(), pairs.count()))
        return plain(groups, pairs, options)

    monkeypatch.setattr(op5_jaccard, "opened", counted)
    found = op5_jaccard.jaccard_components(frame(spark, data, False)).select("doc_id", "n_shingles", "component_id")
    assert collected(found) == join_brute(data, 4, 85, 100)
    (groups, stars), (_, rest) = rows_read
    assert groups > 50 and rest < 6 * groups < groups * groups // 4  # five of the groups hold others too


def test_first_of_each_component_stays(spark):
    df = frame(spark, rows())
    kept = op5_jaccard.keep_first(df)
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    expected = {c for i, _, c in join_brute(rows(), 4, 85, 100) if c is not None}
    assert ids - {None} == expected


# --- 6: rules ----------------------------------------------------------------------------


def base_brute(text: str | None) -> tuple:
    w, lines = words(text), (text or "").split("\n")
    seen, dup = set(), 0
    for line in lines:
        dup += bool(words(line)) and line in seen
        seen.add(line)
    runs = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = [False] * len(w)
    for k in range(len(w) - 7):
        if runs[tuple(w[k : k + 8])] > 1:
            hit[k : k + 8] = [True] * 8
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, dup, sum(hit), len(w) < 20 or 100 * sum(hit) > 30 * len(w)


def rule_rows() -> list[tuple]:
    r = random.Random(5)
    extra = [(100, "a b\na b\n\n\na b\n c", "en", "s0"), (101, "l1 is here\nl1 is here \nl1 is here\r", "en", "s0"), (102, "#*$%& |<> é" * 9, "en", "s0")]
    extra += [(103, " ".join(["one two three four five six seven eight nine"] * 4), "en", "s0")]
    clean = [(200 + i, sentence(r, r.randrange(40, 400), 5000), "en", "s0" if i % 3 else "s1") for i in range(150)]
    junk = [(400 + i, " ".join(w + "%%%" for w in words(sentence(r, 100, 5000))), "en", "s0") for i in range(12)]
    return rows() + extra + clean + junk


def test_base_rules(spark):
    found = op6_rules.quality_rules(frame(spark, rule_rows()))
    got = collected(found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got == sorted(((i, *base_brute(t)) for i, t, *_ in rule_rows()), key=repr)


def test_outliers_go_and_clean_rows_stay(spark):
    df = frame(spark, rule_rows())
    kept = op6_rules.quality_filter(df)
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert {i for i in range(200, 350)} <= ids
    assert not ids & set(range(400, 412))


def test_estimate_is_the_covariance_of_the_central_rows(spark):
    """A concentration step leaves the determinant no larger, and outliers do not move it."""
    import numpy as np

    r = np.random.default_rng(1)
    good = r.multivariate_normal(np.zeros(5), np.diag([1, 2, 3, 4, 5.0]), 900)
    bad = r.normal(40, 1, (100, 5))
    data = [("a", "b", *map(float, x)) for x in np.concatenate([good, bad])]
    df = spark.createDataFrame(data, "g_lang string, g_source string, x0 double, x1 double, x2 double, x3 double, x4 double")
    row = op6_rules.fit_outliers(df).first()
    centre = np.array([row[f"m0_{i}"] for i in range(5)])
    assert np.abs(centre).max() < 0.5
    assert abs(row["det0"] - row["det1"]) < 0.5  # both starts end at the same place


def test_chi_square():
    known = [(0.5, 1, 0.454936), (0.95, 1, 3.841459), (0.75, 5, 6.625680), (0.999, 5, 20.515006), (0.9999, 5, 25.744832), (0.5, 7, 6.345811)]
    for p, k, x in known:
        assert abs(op6_rules.chi_square_quantile(p, k) - x) < 1e-5
    # the central three quarters of normal values, scaled, have their variance again
    import numpy as np

    x = np.random.default_rng(2).normal(size=(400_000, 5))
    d = (x * x).sum(1)
    inner = x[d <= np.quantile(d, 0.75)]
    assert abs(op6_rules.OutlierOptions().consistency * inner.var() - 1) < 0.01


def mcd_brute(x, o):
    """Concentration steps in plain arrays until the kept rows stand still: (distance of each row)."""
    import numpy as np

    rank = lambda v, p: np.sort(v)[math.ceil(p * len(v)) - 1]
    floors = np.diag(np.square(o.floors))
    centre = np.array([rank(c, 0.5) for c in x.T])
    spread = np.array([rank(np.abs(c - m), 0.5) for c, m in zip(x.T, centre)])
    far = (((x - centre) / (1.4826 * spread + o.floors)) ** 2).sum(axis=1)
    best = None
    for weights, factor in ((np.where(far <= 5, 1.0, 0.0) + 1e-9, 1.0), (1 / (1 + far), 1.0)):
        kept = None
        while True:
            mean = (x * weights[:, None]).sum(axis=0) / weights.sum()
            cov = (x * weights[:, None]).T @ x / weights.sum() - np.outer(mean, mean)
            cov = cov * factor + floors
            q = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            now = q <= rank(q, o.half)
            if kept is not None and (kept == now).all():
                break
            kept, weights, factor = now, now.astype(float), o.consistency
        if best is None or np.linalg.slogdet(cov)[1] < best[0] - 1e-12:
            best = np.linalg.slogdet(cov)[1], q
    return best[1]


def test_estimate_equals_plain_concentration_steps(spark):
    import numpy as np

    r, data, want = np.random.default_rng(4), [], {}
    o = op6_rules.OutlierOptions()
    for g, n in (("a", 400), ("b", 150), ("a b", 90)):
        x = r.normal(size=(n, 5)) @ r.normal(size=(5, 5)) * 0.3
        x[: n // 6] += r.normal(size=5) * 3  # a sixth lies elsewhere
        want[g] = mcd_brute(x, o)
        data += [(g, "s", float(i), *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "g_lang string, g_source string, i double, x0 double, x1 double, x2 double, x3 double, x4 double").repartition(4)
    estimate = op6_rules.fit_outliers(df, o)
    best = F.when(F.col("det0") <= F.col("det1"), op6_rules._distance(0)).otherwise(op6_rules._distance(1))
    got = df.join(estimate, ["g_lang", "g_source"]).select("g_lang", "i", best.alias("q")).collect()
    for row in got:
        assert row["q"] == pytest.approx(want[row["g_lang"]][int(row["i"])], rel=1e-3, abs=1e-6)


def test_columns_with_any_name(spark):
    df = frame(spark, rows(), False).withColumn("a b, c: d", F.lit(1)).withColumn("e`f", F.lit(2))
    assert op6_rules.quality_filter(df).columns == df.columns


def test_one_statistic_alone_rejects(spark):
    """A planted outlier in each of the statistics, among texts that have next to nothing of it."""
    r = random.Random(11)
    line = lambda k: " ".join(f"w{r.randrange(10**6):06d}" for _ in range(k))
    text = lambda lines, k=10: "\n".join(line(k) for _ in range(lines))
    data = [(i, text(r.randrange(18, 23)), "en", "s0") for i in range(200)]
    block, rest = line(13), text(9, 9)
    planted = {
        900: text(400),  # 20 times as long
        901: "\n".join(" ".join(w * 2 for w in line(10).split()) for _ in range(20)),  # words twice as long
        902: text(20).replace(" ", " #", 16),  # 8 symbols in 100 words
        903: "\n".join(["yes no"] * 6 + ["no"] * 6 + [line(16) for _ in range(10)]),  # half of the lines repeated
        904: "\n".join([block, rest, block.replace(" ", "\n", 1)]),  # a quarter of the words in repeated runs
    }
    data += [(i, t, "en", "s0") for i, t in planted.items()]
    found = {x["doc_id"]: x for x in op6_rules.quality_rules(frame(spark, data)).select("row.doc_id", "base_failed", "distance", "kept").collect()}
    assert not any(x["base_failed"] for x in found.values())
    assert {i for i, x in found.items() if not x["kept"]} == set(planted)


# --- 7: lines ----------------------------------------------------------------------------


def test_patience_alignment():
    align = op7_lines.align
    assert align(list("abcde"), list("abxde")) == [0, 1, 3, 4]
    assert align(list("abc"), list("xyz")) == []
    assert align([], list("a")) == []
    assert align(list("aab"), list("ab")) == [0, 1]
    assert align(["p", None, "q"], ["z", "p", None, "q"]) == [1, 3]
    moved = align(list("abcdef"), list("defabc"))
    assert len(moved) == 3  # one of the two blocks


def longest_common(a: list, b: list) -> int:
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_of_distinct_lines_is_longest():
    r = random.Random(6)
    for _ in range(200):
        a, b = (r.sample(range(30), r.randrange(20)) for _ in range(2))
        found = op7_lines.align(a, b)
        places = [a.index(b[i]) for i in found]
        assert places == sorted(places)
        assert len(found) == longest_common(a, b)


def all_lines_brute(data: list[tuple]) -> list[tuple]:
    """Every document is aligned with every earlier one that shares a line; rows equal in id and text are one document."""
    docs = {}
    for i, t, *_ in data:
        docs[(i is None, i or 0, t or "")] = (t or "").split("\n")
    order = sorted(docs, key=lambda k: k[:2])
    real = {k: [x if words(x) else None for x in v] for k, v in docs.items()}
    gone = {
        k: {p for e in order if e[:2] < k[:2] and set(real[e]) & set(real[k]) - {None} for p in op7_lines.align(real[e], real[k])} for k in order
    }
    out = []
    for i, t, *_ in data:
        k = (i is None, i or 0, t or "")
        kept = None if t is None else "\n".join(x for j, x in enumerate(docs[k]) if j not in gone[k])
        out.append((i, sum(x is not None for x in real[k]), len(gone[k]), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rare", [100, 4, 1])
def test_lines(spark, monkeypatch, rare):
    monkeypatch.setattr(op7_lines, "RARE", rare)
    r = random.Random(8)
    pool = [f"line {j} {sentence(r, 4)}".replace("\n", "") for j in range(25)]
    data = [(i, "\n".join([*r.sample(pool, r.randrange(1, 9)), "", "the same in all", f"own {i}"]), "en", "s") for i in range(40)]
    data += [x for x in rows() if x[0] is not None]
    assert collected(op7_lines.dedup_lines(frame(spark, data))) == all_lines_brute(data)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_crossing_lines_of_many_holders(spark, monkeypatch, seed):
    """Frequent lines in all orders, with rare ones, blanks and repeats between them."""
    monkeypatch.setattr(op7_lines, "RARE", 3)
    r = random.Random(seed)
    data = []
    for i in range(70):
        some = r.sample("ABCDE", r.randrange(1, 5))
        mixed = [x for line in some for x in (line, r.choice([f"own {i}", f"rare {r.randrange(30)}", "", None, line])) if x is not None]
        data.append((i, "\n".join(mixed), "en", "s"))
    assert collected(op7_lines.dedup_lines(frame(spark, data, False))) == all_lines_brute(data)


def test_later_holders_of_lines_that_cross_at_home(spark):
    """More than a hundred holders: their home has the lines in the other order."""
    data = [(0, "B\nx 0\nA", "en", "s"), (1, "A\nx 1\nB", "en", "s"), (2, "y\nA\nB\nz", "en", "s"), (3, "A\nB\nw", "en", "s")]
    data += [(10 + i, f"p {i}\n{'AB'[i % 2]}\nq {i}", "en", "s") for i in range(260)]
    got = collected(op7_lines.dedup_lines(frame(spark, data, False)))
    assert got == all_lines_brute(data)
    assert [n for i, _, n, _ in got if i in (2, 3)] == [2, 2]


def test_line_of_many_holders(spark):
    data = [(i, f"first {i}\nheld by more than a hundred\nlast {i}", "en", "s") for i in range(105)]
    got = op7_lines.dedup_lines(frame(spark, data)).select("doc_id", "n_removed")
    assert collected(got) == [(i, int(i > 0)) for i in sorted(range(105), key=lambda i: repr((i,)))]


def test_lines_of_every_earlier_document(spark):
    r = random.Random(13)
    pool = [f"line {j}" for j in range(25)]
    data = [(i, "\n".join([*r.sample(pool, r.randrange(1, 9)), "", f"own {i}"]), "en", "s") for i in range(40)]
    data += [(50, "B\nA", "en", "s"), (51, "A\nB", "en", "s"), (52, "z\nA\nB", "en", "s"), (53, "A\nB", "en", "s")]
    data += [(100 + i, f"first {i}\nheld by more than a hundred\nlast {i}", "en", "s") for i in range(105)]
    data += [(300 + i, f"at {i}\nfrequent {i % 3}\nend {i}", "en", "s") for i in range(309)]
    data += [(700, "frequent 0\nfrequent 1\nfrequent 2", "en", "s"), (701, "frequent 0\n\nfrequent 1\nfrequent 2", "en", "s")]
    got = collected(op7_lines.dedup_lines(frame(spark, data)))
    assert got == all_lines_brute(data)
    found = {i: (n, k) for i, n, k, _ in got}
    assert [found[i][1] for i in range(100, 205)] == [0] + [1] * 104
    assert found[53] == (2, 2) and found[52] == (3, 2) and found[700] == (3, 3) and found[701] == (3, 3)


# --- 8: decontamination ------------------------------------------------------------------


def bench_words(text: str | None) -> list[str]:
    import re

    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def hits_brute(data: list[tuple], items: list[tuple]) -> list[tuple]:
    owners = collections.defaultdict(set)
    for item, t in items:
        w = bench_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            owners[tuple(w[k : k + n])].add(item)
    out = []
    for i, t, *_ in data:
        w = bench_words(t)
        hit, found = [False] * len(w), set()
        for n in range(1, 11):
            for k in range(len(w) - n + 1):
                g = tuple(w[k : k + n])
                if g in owners:
                    found |= owners[g]
                    hit[k : k + n] = [True] * n
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), any(hit)))
    return sorted(out, key=repr)


def bench_items(data: list[tuple]) -> list[tuple]:
    r = random.Random(9)
    items = [(1, None), (2, ""), (3, "..."), (4, "One, two"), (5, "zebra"), (6, "É one two w3 w4")]
    long = [t for _, t, *_ in data if len(bench_words(t)) > 40]
    for k in range(10, 22):
        w = bench_words(long[k])
        a = r.randrange(len(w) - 25)
        items.append((k, " ".join(w[a : a + r.randrange(10, 25)]).upper().replace("É", "é")))
    return items + [(30, items[-1][1]), (31, items[-1][1]), (10, items[6][1]), (None, items[7][1])]


def test_decontamination(spark):
    data = rows() + [(80, "a zebraÉ zebra,zebra", "en", "s"), (81, "İ ΑΣ ẞ one two", "en", "s")]
    bench = spark.createDataFrame(bench_items(data), "item_id long, text string").withColumn("window", F.lit("x"))
    found = op8_decontaminate.decontaminate(frame(spark, data), bench).drop("_key")
    assert collected(found) == hits_brute(data, bench_items(data))
    assert any(x[-1] for x in collected(found))


def test_contaminated_rows_go(spark):
    data = rows()
    bench = spark.createDataFrame(bench_items(data), "item_id long, text string")
    df = frame(spark, data)
    kept = op8_decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    clean = collections.Counter(x[0] for x in hits_brute(data, bench_items(data)) if not x[-1])
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == clean


def test_benchmark_words_at_the_edges(spark):
    texts = [None, "", " ", "\x00", ".a", "a.", "..A..b\n\n", "É\u00a0x y\u2028z", "\U0001F600 \U00010400b-0", "İΣẞ", "\x7f\x80\x7f", "[9`{z:/"]
    df = spark.createDataFrame([*enumerate(texts)], "i long, text string").select("i", op8_decontaminate.words_of("text").alias("w"))
    assert {r["i"]: r["w"] for r in df.collect()} == {i: bench_words(t) for i, t in enumerate(texts)}


def test_short_texts_with_a_gram_of_a_long_item(spark):
    items = [(1, "v w x y z"), (2, "a b c d e f"), *((i, "a b c d e " + " ".join(f"t{i + j}" for j in range(5))) for i in range(10, 60))]
    data = [(1, "a b c d e f"), (2, "a b c d e"), (3, "q a b c d e t10 t11 t12 t13 t14"), (4, "t10 t11 t12 t13 t14"), (5, "b c d e t10 t11"), (6, "A B c d e f, v w x y z")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert collected(op8_decontaminate.decontaminate(docs, bench).drop("_key")) == hits_brute(data, items)


def reads_of_texts(spark, items: list[tuple]) -> int:
    """How often a text is worked out for the hits in ``rows()`` and two more."""
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    data = rows() + [(80, "a zebra one two", "en", "s"), (81, "x y " + items[0][1], "en", "s")]
    df = frame(spark, data).withColumn("text", F.udf(counted, "string")("text"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert collected(op8_decontaminate.decontaminate(df, bench).drop("_key")) == hits_brute(data, items)
    return seen.value


def test_texts_are_read_as_often_for_items_of_all_lengths(spark):
    long = [(0, " ".join(f"q{i}" for i in range(12)))]
    short = [(n, " ".join(["one two three four five six seven eight nine".split()[i % 9] for i in range(n)])) for n in range(1, 10)]
    assert reads_of_texts(spark, long + short) == reads_of_texts(spark, long)


# --- empty tables ------------------------------------------------------------------------


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    assert op3_substrings.dedup_substrings(none).count() == 0
    assert op5_jaccard.jaccard_components(none).count() == 0
    assert op6_rules.quality_rules(none).count() == 0
    assert op7_lines.dedup_lines(none).count() == 0
    assert op8_decontaminate.decontaminate(none, items).count() == 0
    assert op8_decontaminate.decontaminate(frame(spark, rows()), items).where("contaminated").count() == 0
