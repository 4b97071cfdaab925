"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import collections
import random
import re
import zlib

import pyarrow as pa
import pytest

from rowcaster.llm import op13_variants as op13

from .fixture import LOW, collected, frame, rows

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def result(df):
    return collected(df.select(COLUMNS))


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_brute(data):
    n = collections.Counter()
    for i, t, *_ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    partners = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)] for w in n}
    form = {}
    for w, found in partners.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(partners[w]), n.get(form[w])))
    return sorted(out, key=repr)


def edited(r: random.Random, word: str) -> str:
    at, kind = r.randrange(len(word)), r.randrange(3)
    letter = r.choice("abcdeéßÿÀ÷x")
    return word[:at] + (letter if kind else "") + word[at + (kind != 2) :]


def texts(seed=4):
    r = random.Random(seed)
    roots = ["".join(r.choice("abcdeé") for _ in range(r.randrange(6, 13))) for _ in range(25)]
    out = []
    for i in range(150):
        found = []
        for _ in range(60):
            w = roots[min(r.randrange(25), r.randrange(25))]
            for _ in range(r.choice([0] * 8 + [1, 1, 2])):
                w = edited(r, w)
            found.append(w.capitalize() if r.random() < 0.1 else w)
        out.append((i, r.choice([" ", "-", "\n", "1"]).join(found), "en", "s"))
    chain = ["kkkkkkkk"] * 300 + ["kkkkkkkb"] * 25 + ["kkkkkkcb"] * 2
    return [*out, (500, " ".join(chain), "en", "s")]


@pytest.mark.parametrize("cell,leaf,columns", [(160_000, 64, 2048), (200, 4, 2048), (200, 4, 5)])
def test_variants(spark, monkeypatch, cell, leaf, columns):
    monkeypatch.setattr(op13, "CELL_BYTES", cell)
    monkeypatch.setattr(op13, "LEAF", leaf)
    monkeypatch.setattr(op13, "COLUMNS", columns)
    want = variants_brute(texts())
    assert any(w[1] for w in want) and any(w[1] != w[2] and w[1] for w in want)
    assert result(op13.spelling_variants(frame(spark, texts(), False))) == want


def test_odd_rows(spark):
    long = "ab" * 20_000
    data = rows() + [(300, "Éclairage éclairage ÉCLAIRAGE eclairage eclairage straße1straße straßen straßen", "fr", "s")]
    data += [(301, f"{long} {long} {long}c {long}c", "en", "s"), (302, None, None, None), (303, "", None, None)]
    data += [data[-4], data[-4]]
    assert result(op13.spelling_variants(frame(spark, data))) == variants_brute(data)


def test_empty(spark):
    assert op13.spelling_variants(frame(spark, [])).collect() == []
    assert op13.spelling_variants(frame(spark, [(1, "short words only", "en", "s")])).collect() == []


def test_words_with_equal_counts(spark, monkeypatch):
    """Anagrams share their vector, so no cut parts them."""
    monkeypatch.setattr(op13, "CELL_BYTES", 500)
    monkeypatch.setattr(op13, "LEAF", 2)
    r = random.Random(8)
    found = ["".join(r.sample("aabbccd", 7)) + x for _ in range(300) for x in ("", "e")]
    data = [(i, " ".join(found), "en", "s") for i in range(2)]
    assert result(op13.spelling_variants(frame(spark, data, False))) == variants_brute(data)


def test_cells_hold_every_partner():
    r = random.Random(1)
    words = sorted({"".join(r.choice("abcd") for _ in range(8)) for _ in range(3000)})
    rows_ = op13.codes(pa.array([w.encode() for w in words]), 8)
    counts = op13.letter_counts(rows_)
    tree = op13.grown(counts, op13.np.arange(200), 8, iter(range(200)))
    own = op13.own_cells(tree, counts)
    x, cells = op13.met_cells(tree, counts, 1, 1)
    met = set(zip(x.tolist(), cells.tolist()))
    assert len(set(own.tolist())) > 8 and len(met) < 0.9 * len(words) * len(set(own.tolist()))
    for i in range(0, len(words), 10):
        for j in op13.np.flatnonzero((rows_ != rows_[i]).sum(axis=1) <= 1):
            assert (i, own[j]) in met
