"""A small table of documents with the odd cases, and brute-force helpers."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sentence(r: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{r.randrange(vocabulary)}" + r.choice(["", "", "", ",", ".\n", "É"]) for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    passage, out = sentence(r, 40), []
    for i in range(40):
        text = sentence(r, r.randrange(25, 90))
        if i % 5 == 0:
            text = f"{text}\n{passage}\n{sentence(r, 12)}"
        out.append([i, text, "en" if i % 3 else "de", f"s{i % 4}"])
    for i in range(40, 60):  # near copies of two documents, one of them much copied
        tokens = words(out[7 if i % 4 else 8][1])
        for _ in range(r.randrange(3)):
            tokens[r.randrange(len(tokens))] = "Other"
        out.append([i, " ".join(tokens), "en", "s1"])
    out += [[60, out[3][1], "en", "s0"], [61, out[3][1], "en", "s2"]]  # exact copies
    out += [[62, None, "en", "s0"], [63, "", "en", None], [64, " \n\t ", None, "s1"], [65, "one two", "en", "s1"], [66, "one TWO", "en", "s1"]]
    out += [[67, "again " * 300, "en", "s2"], [68, sentence(r, 6000, 5000), "en", "s3"], [69, "x" * 30_000, "en", "s3"], [70, None, None, None]]
    out += [[None, out[5][1], "en", "s0"], [None, "no id at all " + sentence(r, 30), "fr", None]]
    out += [out[9], out[9]]  # repeated rows
    r.shuffle(out)
    return [tuple(x) for x in out]


CLASH = ["uid", "row", "size", "_h", "key", "rank", "block", "kept", "_key", "n", "label", "draws", "ids", "url", "ratio"]


def frame(spark, data: list[tuple], clash: bool = True):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(c) for c in CLASH}) if clash else df


def collected(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
