"""Tables beyond the bound of a broadcast are not broadcast, however short their files are."""

import random

from pyspark.sql import functions as F

from rowcaster.llm import frames, op1_urls, op7_lines
from rowcaster.session import written

from .fixture import collected, frame, sentence
from .test_rows import all_lines_brute


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_strings_of_urls(spark, monkeypatch):
    r = random.Random(5)
    urls = [(f"http://h{r.randrange(9)}.example.{r.choice(['com', 'net'])}/{r.randrange(9999)}", 1 + i % 3, bool(i % 2)) for i in range(80)]
    df = spark.createDataFrame(urls, "url string, n long, allowed boolean").dropDuplicates(["url"])
    o, totals = op1_urls.ModelOptions(order=3), (700, 900)
    strings = written(op1_urls.count_strings(df, o), "url-strings")
    want = {r["url"]: r["ratio"] for r in op1_urls.score(df.select("url"), strings, o, totals).collect()}
    for bound in (0, 40):  # no string is frequent, or some are
        monkeypatch.setattr(op1_urls, "BROADCAST_STRINGS", bound)
        scored = op1_urls.score(df.select("url"), strings, o, totals)
        assert "SortMergeJoin" in plan(scored)
        got = {r["url"]: r["ratio"] for r in scored.collect()}
        assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-9 for u in got)
    monkeypatch.setattr(op1_urls, "BROADCAST_STRINGS", 0)
    rated = op1_urls.rate_strings(strings.select(F.col("s").alias("g")), strings, o, totals)
    assert "Broadcast" not in plan(rated)


def test_join_with_a_repeated_table(spark, monkeypatch):
    monkeypatch.setattr(frames, "BROADCAST_ROWS", 2)
    keys = [None, "a", "b", "c"]
    df = spark.createDataFrame([(i, keys[i % 4]) for i in range(40)], "i long, k string")
    small = written(spark.createDataFrame([(None, 1), ("a", 2), ("c", 3)], "k string, v long"), "small")
    out = frames.join_small(df, small, ["k"], "i")
    assert "Broadcast" not in plan(out)
    assert collected(out) == sorted([(i, keys[i % 4], {None: 1, "a": 2, "c": 3}.get(keys[i % 4])) for i in range(40)], key=repr)


def test_lines_of_many_copies_and_kinds(spark, monkeypatch):
    monkeypatch.setattr(frames, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(op7_lines, "RARE", 2)
    plans = []

    def spied(*args):
        out = frames.join_small(*args)
        plans.append(plan(out))
        return out

    monkeypatch.setattr(op7_lines, "join_small", spied)
    r = random.Random(4)
    texts = ["\n".join([*r.sample("ABCDE", r.randrange(1, 5)), f"own {i} {sentence(r, 2)}".replace("\n", " ")]) for i in range(40)]
    data = [(i, texts[i % 30], "en", "s") for i in range(60)]
    assert collected(op7_lines.dedup_lines(frame(spark, data, False))) == all_lines_brute(data)
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)


def test_lines_left_are_joined_without_a_broadcast(spark):
    held = spark.createDataFrame([(1, 5, [0, 2]), (1, 6, [1]), (2, 5, [3])], "uid long, a long, at array<int>")
    gone = written(spark.createDataFrame([(1, [1, 2])], "uid long, gone array<int>"), "gone")
    left = op7_lines._rest(held, gone)
    assert "Broadcast" not in plan(left)
    assert collected(left) == [(1, 5, [0]), (2, 5, [3])]
