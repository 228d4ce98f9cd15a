import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing


def water_fill(sizes, weights, share, cap):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out = share * sum(sizes.values()), {}
    while weight:
        level = left / sum(weight.values())
        over = [s for s in weight if level * weight[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * w for s, w in weight.items()}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            del weight[s]
    return out


def corpus(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "Z", "é", "\U0001f600", None, "tiny"]) if i > 3 else "tiny"
        words = 2 if source == "tiny" else rng.choice([0, 1, 5, 40, 400])
        rows.append((i, " ".join("w%d" % rng.randrange(50) for _ in range(words)), source))
    rows += [(None, "no id here", "a"), (1007, None, "b"), (1009, "same row", "b"), (1009, "same row", "b"), (1010, "\t\n ", "b")]
    return rows


@pytest.mark.parametrize("block", [mixing.BLOCK, 1, 7, 1024])
def test_mix(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "CELL", 16)
    rows = corpus(1)
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, taken int")
    got = mixing.mix(docs, block=block).join(docs.groupBy("doc_id").agg(F.first("source").alias("source")), "doc_id", "left").collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(mixing.WORD, text or ""))
    want = water_fill(sizes, mixing.WEIGHTS, 1.5, 2.0)
    taken = {}
    for r in got:
        source = "a" if r.doc_id is None else r.source
        assert r.source_size == sizes[source] and abs(r.target - want[source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    assert taken == {s: round(t) for s, t in want.items()}
    again = mixing.mix(docs.repartition(5), block=block).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.mix(docs, block=block).collect()))


def test_targets_match_water_filling(spark):
    rng = random.Random(3)
    for _ in range(6):
        sizes = {rng.choice("abcdefghij") + str(i): rng.choice([1, 10, 100, 1000, 5000]) for i in range(rng.randrange(1, 12))}
        sized = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.targets(sized).collect()}
        want = water_fill(sizes, mixing.WEIGHTS, 1.5, 2.0)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * want[s] + 1e-9 for s in got)


def test_schedule_is_even_everywhere(spark):
    sized = spark.createDataFrame([("a", 50_000), ("b", 30_000), ("c", 20_000)], "source string, size long")
    goal = mixing.targets(sized, cap=100.0)
    slots = sorted((r.slot, r.number, r.words) for r in mixing.schedule(goal, 10).collect())
    total = sum(w for *_, w in slots)
    shares = {r.number: r.target / total for r in goal.collect()}
    for cut in (500, 3000, 9000):
        for number, share in shares.items():
            part = sum(w for _, n, w in slots[:cut] if n == number)
            assert abs(part / (10 * cut) - share) < 0.01


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, " ", "x")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.taken) for r in mixing.mix(blank).collect()) == [(1, 0, 0), (2, 0, 0)]


def test_mixed_documents(spark):
    rows = corpus(4)
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    sizes, taken = {}, {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    for r in got.collect():
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
    want = water_fill(sizes, mixing.WEIGHTS, 1.5, 2.0)
    for source, target in want.items():
        assert abs(taken.get(source, 0) - target) <= 400
    assert mixing.mixed(docs.limit(0)).collect() == []
