import hashlib
import random

import numpy as np
import pytest

from strandline.llm import winnowing as W


def brute(text, k, window):
    points = np.array([ord(c) for c in text], np.uint32)
    if not len(points):
        return []
    k = min(k, len(points))
    hashes = [int(W._gram_hashes(points[i : i + k], k)[0]) >> 24 for i in range(len(points) - k + 1)]
    window = min(window, len(hashes))
    picked = []
    for i in range(len(hashes) - window + 1):
        span = hashes[i : i + window]
        low = min(span)
        place = max(j for j in range(window) if span[j] == low) + i
        if not picked or picked[-1] != (low, place):
            picked.append((low, place))
    return picked


@pytest.mark.parametrize("run", [1 << 20, 17])
@pytest.mark.parametrize("k,window", [(16, 64), (5, 4), (3, 7), (1, 1)])
def test_winnow_matches_brute_force(monkeypatch, run, k, window):
    monkeypatch.setattr(W, "RUN", run)
    rng = random.Random(k)
    for n in (0, 1, 4, 15, 16, 17, 78, 79, 80, 300):
        text = "".join(rng.choice("abé\U0001f600 ") for _ in range(n))
        hashes, positions = W.winnow(text, k, window)
        assert list(zip(hashes.tolist(), positions.tolist())) == brute(text, k, window)
    assert len(W.winnow("a" * 200, 5, 4)[0]) == 193  # rightmost of equal hashes


def test_shared_passage_is_found():
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = make(W.K + W.WINDOW - 1)
    a, b = make(500) + shared + make(300), make(100) + shared + make(700)
    assert np.intersect1d(W.winnow(a)[0], W.winnow(b)[0]).size


def expected(rows, marks):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, marks[r[1] or ""]))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(text) // 4
        changed = text[: len(text) - q] + after[:q]
        (own, places), (edit, _), (following, _) = (W.winnow(t) for t in (text, changed, after))
        near = W.likeness(own, edit), W.likeness(own, following)
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), W.digest(own), W.digest(edit), *near, places.tolist()))
    return sorted(map(str, out))


def marks_of(docs):
    return {r.t: r.m for r in docs.selectExpr("coalesce(text, '') as t", "xxhash64(coalesce(text, '')) as m").collect()}


@pytest.mark.parametrize("rows_per_block", [2, 5, 1000])
def test_compare_edited(spark, rows_per_block):
    rng = random.Random(9)
    rows = [(i * 7 % 101, "".join(rng.choice("abcdé \n") for _ in range(rng.randrange(400)))) for i in range(40)]
    rows += [(None, "no id"), (500, None), (501, ""), (502, "tie"), (502, "again a tie"), (502, "tie")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, place int").repartition(3)
    got = W.compare_edited(docs, rows_per_block=rows_per_block).collect()
    assert sorted(str(tuple(r)) for r in got) == expected(rows, marks_of(docs))


def test_an_id_that_repeats_is_split_into_blocks(spark):
    rng = random.Random(10)
    rows = [(i, f"text {i}") for i in range(30)] + [(7, f"other {rng.random()}") for _ in range(60)] + [(None, f"none {rng.random()}") for _ in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes = [r["count"] for r in W.with_next(docs, "doc_id", "text", 5).groupBy("block").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 20
    got = W.compare_edited(docs, rows_per_block=5).collect()
    assert sorted(str(tuple(r)) for r in got) == expected(rows, marks_of(docs))


def test_short_edited_texts_stay_alike():
    rng = random.Random(3)
    near = []
    for _ in range(200):
        a, b = ("".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(90, 160))) for _ in range(2))
        near.append(W.likeness(W.winnow(a)[0], W.winnow(W.edited(a, b))[0]))
    assert all(0 < x < 1 for x in near)


def test_single_and_empty(spark):
    one = spark.createDataFrame([(4, "abcdefgh" * 20)], "doc_id long, text string")
    assert [str(tuple(r)) for r in W.compare_edited(one).collect()] == expected([(4, "abcdefgh" * 20)], {"abcdefgh" * 20: 0})
    assert W.compare_edited(one.limit(0)).collect() == []
    assert len(W.fingerprints(one).first().hashes) > 0
