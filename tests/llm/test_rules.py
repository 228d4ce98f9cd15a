import random
import re

import numpy as np
import pytest

from strandline.llm import rules, weak

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines, dup = [], 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.append(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


TEXTS = [None, "", " \n\n", "a", "a b c a b c", "a a a a", "x y\nx y\n x y\n\nx y", "é ü #*$%&|<>", "a\x0bb\x1cc", "w " * 60, "one two\r\none two\r\n"]


def test_measures_match_brute_force():
    rng = random.Random(8)
    for text in TEXTS + ["".join(rng.choice("ab é\n#") for _ in range(rng.randrange(120))) for _ in range(600)]:
        assert rules.measure((text or "").encode())[:5] == brute(text), text


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(40_000) < 0.7
    accuracy = np.array([0.95, 0.8, 0.7, 0.9, 0.6])
    votes = np.where(rng.random((40_000, 5)) < accuracy, 1, -1) * np.where(truth, 1, -1)[:, None]
    votes[rng.random(votes.shape) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak.fit_accuracies(patterns, counts.astype(float), prior=0.5)
    assert np.abs(model.accuracies() - accuracy).max() < 0.04
    assert abs(model.prior - 0.7) < 0.04
    guess = weak.posterior(model, votes) > 0.5
    majority = votes.sum(axis=1) > 0
    assert (guess == truth).mean() > (majority == truth).mean()


def test_judge(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["stone", "river", "house,", "market.", "winter", "of", "the"]) + "abcdefghijklmnop"[rng.randrange(16)] + rng.choice(["", "n", "r."]) for _ in range(150)) for _ in range(40)]
    junk = [" ".join("wo" + rng.choice("abcdefgh") + "###***" for _ in range(150)) for _ in range(6)]
    rows = list(enumerate([*good, *junk, *TEXTS])) + [(None, good[0]), (0, good[0])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, votes int")
    got = rules.judge(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, text in rows:
        if i is None:
            continue
        n = brute(text)
        assert tuple(by[i])[1:6] == n
        assert by[i].base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
    assert all(by[i].kept for i in range(40) if not by[i].base_failed)
    assert not any(by[i].kept for i in range(40, len(rows) - 2))


@pytest.mark.parametrize("schema", ["doc_id long, text string"])
def test_empty_table(spark, schema):
    assert rules.judge(spark.createDataFrame([], schema)).collect() == []
