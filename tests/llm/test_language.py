import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from strandline.llm import language as L
from tests.conftest import SF


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 4, 3, 4])
    scores, trans = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
    marginal, counts = L.forward_backward(scores, lengths, trans)
    fast = L.marginals(scores, lengths, trans)
    dealt = [L.marginals(scores, lengths, trans, block=b) for b in (1, 2, 3)]
    want, pairs, at = np.zeros_like(scores), np.zeros((3, 3)), 0
    for n in lengths:
        weights = {p: np.exp(sum(scores[at + i, c] for i, c in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))) for p in itertools.product(range(3), repeat=int(n))}
        z = sum(weights.values())
        for p, w in weights.items():
            for i, c in enumerate(p):
                want[at + i, c] += w / z
            for a, b in zip(p, p[1:]):
                pairs[a, b] += w / z
        at += n
    assert np.allclose(marginal, want) and np.allclose(counts, pairs) and np.allclose(fast, want, atol=1e-5)
    assert all(np.allclose(d, want, atol=1e-5) for d in dealt)


def test_blocks_give_the_chances_of_whole_chains():
    rng = np.random.default_rng(3)
    lengths = np.array([5, 1000, 128, 129, 1, 640, 0, 257])
    for spread in (1, 8):  # also with transitions that carry far
        scores, trans = rng.normal(size=(lengths.sum(), 4)) * 0.3, np.eye(4) * spread
        scores[rng.random(len(scores)) < 0.5] = 0
        want, _ = L.forward_backward(scores, lengths[lengths > 0], trans)
        assert np.allclose(L.marginals(scores, lengths, trans), want, atol=2e-4)


def words(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_code_switched_text_is_labelled_by_word():
    rng = random.Random(1)
    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["thr", "str", "onk"], "cc": ["éü", "ñá", "ço"]}
    texts, langs = zip(*[(words(rng, s, 60), n) for _ in range(30) for n, s in kinds.items()])
    field = L.fit(list(texts), list(langs))
    labeler = L.Labeler(field)
    mixed = words(rng, kinds["aa"], 12) + " " + words(rng, kinds["bb"], 12)
    chance, letter, begins = labeler.words(pa.array([mixed, "", "12 34", " x"]))
    assert letter[:24].all() and not letter[24:26].any() and begins.tolist() == [0, 24, 24, 26, 27]
    assert [field.languages[i] for i in chance[:24].argmax(axis=1)] == ["aa"] * 12 + ["bb"] * 12
    names, scores, sure = L.predict_batch(labeler, pa.array([texts[1], None, "", "42 !?", mixed]))
    assert names[:4] == [langs[1], "und", "und", "und"] and scores[0] > 0.9 and 0.3 < scores[4] < 0.7 and sure[4] > 0.9
    # equal shares: the first language by name
    flat = L.Field(["aa", "bb"], np.zeros((L.SLOTS, 2), np.float32), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((3, 2), np.float32), np.zeros((2, 2)))
    assert L.predict_batch(L.Labeler(flat), pa.array(["some words"]))[0] == ["aa"]


def test_long_texts_teach_and_mixed_texts_stay(spark):
    rng = random.Random(4)
    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["thr", "str", "onk"], "cc": ["éü", "ñá", "ço"]}
    rows = [(i, words(rng, kinds[n], 9000 if n == "bb" else 60), n) for i, n in enumerate(["aa", "bb", "cc"] * 20)]
    mixed = " ".join(words(rng, kinds[n], 20) for n in kinds)
    docs = spark.createDataFrame([*rows, (500, mixed, None), (501, "12 34", None)], "doc_id long, text string, lang string")
    texts, langs = L.training_sample(docs, "doc_id", "text", "lang")
    assert set(langs) == set(kinds) and max(map(len, texts)) <= L.MAX_CHARS
    assert {r.doc_id for r in L.keep_known(docs).select("doc_id").collect()} == {*range(60), 500}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    got = L.identify(docs).join(docs, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and (held.lang_pred == held.lang).mean() > 0.97


def test_edges(spark):
    docs = spark.createDataFrame([(1, "der die und", "de", 1.0), (2, None, "de", 1.0), (None, "...", None, 1.0), (1, "der die und", "de", 1.0)], "doc_id long, text string, lang string, score double")
    got = L.identify(docs).collect()
    assert sorted(r.lang_pred for r in got) in (["de", "de", "und", "und"], ["und"] * 4)
    assert L.identify(docs.limit(0)).collect() == []
    assert L.keep_known(docs).columns == docs.columns
    runs = L.switches(docs, L.fit(["der die und", "the of and"], ["de", "en"])).collect()
    assert sum(r.n_words for r in runs) == 7


def test_training_takes_little_room_and_counts_the_same():
    rng = random.Random(5)
    texts, langs = [], []
    for i in range(400):
        own = "abcd"[i % 4]
        words = [f"{own}{rng.randrange(9000)}x" if rng.random() < 0.8 else f"Z{rng.randrange(3000)}" for _ in range(300)]
        texts.append(" ".join(words))
        langs.append(f"l{own}")
    docs_with = {}
    for text, name in zip(texts, langs):
        for w in {w for w in text.split()}:
            docs_with.setdefault(w.lower(), []).append(name)
    want = {w: max(set(n), key=n.count) for w, n in docs_with.items() if len(n) >= 2 and max(map(n.count, n)) >= 0.9 * len(n)}
    tracemalloc.start()
    field = L.fit(texts, langs, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    keys = L.word_features(list(want)).keys
    assert len(field.lexicon_keys) == len(want)
    assert [field.languages[i] for i in field.lookup(keys)] == list(want.values())
    assert peak < 40e6, peak
    few = L.word_features(["straße", "a\x02b", "x", "Ωmega"] * 3)
    parts = L._features(["straße", "a\x02b", "x", "Ωmega"] * 3, part=5)
    assert all(np.array_equal(getattr(few, n), getattr(parts, n)) for n in ("slots", "starts", "keys", "letter"))
