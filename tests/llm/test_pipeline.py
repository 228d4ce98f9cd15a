import re

import corpus_pipeline
from strandline.llm import language, likeness, pii, simhash
from tests.conftest import SF


def brute_firsts(rows):
    """The smallest id of each group of texts, all pairs compared."""
    texts = [(i, t.encode()) for i, t in sorted(rows)]
    fps = [simhash.simhash(t) for _, t in texts]
    prints = [[int(p) for p in simhash.word_prints(t, simhash.SLOTS)] for _, t in texts]
    words = [re.findall(rb"[^\x20\x09-\x0D]+", t.lower()) for _, t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    apart = lambda a, b: (a ^ b).bit_count()
    root = list(range(len(texts)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i in range(len(texts)):
        for j in range(i):
            bits = apart(fps[i], fps[j])
            by_words = bits <= 13 and any(apart(a, b) <= 3 for a, b in zip(prints[i], prints[j]))
            if bits <= 3 or by_words or len(sets[i] & sets[j]) >= likeness.LIKE * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [texts[n][0] for n in range(len(texts)) if root[n] == n]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    known = stages["known_language"](spark, docs, SF).cache()
    judged = {r.doc_id: r for r in language.identify(docs).collect()}
    assert {r.doc_id for r in known.collect()} == {i for i, r in judged.items() if r.lang_pred != "und"}
    single = stages["near_duplicates"](spark, known, SF).cache()
    assert sorted(r.doc_id for r in single.collect()) == brute_firsts([(r.doc_id, r.text) for r in known.collect()])
    clean = stages["personal_data"](spark, single, SF).cache()
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        spans = pii.base_spans(before[r.doc_id])
        assert not pii.base_spans(r.text) and len(r.text) == r.n_chars
        assert sum(r.text.count(f"<{k.upper()}>") for k in pii.KINDS) >= bool(spans)
        if not spans and not pii.loose_spans(before[r.doc_id], []):
            assert r.text == before[r.doc_id]
    mix = stages["source_mix"](spark, clean, SF).cache()
    texts = {r.doc_id: r.text for r in clean.collect()}
    counts = {}
    for r in mix.collect():
        assert r.text == texts[r.doc_id]
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 2
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total, mixed = sum(map(words, texts.values())), sum(words(texts[i]) * n for i, n in counts.items())
    assert abs(mixed - 1.5 * total) < 0.1 * total
    packed = stages["packed"](spark, mix, SF).collect()
    assert sorted(r.doc_id for r in packed if r.piece == 0) == sorted(i for i, n in counts.items() for _ in range(n))
    for stage in (known, single, clean, mix):
        assert stage.columns == docs.columns


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
