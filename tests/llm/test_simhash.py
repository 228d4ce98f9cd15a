import itertools
import random
import re

import pytest
import xxhash

from pyspark.sql import functions as F

from strandline.llm import common, likeness, simhash
from strandline.session import checkpointed


def brute_fingerprint(text, width=3):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[find(i)] = find(j)
    least = {}
    for i, own in enumerate(ids):
        if own is not None:
            least[find(i)] = min(own, least.get(find(i), own))
    return [least.get(find(i)) for i in range(len(ids))]


def test_covering_masks_cover_every_triple():
    masks = simhash.covering(list(range(64)))
    assert len(masks) == 15
    for triple in itertools.combinations(range(64), 3):
        bits = sum(1 << p for p in triple)
        assert any(not m & bits for m in masks)


def test_last_level_leaves_few_bits():
    assert max(64 - f.bit_count() for _, f in simhash._refinements(2)) <= 8


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_fingerprint_matches_brute_force(monkeypatch, piece):
    monkeypatch.setattr(common, "PIECE", piece)
    for text in ["", " \n", "One", "one two", "a b c", "Äb C d é\x1ff g h", "x y " * 50, "a\tb\x0bc\x0cd\re f"]:
        assert simhash.simhash(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("bucket", [2048, 3])
def test_components_match_brute_force(spark, bucket):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    texts = [None, "", "  ", "solo", "solo", "two words"]
    for _ in range(40):
        changed = list(base)
        for _ in range(rng.randrange(3)):
            changed[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(changed))
    texts += [" ".join(rng.choice(words) for _ in range(60)) for _ in range(20)]
    ids = [3 * i + 7 for i in range(len(texts))]
    rows = list(zip(ids, texts)) + [(ids[8], texts[8]), (None, texts[9]), (None, "nobody else says this at all")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted(simhash.near_duplicates(docs, bucket=bucket).collect(), key=str)
    fps = [brute_fingerprint(t) for _, t in rows]
    comps = brute_components([i for i, _ in rows], fps)
    want = [(i, format(f, "016x"), c) for (i, _), f, c in zip(rows, fps, comps)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.keep_one(docs).collect() == []


def test_keep_one(spark):
    docs = spark.createDataFrame(
        [(2, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (5, "quite another text here"), (None, "words without id")],
        "doc_id long, text string",
    )
    assert sorted(map(str, (r.doc_id for r in simhash.keep_one(docs).collect()))) == ["1", "5", "None"]


def test_keep_one_keeps_a_row_for_each_text_of_a_repeated_id(spark):
    rows = [(1, "a b c d e", "y"), (1, "a b c d e", "x"), (1, "words that no other row holds", "x"), (None, "A b c d e", "x"), (None, "alone", "q"), (None, "alone", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __h string")
    kept = sorted(map(str, map(tuple, simhash.keep_one(docs).collect())))
    assert kept == sorted(map(str, [(1, "a b c d e", "x"), (1, "words that no other row holds", "x"), (None, "alone", "q")]))


def edited(rng, words, base, n):
    changed = list(base)
    for _ in range(n):
        changed[rng.randrange(len(changed))] = rng.choice(words)
    return changed


def test_word_prints_find_edited_copies_and_leave_others(spark):
    rng = random.Random(11)
    words = [f"c{rng.randrange(60)}" for _ in range(40_000)] + [f"w{rng.randrange(60_000)}" for _ in range(60_000)]
    rows, pairs = [], []
    for i in range(150):
        base = [rng.choice(words) for _ in range(rng.choice([120, 300, 800]))]
        copy = edited(rng, words, base, max(1, len(base) // 60))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        shingles = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (base, copy)]
        if len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1]) >= 0.8:
            pairs.append(i)
    shuffled = rows[0][1].split()
    rng.shuffle(shuffled)
    rows.append((1000, " ".join(shuffled)))  # the same words, another text
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert {2 * i for i in range(150)} | {1000} <= kept
    assert len(pairs) > 100 and sum(2 * i + 1 in kept for i in pairs) <= 0.05 * len(pairs)


@pytest.mark.parametrize("bucket", [2048, 32, 2])
def test_word_links_match_brute_force(spark, bucket):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(200)]
    texts = [" ".join(edited(rng, words, base, rng.randrange(12))) for _ in range(150)] + [" ".join(rng.choice(words) for _ in range(80)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = simhash.fingerprints(docs, slots=3)
    edges, wide = simhash.word_links(own.drop("id").distinct(), bucket=bucket)
    got = edges.collect()
    assert (wide is None) == (bucket > 1000)
    if wide is not None:
        labels = spark.createDataFrame([(f,) for f in {r.fp for r in own.collect()}], "fp long").selectExpr("fp", "fp as root")
        got += simhash.wide_links(wide, labels, limit=3).collect()
    fps = [simhash.simhash(t.encode()) for t in texts]
    prints = [simhash.word_prints(t.encode(), 3) for t in texts]
    apart = lambda a, b: (int(a) ^ int(b)).bit_count()
    linked = {(i, j) for i in range(len(texts)) for j in range(i) if apart(fps[i], fps[j]) <= simhash.NEAR and any(apart(a, b) <= 3 for a, b in zip(prints[i], prints[j]))}

    unsigned = lambda x: x % (1 << 64)
    assert components([(fps[i], fps[j]) for i, j in linked], set(fps)) == components([(unsigned(r.a), unsigned(r.b)) for r in got], set(fps))


@pytest.mark.parametrize("shape", ["block", "appended", "cut"])
def test_keep_one_finds_a_changed_passage(spark, shape):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(20_000)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([150, 400]))]
        n = len(base) // 10
        other = [rng.choice(words) for _ in range(n)]
        at = rng.randrange(len(base) - n)
        copy = {"block": base[:at] + other[: n * 3 // 5] + base[at + n * 3 // 5 :], "appended": base + other, "cut": base[:-n]}[shape]
        shingles = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (base, copy)]
        assert len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1]) >= 0.8
        half = base[: len(base) // 2] + [rng.choice(words) for _ in range(len(base) // 2)]  # far under the likeness
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(copy)), (3 * i + 2, " ".join(half))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {3 * i for i in range(60)} | {3 * i + 2 for i in range(60)} <= kept
    assert sum(3 * i + 1 in kept for i in range(60)) <= 1


def test_a_bucket_of_any_size_is_compared_as_a_whole(spark):
    # one print for all; fingerprints in two components, of which only the last ones are close to the first
    items = spark.range(9_000).selectExpr("if(id < 8990, id, (id - 8990) | 1048576) as fp", "cast(7 as long) as s0")
    edges, wide = simhash.word_links(items)
    assert wide.select("fp").distinct().count() == 9_000
    labels = items.selectExpr("fp", "struct(fp >= 1048576 as apart) as root")
    found = simhash.wide_links(wide, labels, near=1, limit=512).distinct().collect()
    assert {(r.a, r.b) for r in found} == {(i | 1 << 20, i) for i in range(10)}


def test_shingle_links_match_brute_force_in_one_large_bucket(spark):
    # copies of one text with 0 to 9 % of its words changed: most are below the likeness, and chains through others join some
    rng = random.Random(17)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    texts = [" ".join(edited(rng, words, base, rng.randrange(1, 14))) for _ in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.selectExpr("xxhash64(text) as h", "doc_id as id", "text")
    single = checkpointed(simhash.fingerprints(docs, keys=True).join(rows.drop("text"), "id"))
    rooted = single.select("fp", F.struct("fp").alias("root"))
    edges = [e.collect() for e in likeness.similar(single, rows, lambda: rooted, limit=1 << 14)]
    sets = [likeness.shingles_of(t.encode()) for t in texts]
    fps = [simhash._signed(simhash.simhash(t.encode())) for t in texts]
    brute = [(fps[i], fps[j]) for i in range(160) for j in range(i) if likeness.jaccard(sets[i], sets[j]) >= 0.8]
    got = [(r.a, r.b) for e in edges for r in e]
    assert len(edges[0]) > 20 and len(edges[1]) > 20
    assert set(map(frozenset, got)) <= set(map(frozenset, brute))
    assert components(got, fps) == components(brute, fps)


def components(edges, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        root[find(a)] = find(b)
    out = {}
    for n in root:
        out.setdefault(find(n), set()).add(n)
    return sorted(map(sorted, out.values()))
