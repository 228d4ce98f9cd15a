"""Language identification by a linear-chain conditional random field over words.

Every word gets emission scores from hashed character n-grams (those at its edges are
its affixes) and from a learned lexicon; learned transitions link neighbouring words.
Forward-backward gives each word's chance of each language, so that code-switched
text is labelled word by word; a document's language is the one with the largest
share of its words.  A text is one chain.  To move long chains through forward-backward
together, they are dealt into blocks of ``BLOCK`` words; products of a block's transfer
matrices carry the chances from block to block, so that the result is that of the whole chain.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import crc_mod4, release, sliced

#: Words of a block of a chain (bears on the speed only).
BLOCK = 128
#: Hashed n-gram slots; n-grams of one to three characters, word edges included.
SLOTS, GRAMS = 1 << 16, 3
#: Bounds of the training sample: documents for each language and in all, characters of one, words in all.
DOCS_PER_LANGUAGE, MAX_DOCS, MAX_CHARS, MAX_WORDS = 400, 8_000, 20_000, 400_000
#: Bytes of text labelled at a time.
CHUNK = 2 << 20
#: Words whose features are made, and counts of words in documents that are held, at a time in training.
PART, COUNTED = 5_000, 1 << 18
UNKNOWN = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FIRST, _LAST = 2, 3


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _scramble(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(33))) * _MIX
    return keys ^ (keys >> np.uint64(29))


@dataclass
class Words:
    """Features of different words: n-gram slots in flat form, a hash and whether a word has a letter."""

    slots: np.ndarray
    starts: np.ndarray
    keys: np.ndarray
    letter: np.ndarray


def word_features(words: list[str]) -> Words:
    """Features of ``words`` (none of them empty), all at once."""
    joined = "".join(f"\x02{w}\x03" for w in words).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.nonzero(points == _FIRST)[0]
    if len(first) != len(words):  # a word holds a mark itself
        words = [w.replace("\x02", "?").replace("\x03", "?") for w in words]
        return word_features(words)
    own = np.cumsum(points == _FIRST) - 1
    slots, owners = [], []
    key = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, GRAMS + 1):
            size = len(points) - n + 1
            if size <= 0:
                break
            key = key[:size] * np.uint64(1_000_003) + points[n - 1 :]
            inside = own[:size] == own[n - 1 :]
            if n == 1:
                inside &= (points != _FIRST) & (points != _LAST)
            slots.append((_scramble(key[inside] + np.uint64(n) * _MIX) >> np.uint64(48)).astype(np.int32))
            owners.append(own[:size][inside])
        place = np.arange(len(points)) - first[own]
        powers = _scramble(place.astype(np.uint64) + np.uint64(77)) | np.uint64(1)
        keys = _scramble(np.add.reduceat(points * powers, first)) if len(first) else np.zeros(0, np.uint64)
    slot, owner = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])
    letter = np.logical_or.reduceat(_letters()[points.astype(np.int64)], first) if len(first) else np.zeros(0, bool)
    return Words(slot[order], starts, keys, letter)


def _features(words: list[str], part: int = PART) -> Words:
    """As ``word_features``, for a part of the words at a time: their n-grams take far more room than what stays of them."""
    parts = [word_features(words[at : at + part]) for at in range(0, len(words), part)]
    starts = np.cumsum(np.concatenate([[0], *(np.diff(p.starts) for p in parts)]))
    return Words(np.concatenate([p.slots for p in parts]), starts, np.concatenate([p.keys for p in parts]), np.concatenate([p.letter for p in parts]))


@dataclass
class Field:
    """A fitted field: languages, n-gram and lexicon weights, transitions."""

    languages: list[str]
    grams: np.ndarray
    lexicon_keys: np.ndarray
    lexicon_language: np.ndarray
    lexicon: np.ndarray
    transitions: np.ndarray

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Lexicon entry of each word: a language, or one past the last for none."""
        none = len(self.languages)
        if not len(self.lexicon_keys):
            return np.full(len(keys), none)
        at = np.minimum(np.searchsorted(self.lexicon_keys, keys), len(self.lexicon_keys) - 1)
        return np.where(self.lexicon_keys[at] == keys, self.lexicon_language[at], none)

    def emissions(self, words: Words) -> np.ndarray:
        counts = np.diff(words.starts)
        scores = np.add.reduceat(self.grams[words.slots], words.starts[:-1], axis=0) if len(counts) else np.zeros((0, len(self.languages)))
        scores = scores / np.sqrt(np.maximum(counts, 1))[:, None] + self.lexicon[self.lookup(words.keys)]
        return np.where(words.letter[:, None], scores, 0)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals, expected transition counts) of chains laid end to end in ``scores``."""
    chains, labels = len(lengths), scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    longest = int(sizes[0]) if chains else 0
    live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest)]  # chains longer than t come first
    potential = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    step = np.exp(transitions - transitions.max())
    alpha = np.empty_like(potential)
    beta = np.empty_like(potential)
    before = None
    for t in range(longest):
        rows = begins[: live[t]] + t
        now = potential[rows] if t == 0 else (before[: live[t]] @ step) * potential[rows]
        before = now / now.sum(axis=1, keepdims=True)
        alpha[rows] = before
    counts = np.zeros((labels, labels))
    for t in range(longest - 1, -1, -1):
        rows = begins[: live[t]] + t
        beta[rows] = 1.0 / labels
        more = live[t + 1] if t + 1 < longest else 0
        if more:
            ahead = potential[rows[:more] + 1] * beta[rows[:more] + 1]
            back = ahead @ step.T
            pair = alpha[rows[:more], :, None] * step[None] * ahead[:, None, :]
            counts += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            beta[rows[:more]] = back / back.sum(axis=1, keepdims=True)
    marginal = alpha * beta
    return marginal / np.maximum(marginal.sum(axis=1, keepdims=True), 1e-300), counts


def _live(sizes: np.ndarray) -> list[int]:
    """How many of the chains, longest first, have a word at each place."""
    return [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]) if len(sizes) else 0)]


def _joints(potential: np.ndarray, lengths: np.ndarray, counts: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands before and behind each block: the factors of its first word's and its last word's chances.

    ``lengths`` are the words of the blocks, ``counts`` the blocks of each chain, in order.
    """
    k = potential.shape[1]
    before, behind = np.ones((2, len(lengths), k), np.float32)
    first = np.cumsum(counts) - counts
    many = np.repeat(counts > 1, counts)
    if not many.any():
        return before, behind
    blocks = np.nonzero(many)[0]
    blocks = blocks[np.argsort(-lengths[blocks], kind="stable")]
    begins = (np.cumsum(lengths) - lengths)[blocks]
    opening = np.isin(blocks, first)[:, None, None]
    product = np.tile(np.eye(k, dtype=np.float32), (len(blocks), 1, 1))
    for t, n in enumerate(_live(lengths[blocks])):
        moved = product[:n] @ step
        if t == 0:  # a chain's first word follows nothing
            moved = np.where(opening, product, moved)
        moved = moved * potential[begins[:n] + t][:, None, :]
        product[:n] = moved / moved.sum(axis=(1, 2), keepdims=True)
    transfer = np.zeros((len(lengths), k, k), np.float32)
    transfer[blocks] = product
    order = np.argsort(-counts, kind="stable")
    first, counts = first[order], counts[order]
    live = _live(counts)
    end = np.ones((len(counts), k), np.float32)
    for j, n in enumerate(live[:-1]):
        end = np.einsum("ci,cij->cj", end[:n], transfer[first[:n] + j])[: live[j + 1]]
        end = end / end.sum(axis=1, keepdims=True)
        before[first[: live[j + 1]] + j + 1] = end @ step
    for j in range(len(live) - 1, 0, -1):
        rows = first[: live[j]] + j
        back = np.einsum("cij,cj->ci", transfer[rows], behind[rows])
        behind[rows - 1] = back / back.sum(axis=1, keepdims=True)
    return before, behind


def marginals(scores: np.ndarray, words: np.ndarray, transitions: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Chance of each language for every word of chains of so many ``words``; as ``forward_backward``, without the counts."""
    potential = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32)
    step = np.exp(transitions - transitions.max()).astype(np.float32)
    words = words[words > 0]
    counts = -(-words // block)
    lengths = np.full(int(counts.sum()), block)
    lengths[np.cumsum(counts) - 1] = words - (counts - 1) * block
    prior, behind = _joints(potential, lengths, counts, step)
    order = np.argsort(-lengths, kind="stable")
    begins, live = (np.cumsum(lengths) - lengths)[order], _live(lengths[order])
    prior, behind = prior[order], behind[order]
    alpha = np.empty_like(potential)
    before = None
    for t, n in enumerate(live):
        rows = begins[:n] + t
        now = (prior if t == 0 else before[:n] @ step) * potential[rows]
        before = now / now.sum(axis=1, keepdims=True)
        alpha[rows] = before
    beta = np.ones((0, scores.shape[1]), np.float32)
    for t in range(len(live) - 1, -1, -1):
        rows = begins[: live[t]] + t
        now = behind[: live[t]].copy()
        if len(beta):
            more = len(beta)
            back = (potential[rows[:more] + 1] * beta) @ step.T
            now[:more] = back / back.sum(axis=1, keepdims=True)
        beta = now
        alpha[rows] *= beta
    return alpha / np.maximum(alpha.sum(axis=1, keepdims=True), 1e-30)


def _counted(codes: np.ndarray, counts: np.ndarray, more: array) -> tuple[np.ndarray, np.ndarray]:
    """Different ``codes`` and their ``counts``, after each of ``more`` is counted too."""
    unique, where = np.unique(np.concatenate([codes, np.frombuffer(more, np.int64)]), return_inverse=True)
    return unique, np.bincount(where, np.concatenate([counts, np.ones(len(more))]), len(unique))


def _chain(parts: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(words, labels) of stretches ``(language, words)`` end to end."""
    return np.concatenate([words for _, words in parts]), np.repeat([i for i, _ in parts], [len(words) for _, words in parts])


def fit(texts: list[str], langs: list[str], epochs: int = 6, rate: float = 0.3, seed: int = 11, length: int = 64) -> Field:
    """A field fitted to documents of known language.

    Documents are cut into stretches of 5 to 40 words; half of the training chains
    are runs of one document and half join stretches of several languages, so that
    transitions are learned too.  Adagrad on the exact gradient of the chains'
    likelihood.  Deterministic for a given order of documents.  The driver has little
    room: words are held as numbers, and counted in arrays.
    """
    languages = sorted(set(langs))
    index = {name: i for i, name in enumerate(languages)}
    k = len(languages)
    rng = np.random.default_rng(seed)
    stretches: list[list[np.ndarray]] = [[] for _ in languages]
    quota = MAX_WORDS // max(1, k)
    taken = [0] * k
    number: dict[str, int] = {}
    # how many documents of a language hold a word, by the word's place among the folded ones and the language
    folded: dict[str, int] = {}
    codes, found, fresh = np.zeros(0, np.int64), np.zeros(0), array("q")
    for text, name in zip(texts, langs, strict=True):
        words, i = text.split(), index[name]
        fresh.extend(folded.setdefault(w.lower(), len(folded)) * k + i for w in set(words))
        if len(fresh) > COUNTED:
            codes, found = _counted(codes, found, fresh)
            fresh = array("q")
        at = 0
        while at < len(words) and taken[i] < quota:
            size = int(rng.integers(5, 41))
            stretches[i].append(np.array([number.setdefault(w, len(number)) for w in words[at : at + size]], np.int32))
            taken[i] += len(words[at : at + size])
            at += size
    codes, found = _counted(codes, found, fresh)
    chains: list[tuple[np.ndarray, np.ndarray]] = []
    mixed: list[tuple[int, np.ndarray]] = []
    for i, own in enumerate(stretches):
        for j, words in enumerate(own):
            if j % 2:
                mixed.append((i, words))
            elif j + 2 < len(own) and j % 4 == 0:
                words, labels = _chain([(i, words), (i, own[j + 2])])
                chains.append((words[:length], labels[:length]))
    place = rng.permutation(len(mixed))
    now: list[tuple[int, np.ndarray]] = []
    for at in place:
        now.append(mixed[at])
        if sum(len(words) for _, words in now) >= length:
            chains.append(_chain(now))
            now = []
    if now:
        chains.append(_chain(now))
    # a lexicon of words in two documents or more, nine tenths of them in one language
    row = codes // max(1, k)
    total = np.bincount(row, found, len(folded))[row]
    sure, names = (total >= 2) & (found >= 0.9 * total), list(folded)
    entries = [names[r] for r in row[sure]]
    keys = _features(entries).keys if entries else np.zeros(0, np.uint64)
    del folded, names, entries
    sort = np.argsort(keys, kind="stable")
    field = Field(
        languages, np.zeros((SLOTS, k), np.float32), keys[sort], (codes[sure] % max(1, k))[sort], np.zeros((k + 1, k), np.float32), np.zeros((k, k))
    )
    if k < 2 or not chains:
        return field
    names = list(number)
    used = sorted(np.unique(np.concatenate([words for words, _ in chains])).tolist(), key=names.__getitem__)
    renumbered = np.zeros(len(names), np.int64)
    renumbered[used] = np.arange(len(used))
    known = _features([names[u] for u in used])
    del names, number
    entry, counts = field.lookup(known.keys), np.diff(known.starts)
    scale = (1 / np.sqrt(np.maximum(counts, 1))).astype(np.float32)
    ids = [renumbered[words] for words, _ in chains]
    gold = [labels for _, labels in chains]
    memory = [np.full_like(a, 1e-6) for a in (field.grams, field.lexicon, field.transitions)]
    for _ in range(epochs):
        shuffled = rng.permutation(len(chains))
        for begin in range(0, len(shuffled), 128):
            batch = shuffled[begin : begin + 128]
            word = np.concatenate([ids[i] for i in batch])
            label = np.concatenate([gold[i] for i in batch])
            lengths = np.array([len(ids[i]) for i in batch])
            unique, where = np.unique(word, return_inverse=True)
            n = counts[unique]
            flat = np.repeat(known.starts[unique] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            slots = known.slots[flat]
            letter = known.letter[unique][:, None]
            scores = np.add.reduceat(field.grams[slots], np.cumsum(n) - n, axis=0) * scale[unique][:, None] + field.lexicon[entry[unique]]
            marginal, expected = forward_backward(np.where(letter, scores, 0)[where], lengths, field.transitions)
            error = -marginal
            error[np.arange(len(label)), label] += 1
            per_word = np.stack([np.bincount(where, error[:, c], len(unique)) for c in range(k)], axis=1) * letter / len(batch)
            g_lexicon = np.zeros_like(field.lexicon)
            np.add.at(g_lexicon, entry[unique], per_word)
            spread = np.repeat(per_word * scale[unique][:, None], n, axis=0)
            g_grams = np.stack([np.bincount(slots, spread[:, c], SLOTS) for c in range(k)], axis=1)
            last = np.zeros(len(label), bool)
            last[np.cumsum(lengths) - 1] = True
            seen = np.zeros((k, k))
            pair = np.nonzero(~last)[0]
            np.add.at(seen, (label[pair], label[pair + 1]), 1)
            g_transitions = (seen - expected) / len(batch)
            for weights, gradient, store in zip((field.grams, field.lexicon, field.transitions), (g_grams, g_lexicon, g_transitions), memory, strict=True):
                store += gradient**2
                weights += (rate * gradient / np.sqrt(store)).astype(weights.dtype)
    return field


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = DOCS_PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """Texts and languages of about ``per_language`` documents of each language, fewer where that makes over MAX_DOCS.

    Only documents whose crc32 of the id modulo 4 is not 2, with a language; which ones
    follows from a hash of the id.  Of a text of over MAX_CHARS characters a stretch of
    so many teaches, from a place that follows from the hash too.
    """
    fit_for = docs.where((crc_mod4(F.col(id_col)) != 2) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    counts = {r["lang"]: r["count"] for r in fit_for.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return [], []
    per_language = min(per_language, max(1, MAX_DOCS // len(counts)))
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, min(1.0, per_language / n)).otherwise(share)
    place = F.pmod(F.xxhash64(F.col("id"), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    spare = F.length("text") - MAX_CHARS
    stretch = F.substring(F.col("text"), 1 + F.pmod(F.xxhash64(F.col("id"), F.lit(19)), spare + 1).cast("int"), F.lit(MAX_CHARS))
    whole_words = F.regexp_replace(stretch, r"^\S+\s|\s\S+$", "")
    rows = (
        fit_for.where(place < share)
        .select("id", F.when(spare > 0, whole_words).otherwise(F.col("text")).alias("text"), "lang")
        .orderBy(F.xxhash64(F.col("id"), F.lit(17)), "id", F.xxhash64("text"))
        .limit(2 * per_language * len(counts) + 1000)
        .collect()
    )
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def fitted(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> Field:
    """A field fitted to ``training_sample``; the room that it took goes back to the system, not to the driver's later stages."""
    field = fit(*training_sample(docs, id_col, text_col, lang_col))
    release()
    return field


class Labeler:
    """Labels batches of texts; remembers the emissions of words it has met."""

    def __init__(self, field: Field) -> None:
        self.field = field

    def shares(self, texts: pa.Array) -> np.ndarray:
        """For each text the summed chances of each language over its words with a letter, and of each word's likeliest one."""
        marginal, letter, begins = self.words(texts)
        marginal = np.hstack([marginal, marginal.max(axis=1, keepdims=True, initial=0)]) * letter[:, None]
        sums = np.concatenate([np.zeros((1, marginal.shape[1])), np.cumsum(marginal, axis=0, dtype=np.float64)])
        return sums[begins[1:]] - sums[begins[:-1]]

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chances by word, whether the word has a letter, where each text's words begin)."""
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten()
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        begins = np.concatenate([[0], np.cumsum(filled)])[offsets]
        coded = flat.filter(pa.array(filled)).dictionary_encode()
        vocabulary = coded.dictionary.to_pylist()
        labels = len(self.field.languages)
        if not vocabulary:
            return np.zeros((0, labels), np.float32), np.zeros(0, bool), begins
        scores, letter = [], []
        for at in range(0, len(vocabulary), 20_000):
            known = word_features(vocabulary[at : at + 20_000])
            scores.append(self.field.emissions(known).astype(np.float32))
            letter.append(known.letter)
        place = coded.indices.to_numpy()
        return marginals(np.concatenate(scores)[place], np.diff(begins), self.field.transitions), np.concatenate(letter)[place], begins


def predict_batch(labeler: Labeler, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language of each text, its share, and how sure the words' labels are on average; UNKNOWN and 0 where there is no letter.

    Of languages with equal shares the first by name is taken.
    """
    if not labeler.field.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    shares = labeler.shares(pc.fill_null(texts, ""))
    shares, sure = shares[:, :-1], shares[:, -1]
    total, best = shares.sum(axis=1), shares.argmax(axis=1)
    names = [labeler.field.languages[b] if t > 0 else UNKNOWN for b, t in zip(best, total, strict=True)]
    part = lambda x: np.clip(np.where(total > 0, x / np.maximum(total, 1e-30), 0), 0, 1)
    return names, part(shares.max(axis=1)), part(sure)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", field: Field | None = None
) -> DataFrame:
    """``(id_col, held_out, lang_pred, score)``, one row for each row of ``docs``.

    Without ``field``, one is fitted to ``training_sample``.  Texts that are null or
    have no letter are ``und`` with score 0, as is every text where nothing could be
    learned.  Ids may be null or repeat; an empty table gives an empty result; other
    columns are not read, and the language column only in training.
    """
    field = field or fitted(docs, id_col, text_col, lang_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeler = Labeler(field)
        for batch in sliced(batches, "text", CHUNK):
            names, scores, _ = predict_batch(labeler, batch.column(1))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), (crc_mod4(F.col("id")) == 2).alias("held_out"), "lang_pred", "score")


def switches(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, first_word, n_words, lang)``: runs of words of one language in each text.

    Null texts and texts without a word give no row; ids may be null or repeat; an empty
    table gives an empty result; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeler = Labeler(field)
        for batch in sliced(batches, "text", CHUNK):
            rows: list[tuple] = []
            chance, _, begins = labeler.words(pc.fill_null(batch.column(1), ""))
            best = chance.argmax(axis=1)
            for i, (a, b) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
                if b > a:
                    cut = np.concatenate([[0], np.nonzero(np.diff(best[a:b]))[0] + 1, [b - a]])
                    rows += [(i, int(s), int(e - s), field.languages[best[a + s]]) for s, e in zip(cut[:-1], cut[1:], strict=True)]
            if rows:
                place, first, size, names = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict(
                    {"id": batch.column(0).take(pa.array(place)), "first_word": pa.array(first, pa.int64()), "n_words": pa.array(size, pa.int64()), "lang": pa.array(names)}
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, first_word long, n_words long, lang string").withColumnRenamed("id", id_col)


def keep_known(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_sure: float = 0.5, field: Field | None = None
) -> DataFrame:
    """The rows of ``docs`` whose words' likeliest languages have a chance of at least ``min_sure`` on average; columns as they are.

    Text in several languages stays if its words are told apart.  Null and empty texts and
    texts without a letter go, as does every row where no language could be learned; ids may be
    null or repeat; an empty table gives an empty one; other columns are handed on.
    """
    field = field or fitted(docs, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeler = Labeler(field)
        for batch in sliced(batches, text_col, CHUNK):
            names, _, sure = predict_batch(labeler, batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array([n != UNKNOWN and s >= min_sure for n, s in zip(names, sure.tolist(), strict=True)]))

    return docs.mapInArrow(run, docs.schema)
