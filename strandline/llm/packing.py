"""Best-two-fit packing of tokenised documents into sequences of equal capacity.

A document longer than the capacity is cut into full pieces and a rest; every other
document stays whole.  Pieces are dealt into blocks of about ``BLOCK`` pieces, and
each block is packed by itself: a bin starts with the largest piece left and takes
the largest that fits, until none does; then its smallest piece is given back if two
unpacked pieces fill the widened gap more tightly.  A block leaves at most one bin
poorly filled, so splitting costs under one sequence in some ten thousand, and no
task ever holds more than a block.  Texts are tokenised once; only the narrow table
of pieces is shuffled.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext
from tokenizers import Tokenizer

from strandline.llm.common import sliced
from strandline.session import checkpointed

CAPACITY = 2048
#: Pieces packed together, on average.
BLOCK = 32768
#: Word parts whose ids a worker remembers.
REMEMBERED = 250_000
#: Bytes of text encoded at a time.
SLICE = 2 << 20

_ASCII_LETTERS = frozenset(string.ascii_letters)

PIECES = "piece int, start long, length long, ids_crc32 long, salt long"


class WordTokenizer:
    """Token ids of texts whose tokenizer never joins what white space separates.

    That holds where the tokenizer drops white space before it splits, folds case
    and splits letters from signs, as ``word_bpe_49k.json`` does.  A word is encoded
    as its letters and a closing sign; each different part is encoded once.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, int] = {"": 0}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(2, np.int64)

    @staticmethod
    def parts(words: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
        """The words in lower case without a closing sign that follows a letter, and that sign or nothing.

        What holds "<|" may be a special token, which is matched before case is folded, and stays as it is.
        """
        special = pc.match_substring(words, "<|")
        plain = pc.and_(pc.string_is_ascii(words), pc.invert(special))
        folded = pc.if_else(plain, pc.ascii_lower(words), words)
        closed = pc.and_(pc.match_substring_regex(folded, r"[A-Za-z][.,;:!?]\z"), pc.invert(special))
        bare = pc.if_else(closed, pc.utf8_slice_codeunits(folded, 0, -1), folded)
        signs = pc.if_else(closed, pc.utf8_slice_codeunits(folded, -1), "")
        return bare.dictionary_encode(), signs.dictionary_encode()

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each word.  Words of letters go in rows: the tokens that end a word part them again."""
        flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 8192):  # an encoding holds much more than its ids
            part = words[at : at + 8192]
            if all(map(str.isalpha, part)):
                rows = [" ".join(part[i : i + 512]) for i in range(0, len(part), 512)]
                found = self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)
                ids = np.array([i for e in found for i in e.ids], np.uint32)
                last = np.nonzero(self.ends[ids])[0]
                if len(last) == len(part) and last[-1] == len(ids) - 1:
                    flat.append(ids)
                    lengths.append(np.diff(last, prepend=-1))
                    continue
            ids, sizes = self._each(part)
            flat.append(ids)
            lengths.append(sizes)
        return np.concatenate(flat), np.concatenate(lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids begin (and the last ends)."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        known, base = self.known, len(self.starts) - 1
        both = [(part.dictionary.to_pylist(), part.indices.to_numpy()) for part in self.parts(coded.dictionary)]
        new = sorted(dict.fromkeys(p for part, _ in both for p in part if p not in known), key=str.isalpha)
        flat, lengths = self._encode(new)
        ids = np.concatenate([self.ids, flat])
        starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        fresh = dict(zip(new, range(base, base + len(new)), strict=True))
        found = [np.array([known[p] if p in known else fresh[p] for p in part], np.int64)[at] for part, at in both]
        place = np.stack(found, axis=1).ravel()
        spare = max(0, min(len(new), REMEMBERED - len(known)))
        if spare:  # parts met first stay known; most words of a text are among them
            known.update(zip(new[:spare], range(base, base + spare), strict=True))
            self.starts = starts[: base + spare + 1]
            self.ids = ids[: self.starts[-1]]
        # ids of each different word, then of each word of the texts
        sizes, ids = _gather(ids, starts, place)
        sizes = sizes.reshape(-1, 2).sum(axis=1)
        sizes, ids = _gather(ids, np.concatenate([[0], np.cumsum(sizes)]), coded.indices.to_numpy())
        bounds = np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids, bounds


def _gather(ids: np.ndarray, starts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the spans ``place`` of ``ids``, and the spans one after the other."""
    sizes = (starts[1:] - starts[:-1])[place]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return sizes, ids[np.repeat(starts[:-1][place] - (ends - sizes), sizes) + np.arange(total)]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process; it keeps what it has learned from task to task."""
    return WordTokenizer(path)


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    end_id: int = 0,
    capacity: int = CAPACITY,
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, salt)``: each document's ids and ``end_id``, cut at ``capacity``.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers.
    ``salt`` is a row number that tells repeated rows apart.  A null or empty text is
    ``end_id`` alone; ids may be null or repeat; an empty table gives an empty result;
    other columns are not read.
    """
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = word_tokenizer(path), TaskContext.get().partitionId() << 40
        for chunk in sliced(batches, "text", SLICE):
            ids, bounds = words.encode(pc.fill_null(chunk.column(1), ""))
            rows = []
            for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    rows.append((row, piece, start, len(part), zlib.crc32(part.tobytes()), seen + row))
            seen += chunk.num_rows
            row, *rest = (np.array(c) for c in zip(*rows, strict=True))
            names = ["piece", "start", "length", "ids_crc32", "salt"]
            columns = {n: pa.array(c.astype(np.int32 if n == "piece" else np.int64)) for n, c in zip(names, rest, strict=True)}
            yield pa.RecordBatch.from_pydict({"id": chunk.column(0).take(pa.array(row))} | columns)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {PIECES}")


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; every length is from 1 to ``capacity``."""
    left = np.bincount(lengths, minlength=capacity + 1)
    # the largest length left that is not above i; kept exact as lengths run out
    below = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))

    def take(size: int) -> None:
        left[size] -= 1
        if not left[size]:
            end = size + 1
            while end <= capacity and below[end] == size:
                end += 1
            below[size:end] = below[size - 1]

    def give(size: int) -> None:
        left[size] += 1
        if left[size] == 1:
            view = below[size:]
            np.maximum(view, size, out=view)

    bins = []
    while below[capacity]:
        content, gap = [], capacity
        while gap and (size := int(below[gap])):
            take(size)
            content.append(size)
            gap -= size
        if gap and len(content) > 1:  # a bin's first piece is the largest of all and stays
            small = content[-1]
            room = gap + small
            first = np.arange(1, room)
            first = first[left[first] > 0]
            if len(first):
                second = below[room - first].astype(np.int64)
                twice = (second == first) & (left[first] < 2)
                second[twice] = below[first[twice] - 1]
                sums = np.where(second > 0, first + second, 0)
                best = int(sums.argmax())
                if sums[best] > small:
                    take(int(first[best]))
                    take(int(second[best]))
                    content[-1:] = [int(first[best]), int(second[best])]
                    give(small)
        bins.append(content)
    sizes = np.concatenate([np.array(b) for b in bins]) if bins else np.zeros(0, np.int64)
    number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    offset = np.concatenate([np.cumsum([0, *b[:-1]]) for b in bins]) if bins else sizes
    by_size, by_length = np.argsort(sizes, kind="stable"), np.argsort(lengths, kind="stable")
    bin_of, offset_of = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bin_of[by_length], offset_of[by_length] = number[by_size], offset[by_size]
    return bin_of, offset_of


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    end_id: int = 0,
    capacity: int = CAPACITY,
    block: int = BLOCK,
) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32, sequence_id, offset)``, a row for each piece.

    Null and empty texts are the end id alone; repeated rows and null ids are
    packed like any other; an empty table gives an empty result; other columns
    are not read.
    """
    cut = checkpointed(pieces(docs, id_col, text_col, tokenizer_path, end_id, capacity))
    blocks = max(1, -(-cut.count() // block))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["salt", "piece"], ignore_index=True)
        bins, offsets = best_two_fit(frame["length"].to_numpy(), capacity)
        frame["sequence_id"] = (frame["block"].to_numpy() << 32) + bins
        frame["offset"] = offsets
        return frame.drop(columns=["block", "salt"])

    dealt = cut.withColumn("block", F.pmod(F.xxhash64("salt", "piece"), F.lit(blocks)))
    packed = dealt.groupBy("block").applyInPandas(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return packed.withColumnRenamed("id", id_col)
