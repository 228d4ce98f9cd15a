"""Personal data by weak supervision.

Candidate spans come from patterns.  For each candidate, labelers of three sorts
vote "personal", "not personal" or abstain: patterns and checks on the span itself,
a gazetteer of words that introduce such data, and the characters around it.  The
votes of all candidates, counted by pattern of votes, go through expectation
maximisation, which estimates each labeler's accuracy without labels; the resulting
probabilities, as soft labels, train the final span classifier, a logistic model over
features of the span.  Spans of the base rules are always kept; the classifier
decides on the rest.

What reaches the driver is bounded: one count for each pattern of votes and features.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import sliced
from strandline.llm.weak import fit_accuracies, posterior
from strandline.session import checkpointed

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Further candidates, which only the classifier can admit: other ways of writing, and numbers that the base
# rules lose because another number follows or precedes them.
_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]{1,63}){1,8}"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[-. ])[2-9][0-9]{2}[-. ][0-9]{4}(?![0-9-])"),
}
_LOOSE_HINT = {"email": re.compile(r"[(\[]at[)\]]"), "ip": re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]"), "card": re.compile(r"[0-9]{4}"), "phone": re.compile(r"[0-9][-. )]")}

#: Words that introduce personal data of a kind, and words that speak against it.
GAZETTEER = {
    "email": (frozenset("email e-mail mail contact write kontakt correo courriel".split()), frozenset("example doc sample".split())),
    "ip": (frozenset("ip address host server client from login adresse".split()), frozenset("version v release section chapter".split())),
    "card": (frozenset("card visa mastercard credit payment karte carte tarjeta".split()), frozenset("isbn order id serial".split())),
    "phone": (frozenset("phone tel telephone call fax mobile cell telefon telefono".split()), frozenset("isbn order id serial part".split())),
}
LABELERS = ("pattern", "check", "gazetteer", "before", "after")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d)
        if place % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards so that long runs stay linear."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base rules by kind and start; a match that fails its check is dropped."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = re.sub("[ -]", "", m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates that overlap no base span and none of a kind before theirs."""
    out: list[tuple[str, int, int]] = []
    taken = sorted((a, b) for _, a, b in base)
    for kind, pattern in _LOOSE.items():
        if not _LOOSE_HINT[kind].search(text):
            continue
        starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        own = []
        for m in pattern.finditer(text):
            before = bisect_left(starts, m.end())  # spans that begin before this one ends
            if (not before or reach[before - 1] <= m.start()) and (kind != "card" or luhn(re.sub("[ -]", "", m[0]))):
                own.append(m.span())
        out += [(kind, *span) for span in own]
        taken = sorted(taken + own)
    return out


@lru_cache(maxsize=4096)
def _bare(word: str) -> str:
    return word.strip(".,;:!?()[]\"'=").lower()


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, int]:
    """(votes, features) of a candidate, each packed into one integer.

    Votes: two bits for each labeler of LABELERS, 0 against, 1 abstains, 2 for.
    Features: kind, base rule, length class, separators, case of the word before, edges.
    """
    span = text[start:end]
    near = [_bare(w) for w in text[max(0, start - 40) : start].split()[-3:]]
    good, bad = GAZETTEER[kind]
    digits = sum(map(str.isdigit, span))
    left, right = text[max(0, start - 1) : start], text[end : end + 1]
    if kind == "email":
        valid = 2 if re.search(r"[.)\] ][A-Za-z]{2,24}$", span) else 0
    elif kind == "ip":
        valid = 1 if ":" in span else 2 if all(p == "0" or not p.startswith("0") for p in span.split(".")) else 0
    elif kind == "card":
        valid = 2 if span[0] in "23456" else 1
    else:
        valid = 2 if 10 <= digits <= 13 else 1
    cast = (
        2 if base else 1,
        valid,
        2 if good.intersection(near) else 0 if bad.intersection(near) else 1,
        2 if not left or left.isspace() or left in "(<:\"'=" else 0,
        2 if not right or right.isspace() or right in ".,;:)>\"'!?" else 0,
    )
    packed = sum(v << 2 * i for i, v in enumerate(cast))
    separators = min(3, sum(not c.isalnum() for c in span))
    features = KINDS.index(kind) | base << 2 | min(3, len(span) // 8) << 3 | separators << 5 | (cast[2] << 7) | (cast[3] // 2) << 9 | (cast[4] // 2) << 10 | (valid << 11)
    return packed, features


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, kind, start, end, base, votes, features)`` lists of each text, one row for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                own = [(*s, True) for s in base] + [(*s, False) for s in loose_spans(text, base)]
                rows.append([(KINDS.index(k), a, b, is_base, *votes(text, k, a, b, is_base)) for k, a, b, is_base in own])
            columns = {
                name: pa.array([[c[i] for c in row] for row in rows], pa.list_(kind_))
                for i, (name, kind_) in enumerate(
                    [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.int32())]
                )
            }
            yield pa.RecordBatch.from_pydict({"id": batch.column(0)} | columns)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run,
        f"id {kind}, kind array<int>, start array<int>, end array<int>, base array<boolean>, votes array<int>, features array<int>",
    )


def _expand(features: np.ndarray) -> np.ndarray:
    """One-hot columns of packed features, with a constant."""
    parts = [(0, 4), (2, 2), (3, 4), (5, 4), (7, 3), (9, 2), (10, 2), (11, 3)]
    widths = [2, 1, 2, 2, 2, 1, 1, 2]
    columns = [np.ones((len(features), 1))]
    for (shift, values), width in zip(parts, widths, strict=True):
        value = features >> shift & ((1 << width) - 1)
        columns.append((value[:, None] == np.arange(values)).astype(float))
    return np.hstack(columns)


def fit_spans(found: DataFrame) -> dict[int, float]:
    """Probability of "personal" for each packed feature value, learned from ``candidates``."""
    counts = (
        found.select(F.explode(F.arrays_zip("votes", "features")).alias("c"))
        .groupBy("c.votes", "c.features")
        .count()
        .collect()  # at most a row for each pattern of votes and features, whatever the input
    )
    if not counts:
        return {}
    packed = np.array([r["votes"] for r in counts])
    cast = np.stack([(packed >> 2 * i & 3) - 1 for i in range(len(LABELERS))], axis=1)
    weight = np.array([r["count"] for r in counts], float)
    model = fit_accuracies(cast, weight, prior=0.5)
    soft = posterior(model, cast)
    features = np.array([r["features"] for r in counts])
    x = _expand(features)
    share = weight / weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (share * (p - soft)) + 1e-3 * w
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    scores = 1 / (1 + np.exp(-x @ w))
    return {int(f): float(s) for f, s in zip(features, scores, strict=True)}


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, a row for each row of ``docs``.

    The counts and the digest are of the base spans; ``spans`` lists those and the
    ones that the classifier admits at ``threshold``, as ``kind:start:end`` in code
    points, by kind and start.  Null and empty texts have none; ids may be null or
    repeat; an empty table gives an empty result; other columns are not read.
    """
    found = checkpointed(candidates(docs, id_col, text_col))
    admitted = {f for f, p in fit_spans(found).items() if p >= threshold}
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            names = ("kind", "start", "end", "base", "features")
            for row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
                rows = sorted(zip(*row, strict=True))
                base = [(k, a, b) for k, a, b, is_base, _ in rows if is_base]
                every = [(k, a, b) for k, a, b, is_base, f in rows if is_base or f in admitted]
                counts = [sum(k == i for k, _, _ in base) for i in range(len(KINDS))]
                out.append((*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(every)))
            columns = list(zip(*out, strict=True))
            named = {f"n_{k}": pa.array(columns[i], pa.int64()) for i, k in enumerate(KINDS)}
            named |= {"base_sha256": pa.array(columns[4]), "spans": pa.array(columns[5])}
            if len(out):
                yield pa.RecordBatch.from_pydict({"id": batch.column(0)} | named)

    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return found.drop("votes").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, such as ``<EMAIL>``.

    Overlapping spans are replaced together, named after the first.  The columns
    of ``docs`` stay as they are otherwise; ``n_chars``, where there is one, counts
    the new text.  A null text stays null, an empty one empty; ids are not read beyond the
    search, so they may be null or repeat; an empty table gives an empty one.
    """
    found = candidates(docs, id_col, text_col)
    admitted = {f for f, p in fit_spans(found).items() if p >= threshold}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            texts = [None if t is None else _clean(t, admitted) for t in batch.column(at).to_pylist()]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if "n_chars" in batch.schema.names:
                count = batch.schema.get_field_index("n_chars")
                sizes = [old if t is None else len(t) for t, old in zip(texts, batch.column(count).to_pylist(), strict=True)]
                batch = batch.set_column(count, batch.schema.field(count), pa.array(sizes, batch.schema.field(count).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def _clean(text: str, admitted: set[int]) -> str:
    base = base_spans(text)
    more = [s for s in loose_spans(text, base) if votes(text, *s, False)[1] in admitted]
    out, done = [], 0
    for kind, start, end in sorted(base + more, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
            done = end
        elif end > done:
            done = end
    return "".join(out) + text[done:]
