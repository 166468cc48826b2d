"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or abstain on every text. All documents' vote patterns
are counted (there are at most 3 to the number of heuristics), and expectation-maximisation
over these counts estimates each heuristic's accuracy for either class and the share of bad
documents, without any given label. A pattern's posterior labels a bounded sample of
documents, on which a linear scorer with hashed features is trained on the driver; it then
scores every document. The votes are not among the features, so that the scorer has to learn
what the labels mean. Texts are scanned twice and never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popquilt.llm.common import fresh, prepare, splitmix, table, text_slices, utf8, word_hashes

HEURISTICS = ("symbols", "capitals", "repeats", "top_word", "word_length", "lines", "marks", "separators")
GOOD, BAD, ABSTAIN = "+", "-", "0"
#: Dimensions of the hashed features; the last NUMBERS are measures of the whole text.
DIMENSIONS, NUMBERS = 4096, 8
#: Texts, and bytes, that are worked on at once; a longer text is one slice.
SLICE_TEXTS, PART_BYTES = 200, 1 << 18

# Classes of bytes: other, lower, upper, digit, space, line end, stop or comma, symbol, separator, beyond ASCII.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9, 11, 12]], _CLASS[[10, 13]] = 1, 2, 3, 4, 5
_CLASS[[ord(c) for c in ".,;:?'-"]] = 6
_CLASS[[ord(c) for c in "#$%&*!@^~+=<>\\/_"]] = 7
_CLASS[[ord(c) for c in "|{}[]()"]] = 8
_CLASS[128:] = 9


def _vote(value: np.ndarray, good: tuple[float, float], bad: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Votes: -1 abstain, 0 bad, 1 good."""
    vote = np.full(len(value), -1)
    vote[known & (value >= good[0]) & (value <= good[1])] = 1
    vote[known & bad] = 0
    return vote


def _shapes(raw: np.ndarray, off: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of bytes (texts x 10) and hashed runs of four of them (texts x dims), counted in parts of PART_BYTES."""
    n = len(off) - 1
    counts, x = np.zeros((n, 10)), np.zeros((n, dims))
    for lo in range(0, len(raw), PART_BYTES):
        hi = min(len(raw), lo + PART_BYTES)
        before = min(3, lo)
        kind = _CLASS[raw[lo - before : hi]]
        at = np.arange(lo, hi)
        text = np.searchsorted(off, at, "right") - 1
        first, own = int(text[0]), int(text[-1] - text[0] + 1)
        counts[first : first + own] += np.bincount((text - first) * 10 + kind[before:], minlength=own * 10).reshape(own, 10)
        runs = np.zeros(len(kind), dtype=np.uint64)
        for k in range(4):
            runs[k:] += kind[: len(kind) - k].astype(np.uint64) << np.uint64(8 * k)
        shape = (splitmix(runs[before:]) % np.uint64(dims)).astype(np.int64)
        inside = at - off[text] >= 3
        x[first : first + own] += np.bincount(((text - first) * dims + shape)[inside], minlength=own * dims).reshape(own, dims)
    return counts, x


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Votes (texts x heuristics) and hashed features (texts x DIMENSIONS, float32) of a short column."""
    raw, off = utf8(column)
    words, woff = word_hashes(column)
    n = len(off) - 1
    dims = DIMENSIONS - NUMBERS
    counts, shapes = _shapes(raw, off, dims // 2)
    size, n_words = np.diff(off), np.diff(woff)
    some, visible = n_words > 0, np.maximum(1, counts.sum(1) - counts[:, 4] - counts[:, 5])
    letters = np.maximum(1, counts[:, 1] + counts[:, 2])

    owner = np.repeat(np.arange(n), n_words)
    same = np.zeros(len(words), dtype=np.int64)
    for k in (1, 2):
        same[k:] += (2 - (k == 1)) * ((words[k:] == words[:-k]) & (owner[k:] == owner[:-k]))
    repeated = np.bincount(owner, weights=same % 2, minlength=n) / np.maximum(1, n_words)
    order = np.lexsort((words, owner))
    sorted_words, sorted_owner = words[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], (sorted_words[1:] != sorted_words[:-1]) | (sorted_owner[1:] != sorted_owner[:-1])])) if len(words) else np.empty(0, np.int64)
    run = np.diff(np.append(starts, len(words)))
    top = np.zeros(n)
    np.maximum.at(top, sorted_owner[starts], run)
    top /= np.maximum(1, n_words)
    distinct = np.bincount(sorted_owner[starts], minlength=n) / np.maximum(1, n_words)
    length = visible / np.maximum(1, n_words)
    line_count, line_repeats = _lines(raw, off)

    symbols, capitals, marks, separators = counts[:, 7] / visible, counts[:, 2] / letters, counts[:, 6] / np.maximum(1, n_words), counts[:, 8] / np.maximum(1, n_words)
    votes = np.stack(
        [
            _vote(symbols, (0, 0.02), symbols > 0.08, some),
            _vote(capitals, (0, 0.15), capitals > 0.5, some & (letters >= 20)),
            _vote(repeated, (0, 0.02), repeated > 0.15, n_words >= 10),
            _vote(top, (0, 0.15), top > 0.25, n_words >= 30),
            _vote(length, (3, 12), (length < 2) | (length > 30), n_words >= 5),
            _vote(line_repeats, (0, 0.1), line_repeats > 0.4, line_count >= 4),
            _vote(marks, (0.02, 0.6), marks < 0.003, n_words >= 40),
            _vote(separators, (0, 0.02), separators > 0.2, n_words >= 10),
        ],
        axis=1,
    )

    x = np.zeros((n, DIMENSIONS))
    x[:, : dims // 2] = shapes / np.maximum(1, size)[:, None]
    place = dims // 2 + (words % np.uint64(dims - dims // 2)).astype(np.int64)
    x += np.bincount(owner * DIMENSIONS + place, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS) / np.maximum(1, n_words)[:, None]
    for j, value in enumerate((symbols, capitals, repeated, top, 1 - distinct, np.minimum(1, length / 30), line_repeats, np.minimum(1, separators))):
        x[:, dims + j] = value
    return votes, np.sqrt(x, out=x).astype(np.float32)


def _lines(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each text, and the share of them that repeat an earlier one."""
    count, repeats = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
    for i, (a, b) in enumerate(zip(off[:-1], off[1:])):
        lines = [x for x in raw[a:b].tobytes().split(b"\n") if x.strip()]
        count[i] = len(lines)
        if len(lines) > 1:
            repeats[i] = 1 - len(set(lines)) / len(lines)
    return count, repeats


def _pattern(votes: np.ndarray) -> list[str]:
    signs = np.array([ABSTAIN, BAD, GOOD])[votes + 1]
    return ["".join(row) for row in signs]


@dataclass
class LabelModel:
    """Share of bad documents, and per heuristic the probability that its vote is bad in each class (bad, good).

    Whether a heuristic votes at all says nothing of the class.
    """

    bad: float
    alarm: np.ndarray  # heuristics x class

    def log_odds(self, at: np.ndarray) -> np.ndarray:
        """Logarithms of the odds of good for rows of votes (0 abstain, 1 bad, 2 good)."""
        minus, plus = np.log(self.alarm[:, 1] / self.alarm[:, 0]), np.log((1 - self.alarm[:, 1]) / (1 - self.alarm[:, 0]))
        return np.log((1 - self.bad) / self.bad) + (at == 1) @ minus + (at == 2) @ plus

    def posterior(self, pattern: str) -> float:
        """Probability that a document with these votes is good."""
        return float(1 / (1 + np.exp(-self.log_odds(_numbers([pattern]))[0])))

    def accuracies(self) -> dict[str, float]:
        """How often a heuristic's vote is right."""
        right = self.bad * self.alarm[:, 0] + (1 - self.bad) * (1 - self.alarm[:, 1])
        return {h: float(r) for h, r in zip(HEURISTICS, right)}


def _numbers(patterns: list[str]) -> np.ndarray:
    return np.array([[(ABSTAIN, BAD, GOOD).index(c) for c in p] for p in patterns], dtype=np.int64).reshape(len(patterns), len(HEURISTICS))


def fit_labels(counts: dict[str, int], rounds: int = 50, false_alarms: float = 0.0005, belief: float = 1.0) -> LabelModel:
    """Expectation-maximisation from vote patterns' counts.

    It starts from the belief that a document with any bad vote is bad. Heuristics are
    written to be silent on good text: their share of false alarms has a Beta prior with
    mean ``false_alarms`` that weighs ``belief`` times the votes cast.
    """
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], dtype=np.float64)
    at = _numbers(patterns)
    good = np.where((at == 1).any(1), 0.05, 0.98)
    model = LabelModel(0.1, np.tile([0.3, false_alarms], (len(HEURISTICS), 1)))
    for _ in range(rounds if len(patterns) else 0):
        share = np.stack([1 - good, good], axis=1) * weight[:, None]
        minus, cast = (at == 1).T @ share, (at > 0).T @ share
        prior = belief * cast.sum(1)
        alarm = np.stack([(minus[:, 0] + 1) / (cast[:, 0] + 4), (minus[:, 1] + false_alarms * (prior + 1)) / (cast[:, 1] + prior + 1)], axis=1)
        model = LabelModel(float(np.clip((share[:, 0].sum() + 1) / (weight.sum() + 10), 1e-3, 0.999)), alarm.clip(1e-4, 0.999))
        good = 1 / (1 + np.exp(-model.log_odds(at)))
    return model


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x @ self.weights).astype(np.float64) + self.bias, -30, 30)))


def fit_scorer(x: np.ndarray, good: np.ndarray, rounds: int = 400, rate: float = 0.1, decay: float = 1e-4) -> Scorer:
    """Logistic regression on posteriors; both classes weigh the same."""
    x, good = x.astype(np.float32), np.asarray(good, dtype=np.float64)
    weight = good / max(1e-9, good.sum()) + (1 - good) / max(1e-9, (1 - good).sum())
    weight = (weight / max(1e-9, weight.sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        d = weight * (Scorer(w, b).score(x) - good).astype(np.float32)
        g, gb = x.T @ d + decay * w, float(d.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = w - np.float32(rate) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return Scorer(w, float(b))


def _slices(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        at = 0
        for short in text_slices(batch.column(place), PART_BYTES):
            for lo in range(0, len(short), SLICE_TEXTS):
                part = batch.slice(at + lo, min(SLICE_TEXTS, len(short) - lo))
                yield part, *features(part.column(place))
            at += len(short)


def _evidence(share: float):
    """Rows (votes, n, x): how often a task saw a pattern, and about ``share`` of the texts as examples with their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def rows(patterns: list[str], n: list[int], x: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(patterns, pa.string()), pa.array(n, pa.int64()), pa.array(x, pa.binary())], names=["votes", "n", "x"])

        for part, votes, x in _slices(batches, 0):
            patterns = _pattern(votes)
            for p in patterns:
                counts[p] = counts.get(p, 0) + 1
            drawn = np.flatnonzero(part.column(1).to_numpy() < share)
            yield rows([patterns[k] for k in drawn], [0] * len(drawn), [zlib.compress(x[k].astype(np.float16).tobytes(), 1) for k in drawn])
        yield rows(list(counts), list(counts.values()), [None] * len(counts))

    return run


def fit(docs: DataFrame, sample: int = 3000) -> tuple[LabelModel, Scorer]:
    """The label model from all documents; the scorer from about ``sample`` different ones of them, twice that at most."""
    place = F.pmod(F.xxhash64(F.lit("quality"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    seen = docs.select("text", place.alias("place")).mapInArrow(_evidence(min(1.0, sample / max(1, docs.count()))), "votes string, n long, x binary")
    seen = seen.groupBy("votes", "x").agg(F.sum("n").alias("n")).orderBy(F.col("x").isNotNull(), "votes", "x").limit(3 ** len(HEURISTICS) + 2 * sample).collect()
    counts = {r["votes"]: r["n"] for r in seen if r["x"] is None}
    model = fit_labels(counts)
    rows = [(r["votes"], bytes(r["x"])) for r in seen if r["x"] is not None][: 2 * sample]
    if not rows:
        return model, Scorer(np.zeros(DIMENSIONS, np.float32), 0.0)
    x = np.frombuffer(b"".join(zlib.decompress(b) for _, b in rows), np.float16).reshape(-1, DIMENSIONS)
    return model, fit_scorer(x, np.array([model.posterior(p) for p, _ in rows]))


def predict(docs: DataFrame, model: LabelModel, scorer: Scorer, names: tuple[str, str, str] = ("votes", "posterior", "score")) -> DataFrame:
    """The documents with three more columns: votes, the label model's posterior and the scorer's score."""
    place = docs.columns.index("text")
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes] + [f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for part, votes, x in _slices(batches, place):
            patterns = _pattern(votes)
            for p in set(patterns) - known.keys():
                known[p] = model.posterior(p)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(patterns, pa.string()), pa.array([known[p] for p in patterns], pa.float64()), pa.array(scorer.score(x), pa.float64())],
                names=[*part.schema.names, *names],
            )

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, least: float = 0.8, sample: int = 3000) -> DataFrame:
    """(doc_id, votes, posterior, score, good) for every row.

    ``score`` is the scorer's probability of a good document; good where it is ``least`` or
    more. A null or empty text gets no votes and is not good. Nulls elsewhere, repeated rows
    and extra columns change nothing; an empty table gives no rows. A very long text is read
    whole; what is made of its bytes is held in parts.
    """
    model, scorer = fit(docs, sample)
    found = predict(docs.select("doc_id", "text"), model, scorer)
    return found.select("doc_id", "votes", "posterior", "score", _good(least).alias("good"))


def _good(least: float, votes: str = "votes", score: str = "score"):
    return (F.col(score) >= least) & F.col(votes).rlike("[+-]")


def good_documents(docs: DataFrame, least: float = 0.8, sample: int = 3000) -> DataFrame:
    """The documents that the scorer finds good, and those too short for any vote unless they are blank.

    Blank texts are null, empty, or of white space (0x20 and 0x09 to 0x0D) alone. Each row is
    judged by its own text, also where rows share a doc_id; an empty table gives no rows, and
    columns that clash with the scorer's names stay as they are.
    """
    votes, posterior, score = (fresh(c, docs.columns) for c in ("votes", "posterior", "quality_score"))
    found = predict(docs, *fit(docs, sample), (votes, posterior, score))
    short = ~F.col(votes).rlike("[+-]") & F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return found.filter(_good(least, votes, score) | short).select(*docs.columns)


def op10_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(prepare(spark), sf_dir, "documents"))
