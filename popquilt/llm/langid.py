"""Language identification with a byte convolutional network.

The network reads windows of 256 bytes (A-Z lower-cased): an embedding per byte, filters of
widths 2, 3 and 4 with rectifier and maximum over the window, and a softmax layer. It is
trained in numpy on the driver, on a bounded sample: at most about ``sample`` documents of
each language and ``WINDOWS`` windows of each document. Every byte of every text is then
read in batches of windows; a document's probabilities are its windows' means, weighted by
bytes. For reading, an embedding and the filters on it become tables over byte pairs, so
that a filter response is two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popquilt.llm.common import _LOWER, fresh, prepare, table, text_slices, utf8

WINDOW, WIDTHS, EMBEDDING, FILTERS = 256, (2, 3, 4), 8, 12
POSITIONS = WINDOW - max(WIDTHS) + 1
WINDOWS = 4
#: Bytes that are read at once.
SLICE = 1 << 17
UNDETERMINED = "und"
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def held_out(doc_id: Column) -> Column:
    """True for documents that training never sees; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # per width: width x EMBEDDING x FILTERS
    bias: np.ndarray  # all filters
    out: np.ndarray  # all filters x languages
    out_bias: np.ndarray

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Responses to the byte pair at a position (all widths), and to what follows it: a byte, a pair."""
        t = [[self.embedding @ w[j] for j in range(len(w))] for w in self.filters]

        def pair(x, y):
            return (x[:, None] + y[None]).reshape(1 << 16, -1)

        first = np.concatenate([pair(x[0], x[1]) for x in t], axis=1)
        return first.astype(np.float32), t[1][2].astype(np.float32), pair(t[2][2], t[2][3]).astype(np.float32)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 64, rate: float = 4e-3) -> Network:
    """Adam on the cross-entropy of windows (n x WINDOW bytes) with labels (n integers)."""
    rng = np.random.default_rng(9)
    n_out = FILTERS * len(WIDTHS)
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDING)),
        [rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)) for w in WIDTHS],
        np.zeros(n_out),
        rng.normal(0, 1 / np.sqrt(n_out), (n_out, len(languages))),
        np.zeros(len(languages)),
    )
    params = [net.embedding, *net.filters, net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            x, rows = windows[own], np.arange(len(own))
            e = net.embedding[x].astype(np.float32)
            best, pooled = [], []
            for w in net.filters:
                k = len(w)
                columns = np.concatenate([e[:, j : j + POSITIONS] for j in range(k)], axis=2)
                response = columns @ w.reshape(k * EMBEDDING, FILTERS).astype(np.float32)
                where = response.argmax(1)
                best.append(where)
                pooled.append(np.take_along_axis(response, where[:, None], 1)[:, 0])
            pooled = np.concatenate(pooled, axis=1)
            hidden = np.maximum(pooled + net.bias, 0)
            d = net.probabilities(pooled)
            d[rows, labels[own]] -= 1
            d /= len(own)
            back = (d @ net.out.T) * (hidden > 0)
            grads = [np.zeros_like(net.embedding), *[np.zeros_like(w) for w in net.filters], back.sum(0), hidden.T @ d, d.sum(0)]
            for i, (w, where) in enumerate(zip(net.filters, best)):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(len(w)):
                    byte = x[rows[:, None], where + j]
                    grads[1 + i][j] += np.einsum("bf,bfe->ef", g, net.embedding[byte])
                    np.add.at(grads[0], byte, g[:, :, None] * w[j].T[None])
            step += 1
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def predict_column(net: Network, tables: tuple, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """A language and its probability for every text."""
    parts = [_predict_part(net, tables, part) for part in text_slices(column)]
    return [name for names, _ in parts for name in names], np.concatenate([np.empty(0), *(scores for _, scores in parts)])


def _predict_part(net: Network, tables: tuple, column: pa.Array) -> tuple[list[str], np.ndarray]:
    raw, off = utf8(column)
    low = _LOWER[raw]
    n = len(off) - 1
    names, scores = [UNDETERMINED] * n, np.zeros(n)
    if not net.languages:
        return names, scores
    sums = np.zeros((n, len(net.languages)))
    first, byte, pair = tables
    f = FILTERS
    size = off[1:] - off[:-1]
    count = np.where(size > 0, (size + WINDOW - 1) // WINDOW, 0)
    document, within = np.repeat(np.arange(n), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = off[document] + within * WINDOW
    stop = np.minimum(start + WINDOW, off[document + 1])
    for lo in range(0, len(start), SLICE // WINDOW):
        a, b = start[lo : lo + SLICE // WINDOW], stop[lo : lo + SLICE // WINDOW]
        at = a[:, None] + np.arange(WINDOW)
        x = np.where(at < b[:, None], low[np.minimum(at, len(low) - 1)], 0)
        pairs = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        response = first[pairs[:, :POSITIONS]]
        response[:, :, f : 2 * f] += byte[x[:, 2 : 2 + POSITIONS]]
        response[:, :, 2 * f :] += pair[pairs[:, 2 : 2 + POSITIONS]]
        np.add.at(sums, document[lo : lo + len(a)], net.probabilities(response.max(1)) * (b - a)[:, None])
    best = sums.argmax(1)
    letters = np.add.reduceat(np.append(_ASCII_LETTER[raw], False).astype(np.int64), off[:-1]) * (size > 0) if n else size
    for i in range(n):
        if size[i] and (letters[i] or any(map(str.isalpha, column[i].as_py()))):
            names[i], scores[i] = net.languages[best[i]], min(1.0, sums[i, best[i]] / size[i])
    return names, scores


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to WINDOWS windows of each text, evenly spread over the whole of it."""
    for batch in batches:
        raw, off = utf8(batch.column(1))
        low, found = _LOWER[raw], []
        for lang, a, b in zip(batch.column(0).to_pylist(), off[:-1], off[1:]):
            count = int(min(WINDOWS, -(-(b - a) // WINDOW)))
            for at in np.linspace(a, max(a, b - WINDOW), count).astype(np.int64) if count else ():
                found.append((lang, low[at : min(at + WINDOW, b)].tobytes().ljust(WINDOW, b"\0")))
        cols = list(zip(*found)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary())], names=["lang", "bytes"])


def fit(docs: DataFrame, sample: int = 1000) -> Network:
    """Trains on documents with a language that are not held out; ``sample`` bounds the documents of a language."""
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, count in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample / count)).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rows = known.filter(place < share).select("lang", "text").limit(2 * sample * max(1, len(counts))).mapInArrow(_windows, "lang string, bytes binary")
    rows = sorted((r["lang"], bytes(r["bytes"])) for r in rows.collect())
    languages = sorted(counts)
    windows = np.frombuffer(bytearray().join(b for _, b in rows), np.uint8).reshape(-1, WINDOW) if rows else np.empty((0, WINDOW), np.uint8)
    number = {lang: i for i, lang in enumerate(languages)}
    return train(windows, np.array([number[lang] for lang, _ in rows], dtype=np.int64), languages)


def predict(docs: DataFrame, net: Network, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The documents with two more columns: the language and its probability."""
    place = docs.columns.index("text")
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes] + [f"`{names[0]}` string, `{names[1]}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            found, scores = predict_column(net, tables, batch.column(place))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, *names]
            )

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, sample: int = 1000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.

    A text that is null, empty or without letters (characters of Unicode's categories L) is
    ``und`` with score 0, and so is every text where no row has a language to learn from.
    Long texts are read whole, in batches of windows. Nulls in other columns, repeated rows
    and extra columns change nothing; an empty table gives no rows.
    """
    net = fit(docs, sample)
    out = predict(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, least: float = 0.4, sample: int = 1000) -> DataFrame:
    """The documents whose language is told with at least that probability.

    Each row is judged by its own text, also where rows share a doc_id; rows without letters go.
    """
    lang, score = fresh("lang_pred", docs.columns), fresh("lang_score", docs.columns)
    found = predict(docs, fit(docs, sample), (lang, score))
    return found.filter((F.col(lang) != UNDETERMINED) & (F.col(score) >= least)).select(*docs.columns)


def op9_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(prepare(spark), sf_dir, "documents"))
