"""Cross-entropy difference of documents under two matched n-gram models.

The target model counts documents with a good label, the background model all documents
(Moore and Lewis, 2010). Both are interpolated bigram models over the same words. Words,
contexts and bigrams are counted exactly over all documents, each under its full 64-bit hash,
so that the table of counts grows with the corpus. It is never in one place: documents are
dealt into chunks by their ids and hashes into buckets by their leading bits, both of bounded
size. A chunk sends each bucket its distinct words and bigrams with both models' counts; the
bucket adds them over all chunks and answers each chunk with the sums of what it sent, in the
same order; the chunk then scores its documents by their tokens' mean losses. A frequent word
or bigram is sent once a chunk, so that none makes a bucket large.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popquilt.llm.common import _MUL, prepare, splitmix, table, text_slices, word_hashes

#: Bytes of text for each chunk and each bucket.
CHUNK_BYTES = 1 << 24
#: The uniform distribution that words back off to is over so many words, or over those of the corpus where they are more.
WORD_BITS = 18
#: The counts that a word and a bigram have: in the target and in all documents, for a word first as a word and then as a context.
OF_WORD, OF_PAIR = 4, 2
STRENGTH = 64.0
START = np.uint64(0x5851F42D4C957F2D)


def events(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all words of a column: hashes of words, contexts and pairs; and n + 1 offsets of the texts."""
    words, off = word_hashes(column)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[off[:-1][np.diff(off) > 0]] = START
    return words, before, splitmix(before * _MUL + words), off


def chunk_events(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``events``, with texts taken in short slices; the last array has the texts' numbers of words."""
    parts = [events(part) for batch in column.chunks for part in text_slices(batch)]
    words, before, pair = (np.concatenate([p[k] for p in parts]) for k in range(3))
    return words, before, pair, np.concatenate([np.diff(p[3]) for p in parts])


def pack(counts: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes; those of small numbers are mostly zeros."""
    return zlib.compress(counts.astype("<i8").reshape(-1, 1).view(np.uint8).T.tobytes(), 1)


def unpack(blob: bytes, kinds: int) -> np.ndarray:
    """What ``pack`` took, with a row for each kind of count."""
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1).T).view("<i8").reshape(kinds, -1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending hashes as planes of their differences' bytes."""
    return np.diff(keys, prepend=np.uint64(0)).reshape(-1, 1).view(np.uint8).T.tobytes()


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2 ** bits buckets begins in ascending hashes, and the end."""
    first = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, first), [len(keys)]])


def tally(keys: np.ndarray, *seen: np.ndarray) -> np.ndarray:
    """How often each of the ascending keys is in each of the arrays."""
    out = np.zeros((len(seen), len(keys)), np.int64)
    for row, values in zip(out, seen):
        own, n = np.unique(values, return_counts=True)
        row[np.searchsorted(keys, own)] = n
    return out


REQUEST = "chunk int, bucket int, words binary, word_counts binary, pairs binary, pair_counts binary"
ANSWER = "chunk int, bucket int, totals array<long>, word_counts binary, pair_counts binary"


def _ask(bits: int) -> Callable[[tuple[pa.Scalar, ...], pa.Table, pa.Table], pa.Table]:
    names = [x.split()[0] for x in REQUEST.split(", ")]
    types = pa.schema([(n, pa.int32() if k < 2 else pa.binary()) for k, n in enumerate(names)])

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, good: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return types.empty_table()
        words, before, pair, n = chunk_events(docs.column("text"))
        if not len(words):
            return types.empty_table()
        ids = docs.column("doc_id")
        known = np.isin(ids.fill_null(0).to_numpy(), good.column("doc_id").to_numpy()) & ids.is_valid().to_numpy()
        own = np.repeat(known, n)
        keys = np.unique(np.append(words, START))
        pairs = np.unique(pair)
        counts = tally(keys, words[own], words, before[own], before)
        pair_counts = tally(pairs, pair[own], pair)
        at, pair_at = cuts(keys, bits), cuts(pairs, bits)
        rows = [
            (key[0].as_py(), b, pack_keys(keys[i:j]), pack(counts[:, i:j]), pack_keys(pairs[k:m]), pack(pair_counts[:, k:m]))
            for b, (i, j, k, m) in enumerate(zip(at, at[1:], pair_at, pair_at[1:]))
        ]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types.types)], schema=types)

    return run


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The counts added up for each distinct key, and for each key as it came the place of its sums."""
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return np.stack([np.bincount(place, np.concatenate(c), len(distinct)).astype(np.int64) for c in zip(*counts)]), place


def _answer(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks, words, word_counts, pairs, pair_counts = [], [], [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            chunks.append(r["chunk"])
            words.append(unpack_keys(r["words"]))
            word_counts.append(unpack(r["word_counts"], OF_WORD))
            pairs.append(unpack_keys(r["pairs"]))
            pair_counts.append(unpack(r["pair_counts"], OF_PAIR))
    word_sums, word_place = _sum(words, word_counts)
    pair_sums, pair_place = _sum(pairs, pair_counts)
    totals = [int(word_sums[0].sum()), int(word_sums[1].sum()), int((word_sums[1] > 0).sum())]
    i = k = 0
    for chunk, w, p in zip(chunks, words, pairs):
        values = [pack(word_sums[:, word_place[i : i + len(w)]]), pack(pair_sums[:, pair_place[k : k + len(p)]])]
        i, k = i + len(w), k + len(p)
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int32()), pa.array([key[0].as_py()], pa.int32()), pa.array([totals], pa.list_(pa.int64())), *(pa.array([v], pa.binary()) for v in values)],
            names=["chunk", "bucket", "totals", "word_counts", "pair_counts"],
        )


def losses(single: np.ndarray, total: int, size: int, context: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Negative logarithms of words' probabilities. Pairs back off to words, and words to the uniform distribution over ``size``."""
    base = (single + 0.1) / (total + 0.1 * size)
    return -np.log((pair + STRENGTH * base) / (context + STRENGTH))


def _score(docs: pa.Table, answers: pa.Table) -> pa.Table:
    names = ["doc_id", "n_tokens", "ce_target", "ce_background", "score"]
    if not docs.num_rows:
        return pa.schema(list(zip(names, [pa.int64()] * 2 + [pa.float64()] * 3))).empty_table()
    words, before, pair, n = chunk_events(docs.column("text"))
    means = [np.zeros(len(n))] * 2
    if len(words):
        rows = answers.sort_by("bucket").to_pylist()
        *total, distinct = np.sum([r["totals"] for r in rows], axis=0)
        word_counts = np.concatenate([unpack(r["word_counts"], OF_WORD) for r in rows], axis=1)
        pair_counts = np.concatenate([unpack(r["pair_counts"], OF_PAIR) for r in rows], axis=1)
        keys = np.unique(np.append(words, START))
        word, context = np.searchsorted(keys, words), np.searchsorted(keys, before)
        place = np.unique(pair, return_inverse=True)[1]
        owner = np.repeat(np.arange(len(n)), n)
        size = max(1 << WORD_BITS, distinct)
        means = [
            np.bincount(owner, losses(word_counts[m][word], total[m], size, word_counts[OF_PAIR + m][context], pair_counts[m][place]), len(n)) / np.maximum(1, n)
            for m in range(OF_PAIR)
        ]
    columns = [pa.array(x, pa.float64(), mask=n == 0) for x in (*means, means[0] - means[1])]
    return pa.Table.from_arrays([docs.column("doc_id"), pa.array(n, pa.int64()), *columns], names=names)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ce_target, ce_background, score) for every row, in nats a token.

    ``labels`` has (doc_id, good); a document is good if all its labels are. score is
    ce_target less ce_background: the lower, the more a document is like the target. Without
    words the three are null. Without any good label the target is the uniform distribution.
    Labels that are null or of unknown documents count for nothing; repeated rows count and
    are scored as often as they come; other columns are not read; an empty table gives no rows.
    """
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = held // CHUNK_BYTES + 1
    bits = (chunks - 1).bit_length()

    def chunk(key: Column) -> Column:
        return F.pmod(key, F.lit(chunks)).cast("int").alias("chunk")

    # The texts are dealt once: both uses below are one exchange. Rows without an id, which no label meets, go by their texts.
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = dealt.select(chunk(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text"))), "doc_id", "text").repartition(chunks, "chunk")
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "good").filter("doc_id is not null")
    good = good.groupBy("doc_id").agg(F.min("good").alias("good")).filter("good").select(chunk(F.xxhash64("doc_id")), "doc_id").repartition(chunks, "chunk")
    asked = dealt.groupBy("chunk").cogroup(good.groupBy("chunk")).applyInArrow(_ask(bits), REQUEST)
    answers = asked.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(_answer, ANSWER).repartition(chunks, "chunk")
    result = "doc_id long, n_tokens long, ce_target double, ce_background double, score double"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score, result)


def op5_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return score(table(spark, sf_dir, "documents"), labels.filter("good is not null"))
