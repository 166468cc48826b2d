"""Exact duplicates by composable polynomial fingerprints and a comparison chunk by chunk.

A text's fingerprint is the polynomial of its bytes modulo 2^61 - 1 at two fixed points. The
hash of a part, times the point to the power of the number of bytes behind the part, is the
part's share of the whole, so that chunks of a huge document are hashed by any tasks and
their shares are added in any order. Texts of up to ``CHUNK`` bytes are one chunk and stay in
their task; longer ones are cut, their chunks dealt out and hashed apart.

Fingerprints only tell who may be equal. The texts that share one (found again by a table of
marks, so that the others are never shuffled) are compared with one of them, chunk by chunk,
in a join whose large keys Spark splits. What differs from it goes into another round, so
that the result does not depend on fingerprints being different for different texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popquilt.llm.common import prepare, remove, shared_name, table, text_slices, utf8, written
from popquilt.llm.jaccard import marked, marks

PRIME = (1 << 61) - 1
#: The points at which the polynomial is taken.
POINTS = (0x0B4C9E2D51F1D36F, 0x1A54FF53A5872C59)
#: Bytes of a chunk. A text of more is hashed and compared in parts that need not meet in a task.
CHUNK = 1 << 16
#: Bytes that one row of a matrix product takes.
LINE = 64
#: Bits of a fingerprint at each point; tests take fewer to have different texts share one.
BITS = 61
#: Marks for each shared fingerprint, and the most marks as a power of two (8 MB of bits). Beyond, more texts pass to the comparison.
MARKS_EACH, MOST_MARK_BITS = 16, 26

_P, _U = np.uint64(PRIME), np.uint64


def fold(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo the prime."""
    x = (x & _P) + (x >> _U(61))
    return np.where(x >= _P, x - _P, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, both below it: halves of 31 bits, with 2^61 being 1."""
    a1, a0, b1, b0 = a >> _U(31), a & _U(0x7FFFFFFF), b >> _U(31), b & _U(0x7FFFFFFF)
    middle = a1 * b0 + a0 * b1
    return fold((a1 * b1 << _U(1)) + (middle >> _U(30)) + ((middle & _U(0x3FFFFFFF)) << _U(31)) + a0 * b0)


def _limbs(value: int) -> list[int]:
    return [value >> s & 0x1FFFFF for s in (0, 21, 42)]


# Powers of the points within a line, in limbs whose products with bytes add up exactly in doubles; and powers from line to line.
_WEIGHTS = np.array([[x for r in POINTS for x in _limbs(pow(r, LINE - 1 - k, PRIME))] for k in range(LINE)], dtype=float)
_STEPS = [np.array([pow(r, LINE * j, PRIME) for j in range(CHUNK // LINE)], dtype=np.uint64) for r in POINTS]


def chunk_hashes(column: pa.Array) -> list[np.ndarray]:
    """For each point, the polynomials of a column of byte strings of at most CHUNK bytes; null counts as empty."""
    b, off = utf8(column)
    n = np.diff(off)
    lines = np.maximum(1, -(-n // LINE))
    first = np.concatenate([[0], np.cumsum(lines)])
    padded = np.zeros(first[-1] * LINE, np.uint8)  # bytes stand at the end of their lines; zeros in front add nothing
    for at, end, size in zip(off[:-1], first[1:] * LINE, n):
        padded[end - size : end] = b[at : at + size]
    sums = (padded.reshape(-1, LINE).astype(float) @ _WEIGHTS).astype(np.uint64)
    behind = np.repeat(first[1:], lines) - 1 - np.arange(first[-1])
    out = []
    for k, steps in enumerate(_STEPS):
        s0, s1, s2 = (sums[:, 3 * k + i] for i in range(3))
        line = fold(s0 + (s1 << _U(21)) + ((s2 & _U(0x7FFFF)) << _U(42)) + (s2 >> _U(19)))
        share = product(line, steps[behind])
        high, low = (np.add.reduceat(x, first[:-1]) if len(n) else np.empty(0, np.uint64) for x in (share >> _U(31), share & _U(0x7FFFFFFF)))
        out.append(fold(product(fold(high), np.full(len(n), 1 << 31, np.uint64)) + low))
    return out


def _hashed(keep: list[int], chunk: int, held: object = None, mask: int = PRIME) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds f1 and f2, a chunk's shares of its text's fingerprint, to rows whose last columns are n, chunk_no and chunk; with marks, only rows that meet one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(at, len(texts))
                at += len(texts)
                n, no = (part.column(part.num_columns - k).to_numpy() for k in (3, 2))
                behind = n - np.minimum(n, (no + 1) * chunk)
                shares = []
                for point, h in zip(POINTS, chunk_hashes(texts)):
                    for i in np.flatnonzero(behind):
                        h[i] = int(h[i]) * pow(point, int(behind[i]), PRIME) % PRIME
                    shares.append(h)
                columns = [part.column(k) for k in keep] + [pa.array((s & _U(mask)).view(np.int64)) for s in shares]
                out = pa.RecordBatch.from_arrays(columns, names=[*(part.schema.names[k] for k in keep), "f1", "f2"])
                yield out if held is None else out.filter(pa.array(marked(out.column("f1"), held.value)))

    return run


def exact_copies(docs: DataFrame, chunk: int = CHUNK, bits: int = BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for each row of ``docs``, by whole texts.

    Of equal texts the row of the largest doc_id stays; keep_id is its doc_id and group_size
    the number of rows with the text. A null text is empty, and empty texts are equal. Null
    doc_ids come behind all others; if all of a group are null, keep_id is null. Of rows that
    are repeated, doc_id and all, exactly one can stay. A text may be as long as Spark lets a
    value be: only its row holds it whole. Other columns are not read, whatever their names;
    an empty table gives no rows. ``chunk`` is at most CHUNK.
    """
    spark = docs.sparkSession
    mask = (1 << bits) - 1
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.spark_partition_id().alias("part"), F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("n"), text.alias("chunk"))
    print_columns = "doc_id long, part int, sha string, n long"
    short = base.filter(F.col("n") <= chunk).select("doc_id", "part", "sha", "n", F.lit(0).cast("long").alias("chunk_no"), "chunk")
    short_prints = short.mapInArrow(_hashed([0, 1, 2, 3], chunk, None, mask), f"{print_columns}, f1 long, f2 long")

    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk)), lambda i: F.substring(F.col("chunk"), (i * chunk + 1).cast("int"), F.lit(chunk)))
    long = base.filter(F.col("n") > chunk).withColumn("row", F.monotonically_increasing_id())
    long = long.select("row", "doc_id", "part", "sha", "n", F.posexplode(cut).alias("chunk_no", "chunk")).withColumn("chunk_no", F.col("chunk_no").cast("long")).repartition("row", "chunk_no")
    at = [shared_name(spark, k) for k in ("long-texts", "candidates", "first-texts")]
    long = written(long.mapInArrow(_hashed(list(range(7)), chunk), f"row long, {print_columns}, chunk_no long, chunk binary, f1 long, f2 long"), at[0])
    # Shares are below 2^61 and are added as decimals, so that no sum overflows.
    whole = [(F.sum(F.col(f).cast("decimal(20,0)")) % PRIME).cast("long").bitwiseAND(F.lit(mask)).alias(f) for f in ("f1", "f2")]
    long_prints = long.groupBy("row", "doc_id", "part", "sha", "n").agg(*whole)

    prints = short_prints.unionByName(long_prints.drop("row"))
    key = ["n", "f1", "f2"]
    groups = prints.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("doc_id"), F.min("sha").alias("sha")).checkpoint()
    several = groups.filter("rows > 1").select(*key)
    wide = min(MOST_MARK_BITS, max(13, (MARKS_EACH * several.count()).bit_length()))
    held = spark.sparkContext.broadcast(marks(several.select("f1"), wide))

    candidate = f"{print_columns}, chunk_no long, chunk binary, f1 long, f2 long"
    found = short.mapInArrow(_hashed(list(range(6)), chunk, held, mask), candidate)
    found = found.unionByName(long.drop("f1", "f2").join(long_prints.join(several, key, "left_semi").select("row", "f1", "f2"), "row").drop("row"))
    rest = candidates = written(found, at[1])
    verdicts, made = [], 2
    while True:
        # The same row comes first for all chunks of a fingerprint's texts, which are as long as each other.
        first = written(rest.groupBy(*key, "chunk_no").agg(F.max_by("chunk", F.struct("doc_id", "sha")).alias("first")), at[made])
        same = rest.join(first, [*key, "chunk_no"]).groupBy(*key, "doc_id", "sha", "part")
        same = same.agg(F.min(F.col("chunk") == F.col("first")).alias("same"), F.count_if(F.col("chunk_no") == 0).alias("copies")).checkpoint()
        verdicts.append(same.filter("same").drop("same").withColumn("round", F.lit(len(verdicts))))
        other = same.filter("not same").select(*key, "sha").distinct()
        if other.isEmpty():
            break
        at.append(shared_name(spark, "first-texts"))
        made += 1
        rest = candidates.join(other, [*key, "sha"], "left_semi")
    remove(spark, *at)

    equal = verdicts[0]
    for more in verdicts[1:]:
        equal = equal.unionByName(more)
    classes = equal.groupBy(*key, "round").agg(F.max(F.struct("doc_id", "part")).alias("keep"), F.sum("copies").alias("group_size"))
    classes = classes.join(several, key, "left_semi").checkpoint()  # without rows that met a mark by chance
    each = equal.join(classes, [*key, "round"]).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    stays = (F.col("nth") == 1) & F.struct("doc_id", "part").eqNullSafe(F.col("keep"))
    alone = groups.filter("rows = 1").select("doc_id", F.col("doc_id").alias("keep_id"), F.col("rows").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return each.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), F.col("sha").alias("text_sha256")).unionByName(alone)


def op11_polynomial_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(prepare(spark), sf_dir, "documents"))


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
