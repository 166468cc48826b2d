"""Exact Jaccard join of word n-gram sets by vertical partitioning.

1. One scan gives each document's set size and a 128-bit digest of its set; equal sets are
   linked through the digest, and from then on the one of the smallest doc_id stands for
   them. The scan also counts n-grams in a sketch of fixed size.
2. The sketch sets the global order of n-grams, rarest buckets first. Any order is right;
   this one keeps passages that several documents share out of the prefixes. Two sets
   that link share at least COMMON n-grams of their prefixes (the first
   ``n - ceil(t n) + COMMON`` in that order). The prefixes are dealt by n-gram and sorted by
   set size. An n-gram of at most FEW prefixes gives their pairs, and pairs that have fewer
   than COMMON such n-grams are dropped: these met by chance. Of an n-gram of more prefixes
   neighbours whose sizes allow a link are chained. So documents that may link fall into
   one cluster, with less than FEW / 2 rows for a prefix entry.
3. A cluster is cut into blocks by set size and salt, each of bounded weight; the blocks
   whose sizes allow a link meet in units of work. A unit cuts the n-gram order into
   fragments, counts the partial overlaps of its pairs fragment by fragment and sums them
   per pair. It returns the edges of a spanning forest, so that no pair is ever a row.
4. Connected components of these edges and the equal sets.

Nothing that grows with the table reaches the driver; the sketch's levels are broadcast and
have a fixed size of ``1 << sketch_bits`` bytes.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popquilt.llm.common import fresh, prepare, splitmix, table, text_slices, window_hashes, word_hashes
from popquilt.llm.graph import components

#: Bytes of the sketch that one blob holds.
PIECE = 1 << 17
FRAGMENTS = 4
#: Weight of a block of a cluster, in n-grams; a set weighs at least LEAST_WEIGHT.
BLOCK, LEAST_WEIGHT = 1 << 20, 512
#: Runs of up to this many documents that share an n-gram are counted pair by pair, longer ones by matrix product.
SHORT_RUN = 24
#: Places of a table of marks, as a power of two: 2 MB of bits.
MARK_BITS = 24
#: N-grams that the sketch gathers before it adds them, and prefix entries that are paired together.
CHUNK = 1 << 20
#: Sets that link share so many n-grams of their prefixes, or as many as they must share in all where that is less.
COMMON = 4
#: An n-gram in the prefixes of up to so many sets gives all their pairs, one in more of them a chain.
FEW = 4


def ngram_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its word n-grams.

    A text of fewer than ``width`` words is one n-gram; one without words has none.
    """
    for part in text_slices(column):
        words, off = word_hashes(part)
        grams = window_hashes(words, width)
        for a, b in zip(off[:-1], off[1:]):
            if b - a >= width:
                own = np.sort(grams[a : b - width + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                yield splitmix(window_hashes(words[a:b], int(b - a)))
            else:
                yield words[:0]


def digest_of(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


class Sketch:
    """Counts of n-grams by the leading bits of their hashes, saturating at 255 in a partition."""

    def __init__(self, bits: int):
        self.bits, self.waiting, self.size = bits, [], 0
        self.counts = np.zeros(1 << bits, np.uint8)

    def add(self, grams: np.ndarray) -> None:
        self.waiting.append(grams)
        self.size += len(grams)
        if self.size >= CHUNK:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            at, n = np.unique(np.concatenate(self.waiting) >> np.uint64(64 - self.bits), return_counts=True)
            at = at.astype(np.int64)
            self.counts[at] = np.minimum(self.counts[at] + np.minimum(n, 255).astype(np.int64), 255).astype(np.uint8)
            self.waiting, self.size = [], 0

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        self.flush()
        step = min(PIECE, len(self.counts))
        for k in range(len(self.counts) // step):
            part = self.counts[k * step : (k + 1) * step]
            if part.any():
                yield k, zlib.compress(part.tobytes(), 1)


def _scan_sets(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = Sketch(bits), set()
        names = ["doc_id", "n", "digest", "piece", "blob"]
        for batch in batches:
            sizes, digests = [], []
            for grams in ngram_sets(batch.column(1), width):
                digest = digest_of(grams) if len(grams) else None
                if digest is not None and digest not in seen:
                    seen.add(digest)
                    sketch.add(grams)
                sizes.append(len(grams))
                digests.append(digest)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=names,
            )
        for piece, blob in sketch.blobs():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([piece], pa.int32()), pa.array([blob], pa.binary())],
                names=names,
            )

    return run


def frequency_levels(blobs: DataFrame, bits: int) -> np.ndarray:
    """A byte per bucket of the sketch, that grows with its count: evenly near the mean, with the logarithm above."""
    step = min(PIECE, 1 << bits)

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(step, np.int64)
        for batch in batches:
            for blob in batch.column("blob"):
                total += np.frombuffer(zlib.decompress(blob.as_py()), np.uint8)
        mean = total.mean()
        z = (total - mean) / math.sqrt(max(mean, 1))
        level = np.where(z < 4, 100 + 20 * z, 180 + 6 * np.log2(np.maximum(z, 4) / 4)).clip(0, 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], names=["piece", "blob"])

    levels = np.zeros(1 << bits, np.uint8)
    for row in blobs.groupBy("piece").applyInArrow(add, "piece int, blob binary").collect():  # at most (1 << bits) / PIECE rows
        levels[row["piece"] * step : (row["piece"] + 1) * step] = np.frombuffer(zlib.decompress(row["blob"]), np.uint8)
    return levels


def _prefixes(width: int, least: int, bits: int, levels, wanted):
    """(gram, doc_id, n) of the prefixes of texts whose doc_id is marked; of equal sets in a task, one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = levels.value, set()
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            batch = batch.filter(pa.array(marked(batch.column(0), wanted.value)))
            grams, ids, sizes, counts = [], [], [], []
            for doc_id, own in zip(batch.column(0).to_pylist(), ngram_sets(batch.column(1), width)):
                if doc_id is None or not len(own) or (d := digest_of(own)) in seen:
                    continue
                seen.add(d)
                n = len(own)
                order = level[(own >> np.uint64(64 - bits)).astype(np.int64)]
                if order.any():
                    own = own[np.argsort(order, kind="stable")]
                both = -(-n * least // 100)
                grams.append(own[: n - both + min(COMMON, both)])
                ids.append(doc_id)
                sizes.append(n)
                counts.append(len(grams[-1]))
            if grams:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.repeat(ids, counts).astype(np.int64)), pa.array(np.repeat(sizes, counts).astype(np.int32))],
                    names=["gram", "doc_id", "n"],
                )

    return run


def _met(least: int):
    """(a, b, need) of prefix entries in the order of gram, n and doc_id: the pair may link if it comes at least ``need`` times."""

    def pairs(gram: np.ndarray, ids: np.ndarray, n: np.ndarray, long: bool) -> Iterator[pa.RecordBatch]:
        run = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))
        chained = np.bincount(run)[run] > FEW
        if long:
            chained[run == 0] = True
        for k in range(1, FEW):
            met = (run[k:] == run[:-k]) & (ids[k:] != ids[:-k]) & (100 * n[:-k] >= least * n[k:])
            if k > 1:
                met &= ~chained[k:]
            at = np.flatnonzero(met)
            if len(at):
                need = np.where(chained[at], 0, np.minimum(COMMON, -(-n[at] * least // 100)))
                a, b = ids[at], ids[at + k]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need.astype(np.int8))], names=["a", "b", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, long = [], 0, False
        for batch in batches:
            waiting.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size < CHUNK:
                continue
            gram, ids, n = (np.concatenate(c) for c in zip(*waiting))
            last = int(np.searchsorted(gram, gram[-1]))  # the last n-gram's entries may go on in the next batch
            goes_on = size - last > FEW or (long and last == 0)
            end = size if goes_on else last
            yield from pairs(gram[:end], ids[:end], n[:end].astype(np.int64), long) if end else ()
            keep = size - 1 if goes_on else last
            waiting, size, long = [[gram[keep:], ids[keep:], n[keep:]]], size - keep, goes_on
        if size:
            gram, ids, n = (np.concatenate(c) for c in zip(*waiting))
            yield from pairs(gram, ids, n.astype(np.int64), long)

    return run


def may_link(entries: DataFrame, least: int) -> DataFrame:
    """(a, b) of the prefix entries, so that every two documents that link are in one component."""
    return (
        entries.repartition("gram")
        .sortWithinPartitions("gram", "n", "doc_id")
        .mapInArrow(_met(least), "a long, b long, need byte")
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("times"), F.min("need").alias("need"))
        .filter("times >= need")
        .select("a", "b")
    )


def marks(ids: DataFrame, bits: int = MARK_BITS) -> np.ndarray:
    """A table of fixed size with a mark for the hash of every id of a one-column table.

    Who finds no mark is not among the ids; who finds one may be, and an exact join follows.
    Where the ids are many more than the table's places, it lets all through to the join.
    """
    step = min(PIECE, 1 << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            own[_places(batch.column(0), bits)] = 1
        for k in range(len(own) // step):
            if (part := own[k * step : (k + 1) * step]).any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(np.packbits(part).tobytes(), 1)], pa.binary())], names=["piece", "blob"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(step // 8, np.uint8)
        for batch in batches:
            for blob in batch.column("blob"):
                total |= np.frombuffer(zlib.decompress(blob.as_py()), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["piece", "blob"])

    found = np.zeros((1 << bits) // 8, np.uint8)
    pieces = ids.filter(F.col(ids.columns[0]).isNotNull()).mapInArrow(run, "piece int, blob binary").groupBy("piece").applyInArrow(add, "piece int, blob binary")
    for row in pieces.collect():  # at most (1 << bits) / PIECE rows
        found[row["piece"] * step // 8 : (row["piece"] + 1) * step // 8] = np.frombuffer(zlib.decompress(row["blob"]), np.uint8)
    return found


def _places(ids: pa.Array, bits: int) -> np.ndarray:
    return (splitmix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def marked(ids: pa.Array, found: np.ndarray) -> np.ndarray:
    """Which ids find a mark; null finds none."""
    at = _places(ids, (8 * len(found)).bit_length() - 1)
    return (found[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) & ids.is_valid().to_numpy(zero_copy_only=False)


def _sets(width: int, wanted):
    """(doc_id, n, grams) of the texts whose doc_id is marked; of equal sets of one doc_id in a task, one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            batch = batch.filter(pa.array(marked(batch.column(0), wanted.value)))
            rows = []
            for doc_id, own in zip(batch.column(0).to_pylist(), ngram_sets(batch.column(1), width)):
                if len(own) and (d := (doc_id, digest_of(own))) not in seen:
                    seen.add(d)
                    rows.append((doc_id, len(own), own.tobytes()))
                if len(rows) >= 200:
                    yield _set_rows(rows)
                    rows = []
            yield _set_rows(rows)

    return run


def _set_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n", "grams"])


def overlaps(sets: list[np.ndarray], first: int | None) -> np.ndarray:
    """Intersection sizes of all pairs (first None), or of the first ``first`` sets with the others.

    The n-gram order is cut into fragments; each fragment's partial overlaps are counted by
    themselves and added to their pairs.
    """
    d = len(sets)
    a, shift = (d, 0) if first is None else (first, first)
    total = np.zeros((a, d - shift), np.float32)
    grams, owner = np.concatenate(sets), np.repeat(np.arange(d), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    pivots = np.searchsorted(grams, np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 64) // FRAGMENTS))
    for lo, hi in zip([0, *pivots], [*pivots, len(grams)]):
        g, own = grams[lo:hi], owner[lo:hi]
        if len(g) < 2:
            continue
        run = np.cumsum(np.concatenate([[0], g[1:] != g[:-1]]))
        length = np.bincount(run)[run]
        short = (length > 1) & (length <= SHORT_RUN)
        r, o = run[short], own[short]
        for k in range(1, min(SHORT_RUN, len(r))):
            same = r[k:] == r[:-k]
            if not same.any():
                break
            i, j = o[:-k][same], o[k:][same]
            if first is not None:
                cross = (i < first) & (j >= first)
                i, j = i[cross], j[cross] - first
            np.add.at(total, (i, j), 1)
        r, o = run[length > SHORT_RUN], own[length > SHORT_RUN]
        if len(r):
            column = np.cumsum(np.concatenate([[0], r[1:] != r[:-1]]))
            for c in range(0, column[-1] + 1, 2048):
                own_columns = (column >= c) & (column < c + 2048)
                x = np.zeros((d, min(2048, column[-1] + 1 - c)), np.float32)
                x[o[own_columns], column[own_columns] - c] = 1
                total += x[:a] @ x[shift:].T
    return total


def forest(ids: list[int], sets: list[np.ndarray], first: int | None, least: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the linked pairs."""
    if first in (0, len(sets)):
        return []
    n = np.array([len(s) for s in sets], np.float64)
    both = overlaps(sets, first)
    a, shift = (len(sets), 0) if first is None else (first, first)
    link = 100 * both.astype(np.float64) >= least * (n[:a, None] + n[None, shift:] - both)
    if first is None:
        link = np.triu(link, 1)
    i, j = np.nonzero(link)
    j = j + shift
    label = np.arange(len(sets))
    while len(i):  # smallest label in reach
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(ids[k], ids[label[k]]) for k in np.flatnonzero(label != np.arange(len(sets)))]


def _compare(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []

        def done() -> pa.RecordBatch:
            rows.sort(key=lambda x: (x[0], x[1]))
            sides = {x[0] for x in rows}
            first = None if 2 in sides else sum(x[0] == 0 for x in rows)
            edges = forest([x[1] for x in rows], [x[2] for x in rows], first, least)
            a, b = zip(*edges) if edges else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for u, side, doc_id, grams in zip(*(batch.column(c) for c in ("unit", "side", "doc_id", "grams"))):
                u = u.as_py()
                if u != unit and rows:
                    yield done()
                    rows = []
                unit = u
                rows.append((side.as_py(), doc_id.as_py(), np.frombuffer(grams.as_py(), np.uint64)))
        if rows:
            yield done()

    return run


def work_units(sets: DataFrame, clusters: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """(doc_id, n, units): for each set size of a document, the units in which it is compared.

    A cluster of up to ``block`` is one unit. A heavier one is cut by classes of set size
    (sets that link are in equal or neighbouring classes) and each class by salt; every two
    blocks of equal or neighbouring classes are a unit, in which the document is on side 0
    or 1, or 2 where a block meets itself.
    """
    base = math.log(100 / least * 1.01) if least < 100 else 0.01
    member = sets.join(clusters.withColumnRenamed("node", "doc_id"), "doc_id").select(
        "doc_id", "n", F.col("component").alias("cluster"), F.floor(F.log("n") / base).cast("int").alias("class")
    ).distinct()
    weight = F.sum(F.greatest("n", F.lit(LEAST_WEIGHT)))
    classes = member.groupBy("cluster", "class").agg(weight.alias("w"))
    heavy = classes.groupBy("cluster").agg(F.sum("w").alias("w")).filter(F.col("w") > block).select("cluster", F.lit(True).alias("heavy"))
    salts = classes.join(heavy, "cluster", "left_semi").select("cluster", "class", F.ceil(F.col("w") / block).cast("int").alias("s"))
    up = salts.select("cluster", (F.col("class") - 1).alias("class"), F.col("s").alias("s_up"))
    down = salts.select("cluster", (F.col("class") + 1).alias("class"), F.col("s").alias("s_down"))
    salts = salts.join(up, ["cluster", "class"], "left").join(down, ["cluster", "class"], "left")
    i = F.pmod(F.xxhash64("doc_id"), F.col("s")).cast("int")

    def each(count, unit, side):
        return F.when(
            F.col(count).isNotNull(),
            F.transform(F.sequence(F.lit(0), F.col(count) - 1), lambda j: F.struct(F.concat_ws(":", *unit(j)).alias("unit"), side(j).alias("side"))),
        ).otherwise(F.array().cast("array<struct<unit:string,side:int>>"))

    c = F.col("class")
    own = each("s", lambda j: ("cluster", c, F.least("i", j), c, F.greatest("i", j)), lambda j: F.when(j == F.col("i"), 2).when(F.col("i") < j, 0).otherwise(1))
    above = each("s_up", lambda j: ("cluster", c, "i", c + 1, j), lambda j: F.lit(0))
    below = each("s_down", lambda j: ("cluster", c - 1, j, c, "i"), lambda j: F.lit(1))
    alone = F.array(F.struct(F.col("cluster").cast("string").alias("unit"), F.lit(2).alias("side")))
    return (
        member.join(salts, ["cluster", "class"], "left")
        .withColumn("i", i)
        .select("doc_id", "n", F.when(F.col("s").isNull(), alone).otherwise(F.concat(own, above, below)).alias("units"))
    )


def jaccard_components(docs: DataFrame, width: int = 5, least: int = 80, sketch_bits: int = 25) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``.

    Two documents link where ``100 * |A and B| >= least * |A or B|`` for their sets of word
    n-grams (A-Z lower-cased); component_id is the smallest doc_id in reach. A null or empty
    text has no n-grams and links with nothing. A row without doc_id keeps a null
    component_id and links with nothing. Repeated rows give repeated rows. Rows that share a
    doc_id but not the text are one vertex that links by any of its texts. Other columns are
    not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    scanned = texts.mapInArrow(_scan_sets(width, sketch_bits), "doc_id long, n long, digest binary, piece int, blob binary").checkpoint()
    sets = scanned.filter("piece is null").select("doc_id", "n", "digest")
    levels = spark.sparkContext.broadcast(frequency_levels(scanned.filter("piece is not null"), sketch_bits))

    # Of equal sets, the first stands for all; a document of several sets stays, for it is more than a copy.
    firsts = sets.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).checkpoint()
    copies = sets.join(firsts.filter("copies > 1"), "digest").filter("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct().checkpoint()
    several = sets.filter("digest is not null").join(copies.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y")
    stands = copies.join(several.select(F.col("doc_id").alias("a")), "a", "left_anti").withColumnRenamed("b", "first").checkpoint()
    leading = spark.sparkContext.broadcast(marks(firsts.select("first")))

    entries = texts.mapInArrow(_prefixes(width, least, sketch_bits, levels, leading), "gram long, doc_id long, n int")
    edges = may_link(entries, least)
    for end, other in (("a", "b"), ("b", "a")):
        edges = edges.join(stands.withColumnRenamed("a", end), end, "left").select(F.coalesce("first", end).alias(end), other)
    clusters = components(edges)

    member = work_units(sets, clusters, least).checkpoint()
    wanted = spark.sparkContext.broadcast(marks(member.select("doc_id")))
    compared = (
        texts.mapInArrow(_sets(width, wanted), "doc_id long, n long, grams binary")
        .join(member.hint("merge"), ["doc_id", "n"])  # one plan at every size
        .select("doc_id", "grams", F.explode("units").alias("u"))
        .select("u.unit", "u.side", "doc_id", "grams")
        .repartition("unit")
        .sortWithinPartitions("unit")
        .mapInArrow(_compare(least), "a long, b long")
    )
    found = components(compared.union(copies)).withColumnRenamed("node", "doc_id")
    return sets.join(found, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, width: int = 5, least: int = 80) -> DataFrame:
    """The documents without those that link to one that stays: of each component the row of the smallest doc_id.

    Rows are told apart by doc_id and text together (by a 64-bit hash of both), so that rows
    that share a doc_id but not the text go or stay by their own text; rows without doc_id
    take part and come last in their component. Of rows that are equal in both, one stays.
    Rows without words link with nothing and all stay. Ties go by the hash, so that a task
    that is run again keeps the same row.
    """
    key, group, won, nth = (fresh(c, docs.columns) for c in ("key", "group", "won", "nth"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), width, least).filter("n_shingles > 0")
    found = found.groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("rows"))
    several = found.filter((F.col("doc_id") != F.col("component_id")) | (F.col("rows") > 1)).select("component_id").distinct()
    member = found.join(several, "component_id", "left_semi").select(F.col("doc_id").alias(key), F.col("component_id").alias(group)).checkpoint()
    held = docs.sparkSession.sparkContext.broadcast(marks(member.select(key)))

    @F.pandas_udf("boolean")
    def is_marked(keys):
        return pd.Series(marked(pa.array(keys, pa.int64()), held.value))

    # Rows that no member's mark meets are alone in their component and stay where they are; the others meet their component.
    doubtful = is_marked(key) & F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    first = keyed.filter(doubtful).select(key, "doc_id").join(member, key).groupBy(group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", key)).alias("first"))
    first = first.select(F.col(f"first.{key}").alias(key), F.lit(True).alias(won))
    met = keyed.filter(doubtful).join(member, key, "left").join(first, key, "left").withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    kept = met.filter(F.col(group).isNull() | (F.col(won) & (F.col(nth) == 1)))
    return kept.select(*docs.columns).unionByName(keyed.filter(~doubtful).select(*docs.columns))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(prepare(spark), sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x
  FROM documents),
g AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 5 THEN [array_to_string(x, ' ')]
    ELSE list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i + 4], ' ')) END)) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.i >= 80 * (x.n + y.n - o.i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
