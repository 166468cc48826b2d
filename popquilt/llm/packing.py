"""Hierarchical multi-length packing of tokenised documents.

Documents are cut into full windows of the longest tier and a remainder; the remainder goes
to the shortest tier that holds it. Each tier's pieces open windows of that tier, longest
first; the gap that a piece leaves is filled from shorter tiers with the longest piece that
fits, and a piece is cut only where none fits. Windows of every tier are full, so that only
the last one of a partition is padded. Finished windows are dealt to step groups of equal
token counts, each group getting windows of one tier with about the same attention cost (the
sum of the squared piece lengths).

The work is one pass over the scan without a shuffle. A task holds at most ``buffer_tokens``
waiting tokens and one Arrow batch, and its result depends on its rows only, so a task that
is run again gives the same pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from popquilt.llm.common import prepare, table

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, tier int, step_group long, sequence_tokens int"
)
_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("tier", pa.int32()), ("step_group", pa.int64()), ("sequence_tokens", pa.int32())]
)
#: Partitions number their sequences and step groups from multiples of this.
PARTITION_STRIDE = 1 << 36
END_OF_TEXT = 1
#: White space of this length goes to ``tokenizers``: tiktoken's pattern backtracks over it and runs out of stack at some 10^6 characters.
LONG_SPACE = 100_000
_LONG_SPACE = re.compile(r"\s{%d}" % LONG_SPACE)
_encoders: dict[str, tuple] = {}


def byte_bpe(name: str = "byte_bpe_50k"):
    """Encodes texts as ``tokenizers`` does with the JSON vocabulary of that name.

    The rank file of the same vocabulary gives the same ids four times as fast, through
    tiktoken; a text with a special token's string goes to ``tokenizers``, which gives such
    a string an id of its own, and so does one with LONG_SPACE or more white space at a stretch.
    """
    if name not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        special = [t.content for t in exact.get_added_tokens_decoder().values()]
        _encoders[name] = fast, exact, special
    fast, exact, special = _encoders[name]

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special) or len(text) >= LONG_SPACE and _LONG_SPACE.search(text):
            return np.array(exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(fast.encode_ordinary(text), dtype=np.uint32)

    return encode


class Packer:
    """Packs pieces into windows. A piece is (document, start, length)."""

    def __init__(self, tiers: tuple[int, ...] = (256, 512, 1024, 2048)):
        self.tiers, self.longest = tuple(sorted(tiers)), max(tiers)
        self.by_length: list[list[tuple]] = [[] for _ in range(self.longest + 1)]
        self.some = 0  # bit n is set if pieces of length n wait
        self.tokens = 0

    def tier(self, length: int) -> int:
        return next(t for t in self.tiers if length <= t)

    def put(self, doc, start: int, length: int) -> None:
        self.by_length[length].append((doc, start))
        self.some |= 1 << length
        self.tokens += length

    def take(self, length: int) -> tuple:
        pool = self.by_length[length]
        doc, start = pool.pop()
        if not pool:
            self.some ^= 1 << length
        self.tokens -= length
        return doc, start, length

    def add(self, doc, length: int) -> Iterator[tuple[int, list[tuple]]]:
        """Routes a document; its full windows of the longest tier come out at once."""
        start = 0
        while length - start >= self.longest:
            yield self.longest, [(doc, start, self.longest)]
            start += self.longest
        if length > start:
            self.put(doc, start, length - start)

    def fill(self, window: list[tuple], gap: int, below: int) -> int:
        """Fills a gap from pieces shorter than ``below``; what is left of it, at the end."""
        while gap:
            fits = self.some & ((1 << min(gap + 1, below)) - 1)
            if fits:
                window.append(piece := self.take(fits.bit_length() - 1))
                gap -= piece[2]
                continue
            longer = (self.some & ((1 << below) - 1)) >> (gap + 1)
            if not longer:
                return gap
            doc, start, length = self.take(gap + (longer & -longer).bit_length())
            window.append((doc, start, gap))
            self.put(doc, start + gap, length - gap)
            gap = 0
        return 0

    def flush(self, last: bool = False) -> Iterator[tuple[int, list[tuple]]]:
        """Windows of all tiers, longest first. Without ``last``, what fills no window waits on."""
        for tier in reversed(self.tiers):
            lower = max((t for t in self.tiers if t < tier), default=0)
            own = (1 << (tier + 1)) - (1 << (lower + 1))
            while pieces := self.some & own:
                if self.tokens < tier:
                    break
                window = [piece := self.take(pieces.bit_length() - 1)]
                gap = self.fill(window, tier - piece[2], lower + 1)
                if gap:  # no shorter piece is left: cut one of the same tier
                    gap = self.fill(window, gap, tier + 1)
                if gap:  # only longer pieces are left
                    for piece in window:
                        self.put(*piece)
                    break
                yield tier, window
        while last and self.some:
            window: list[tuple] = []
            self.fill(window, self.longest, self.longest + 1)
            yield self.longest, window


class StepGroups:
    """Deals windows of a tier to groups of ``group_tokens`` tokens, balanced by attention cost."""

    def __init__(self, tiers: tuple[int, ...], group_tokens: int, groups: int):
        self.size, self.groups = {t: max(1, group_tokens // t) for t in tiers}, groups
        self.waiting: dict[int, list[tuple[int, list]]] = {t: [] for t in tiers}
        self.given = 0

    def add(self, tier: int, window: list) -> Iterator[tuple[int, int, list]]:
        self.waiting[tier].append((sum(p[2] ** 2 for p in window), window))
        if len(self.waiting[tier]) >= self.size[tier] * self.groups:
            yield from self.deal(tier)

    def deal(self, tier: int) -> Iterator[tuple[int, int, list]]:
        windows, self.waiting[tier] = self.waiting[tier], []
        if not windows:
            return
        n = -(-len(windows) // self.size[tier])
        cost, room = [0] * n, [self.size[tier]] * n
        for c, window in sorted(windows, key=lambda x: -x[0]):
            g = min((g for g in range(n) if room[g]), key=lambda g: cost[g])
            cost[g] += c
            room[g] -= 1
            yield tier, self.given + g, window
        self.given += n


def pack_partition(
    batches: Iterable[pa.RecordBatch],
    first: int,
    tiers: tuple[int, ...],
    buffer_tokens: int,
    group_tokens: int,
) -> Iterator[pa.RecordBatch]:
    encode = byte_bpe()
    packer, steps = Packer(tiers), StepGroups(tiers, group_tokens, 8)
    ids: dict[int, tuple] = {}  # per document that waits: doc_id, ids, tokens not yet given out
    rows: list[tuple] = []
    sequence, document = first, 0

    def give(dealt: Iterable[tuple[int, int, list]]) -> None:
        nonlocal sequence
        for tier, group, window in dealt:
            offset, used = 0, sum(p[2] for p in window)
            for doc, start, length in window:
                doc_id, tokens, left = ids[doc]
                crc = zlib.crc32(tokens[start : start + length].tobytes())
                rows.append((doc_id, start, length, crc, len(tokens), sequence, offset, tier, first + group, used))
                offset += length
                if left == length:
                    del ids[doc]
                else:
                    ids[doc] = doc_id, tokens, left - length
            sequence += 1

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
            rows = []

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            tokens = np.append(encode(text.as_py() or ""), np.uint32(END_OF_TEXT)).astype("<u4")
            document += 1
            ids[document] = doc_id, tokens, len(tokens)
            for tier, window in packer.add(document, len(tokens)):
                give(steps.add(tier, window))
            if packer.tokens > buffer_tokens:
                for tier, window in packer.flush():
                    give(steps.add(tier, window))
            if len(rows) > 20_000:
                yield from out()
    for tier, window in packer.flush(last=True):
        give(steps.add(tier, window))
    for tier in reversed(sorted(tiers)):
        give(steps.deal(tier))
    yield from out()


def pack(
    docs: DataFrame,
    tiers: tuple[int, ...] = (256, 512, 1024, 2048),
    buffer_tokens: int = 2_000_000,
    group_tokens: int = 16_384,
) -> DataFrame:
    """One row per piece of a document in a packed sequence.

    A null or empty text is one end-of-text token; a null doc_id stays null; repeated rows
    are packed as often as they come; columns other than doc_id and text are not read; an
    empty table gives no rows. A very long text is read whole, whatever it consists of. ``sequence_tokens`` is what the piece's sequence holds, at
    most its tier; only a partition's last sequence holds less.
    """

    def run(batches):
        yield from pack_partition(
            batches, TaskContext.get().partitionId() * PARTITION_STRIDE, tiers, buffer_tokens, group_tokens
        )

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, SCHEMA)


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(prepare(spark), sf_dir, "documents"))
