"""SentencePiece encoding and decoding by streaming Viterbi.

The trellis has a boundary after every character and an edge for every piece. Edges are drawn
to a boundary as its character comes: the tree of pieces has links from what was read to its
longest end that a piece can begin with, so that each character is one step and gives the
pieces that end there. At least as often as the longest piece has characters, the paths that
are still alive are followed back; where they meet, the ids up to there are final and leave
the window, so that memory does not grow with the text. Every text takes this way.

The trellis serves both kinds of vocabulary. In a unigram vocabulary an edge adds its piece's
score and the best path to a boundary survives. In a byte-pair vocabulary an edge is allowed
after a piece only if merging the two pieces' characters by rank gives back the two; such a
vocabulary has exactly one path of allowed edges to any boundary, and it is what merging the
whole text would give. (Adding up a byte-pair vocabulary's ranks would not give its ids.)

A character outside the vocabulary becomes its UTF-8 bytes' pieces, and all paths meet on
both of its sides. So they do before a space that follows another character, since no piece
has a space after another character; such stretches are memoised in a table of bounded size,
which a worker keeps from task to task.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from popquilt.llm.common import prepare, table

SPACE = "▁"
_models: dict[str, Vocabulary] = {}
_encoders: dict[tuple[str, str], Encoder] = {}

#: Nodes by character; the pieces that end here, longest first, as (id, characters, what is known of pieces before it); characters from the root; the node of the longest shorter end.
Node = tuple[dict[str, "Node"], tuple[tuple[int, int, dict[int, bool]], ...], int, "Node | None"]


def tree_of(ids: dict[str, int], before: dict[int, dict[int, bool]] | None = None) -> Node:
    """The root of the pieces' tree by characters, with links to shorter ends (Aho and Corasick's)."""
    by_length: dict[int, dict[str, int]] = {}
    for piece, i in ids.items():
        for n in range(1, len(piece) + 1):
            by_length.setdefault(n, {}).setdefault(piece[:n], -1)
        by_length[len(piece)][piece] = i
    root: Node = ({}, (), 0, None)
    above = {"": root}
    for n in sorted(by_length):
        level = {}
        for text, i in by_length[n].items():
            parent, c = above[text[:-1]], text[-1]
            link = parent[3]
            while link is not None and c not in link[0]:
                link = link[3]
            link = root if link is None else link[0][c]
            own = ((i, n, {} if before is None else before[i]),) if i >= 0 else ()
            level[text] = parent[0][c] = ({}, own + link[1], n, link)
        above = level
    return root


class Vocabulary:
    """Pieces of a SentencePiece model file."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = {i for i in range(sp.get_piece_size()) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.scores = [sp.get_score(i) for i in range(sp.get_piece_size())]
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.control = {i for i in special if i not in self.byte_of}
        # What a piece stands for by itself; bytes beyond ASCII are parts of characters.
        self.words = [chr(self.byte_of[i]) if i in self.byte_of else "" if i in self.control else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.high = np.array([self.byte_of.get(i, 0) > 127 for i in range(len(self.pieces))])
        self.longest = max(map(len, self.ids))
        self.kind = kind
        self.known = {p for p in self.ids if len(p) == 1}
        self.longest_run = max(len(p) for p in self.ids if set(p) == {SPACE})
        splits = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids)
        self.stretches = None if splits else re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        # Per piece, whether it may follow another; ``pairs`` are known in all.
        self.before: dict[int, dict[int, bool]] = {i: {} for i in self.ids.values()}
        self.pairs = 0
        self.tree = tree_of(self.ids, self.before)

    def score(self, piece: str) -> float:
        i = self.ids.get(piece)
        return -np.inf if i is None else self.scores[i]

    def merged(self, text: str) -> list[str]:
        """Merges neighbours by score, best and then leftmost first."""
        parts = list(text)
        scores = [self.score(a + b) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > -np.inf:
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = self.score(parts[k - 1] + parts[k])
            if k < len(scores):
                scores[k] = self.score(parts[k] + parts[k + 1])
        return parts

    def follows(self, before: int, piece: int) -> bool:
        """Whether a byte-pair encoding may have these two pieces side by side; before is -1 at a start."""
        known = self.before[piece].get(before)
        if known is None:
            if self.pairs > 1_000_000:
                for pairs in self.before.values():
                    pairs.clear()
                self.pairs = 0
            own = self.pieces[piece]
            two = [own] if before < 0 else [self.pieces[before], own]
            known = self.before[piece][before] = self.merged("".join(two)) == two
            self.pairs += 1
        return known


class Viterbi:
    """Encodes a stretch of known characters that is given in any number of parts."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        # Per boundary of the window: (piece, boundary before, score), or None where no path ends.
        self.window: list[tuple[int, int, float] | None] = [(-1, -1, 0.0)]
        self.node: Node = vocabulary.tree
        self.most = 1  # boundaries held at once

    def push(self, chars: str) -> list[int]:
        """Takes characters; the ids that have become final."""
        out, step = [], self.v.longest
        for at in range(0, len(chars), step):
            self.draw(chars[at : at + step])
            if len(self.window) > step:
                out += self.commit()
        return out

    def finish(self) -> list[int]:
        """The ids that are left, at the end of the text."""
        return self.path(len(self.window) - 1)

    def draw(self, chars: str) -> None:
        """Draws the edges to the boundaries after these characters, of which the surviving path's stay."""
        v, window, node = self.v, self.window, self.node
        root, scores, bpe = v.tree, v.scores, v.kind == "bpe"
        for stop, c in enumerate(chars, len(window)):
            after = node[0].get(c)
            while after is None and node is not root:
                node = node[3]
                after = node[0].get(c)
            node = root if after is None else after
            best = None
            for piece, size, before in node[1]:
                start = stop - size
                if start < 0 or (at := window[start]) is None:
                    continue
                if bpe:
                    known = before.get(at[0])
                    if known or known is None and v.follows(at[0], piece):
                        best = (piece, start, 0.0)
                        break
                elif best is None or at[2] + scores[piece] > best[2]:
                    best = (piece, start, at[2] + scores[piece])
            window.append(best)
        self.node = node
        self.most = max(self.most, len(window))

    def commit(self) -> list[int]:
        """Ids up to the last boundary that all living paths share: those to where a piece that goes on can have begun."""
        window = self.window
        end = len(window)
        heads = {k for k in range(max(0, end - 1 - self.node[2]), end) if window[k] is not None}
        while len(heads) > 1:
            last = max(heads)
            heads.remove(last)
            heads.add(window[last][1])
        return self.leave(heads.pop()) if heads else []

    def path(self, at: int) -> list[int]:
        """The ids of the path to a boundary."""
        out, window = [], self.window
        while at > 0:
            piece, at, _ = window[at]
            out.append(piece)
        out.reverse()
        return out

    def leave(self, at: int) -> list[int]:
        """Takes the ids up to a boundary out of the window."""
        out = self.path(at)
        if at:
            shift = [None if w is None else (w[0], w[1] - at, w[2]) for w in self.window[at:]]
            self.window = [(shift[0][0], -1, shift[0][2]), *shift[1:]]
        return out


class _Memo(dict):
    """Ids of stretches as bytes; it starts again when it is full."""

    def __init__(self, encoder: Encoder, most: int = 1_000_000):
        super().__init__()
        self.encoder, self.most = encoder, most

    def __missing__(self, stretch: str) -> bytes:
        found = raw_ids(self.encoder.stretch(stretch))
        if len(stretch) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[stretch] = found
        return found


def raw_ids(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.memo = _Memo(self)

    def stretch(self, text: str) -> list[int]:
        """Ids of text with spaces already marked; unknown characters become bytes."""
        v, out = self.v, []
        run = len(text) - len(text.lstrip(SPACE))
        if run > 1 and v.kind == "bpe":  # spaces merge last, from the left, and the last of them goes with a word if it can
            rest = self.known(text[run - 1 :]) if len(text) > run else [v.ids[SPACE]]
            alone = rest[0] == v.ids[SPACE]
            spaces = run if alone else run - 1
            while spaces > 0:
                out.append(v.ids[SPACE * min(spaces, v.longest_run)])
                spaces -= v.longest_run
            return out + rest[alone:]
        return self.known(text)

    def known(self, text: str) -> list[int]:
        v, out, at = self.v, [], 0
        if v.known.issuperset(text):
            return self.run(text)
        for k, c in enumerate(text):
            if c not in v.known:
                if k > at:
                    out += self.run(text[at:k])
                out += [v.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
                at = k + 1
        return out + (self.run(text[at:]) if at < len(text) else [])

    def run(self, text: str) -> list[int]:
        trellis = Viterbi(self.v)
        return trellis.push(text) + trellis.finish()

    def encode(self, text: str) -> list[int]:
        """Ids of a text; a mark of a space in the text itself is kept as bytes."""
        return self.ids(text).tolist()

    def ids(self, text: str) -> np.ndarray:
        """As ``encode``, 32-bit."""
        out: list[bytes] = []
        for k, part in enumerate(text.split(SPACE)) if text else ():
            if k:
                out.append(raw_ids([self.v.bytes[b] for b in SPACE.encode()]))
            part = part.replace(" ", SPACE)
            part = part if k else SPACE + part
            if self.v.stretches is None:
                out.append(raw_ids(self.stretch(part)))
            else:
                out += map(self.memo.__getitem__, self.v.stretches.findall(part))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids; it undoes ``encode`` for every text."""
        v, out, raw = self.v, [], bytearray()
        ids = np.asarray(ids, dtype=np.int64)
        if not v.high[ids].any():
            out = list(map(v.words.__getitem__, ids.tolist()))
        else:
            for i in ids.tolist():
                if v.high[i]:
                    raw.append(v.byte_of[i])
                    continue
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                out.append(v.words[i])
            out.append(raw.decode("utf-8", "replace"))
        if out and out[0][:1] == " ":
            out[0] = out[0][1:]
        return "".join(out)


def vocabulary(name: str = "piece_bpe_32k.model", kind: str = "bpe") -> Vocabulary:
    if name not in _models:
        import public_tokenizers

        _models[name] = Vocabulary(public_tokenizers.path(name), kind)
    return _models[name]


def encoder_of(name: str, kind: str) -> Encoder:
    """This worker's encoder, with what it remembers of stretches."""
    if (name, kind) not in _encoders:
        _encoders[name, kind] = Encoder(vocabulary(name, kind))
    return _encoders[name, kind]


def encode(docs: DataFrame, name: str = "piece_bpe_32k.model", kind: str = "bpe") -> DataFrame:
    """(doc_id, ids) for every row; a null or empty text has no ids.

    A null doc_id stays null, repeated rows give repeated rows, other columns are not read,
    and an empty table gives no rows. A text is read whole; besides its ids, what is held of
    a stretch does not grow with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(name, kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids = [encoder.ids(t.as_py() or "") for t in part.column(1)]
                off = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, name: str = "piece_bpe_32k.model", kind: str = "bpe") -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text. Null doc_ids and repeated rows stay; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Encoder(vocabulary(name, kind))
        for batch in batches:
            texts = [decoder.decode(ids.as_py() or ()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op3_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as count and CRC, and the digest of the text that decoding them gives."""
    prepare(spark)
    schema = "doc_id long, n_ids long, ids_crc32 long, decoded_bytes long, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Encoder(vocabulary())
        for batch in batches:
            rows = []
            for ids in batch.column(1):
                a = ids.values.to_numpy().astype("<u4")
                text = decoder.decode(a).encode("utf-8", "surrogatepass")
                rows.append((len(a), zlib.crc32(a.tobytes()), len(text), hashlib.sha256(text).hexdigest()))
            cols = list(zip(*rows)) or [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_ids", "ids_crc32", "decoded_bytes", "decoded_sha256"])

    return encode(table(spark, sf_dir, "documents")).mapInArrow(run, schema)
