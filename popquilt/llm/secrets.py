"""Secrets in text: fixed patterns, and strings that a battery of randomness tests cannot tell from noise.

The patterns give the base spans. The battery adds spans: every maximal run of 16 or more
characters of the base64 alphabets that has a letter is a candidate, also inside or across
base spans. Where its letters are of one case, signs between its parts are left out (as in
UUIDs). The narrowest encoding that holds all its characters is inferred (hex, base32,
base36, base62, base64), its characters become symbol numbers, and three tests measure how
well they agree with chance: chi-squared uniformity over the alphabet, runs above and below
the middle, and lag-one serial correlation, combined by Fisher's method.

Agreement with chance alone proves little for a short string, so what is tested is the
hypothesis that a candidate is ordinary text. Its distribution comes from the corpus: all
letters and digits of every document, without what stands between them, are cut to windows
that are measured in the same way, for every stratum of lengths. A candidate's p-value is the share
of these windows of its stratum that look as random as it does; the procedure of Benjamini
and Hochberg, in each stratum, bounds the share of false secrets among those found.

The scan reads the texts once. Its rows (spans and bins, no text) go to a checkpoint; the
strata's counts in a fixed number of bins are all that reaches the driver.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popquilt.llm.common import prepare, table, text_slices

KINDS = ("assign", "access", "hex")
#: The base patterns of the contract. Case counts only where the pattern says so.
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_PARTS = (re.compile(r"[A-Za-z0-9+/]+={0,2}"), re.compile(r"[A-Za-z0-9_-]+={0,2}"))
_SIGNS, _OTHER = re.compile(r"[+/_-]+"), re.compile(r"[^A-Za-z0-9]+")
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_ALPHABETS = [(n, frozenset(a)) for n, a in ENCODINGS]
SIZES = np.array([len(a) for _, a in ENCODINGS])
#: Number of the symbol of each ASCII character in each encoding.
NUMBERS = np.zeros((len(ENCODINGS), 128), dtype=np.int64)
for _k, (_, _a) in enumerate(ENCODINGS):
    NUMBERS[_k, [ord(c) for c in _a]] = np.arange(len(_a))
#: Windows of text are of one case: hex or base36, whose letters have the same numbers; other characters are above.
_HEX_KIND, _BASE36_KIND = 0, 3
_LETTERS = np.full(256, 255, np.uint8)
for _k, _c in enumerate("0123456789abcdefghijklmnopqrstuvwxyz"):
    _LETTERS[[ord(_c), ord(_c.upper())]] = _k
#: Lower ends of the strata of lengths, in symbols.
STRATA = (16, 20, 24, 32, 48, 64, 128)
BINS = 1000
_FLOOR = 1e-300
#: Symbols that the battery takes at once.
SYMBOLS = 1 << 18


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base patterns' matches."""
    found = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def symbols_of(token: str) -> str:
    """The characters that are tested: without padding, and without signs where all letters are of one case."""
    body = token.rstrip("=")
    return _SIGNS.sub("", body) if body.islower() or body.isupper() else body


def infer_encoding(symbols: str) -> int | None:
    """Number of the narrowest encoding that holds all the symbols; None where no encoding does."""
    chars = set(symbols)
    return next((k for k, (_, letters) in enumerate(_ALPHABETS) if chars <= letters), None)


def _upper_normal(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.array([math.erfc(v) for v in (z / math.sqrt(2)).tolist()])


def battery(texts: list[str], encodings: list[int]) -> np.ndarray:
    """The combined p-value of chance of each string of symbols, by its encoding; strings have two symbols or more.

    Chi-squared by the approximation of Wilson and Hilferty; runs by Wald and Wolfowitz,
    two-sided; correlation of neighbours by the normal approximation, two-sided.
    """
    if not texts:
        return np.empty(0)
    n, kind = np.array([len(t) for t in texts]), np.array(encodings)
    return _agreement(n, kind, NUMBERS[np.repeat(kind, n), np.frombuffer("".join(texts).encode("ascii"), np.uint8)])


def _agreement(n: np.ndarray, kind: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The battery on symbol numbers of strings of lengths n, one after another."""
    owner, x = np.repeat(np.arange(len(n)), n), numbers.astype(np.float64)
    size = SIZES[kind].astype(np.float64)

    counts = np.bincount(owner * 64 + x.astype(np.int64), minlength=len(n) * 64).reshape(-1, 64)
    value, df = (counts.astype(np.float64) ** 2).sum(1) * size / n - n, size - 1
    chi = _upper_normal((np.cbrt(value / df) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df)))

    high = x >= size[owner] / 2
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    a = np.bincount(owner, high, len(n))
    b = n - a
    changes = np.bincount(owner[inner], high[inner + 1] != high[inner], len(n))
    two = 2 * a * b
    mean, var = 1 + two / n, two * (two - n) / (n * n * (n - 1.0))
    sided = 2 * _upper_normal(np.abs(1 + changes - mean) / np.sqrt(np.where(var > 0, var, 1)))
    run = np.where(two == 0, 2.0 ** (1 - n.astype(np.float64)), np.where(var > 0, sided, 1.0))

    pairs, own = n - 1.0, owner[inner]
    first, second = x[inner], x[inner + 1]
    m1, m2 = np.bincount(own, first, len(n)) / pairs, np.bincount(own, second, len(n)) / pairs
    d1, d2 = first - m1[own], second - m2[own]
    s1, s2, s12 = (np.bincount(own, v, len(n)) / pairs for v in (d1 * d1, d2 * d2, d1 * d2))
    flat = (s1 < 1e-9) | (s2 < 1e-9)
    r = s12 / np.sqrt(np.where(flat, 1.0, s1 * s2))
    serial = np.where(flat, _FLOOR, 2 * _upper_normal(np.abs(r) * np.sqrt(pairs)))

    half = -sum(np.log(np.clip(p, _FLOOR, 1.0)) for p in (chi, run, serial))
    return np.clip(np.exp(-half) * (1 + half + half * half / 2), _FLOOR, 1.0)


def stratum(length: int) -> int:
    return sum(length >= s for s in STRATA) - 1


def bins(p: np.ndarray) -> np.ndarray:
    """Bins are even in log10 from 1 down to 1e-50; the first are the most random."""
    return np.minimum(BINS - 1, (-np.log10(np.maximum(p, 1e-50)) * (BINS / 50)).astype(np.int64))


def text_windows(text: str) -> list[str]:
    """For each stratum, all letters and digits of the text in lower case, cut to windows as long as its shortest strings; what is left is in a window that ends with the text."""
    letters, out = _OTHER.sub("", text).lower(), []
    for length in STRATA:
        n = len(letters)
        starts = [*range(0, n - length + 1, length), *([n - length] if n > length and n % length else [])]
        out += [w for w in (letters[k : k + length] for k in starts) if not w.isdigit()]
    return out


def window_bins(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, stratum, bin) of the ``text_windows`` of all texts."""
    raw = [t.encode("ascii", "ignore") for t in texts]
    letters = _LETTERS[np.frombuffer(b"".join(raw), np.uint8)]
    kept = letters < 36
    sizes = np.bincount(np.repeat(np.arange(len(raw)), [len(r) for r in raw])[kept], minlength=len(raw))
    letters, begin = letters[kept], np.cumsum(sizes) - sizes
    out = [(np.empty(0, np.int64),) * 3]
    for s, length in enumerate(STRATA):
        n = -(-sizes // length) * (sizes >= length)
        own = np.repeat(np.arange(len(raw)), n)
        place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * length
        start = begin[own] + np.minimum(place, sizes[own] - length)
        step = SYMBOLS // length
        for at in range(0, len(start), step):
            x = letters[start[at : at + step, None] + np.arange(length)]
            top = x.max(axis=1)
            some = top > 9  # the others are numbers
            kind = np.where(top[some] < 16, _HEX_KIND, _BASE36_KIND)
            p = _agreement(np.full(len(kind), length), kind, x[some].ravel()) if len(kind) else np.empty(0)
            out.append((own[at : at + step][some], np.full(len(kind), s), bins(p)))
    return tuple(np.concatenate(c) for c in zip(*out))


def window_counts(texts: list[str]) -> dict[tuple[int, int], int]:
    """How many windows of the texts each (stratum, bin) has."""
    _, s, b = window_bins(texts)
    place, n = np.unique(s * BINS + b, return_counts=True)
    return {divmod(k, BINS): v for k, v in zip(place.tolist(), n.tolist())}


def join_spans(spans: list[tuple[int, int, int]], names: tuple[str, ...]) -> str:
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))


_SCAN = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
    "base array<struct<start:long,kind:int,end:long>>, extra array<struct<start:long,end:long,encoding:string,stratum:int,bin:int>>, "
    "windows array<struct<stratum:int,bin:int,n:long>>"
)
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_EXTRA = pa.list_(
    pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("stratum", pa.int32()), ("bin", pa.int32())])
)
_WINDOW = pa.list_(pa.struct([("stratum", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())]))


def _measured(found: list[tuple[str, int]]) -> list[int]:
    """Bins of strings of symbols with their encodings, some at a time."""
    out, at = [], 0
    while at < len(found):
        end, held = at, 0
        while end < len(found) and (end == at or held + len(found[end][0]) <= SYMBOLS):
            held += len(found[end][0])
            end += 1
        out += bins(battery([t for t, _ in found[at:end]], [k for _, k in found[at:end]])).tolist()
        at = end
    return out


def runs(text: str) -> list[tuple[int, int]]:
    """Where the strings to test are: runs of the alphabets' characters, or parts of those that no encoding holds.

    A run with signs of both base64 alphabets, as a path with a key in it may be, is cut at
    the signs of one of them and, apart from that, at the signs of the other.
    """
    out = []
    for m in CANDIDATE.finditer(text):
        start, run = m.start(), m.group()
        if infer_encoding(symbols_of(run)) is not None:
            out.append(m.span())
            continue
        parts = {(start + p.start(), start + p.end()) for pattern in _PARTS for p in pattern.finditer(run)}
        out += sorted(p for p in parts if p[1] - p[0] >= STRATA[0])
    return out


def candidates(texts: list[str]) -> list[list[tuple[int, int, str, int, int]]]:
    """For each text, its candidates (start, end, encoding, stratum, bin)."""
    places, found = [], []
    for i, text in enumerate(texts):
        for start, end in runs(text):
            symbols = symbols_of(text[start:end])
            if len(symbols) < STRATA[0] or symbols.isdigit() or (kind := infer_encoding(symbols)) is None:
                continue
            places.append((i, start, end, ENCODINGS[kind][0], stratum(len(symbols))))
            found.append((symbols, kind))
    out: list[list] = [[] for _ in texts]
    for (i, *place), b in zip(places, _measured(found)):
        out[i].append((*place, b))
    return out


def ordinary(texts: list[str]) -> list[list[tuple[int, int]]]:
    """For each text, (stratum, bin) of its windows."""
    out: list[list] = [[] for _ in texts]
    for i, s, b in zip(*(c.tolist() for c in window_bins(texts))):
        out[i].append((s, b))
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        at = 0
        for short in text_slices(batch.column(1)):
            yield batch.slice(at, len(short)), [t.as_py() or "" for t in short]
            at += len(short)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in _parts(batches):
        cols: list[list] = [[] for _ in range(8)]
        # A part's windows are counted together and stand in its first row.
        counted = [[(s, b, n) for (s, b), n in window_counts(texts).items()], *([] for _ in texts[1:])]
        for doc_id, text, extra, windows in zip(part.column(0).to_pylist(), texts, candidates(texts), counted):
            base = base_spans(text)
            kinds = [k for _, k, _ in base]
            digest = hashlib.sha256(join_spans(base, KINDS).encode()).hexdigest()
            for c, v in zip(cols, (doc_id, kinds.count(0), kinds.count(1), kinds.count(2), digest, base, extra, windows)):
                c.append(v)
        names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "extra", "windows")
        types = (*[pa.int64()] * 4, pa.string(), _SPAN, _EXTRA, _WINDOW)
        cols[5] = [[dict(zip(("start", "kind", "end"), x)) for x in v] for v in cols[5]]
        cols[6] = [[dict(zip(("start", "end", "encoding", "stratum", "bin"), x)) for x in v] for v in cols[6]]
        cols[7] = [[dict(zip(("stratum", "bin", "n"), x)) for x in v] for v in cols[7]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=list(names))


def secret_bins(found: dict[tuple[int, int], int], text: dict[tuple[int, int], int], level: float) -> list[int]:
    """Per stratum, how many of the first bins hold secrets: the most that Benjamini and Hochberg allow; 0 if none.

    ``found`` counts candidates and ``text`` windows, both by (stratum, bin). A bin's p-value
    is (1 + windows at least as random) / (1 + windows).
    """
    cut = []
    for s in range(len(STRATA)):
        total, windows = (sum(n for (st, _), n in c.items() if st == s) for c in (found, text))
        most = seen = random = 0
        for b in range(BINS):
            seen += found.get((s, b), 0)
            random += text.get((s, b), 0)
            if found.get((s, b)) and (1 + random) / (1 + windows) * total <= level * seen:
                most = b + 1
        cut.append(most)
    return cut


def find_secrets(docs: DataFrame, level: float = 0.05) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans.

    ``all_spans`` has (start, end, kind), kind being a base kind or ``random-`` and the
    inferred encoding; added spans may overlap base spans. Strings of digits alone are
    numbers and stay out, and so does what has fewer than 16 symbols. Thresholds come from the
    table's own texts, so that added spans depend on the corpus; tables of too few texts to
    tell chance from text (about 1 / ``level``) get base spans only. Strings of 16 symbols
    are too short to be told from text, of 20 most random ones are found, of 32 nearly all. A null text is empty
    and has no spans; null doc_ids and repeated rows give one row each, and all of them
    count towards the thresholds; other columns are not read; an empty table gives no rows.
    Time and memory grow in proportion to a text, however long.
    """
    scanned = docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(_scan, _SCAN).checkpoint()

    def counts(column: str, n: Column) -> dict[tuple[int, int], int]:
        seen = scanned.select(F.explode(column).alias("x")).groupBy("x.stratum", "x.bin").agg(F.sum(n).alias("n")).collect()
        return {(r["stratum"], r["bin"]): r["n"] for r in seen}

    limits = F.array(*map(F.lit, secret_bins(counts("extra", F.lit(1)), counts("windows", F.col("x.n")), level)))
    added = F.transform(
        F.filter("extra", lambda x: x["bin"] < F.element_at(limits, x["stratum"] + 1)),
        lambda x: F.struct(x["start"], F.lit(len(KINDS)).alias("kind"), x["end"], F.concat(F.lit("random-"), x["encoding"]).alias("name")),
    )
    names = F.array(*map(F.lit, KINDS))
    based = F.transform("base", lambda x: F.struct(x["start"], x["kind"], x["end"], F.element_at(names, x["kind"] + 1).alias("name")))
    spans = F.array_sort(F.concat(based, added))
    return scanned.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.transform(spans, lambda x: F.struct(x["start"], x["end"], x["name"].alias("kind"))).alias("all_spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]", level: float = 0.05) -> DataFrame:
    """The documents with every found span, base or added, replaced by a mark; n_chars follows.

    Spans that overlap become one mark. The thresholds come from one pass over all documents,
    as in ``find_secrets``; the second pass applies them text by text, so no text is shuffled.
    Each row keeps its place and its other columns, also where rows share a doc_id; a null
    text stays null.
    """
    scanned = docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(_histogram, "stratum int, bin int, candidate boolean, n long")
    seen = scanned.groupBy("stratum", "bin", "candidate").agg(F.sum("n").alias("n")).collect()
    found, text = ({(r["stratum"], r["bin"]): r["n"] for r in seen if r["candidate"] == c} for c in (True, False))
    cut = secret_bins(found, text, level)

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redact_text(t, cut, mark))

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[int, int, bool], int] = {}
    for _, texts in _parts(batches):
        for key in ((s, b, True) for found in candidates(texts) for *_, s, b in found):
            counts[key] = counts.get(key, 0) + 1
        for (s, b), n in window_counts(texts).items():
            counts[s, b, False] = counts.get((s, b, False), 0) + n
    rows = [(*key, n) for key, n in counts.items()]
    cols = list(zip(*rows)) or [[], [], [], []]
    types = (pa.int32(), pa.int32(), pa.bool_(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["stratum", "bin", "candidate", "n"])


def redact_text(text: str, cut: list[int], mark: str) -> str:
    base, (extra,) = base_spans(text), candidates([text])
    spans = sorted([(s, e) for s, _, e in base] + [(s, e) for s, e, _, st, b in extra if b < cut[st]])
    if not spans:
        return text
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(prepare(spark), sf_dir, "documents"))
    joined = F.array_join(F.transform("all_spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", joined.alias("spans"))
