"""Packing and SentencePiece."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from popquilt.llm import packing, spm

TEXTS = [None, "", "a", "Hello, world! " * 400, "für alle\n\nÉtudes 日本𠀀", "x" * 9000, "<|endoftext|> in a text", " \t ", "Hello, world! " * 400]


def check_pieces(rows):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    padding = 0
    for pieces in by_sequence.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == end and r["length"] > 0
            end += r["length"]
        assert end <= 2048 and {r["sequence_tokens"] for r in pieces} == {end}
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    return by_doc, padding


def test_pack_gives_each_id_once(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, length int")
    rows = packing.pack(docs).collect()
    by_doc, _ = check_pieces(rows)
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in enumerate(TEXTS):
        ids = np.array(reference.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        pieces = sorted(by_doc[i, len(ids)], key=lambda r: r["start"])
        assert [p["start"] for p in pieces] == list(np.cumsum([0] + [p["length"] for p in pieces])[:-1])
        assert sum(p["length"] for p in pieces) == len(ids)
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())


def test_pack_is_the_same_again_and_handles_repeats(spark):
    docs = spark.createDataFrame([(7, "a b c")] * 5 + [(None, "d")], "doc_id long, text string")
    one, two = packing.pack(docs).collect(), packing.pack(docs).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    assert sum(r["doc_id"] is None for r in one) == 1 and len({(r["sequence_id"], r["offset"]) for r in one}) == len(one)
    assert packing.pack(docs.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=120), st.integers(2048, 40000))
def test_packer_fills_windows(lengths, buffer):
    packer, windows = packing.Packer(), []
    for doc, n in enumerate(lengths):
        windows += packer.add(doc, n)
        if packer.tokens > buffer:
            windows += packer.flush()
    windows += packer.flush(last=True)
    seen = defaultdict(int)
    for k, (tier, window) in enumerate(windows):
        used = sum(p[2] for p in window)
        assert used <= tier and (used == tier or k == len(windows) - 1)
        for doc, start, n in window:
            seen[doc] += n
    assert [seen[d] for d in range(len(lengths))] == lengths


def test_step_groups_hold_equal_tokens():
    steps = packing.StepGroups((256, 512), 1024, 2)
    given_out = [x for k in range(9) for x in steps.add(512, [(k, 0, 512)])] + list(steps.deal(512))
    groups = defaultdict(int)
    for tier, group, _ in given_out:
        groups[group] += tier
    assert len(given_out) == 9 and all(v <= 1024 for v in groups.values()) and len(groups) == 5


SP_TEXTS = ["a", " a", "  a  b ", "a\nb\n\n c", "Ａﬁ ½", "é é", "", " ", "\x00a", "日本𠀀", " " * 40 + "x" + " " * 17, "  日", "a" * 900, "Unbelievable, tokenisation; x=1\n" * 30]


@pytest.fixture(scope="module")
def encoder():
    return spm.Encoder(spm.vocabulary())


def test_ids_are_the_librarys(encoder):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for text in SP_TEXTS:
        assert encoder.encode(text) == sp.encode(text)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_decoding_undoes_encoding(text):
    encoder = spm.Encoder(spm.vocabulary())
    if not any(0xD800 <= ord(c) < 0xE000 for c in text):
        assert encoder.decode(encoder.encode(text)) == text


def test_the_window_stays_bounded_and_parts_do_not_matter(encoder):
    text = "thequickbrownfoxjumpsoverthelazydog" * 200
    whole, parts = spm.Viterbi(encoder.v), spm.Viterbi(encoder.v)
    a = whole.push(text) + whole.finish()
    b = [i for k in range(0, len(text), 7) for i in parts.push(text[k : k + 7])] + parts.finish()
    assert a == b and parts.most <= 4 * encoder.v.longest and "".join(encoder.v.pieces[i] for i in a) == text


class Unigram:
    """A tiny unigram vocabulary."""

    kind, pieces = "unigram", ["a", "b", "ab", "ba", "aba", "bb"]
    scores = [-2.0, -2.1, -2.9, -3.3, -3.8, -3.6]
    longest = 3
    ids = {p: i for i, p in enumerate(pieces)}
    tree = spm.tree_of(ids)


def test_unigram_paths_are_the_best_of_all():
    def best(text):
        if not text:
            return 0.0
        return max(Unigram.scores[i] + best(text[len(p) :]) for p, i in Unigram.ids.items() if text.startswith(p))

    for k in range(200):
        text = "".join("ab"[k * 7919 >> j & 1] for j in range(14))
        trellis = spm.Viterbi(Unigram)
        ids = trellis.push(text) + trellis.finish()
        assert "".join(Unigram.pieces[i] for i in ids) == text
        assert sum(Unigram.scores[i] for i in ids) == pytest.approx(best(text))


def test_encode_and_decode_columns(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "abc  def\n", 5), (4, "x▁y ▁ z", 5), (4, "x▁y ▁ z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoded = spm.encode(docs)
    back = sorted(map(tuple, spm.decode(encoded).collect()), key=str)
    assert back == sorted([(d, t or "") for d, t, _ in rows], key=str)
    assert spm.encode(docs.limit(0)).count() == 0


def test_arrow_lists_are_read_from_their_own_offset():
    lists = pa.array([[1, 2], [3]], pa.list_(pa.int32()))
    assert [x.values.to_pylist() for x in lists] == [[1, 2], [3]]


@pytest.mark.parametrize("text", [" " * 2_000_000 + "a", "a" * 2_000_000, "1" * 2_000_000, "\n" * 2_000_000, "b" + " " * packing.LONG_SPACE + "c"], ids=["spaces", "letters", "digits", "lines", "limit"])
def test_very_long_runs_have_the_librarys_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.byte_bpe()(text).tolist() == exact.encode(text, add_special_tokens=False).ids
