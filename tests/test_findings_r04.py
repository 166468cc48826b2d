"""The n-gram join's candidates: those that met by chance, and copies, take no part in the comparison."""

import random

import numpy as np
import pyarrow as pa
import pytest

from popquilt.llm import jaccard
from popquilt.llm.common import prepare


def compared(spark, monkeypatch, texts):
    """The documents whose texts are compared, and the component of each document."""
    seen, units = [], jaccard.work_units

    def kept(sets, clusters, least):
        seen.extend(r["node"] for r in clusters.collect())
        return units(sets, clusters, least)

    monkeypatch.setattr(jaccard, "work_units", kept)
    docs = prepare(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, sketch_bits=4).collect()}
    return sorted(seen), [found[k] for k in range(len(texts))]


def text(rng, words=40):
    return " ".join(f"w{rng.randrange(10**9)}" for _ in range(words))


def test_f1_f2_passages_that_two_share_join_no_documents(spark, monkeypatch):
    """Each shares a passage of five words with the next; a sketch of 16 places can't tell it from what is in one alone."""
    rng = random.Random(1)
    links = [text(rng, 5) for _ in range(41)]
    texts = [f"{links[k]} {text(rng)} {links[k + 1]}" for k in range(40)]
    nodes, component = compared(spark, monkeypatch, [*texts, text(rng, 60), f"{texts[7]} more"])
    assert nodes == [7, 41]
    assert component == [*range(41), 7]


def test_f1_f2_copies_are_stood_for_by_their_first(spark, monkeypatch):
    rng = random.Random(2)
    a, b = text(rng), text(rng)
    texts = [a] * 9 + [b] * 9 + [f"{a} more"]
    nodes, component = compared(spark, monkeypatch, texts)
    assert nodes == [0, 18]
    assert component == [0] * 9 + [9] * 9 + [0]


@pytest.mark.parametrize(("chunk", "batch"), [(1 << 20, 1000), (6, 1), (7, 3), (11, 4)])
def test_f1_f2_pairs_of_prefix_entries(monkeypatch, chunk, batch):
    """As by a plain loop over n-grams, wherever the batches and what waits are cut."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    entries = sorted({(int(g), int(n), int(d)) for g, n, d in zip(rng.geometric(0.06, 400), rng.integers(2, 9, 400), rng.integers(0, 60, 400))})
    runs, expected = {}, []
    for g, n, d in entries:
        runs.setdefault(g, []).append((n, d))
    assert {len(r) > jaccard.FEW for r in runs.values()} == {True, False}
    for run in runs.values():
        few = len(run) <= jaccard.FEW
        for i, (n, d) in enumerate(run):
            for m, e in run[i + 1 :] if few else run[i + 1 : i + 2]:
                if d != e and 100 * n >= 80 * m:
                    expected.append((min(d, e), max(d, e), min(jaccard.COMMON, -(-n * 80 // 100)) if few else 0))
    gram, n, ids = (np.array(c, np.int64) for c in zip(*entries))
    batches = [pa.record_batch([pa.array(gram[k : k + batch]), pa.array(ids[k : k + batch]), pa.array(n[k : k + batch].astype(np.int32))], ["gram", "doc_id", "n"]) for k in range(0, len(gram), batch)]
    got = [tuple(r.values()) for out in jaccard._met(80)(iter(batches)) for r in out.to_pylist()]
    assert sorted(got) == sorted(expected)


def test_f1_one_of_each_compares_near_copies_only(spark, monkeypatch):
    rng = random.Random(4)
    links = [text(rng, 5) for _ in range(21)]
    texts = [f"{links[k]} {text(rng)} {links[k + 1]}" for k in range(20)]
    texts += [*texts[:6], f"{texts[3]} more", None, ""]
    seen, units = [], jaccard.work_units

    def kept(sets, clusters, least):
        seen.append(clusters.count())
        return units(sets, clusters, least)

    monkeypatch.setattr(jaccard, "work_units", kept)
    docs = prepare(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(docs).collect()) == [*range(20), 27, 28]
    assert seen == [2]
