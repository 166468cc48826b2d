"""Transport streams, nearest neighbours, URL rules, and the registered queries."""

import hashlib
import zlib
from urllib.parse import urlsplit

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from popquilt.llm import ann, mpegts, queries, urlrules

# Transport streams


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000))
def test_streams_give_their_payload_back(data):
    stream = mpegts.mux(data)
    assert len(stream) % mpegts.PACKET == 0 and set(stream[:: mpegts.PACKET]) == {0x47}
    read = mpegts.demux(stream)
    assert read.payload == data and (read.lost, read.repeated, read.damaged, read.bad_tables) == (0, 0, 0, 0)
    assert read.programs == {1: mpegts.PMT_PID} and read.streams == {mpegts.DATA_PID: mpegts.STREAM_TYPE_PRIVATE}
    stamps = [u[0] for u in read.units[mpegts.DATA_PID]]
    assert stamps == [k * mpegts.TICKS for k in range(-(-len(data) // mpegts.UNIT))]
    assert [u[2] for u in read.units[mpegts.DATA_PID]] == [k % mpegts.KEY_EVERY == 0 for k in range(len(stamps))]


def test_losses_and_damage_are_seen():
    data = bytes(range(256)) * 64
    rows = [mpegts.mux(data)[k : k + 188] for k in range(0, len(mpegts.mux(data)), 188)]
    assert mpegts.demux(b"".join(rows[:9] + rows[11:])).lost == 2
    again = mpegts.demux(b"".join(rows[:9] + rows[8:]))
    assert again.repeated == 1 and again.payload == data
    broken = bytearray(b"".join(rows))
    broken[10] ^= 1
    assert mpegts.demux(bytes(broken)).bad_tables == 1
    assert mpegts.demux(b"\0" * 188).damaged == 1 and mpegts.demux(b"").packets == 0


def test_large_stamps_and_crc():
    pts = (1 << 33) - 5
    stream = mpegts.TABLES + mpegts._packets(mpegts.pes_packet(b"x", pts), mpegts.DATA_PID, 0, True).tobytes()
    assert mpegts.demux(stream).units[mpegts.DATA_PID] == [(pts, 2, True)]
    assert mpegts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_stream_query_rows(spark, tmp_path):
    texts = [None, "", "ä" * 32, "x" * 63, "x" * 65, "long " * 60_000, "x" * 65]
    rows = [(i if i else None, t, "c") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, media string").write.parquet(str(tmp_path / "documents.parquet"))
    got = mpegts.op6_transport_streams(spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r["doc_id"] or 0] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(mpegts.mux(payload)).hexdigest()
    assert len({r["feature"] for r in got if r["doc_id"] in (4, 6)}) == 1
    read = mpegts.read_media(mpegts.encode_media(spark.createDataFrame(rows[2:], "doc_id long, text string, media string"))).collect()
    assert all(bytes(r["payload"]).rstrip(b"\0") == texts[r["doc_id"]].encode() for r in read)


def test_streams_of_odd_rows(spark):
    rows = [(None, "a", "m"), (1, None, "m"), (1, None, "m"), (2, "", "m"), (3, "x" * 3_000_000, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    made = mpegts.encode_media(docs)
    back = mpegts.read_media(made).collect()
    assert sorted((str(r["doc_id"]), len(r["payload"])) for r in back) == [("1", 64), ("1", 64), ("2", 64), ("3", 3_000_000), ("None", 64)]
    assert mpegts.read_media(mpegts.encode_media(docs.limit(0))).count() == 0


# Nearest neighbours


def brute(ids, x, k=5, every=50):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def rows_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_few_vectors_are_searched_exactly(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[200:260] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(1000, None, 0), (1050, [0.0] * 16, 0), (1100, [float("nan")] * 16, 0), (1150, [None] + [1.0] * 15, 0), (1200, [float("inf")] * 16, 0), (None, [1.0] * 16, 0)]
    got = rows_of(ann.nearest(vectors(spark, rows + odd)))
    want = brute(np.arange(400), x.astype(np.float64))
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [v for v, _ in got[q]] == [v for v, _ in near]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in near], abs=1e-12)
    assert [v for v, _ in got[100]] == [200, 201, 202, 203, 204]


def test_forest_finds_nine_of_ten(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 64)).astype(np.float32)
    x[1000:2000] = x[7]  # a hot vector
    got = rows_of(ann.nearest(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])))
    want = brute(np.arange(6000), x.astype(np.float64))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in near}) for q, near in want.items())
    assert got.keys() == want.keys() and hits >= 0.9 * 5 * len(want)


def test_a_repeated_id_takes_one_place(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(46, 8)).astype(np.float32)
    x[40:] = x[0] + 0.01 * rng.normal(size=(6, 8))
    ids = np.array([*range(40), *[7] * 6])
    got = rows_of(ann.nearest(vectors(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, x)])))
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    best = {}
    for i, s in zip(ids[1:].tolist(), unit[1:] @ unit[0]):
        best[i] = max(best.get(i, -2), s)
    assert [v for v, _ in got[0]] == sorted(best, key=lambda i: -best[i])[:5] and got[0][0][0] == 7
    assert ann.least_ids(x[[0, 0, 0, 1, 0]].astype(np.float64), np.array([5, 3, 3, 9, 1]), 2).tolist() in ([4, 1, 3], [4, 2, 3])


def test_structured_vectors_need_few_rows(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(60, 16))
    x = (centre[np.arange(6000) % 60] + 0.05 * rng.normal(size=(6000, 16))).astype(np.float32)
    ids = np.arange(6000)
    want = brute(ids, x.astype(np.float64))
    df = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]).repartition(4)
    got = rows_of(ann.nearest(df, leaf_rows=100, recall=0.95))
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in near}) for q, near in want.items()) >= 0.9 * 5 * len(want)
    unit = ann._unit(x.astype(np.float64))
    trees = [ann.build_tree(unit, np.random.default_rng(s), 100) for s in range(8)]
    leaves = np.stack([t.leaf_of(unit) for t in trees], axis=1)
    sizes = {(t, int(n)): int(c) for t in range(8) for n, c in zip(*np.unique(leaves[:, t], return_counts=True))}
    needed = [n for q, near in want.items() for n in ann.needed_rows(trees, sizes, unit[q], [leaves[v].tolist() for v, _ in near])]
    assert np.quantile(needed, 0.95) < 3000


def test_tiny_and_repeated_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [-1.0, 0.0], 1)]
    assert rows_of(ann.nearest(vectors(spark, rows))) == {0: [(1, pytest.approx(2**-0.5)), (2, -1.0)]}
    assert ann.nearest(vectors(spark, rows).limit(0)).count() == 0
    assert ann.nearest(vectors(spark, [(1, [1.0], 0)])).count() == 0


# URL rules

URLS = [
    None, "", "no scheme", "http://A.Example.COM/en/7?x=1", "https://example.com/en/8#t", "http://example.net/de/81", "http://x.example.net/de/9", "http://notnet/de/", "http://b.org/es/",
    "http://b.org/es", "ftp://com?/en/", "x://y://com/en/", "http://com/en/", "http://xcom/en/", "http://EXAMPLE.com/EN/", "http://a.com/en/\nb",
]


def expected_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((k for k in (path.find(c) for c in "?#") if k >= 0), default=len(path))]
    fit = [(len(h + p), h + p, v) for v, h, p in urlrules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


def test_given_rules(spark):
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS)] + [(None, URLS[3], "r")], "page_id long, url string, rule string")
    labels = spark.createDataFrame([], "url_number long, bad boolean")
    rows = urlrules.judge(pages, labels).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path, rule, verdict = expected_rule(URLS[3 if r["page_id"] is None else r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert urlsplit(URLS[3]).hostname == expected_rule(URLS[3])[0]
    assert urlrules.judge(pages.limit(0), labels).count() == 0


def test_mined_rules_block_their_combinations(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        host = "shop.example.edu" if bad or i % 4 == 1 else f"h{i % 7}.example.gov"
        rows.append((i, f"http://{host}/p/{i}" + ("?promo=1" if bad or i % 4 == 2 else "")))
        labels.append((i, bad))
    rows += [(900, "http://shop.example.edu/q/999999?promo=7"), (901, "http://shop.example.edu/q/999999")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in urlrules.judge(pages, spark.createDataFrame(labels, "url_number long, bad boolean"), confidence=0.9).collect()}
    assert got[900]["verdict"] == "block" and got[901]["verdict"] == "allow" and got[900]["rule"] is None
    assert set(got[900]["mined"].split()) == {"host=shop.example.edu", "param=promo"} or len(got[900]["mined"].split()) == 2
    assert all((got[i]["verdict"] == "block") == (i % 4 == 0) for i in range(400))


def test_mining_is_brute_force(spark):
    from itertools import combinations

    rng = np.random.default_rng(9)
    data = [(sorted({f"t{k}" for k in rng.integers(0, 6, 3)}), bool(rng.random() < 0.5)) for _ in range(80)]
    share = sum(b for _, b in data) / len(data)
    for confidence, lift, errors in ((0.6, 1.0, 0.0), (0.0, 1.2, 0.0), (0.0, 1.0, 0.8), (0.5, 1.1, 0.5)):
        mined = urlrules.mine_rules(spark.createDataFrame(data, "tokens array<string>, bad boolean"), 0.03, confidence, lift, errors, least=1)
        got = {tuple(r["antecedent"]): r["confidence"] for r in mined.collect()}
        rules = {}
        for n in (1, 2, 3):
            for a in combinations([f"t{k}" for k in range(6)], n):
                own = [b for t, b in data if set(a) <= set(t)]
                good = own and sum(own) / len(data) >= 0.03 and sum(own) / len(own) >= max(confidence, lift * share)
                if good and sum(own) / len(own) - share >= errors * (share * (1 - share) / len(own)) ** 0.5 and not any(set(r) < set(a) for r in rules):
                    rules[a] = sum(own) / len(own)
        assert got == pytest.approx(rules) and rules


def test_frequent_sets_change_nothing(spark, monkeypatch):
    urls = [f"http://{h}.test/{p}/{k}" for k, (h, p) in enumerate((h, p) for h in ("bad", "fine") for p in ("x", "y") for _ in range(40))]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(k, "bad" in u and "/x/" in u) for k, u in enumerate(urls) if k % 2], "url_number long, bad boolean")
    rows = {}
    for share in (1e-3, 2.0):
        monkeypatch.setattr(urlrules, "FREQUENT", share)
        rows[share] = sorted(map(tuple, urlrules.judge(pages, labels).collect()))
    assert rows[1e-3] == rows[2.0]
    assert [r[0] for r in rows[2.0] if r[4] == "block"] == list(range(40))


def test_long_hosts_are_read_in_proportion(spark):
    import time

    host = ".".join(f"l{k}" for k in range(100_000)) + ".org"
    pages = spark.createDataFrame([(1, f"http://{host}/es/1"), (2, f"http://{host}/de/1")], "page_id long, url string")
    began = time.time()
    rows = {r["page_id"]: r for r in urlrules.judge(pages, spark.createDataFrame([(1, True)], "url_number long, bad boolean")).collect()}
    assert rows[1]["rule"] == "org/es/" and rows[2]["rule"] is None and rows[2]["host"] == host and time.time() - began < 60


# The registry


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", ["secret_counts", "media_payloads", "given_url_rules"])
def test_parts_of_results_match_sql(spark, name, tmp_path):
    import duckdb

    texts = [None, "", "a", "x" * 64, "é" * 40, 'PassWord = "abcdef" API_key:12345 apikey=abcdefg', "AKIA" + "B" * 16 + " AKIA" + "C" * 15, "ab" * 13 + " " + "ab" * 11, "token token=  secretsecret"]
    urls = [None, "", "no", "http://A.Example.COM/en/7?x=1", "http://example.net/de/81", "http://x.net/de/9", "http://b.org/es/", "x://y://com/en/", "http://com/en/\nb"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
