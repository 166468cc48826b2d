"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from popquilt.llm import ann, codes, fingerprints, jaccard, langid, lmscore, mpegts, packing, quality, secrets, spm, urlrules, whitening

QUERIES = {
    "op1_hierarchical_packing": packing.op1_hierarchical_packing,
    "op2_projection_forest": ann.op2_projection_forest,
    "op3_sentencepiece_viterbi": spm.op3_sentencepiece_viterbi,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_cross_entropy_difference": lmscore.op5_cross_entropy_difference,
    "op6_transport_streams": mpegts.op6_transport_streams,
    "op7_association_rules": urlrules.op7_association_rules,
    "op8_ngram_jaccard_join": jaccard.op8_ngram_jaccard_join,
    "op9_byte_cnn_language": langid.op9_byte_cnn_language,
    "op10_weak_label_quality": quality.op10_weak_label_quality,
    "op11_polynomial_fingerprints": fingerprints.op11_polynomial_fingerprints,
    "op12_tiled_whitening": whitening.op12_tiled_whitening,
    "op13_filtering_lloyd": codes.op13_filtering_lloyd,
    "vector_deviations": whitening.vector_deviations,
}
ORACLES: dict[str, str] = {
    "op8_ngram_jaccard_join": jaccard.OP8_SQL,
    "op11_polynomial_fingerprints": fingerprints.OP11_SQL,
    "op13_filtering_lloyd": codes.OP13_SQL,
    "vector_deviations": whitening.DEVIATIONS_SQL,
}


# Parts of operators' results that SQL can express, though it can't express the whole.


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = f"""({_KEYS})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""".replace("\\\\", "\\")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's counts of base spans."""
    return secrets.op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6's payloads as read back from the streams."""
    return mpegts.op6_transport_streams(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def given_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's hosts, paths and given rules."""
    return urlrules.op7_association_rules(spark, sf_dir).select("page_id", "host", "path", "rule")


QUERIES |= {f.__name__: f for f in (secret_counts, media_payloads, given_url_rules)}
ORACLES |= {
    "secret_counts": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(x, '{_ASSIGN}', 2), lambda v: length(v) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(x, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20)) AS n_access, len(regexp_extract_all(x, '[0-9a-f]{{24,}}')) AS n_hex FROM t""",
    "media_payloads": """WITH t AS (SELECT doc_id, coalesce(text, '') AS x, strlen(coalesce(text, '')) AS n FROM documents), p AS (SELECT *, greatest(64, (n + 63) // 64 * 64) AS m FROM t)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(x || repeat(chr(0), m - n)) AS payload_sha256 FROM p""",
    "given_url_rules": """WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, p) AS (VALUES ('com', '/en/'), ('example.com', '/en/7'), ('net', '/de/'), ('example.net', '/de/8'), ('org', '/es/'))
SELECT page_id, host, path, (SELECT arg_max(h || p, length(h || p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule FROM u""",
}
