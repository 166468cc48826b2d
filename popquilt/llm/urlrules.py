"""URL filter: given host and path rules, and association rules that FP-growth mines from labels.

Given rules decide where one fits; the longest wins. Elsewhere the mined rules decide. URLs
become small sets of tokens (host, parent domains, first path segment, shape of the path,
names of parameters). Labelled URLs' sets, each with its class as one more item, are mined by
Spark's FP-growth; rules that conclude "bad" are pruned by support, by confidence, by how far
they exceed the share of bad URLs among all labelled ones (lift, and standard errors), and
where a rule with fewer tokens says the same. The rest go into an inverted index under their
rarest token. Distinct token sets look their tokens up there, and URLs join their set's
verdict, so that many URLs of one host cost one look-up; the few sets that many URLs share
are joined apart. All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popquilt.llm.common import prepare, table

#: The given rules (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
BAD = "class=bad"
#: A token set is frequent where it is one of at least this share of all URLs; there are at most the reciprocal of such sets.
FREQUENT = 1 / 1000
#: Parent domains have at most so many labels, and so many names of parameters (in order) are tokens by themselves; a longer
#: host or list of names is one more token. A set thus has a dozen tokens, and what FP-growth makes of it is bounded.
LABELS, NAMES = 4, 4
#: A host or list of names that is longer than this is known by its digest.
SPELT = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(rules: tuple[tuple[str, str, str], ...]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits columns host and path, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a URL; digits in the path's shape are one sign.

    A host has itself and its parent domains of up to LABELS labels.
    """
    spelt = lambda c: F.when(F.length(c) > SPELT, F.sha2(c, 256)).otherwise(c)
    labels = F.split(F.substring_index(host, ".", LABELS * -1), r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), spelt(F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    )
    parents = F.array_append(parents, F.concat(F.lit("host="), spelt(host)))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    first = F.when(F.size(segments) > 0, F.array(F.concat(F.lit("first="), spelt(F.regexp_replace(F.element_at(segments, 1), "[0-9]+", "#")))))
    shape = F.array(F.concat(F.lit("shape="), spelt(F.regexp_replace(F.regexp_replace(path, "[0-9]+", "#"), "[A-Za-z]+", "a"))))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    names = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.regexp_extract(p, "(?s)^([^=]*)", 1))))
    params = F.array_append(F.slice(names, 1, NAMES), F.array_join(names, "&"))
    names = F.when(F.size(names) > 0, F.transform(params, lambda p: F.concat(F.lit("param="), spelt(p))))
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(parents, F.coalesce(first, none), shape, F.coalesce(names, none))))


def mine_rules(labelled: DataFrame, support: float = 0.001, confidence: float = 0.5, lift: float = 1.5, errors: float = 4.0, least: int = 5) -> DataFrame:
    """(antecedent, confidence, support) of the rules that conclude ``bad``, from (tokens, bad).

    A rule has at least the share ``support`` of all rows, and ``least`` rows, to support it.
    Its confidence is at least ``confidence``, ``lift`` times the share of bad rows, and
    ``errors`` standard errors (of that share in as many rows as have the rule's tokens)
    above it. An empty table, or one without bad rows, gives no rules. A rule goes where
    another one's tokens are a part of its own.
    """
    spark = labelled.sparkSession
    sets = labelled.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    rows, bad = labelled.agg(F.count(F.lit(1)), F.count(F.when(F.col("bad"), 1))).first()
    if not bad:
        return spark.createDataFrame([], "antecedent array<string>, confidence double, support double")
    share = bad / rows
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / rows)), minConfidence=min(1.0, max(confidence, lift * share))).fit(sets)
    own = F.col("support") * rows / F.col("confidence")  # rows that have the rule's tokens
    rules = (
        model.associationRules.filter(F.array_contains("consequent", BAD) & (F.col("support") * rows >= least - 0.5))
        .filter(F.col("confidence") - share >= errors * F.sqrt(share * (1 - share) / own))
        .select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
        .checkpoint()
    )
    part = rules.select(F.element_at("antecedent", 1).alias("token"), F.col("antecedent").alias("part"))
    wider = (
        rules.select("antecedent", F.explode("antecedent").alias("token"))
        .join(part, "token")
        .filter((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0))
        .select("antecedent")
        .distinct()
    )
    return rules.join(wider, "antecedent", "left_anti")


def matched_sets(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined): the token sets that hold all tokens of a rule, and the most confident such rule.

    ``sets`` has distinct ``tokens``. A rule stands in the index under its token that is in
    the fewest sets.
    """
    counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").count()
    index = (
        rules.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
        .join(counts, "token")
        .groupBy("antecedent", "confidence")
        .agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    )
    hits = (
        sets.select("tokens", F.explode("tokens").alias("token"))
        .join(index, "token")
        .filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    )
    said = F.array_join("antecedent", " ")
    return hits.groupBy("tokens").agg(F.max_by(said, F.struct("confidence", said)).alias("mined"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, **mining: float) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) for every row of ``pages``; ``mining`` goes to ``mine_rules``.

    ``labels`` has (url_number, bad): the label of URLs with that number as the last number
    of their path. A null url, or one without ``://``, has empty host and path; no given rule
    fits it. ``mined`` is the mined rule that blocks the page where no given rule fits, or
    null. Nulls in page_id stay, repeated rows give repeated rows, other columns are not
    read, and an empty table gives no rows. What is made of a URL grows in proportion to it.
    """
    url = F.col("url")
    parsed = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), url, host_of(url).alias("host"), path_of(url).alias("path"))
        .withColumn("tokens", tokens_of(url, F.col("host"), F.col("path")))
        .withColumn("given", given_rule(rules))
    )
    number = F.regexp_extract("path", r"([0-9]{1,18})[^0-9]*$", 1)
    numbered = parsed.filter("host <> ''").withColumn("url_number", F.expr("try_cast(nullif(regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1), '') as bigint)"))
    labelled = numbered.filter(number != "").join(labels.groupBy("url_number").agg(F.max("bad").alias("bad")), "url_number").select("tokens", "bad")
    mined = mine_rules(labelled, **mining)
    open_sets = parsed.filter("given is null").groupBy("tokens").agg(F.count(F.lit(1)).alias("urls"))
    matched = open_sets.select("tokens", "urls").join(matched_sets(open_sets.select("tokens"), mined), "tokens")
    # Frequent sets are at most 1 / FREQUENT rows; the URLs that have one of them are not dealt by it in the join of the rest.
    frequent = open_sets.filter(F.col("urls") >= FREQUENT * pages.count()).select(F.col("tokens").alias("known"))
    frequent = frequent.join(matched.select(F.col("tokens").alias("known"), F.col("mined").alias("known_mined")), "known", "left")
    apart = parsed.join(F.broadcast(frequent), F.col("tokens") == F.col("known"), "left")
    dealt = F.when(F.col("known").isNull() & F.col("given").isNull(), F.xxhash64("tokens")).otherwise(F.xxhash64("page_id", "url"))
    rest = matched.select(F.col("tokens").alias("set"), "mined", F.xxhash64("tokens").alias("dealt"))
    found = apart.withColumn("by", dealt).join(rest, (F.col("by") == F.col("dealt")) & (F.col("tokens") == F.col("set")), "left")
    said = F.coalesce("known_mined", "mined")
    hit = F.col("given").isNull() & said.isNotNull()
    return found.select(
        "page_id", "host", "path", F.col("given.rule").alias("rule"),
        F.coalesce(F.col("given.verdict"), F.when(hit, "block").otherwise("allow")).alias("verdict"),
        F.when(hit, said).alias("mined"),
    )


def op7_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("url_number"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge(table(spark, sf_dir, "pages"), labels.filter("bad is not null"))
