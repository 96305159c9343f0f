"""URL verdicts: allow and block rules, and gradient-boosted trees on lexical features for what no rule covers.

A rule names a host and a path prefix, fits the host and all its subdomains, and the longest fitting rule wins. The URLs
that rules decide are the labelled examples; the trees learn from lexical features what such URLs look
like: lengths, depth, digit ratio, entropy, parameter counts, and how the host's suffixes fared among the labelled URLs.
Rules themselves need no model; the model decides all other URLs.

The trees are fitted on a bounded sample: the ``sample`` labelled URLs with the smallest hash, half of them from each
verdict. Suffix statistics and all verdicts cover every row.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the model on its
features as they are. Without labelled URLs of both verdicts the model allows what no rule covers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwatch.llm.common import LOWER, UPPER, let
from netwatch.session import written

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]
FEATURES = ("url_chars", "host_chars", "path_chars", "host_labels", "depth", "digit_rate", "host_digit_rate", "hyphens", "entropy",
            "host_entropy", "n_params", "has_fragment", "secure", "last_dot", "longest_label", "suffix1", "suffix2")
#: Weight, in URLs, of the overall share of blocked URLs in a suffix's own.
PRIOR = 20.0
#: Folds of hosts for the suffix shares of labelled URLs.
FOLDS = 5


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path) columns."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.substr(text, F.instr(text, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(verdict, rule) of the longest fitting rule; null where none fits."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + prefix).alias("rule"))).otherwise(out)
    return out


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _entropy(text: Column) -> Column:
    """Bits a character of the text."""
    def over(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
        return -F.aggregate(counts, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))
    return F.when(F.length(text) > 0, let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), over)).otherwise(F.lit(0.0))


def lexical(pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, verdict and rule of the rules, and the features but the suffix statistics."""
    base = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("_url"),
                        *[c.alias(n) for c, n in zip(parse(F.col(url)), ("host", "path"))])
    ruled = base.select("*", F.split("host", r"\.").alias("_labels"),
                        rule_of(F.col("host"), F.col("path"), rules).alias("_rule"))
    u, h, p, labels = F.col("_url"), F.col("host"), F.col("path"), F.col("_labels")
    n = F.size(labels)
    d = lambda c: c.cast("double")
    return ruled.select(
        "page_id", "host", "path", F.col("_rule.verdict").alias("verdict"), F.col("_rule.rule").alias("rule"),
        F.element_at(labels, -1).alias("_top"),
        F.when(n > 1, F.concat_ws(".", F.get(labels, n - 2), F.get(labels, n - 1))).otherwise(h).alias("_domain"),
        d(F.length(u)).alias("url_chars"), d(F.length(h)).alias("host_chars"), d(F.length(p)).alias("path_chars"),
        d(n).alias("host_labels"), d(F.regexp_count(p, F.lit("/"))).alias("depth"),
        _rate(F.regexp_count(u, F.lit("[0-9]")), F.length(u)).alias("digit_rate"),
        _rate(F.regexp_count(h, F.lit("[0-9]")), F.length(h)).alias("host_digit_rate"),
        d(F.regexp_count(h, F.lit("-"))).alias("hyphens"), _entropy(u).alias("entropy"), _entropy(h).alias("host_entropy"),
        d(F.regexp_count(u, F.lit("[?&][^=&#]*="))).alias("n_params"), d(u.contains("#")).alias("has_fragment"),
        d(u.startswith("https:")).alias("secure"), d(F.regexp_count(p, F.lit(r"\.[A-Za-z0-9]+$"))).alias("last_dot"),
        d(F.array_max(F.transform(labels, F.length))).alias("longest_label"))


def with_suffix_rates(rows: DataFrame) -> DataFrame:
    """Adds the smoothed share of blocked URLs among the labelled ones of the same last one and two host labels.

    A labelled URL gets the share of the other folds of hosts, so no URL, and no host, tells the trees its own label; all
    other URLs get the share of all folds. Counts are combined before the shuffle, and the joins' sides have a row
    a suffix with at most ``FOLDS`` entries."""
    fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")
    labelled = rows.where("verdict IS NOT NULL")
    blocked = F.sum(F.when(F.col("verdict") == "block", 1.0).otherwise(0.0))
    overall = labelled.agg(F.coalesce(blocked / F.nullif(F.count("*"), F.lit(0)), F.lit(0.5)).alias("share")).first()["share"]
    for key, name in (("_top", "suffix1"), ("_domain", "suffix2")):
        counts = (labelled.groupBy(key, fold.alias("fold")).agg(blocked.alias("blocked"), F.count("*").alias("n"))
                  .groupBy(key).agg(F.sum("blocked").alias("_blocked"), F.sum("n").alias("_n"), F.map_from_entries(
                      F.collect_list(F.struct("fold", F.struct("blocked", "n")))).alias("_folds")))
        own = F.when(F.col("verdict").isNotNull(), F.element_at("_folds", fold))
        share = ((F.col("_blocked") - F.coalesce(own["blocked"], F.lit(0.0)) + PRIOR * overall)
                 / (F.col("_n") - F.coalesce(own["n"], F.lit(0)) + PRIOR))
        rows = rows.join(counts, key, "left").withColumn(name, F.coalesce(share, F.lit(overall))).drop(
            "_blocked", "_n", "_folds")
    return rows


def fit_trees(rows: DataFrame, sample: int = 8_000, seed: int = 7) -> GBTClassificationModel | None:
    """Boosted trees on the bounded sample; None if one of the verdicts has no URL."""
    order = F.xxhash64("url_chars", "host", "path", "page_id")
    both = [rows.where(F.col("verdict") == v).orderBy(order, "page_id").limit(sample // 2) for v in ("allow", "block")]
    train = both[0].union(both[1]).select((F.col("verdict") == "block").cast("double").alias("label"), *FEATURES)
    train = written(train, "labelled")
    if train.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, seed=seed, cacheNodeIds=False).fit(
        VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train))


def url_verdicts(pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url",
                 sample: int = 8_000) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score: the rules' verdict, else the trees'."""
    rows = with_suffix_rates(written(lexical(pages, rules, page_id, url), "urls"))
    model = fit_trees(rows, sample)
    if model is None:
        scored = rows.withColumn("block_score", F.lit(0.0))
    else:
        from pyspark.ml.functions import vector_to_array

        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        scored = model.transform(vectors).withColumn("block_score", vector_to_array("probability")[1])
    by_model = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_model).alias("verdict"), "block_score")
