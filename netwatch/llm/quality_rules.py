"""Quality rules with certified cutoffs (DataFrame functions only).

Every document gets cheap text measures. Rules such as "reject when the share of repeated words is above
c" get their cutoff c from labelled documents: half of them proposes which rules are of use, the other half
(the holdout) certifies cutoffs. A cutoff passes when the exact binomial (Clopper-Pearson) upper bound on
the share of good documents it rejects is within the rule's error budget. Cutoffs of a rule are tested from
loose to tight until the first failure (fixed-sequence testing, which needs no further correction), and the
confidence is divided among all proposed rules of all strata (Bonferroni). So with probability
``1 - delta`` no stratum loses more than ``alpha`` of its good documents to the certified rules.

Defined results: a null text counts as empty (all measures 0, base rule fails). A null stratum value counts
as the empty string. Labels that are null are left out; a document labelled more than once counts as good
only if all its labels are good; repeated document rows are judged one by one. Without labels, or with too few
for the wanted confidence, no rule is certified and only the base rule rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netwatch.llm.common import WORD, let
from netwatch.session import written

#: Rules: signal -> cutoffs from loose to tight; a document is rejected when the signal is above the cutoff.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_rate": (2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1),
    "dup_line_rate": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_rate": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "same_word_rate": (0.98, 0.95, 0.92, 0.9, 0.87, 0.85, 0.8, 0.75),
    "mean_word_chars": (40.0, 25.0, 18.0, 15.0, 13.0, 12.0, 11.0, 10.0),
    "upper_rate": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SIGNALS = tuple(RULES)


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words that lie in 3-word windows found twice or more. Windows are sorted by hash next to their equals,
    so the work is n log n for any text."""
    def covered(windows: Column) -> Column:
        last = F.size(windows) - 1
        twice = F.filter(windows, lambda x, j: (
            ((j > 0) & (F.get(windows, j - 1)["h"] == x["h"]))
            | ((j < last) & (F.get(windows, j + 1)["h"] == x["h"]))))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(
            places, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"),
                                    p.alias("last")))["n"]

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes),
                  let(ordered, covered)).otherwise(F.lit(0).cast("bigint"))


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def text_measures(docs: DataFrame, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """``keep`` columns (default: the whole row as struct ``doc``) plus the measures and the rule signals."""
    kept = [c.alias(n) for n, c in (keep or {"doc": F.struct("*")}).items()]
    names = list(keep or ["doc"])
    spaced = docs.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    worded = spaced.select(*names, "_text", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"),
                           F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)).alias("_lines"))
    w = F.col("_words")
    hashed = worded.select(
        *names, "_words", "_lines", "_text",
        F.when(F.size(w) > 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(
            F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
        .alias("_hashes"))
    # A generated row, so that a later filter on the measures can't be pushed into (and repeat) their expressions.
    counted = hashed.select(*names, F.inline(F.array(F.struct(
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(w, F.col("_hashes")).alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        F.size(F.array_distinct("_words")).alias("_n_distinct"),
        F.regexp_count("_text", F.lit("[A-Z]")).alias("_n_upper")))))
    n = F.col("n_words")
    return counted.select(
        *names, *MEASURES,
        ((n < 50) | (100 * F.col("n_repeat_words") > 50 * n)).alias("base_failed"),
        _rate(F.col("n_symbols"), n).alias("symbol_rate"),
        _rate(F.col("n_dup_lines"), F.col("_n_lines")).alias("dup_line_rate"),
        _rate(F.col("n_repeat_words"), n).alias("repeat_rate"),
        _rate(n - F.col("_n_distinct"), n).alias("same_word_rate"),
        _rate(F.col("word_chars"), n).alias("mean_word_chars"),
        _rate(F.col("_n_upper"), F.col("word_chars")).alias("upper_rate"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by seven; relative error below 1e-12 for x >= 1."""
    shift = x
    for k in range(1, 7):
        shift = shift * (x + k)
    y = x + 7
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + series - F.ln(shift)


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) of a binomial, for k <= n * p (above that the result is 1, which certifies nothing).

    The largest term comes from log factorials, the smaller ones by ratio; terms further than twelve standard
    deviations below k are under double precision, so the work grows with sqrt(n)."""
    k, n = k.cast("double"), n.cast("double")
    top = (_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)
           + k * F.ln(p) + (n - k) * F.ln(1 - p))
    steps = F.least(k, F.ceil(12 * F.sqrt(n * p) + 60)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct(
            (acc["term"] * (k - i) / (n - k + i + 1) * (1 - p) / p).alias("term"),
            (acc["sum"] + acc["term"]).alias("sum")))["sum"]
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(top + F.ln(total)))


def certify_cutoffs(measures: DataFrame, labels: DataFrame, stratum: str = "stratum", alpha: float = 0.02,
                    delta: float = 0.05, rules: dict[str, tuple[float, ...]] = RULES) -> DataFrame:
    """Certified rules: (stratum, signal, cutoff, n_good, n_rejected, bound_delta).

    ``measures``: doc_id, stratum and the signals. ``labels``: doc_id, quality (1 good, 0 bad). ``alpha`` is the
    share of good documents a stratum may lose, divided among its proposed rules.
    """
    label = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
             .agg((F.min("quality") > 0).alias("good")))
    known = measures.select("doc_id", F.col(stratum).alias("stratum"), *rules).join(label, "doc_id")
    holdout = F.pmod(F.xxhash64("doc_id", F.lit("holdout")), F.lit(2)) == 1
    levels = F.array(*[F.struct(F.lit(name).alias("signal"),
                                sum((F.col(name) > c).cast("int") for c in cuts).alias("level"))
                       for name, cuts in rules.items()])
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    counts = (known.select("stratum", "good", holdout.alias("holdout"), F.inline(levels))
              .groupBy("stratum", "signal", "level")
              .agg(one(F.col("holdout") & F.col("good")).alias("good_here"),
                   one(~F.col("holdout") & ~F.col("good")).alias("bad_here")))
    # A document of level L is rejected by the L loosest cutoffs. Levels are few, so these frames are tiny.
    depth = max(len(c) for c in rules.values())
    steps = counts.groupBy("stratum", "signal").agg(
        F.sum("good_here").alias("n_good"),
        *[F.sum(F.when(F.col("level") >= i, F.col("good_here")).otherwise(0)).alias(f"good_{i}")
          for i in range(1, depth + 1)],
        *[F.sum(F.when(F.col("level") >= i, F.col("bad_here")).otherwise(0)).alias(f"bad_{i}")
          for i in range(1, depth + 1)])
    proposed = steps.where(F.col(f"bad_{depth}") > 0).select(
        "*", F.count("*").over(Window.partitionBy("stratum")).alias("rules_here"))
    table = F.create_map(*[x for name, cuts in rules.items()
                           for x in (F.lit(name), F.array(*[F.lit(float(c)) for c in cuts]))])
    tested = (proposed.withColumn("rules_in_all", F.count("*").over(Window.partitionBy()))
              .select("stratum", "signal", "n_good", "rules_here", "rules_in_all",
                      F.posexplode(F.array(*[F.struct(F.col(f"good_{i}").alias("n_rejected"),
                                                      F.col(f"bad_{i}").alias("n_bad"))
                                             for i in range(1, depth + 1)])).alias("step", "x"))
              .select("*", "x.*", F.get(table[F.col("signal")], F.col("step")).alias("cutoff"))
              .where("cutoff IS NOT NULL")
              .withColumn("bound_delta", F.lit(delta) / F.col("rules_in_all"))
              .withColumn("passes", binomial_cdf(F.col("n_rejected"), F.col("n_good"),
                                                 F.lit(alpha) / F.col("rules_here")) <= F.col("bound_delta")))
    chain = Window.partitionBy("stratum", "signal").orderBy("step")
    certified = tested.withColumn("so_far", F.min(F.col("passes").cast("int")).over(chain)).where("so_far = 1")
    # Of the certified cutoffs, the loosest that catches as many bad proposals as any of them.
    best = Window.partitionBy("stratum", "signal").orderBy(F.desc("n_bad"), "step")
    return (certified.where("n_bad > 0").withColumn("rank", F.row_number().over(best)).where("rank = 1")
            .select("stratum", "signal", "cutoff", "n_good", "n_rejected", "bound_delta"))


def apply_cutoffs(measures: DataFrame, cutoffs: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Adds ``kept``. The cutoffs are one row per stratum and rule; the join is left to Spark, which broadcasts
    them when their measured size allows."""
    wide = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(
        F.map_from_entries(F.collect_list(F.struct("signal", "cutoff"))).alias("_cuts"))
    over = F.lit(False)
    for name in SIGNALS:
        over = over | F.coalesce(F.col(name) > F.col("_cuts")[name], F.lit(False))
    return (measures.join(wide, measures[stratum] == wide["_stratum"], "left")
            .withColumn("kept", ~F.col("base_failed") & ~over).drop("_stratum", "_cuts"))


def _strata(names: tuple[str, ...]) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])


def quality_verdicts(docs: DataFrame, labels: DataFrame, strata: tuple[str, ...] = ("lang",),
                     alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per document: doc_id, stratum, measures, base_failed, signals, kept. The measures (a few numbers a
    document) are written once, since calibration and verdicts both read them."""
    measured = written(text_measures(docs, keep={"doc_id": F.col("doc_id"), "stratum": _strata(strata)}), "quality")
    cutoffs = written(certify_cutoffs(measured, labels, alpha=alpha, delta=delta), "cutoffs")
    return apply_cutoffs(measured, cutoffs)


def quality_filter(docs: DataFrame, labels: DataFrame, strata: tuple[str, ...] = ("lang",),
                   alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The documents that the rules keep, with all their columns. The texts are measured in both passes: that is
    less work than carrying them through a shuffle to meet their verdicts."""
    measured = text_measures(docs, keep={"doc_id": F.col("doc_id"), "stratum": _strata(strata)})
    cutoffs = written(certify_cutoffs(measured, labels, alpha=alpha, delta=delta), "cutoffs")
    whole = text_measures(docs, keep={"doc": F.struct("*"), "stratum": _strata(strata)})
    return apply_cutoffs(whole, cutoffs).where("kept").select("doc.*")
