"""Evaluation of extracted rules against ground truth: metrics, categories, diagnoses and guidance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.operators.similarity import MATCH_FROM


def ratio(a: Column, b: Column) -> Column:
    """a / b in single precision, 0 if b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("float") / b.cast("float")).cast("float")


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1 columns with a guard against empty denominators."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)).cast("float").alias("f1")]


def overall(matches: DataFrame, rules: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1. Misses are counted on distinct ids."""
    tp = matches.agg(F.count("*").alias("tp"))
    fp = rules.join(matches, "rule_id", "left_anti").agg(F.count("*").alias("fp"))
    fn = entries.join(matches, "gt_id", "left_anti").agg(F.count("*").alias("fn"))
    return tp.crossJoin(fp).crossJoin(fn).select("tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def by_category(matches: DataFrame, rules: DataFrame, entries: DataFrame) -> DataFrame:
    """category (folded), tp, fp, fn, precision, recall, f1 of every type and category that counts anything.

    A match counts for its rule's type and for its entry's category, once if they are the same.
    """
    both = matches.join(rules.select("rule_id", "type"), "rule_id").join(entries.select("gt_id", "category"), "gt_id")
    side = F.array_compact(F.array_distinct(F.array(F.lower("type"), F.lower("category"))))
    tp = both.select(F.explode(side).alias("category"), F.lit(1).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn"))
    fp = rules.join(matches, "rule_id", "left_anti").select(F.lower("type").alias("category"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))
    fn = entries.join(matches, "gt_id", "left_anti").select(F.lower("category").alias("category"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn"))
    sums = tp.unionByName(fp).unionByName(fn).where("category <> ''").groupBy("category").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return sums.select("category", "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def plain_extra() -> Column:
    """Why a rule (confidence, text) matched nothing, as far as the rule alone tells; else null."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    return (
        F.when(F.col("confidence") == "Low", "low confidence reported")
        .when(F.length(text) < 40, "very short description")
        .when(text.rlike("display|print|filler|trace|log"), "infrastructure output or padding")
    )


def diagnose_extra(unmatched: DataFrame, best: Column, threshold: float = MATCH_FROM) -> Column:
    """Why a rule (confidence, text) matched nothing; ``best`` is its best similarity to any entry, null without any."""
    similar = F.when(F.coalesce(best, F.lit(0.0)) < 0.15, "no similar entry").otherwise(F.format_string("best similarity %.2f, below the threshold of %.2f", best, F.lit(float(threshold))))
    return F.coalesce(plain_extra(), similar)


def plain_missed(types: list[str]) -> Column:
    """Why an entry (category, text) was not found, as far as the entry alone tells; else null."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    return (
        F.when(~F.coalesce(F.lower("category").isin(types), F.lit(False)), F.concat(F.lit("no extracted rule of category "), F.coalesce("category", F.lit(""))))
        .when(F.size(F.split(F.coalesce("text", F.lit("")), " ", -1)) < 8, "very short text")
        .when(text.rlike("nested|recursive|loop|iteration"), "iterative or nested logic")
    )


def diagnose_missed(types: list[str], best: Column) -> Column:
    """Why an entry (category, text) was not found; ``types`` are the extracted rule types, folded, ``best`` its best similarity to any rule."""
    similar = F.when(F.coalesce(best, F.lit(0.0)) < 0.10, "no overlapping rule").otherwise(F.format_string("best similarity %.2f, found in part", best))
    return F.coalesce(plain_missed(types), similar)


def guidance(total: DataFrame, extra_reasons: DataFrame, missed: DataFrame, categories: DataFrame) -> DataFrame:
    """(no, advice) from the overall scores, the reasons and the categories.

    Every reason that holds the letters ``low`` counts as low confidence, also ``below the threshold``.
    """
    low = extra_reasons.agg(F.count_if(F.lower("reason").contains("low")).alias("low"))
    absent = missed.where(F.lower("reason").contains("category")).agg(F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("absent"))
    worst = categories.agg(F.min(F.struct("f1", "category")).alias("worst"))
    row = total.crossJoin(low).crossJoin(absent).crossJoin(worst)
    advice = F.array_compact(
        F.array(
            F.when(F.col("recall") < 0.6, F.lit("recall is low: add source files or lower the complexity threshold")),
            F.when(F.col("precision") < 0.6, F.lit("precision is low: review what is suppressed")),
            F.when(F.col("low") >= 2, F.concat(F.col("low").cast("string"), F.lit(" low-confidence extras: tell the extractor to omit them"))),
            F.when(F.col("absent") != "", F.concat(F.lit("categories never extracted: "), "absent")),
            F.when(F.col("worst.f1") < 0.5, F.concat(F.lit("worst category: "), F.col("worst.category"))),
        )
    )
    listed = F.when(F.size(advice) == 0, F.array(F.lit("results look good"))).otherwise(advice)
    return row.select(F.posexplode(listed).alias("no", "advice"))
