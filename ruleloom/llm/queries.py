"""The queries pN_ over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ruleloom.llm.entity_match import match
from ruleloom.llm.leakage import aligned, leaks
from ruleloom.llm.mixing import mixture
from ruleloom.llm.near_dup import near_duplicates, pairs_of
from ruleloom.llm.packing import items, pack
from ruleloom.llm.splitting import pieces
from ruleloom.llm.survivor import confidence_level, golden, reference_level, shared, survivors
from ruleloom.llm.subjects import document_subjects
from ruleloom.llm.truncation import truncated
from ruleloom.plans.lineage import settle
from ruleloom.sources.tables import table


def _matches(spark: SparkSession, folder: str, every: bool = True) -> DataFrame:
    rules = table(spark, folder, "rules").select(F.col("rule_id").alias("id"), "label", F.col("description").alias("text"), "type")
    entries = table(spark, folder, "gt_rules").select(F.col("gt_id").alias("id"), F.col("rule_text").alias("text"))
    return match(rules, entries, every=every)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ground-truth entries and the rules that state the same: same field, amount and kind of logic."""
    return _matches(spark, folder, every=False).where("same").select(F.col("entry_id").alias("gt_id"), "rule_id")


def p1_matches(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs that reach the least cosine with their calibrated confidence, near misses included."""
    return _matches(spark, folder).select(F.col("entry_id").alias("gt_id"), "rule_id", F.round("cosine", 4).alias("cosine"), F.round("confidence", 4).alias("confidence"), "same")


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each rule with a description and the group of near-identical descriptions it belongs to."""
    groups = near_duplicates(table(spark, folder, "rules"), "rule_id", "description")
    return groups.select(F.col("id").alias("rule_id"), F.col("group_id").alias("group_rule_id"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of rules whose descriptions are the same up to small edits."""
    groups = near_duplicates(table(spark, folder, "rules"), "rule_id", "description")
    return pairs_of(groups).select(F.col("a").alias("rule_id_a"), F.col("b").alias("rule_id_b"))


#: Log-odds beyond which a value counts as cut, by (language, column); others take the default.
CUT_THRESHOLDS = {("", "description"): 2.5, ("", "migration_notes"): 2.5}
CUT_FIELDS = ["description", "migration_notes"]
MERGED_FIELDS = ["description", "confidence", "source_reference", "migration_notes"]


def _cuts(spark: SparkSession, folder: str) -> DataFrame:
    models = table(spark, folder, "sessions").select(F.col("session_id").alias("key"), F.col("model_used").alias("source"))
    rules = table(spark, folder, "rules").select("rule_id", "session_id", "source_reference", *CUT_FIELDS)
    return truncated(rules, CUT_FIELDS, "rule_id", "session_id", context=("source_reference",), sources=models, thresholds=CUT_THRESHOLDS)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The values that were cut."""
    return _cuts(spark, folder).where("is_cut").select(F.col("id").alias("rule_id"), F.col("field").alias("field_name"))


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    """For each model and column the values and the share of them that are cut."""
    cuts = _cuts(spark, folder).groupBy(F.col("source").alias("model_used"), F.col("field").alias("field_name"))
    return cuts.agg(F.count("*").alias("n_values"), F.count_if("is_cut").alias("n_cut"), F.avg(F.col("is_cut").cast("int")).alias("cut_share"))


def _winners(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rules = table(spark, folder, "rules")
    members = settle(shared(settle(near_duplicates(rules, "rule_id", "description"), "groups")), "members")
    # all texts are scored, as most are of groups, which costs less than looking for those
    cuts = _cuts(spark, folder).groupBy("id").pivot("field", CUT_FIELDS).agg(F.first(F.col("is_cut").cast("int")))
    levels = {"description": None, "migration_notes": None, "confidence": confidence_level(F.col("confidence")), "source_reference": reference_level(F.col("source_reference"))}
    return survivors(rules, members, "rule_id", "extracted_at", levels, told=cuts), rules


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """For each group of near-duplicates and field the row whose value survives."""
    winners, _ = _winners(spark, folder)
    return winners.select(F.col("group_id").alias("group_rule_id"), F.col("field").alias("field_name"), F.col("id").alias("rule_id"))


def p3_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """One surviving rule a group, each field with its best value."""
    winners, rules = _winners(spark, folder)
    return golden(settle(winners, "winners"), rules, "rule_id", MERGED_FIELDS).withColumnRenamed("group_id", "group_rule_id")


def _limit(spark: SparkSession, folder: str, purpose: str) -> tuple[int, int]:
    row = table(spark, folder, "chunk_limits").where(F.col("purpose") == purpose).select("capacity_chars", "overlap_lines").first()
    return int(row[0]), int(row[1] or 0)


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select(F.col("chunk_id").alias("id"), F.col("file_name").alias("name"), "label", "start_line", F.col("source_text").alias("text"))


def p5_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The prompt of each chunk, with its line range; only a chunk beyond the limit is divided."""
    capacity, _ = _limit(spark, folder, "pack")
    packed = pack(items(_texts(spark, folder), capacity), capacity)
    return packed.select(F.col("container").alias("prompt_id"), F.col("id").alias("chunk_id"), "piece_no", "start_line", "end_line", "n_chars")


def p5_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the prompts are: their number, the least possible number, and the share of unused characters."""
    capacity, _ = _limit(spark, folder, "pack")
    prompts = p5_prompts(spark, folder).groupBy("prompt_id").agg((F.sum("n_chars") + F.count("*") - 1).alias("used"))
    total = prompts.agg(F.count("*").alias("n_prompts"), F.sum("used").alias("used"), F.max("used").alias("fullest"))
    return total.select("n_prompts", F.ceil(F.col("used") / capacity).alias("least_prompts"), F.col("fullest").cast("long").alias("fullest"), (1 - F.col("used") / (F.col("n_prompts") * capacity)).alias("unused_share"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of oversized chunks that open a division, section, paragraph or routine: the boundaries of its pieces."""
    capacity, overlap = _limit(spark, folder, "split")
    split = pieces(_texts(spark, folder), capacity, overlap)
    return split.select(F.col("id").alias("chunk_id"), F.explode("headers").alias("line_no")).distinct()


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of oversized chunks, each with label and line range; consecutive pieces share lines."""
    capacity, overlap = _limit(spark, folder, "split")
    return pieces(_texts(spark, folder), capacity, overlap).drop("headers").withColumnRenamed("id", "chunk_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that repeat a passage of an evaluation item."""
    found = leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text")
    return found.select("item_id", F.col("id").alias("doc_id")).distinct()


def p7_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All documents and items with a similar passage: the longest aligned run and its errors, leak or not."""
    found = aligned(table(spark, folder, "documents"), table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text")
    return found.withColumnRenamed("id", "doc_id")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return mixture(docs, table(spark, folder, "mix_targets"))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture, once for each copy, with their size in tokens."""
    return _mixed(spark, folder)[0].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of each source, its size, rate and copies."""
    return _mixed(spark, folder)[1]


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "doc_labels").select(F.col("doc_id").alias("id"), "subject")
    return document_subjects(table(spark, folder, "documents"), "doc_id", "text", "code_lang", table(spark, folder, "subjects"), labels)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The subjects of each document."""
    return _subjects(spark, folder).select(F.col("id").alias("doc_id"), "subject")


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """The make-up of the corpus: documents of each subject, and its share of all assignments weighted by unit share."""
    out = _subjects(spark, folder).groupBy("subject").agg(F.count("*").alias("documents"), F.sum("share").alias("weight"))
    return out.withColumn("corpus_share", F.col("weight") / F.sum("weight").over(Window.partitionBy()))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage by name."""
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}
