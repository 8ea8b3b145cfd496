"""Reading ground truth: line formats, JSON answers, and reviewed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.text import lookup

#: Categories of reviewed rule types; others become BusinessRule.
TYPE_CATEGORY = {"BusinessRule": "BusinessRule", "Validation": "Validation", "Calculation": "Calculation", "DataTransformation": "DataMapping", "ControlFlow": "WorkflowControl"}


def _lines(docs: DataFrame) -> DataFrame:
    exploded = docs.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("p", "raw"))
    clean = F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))
    return exploded.select("doc", (F.col("p") + 1).alias("line_no"), clean.alias("line")).where("line <> '' and not startswith(line, '#')").withColumn("parts", F.split("line", r"\|", -1))


def _stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def _structured(parts: Column) -> tuple[Column, Column, Column]:
    return _stripped(parts[0]), _stripped(F.try_element_at(parts, F.lit(2))), _stripped(F.array_join(F.slice(parts, 3, 1 << 20), "|"))


def parse_strict(docs: DataFrame) -> DataFrame:
    """doc, line_no, id, category, text of ``ID | category | text`` lines of (doc, text); other lines are skipped.

    Comments begin with ``#``; further bars belong to the text; the category may be empty, id and text may not.
    """
    gid, category, text = _structured(F.col("parts"))
    rows = _lines(docs).where(F.size("parts") >= 3)
    return rows.select("doc", "line_no", gid.alias("id"), category.alias("category"), text.alias("text")).where("id <> '' and text <> ''")


def parse_lenient(docs: DataFrame) -> DataFrame:
    """As ``parse_strict``, but any other line is an entry ``GT-nnn`` (its line number) of ``Business Rules``."""
    gid, category, text = _structured(F.col("parts"))
    whole = (F.size("parts") >= 3) & (gid != "") & (text != "")
    pick = lambda a, b: F.when(whole, a).otherwise(b)
    number = F.concat(F.lit("GT-"), F.when(F.col("line_no") < 1000, F.lpad(F.col("line_no").cast("string"), 3, "0")).otherwise(F.col("line_no").cast("string")))
    return _lines(docs).select("doc", "line_no", pick(gid, number).alias("id"), pick(category, F.lit("Business Rules")).alias("category"), pick(text, F.col("line")).alias("text"))


def parse_answer(answers: DataFrame) -> DataFrame:
    """doc, pos, id, category, text of the JSON list in an answer (doc, answer); keys in any case, no list: no rows."""
    body = F.regexp_extract("answer", r"(?s)\[.*\]", 0)
    keys = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r'(?i)"id"\s*:', '"id":'), r'(?i)"category"\s*:', '"category":'), r'(?i)"ruletext"\s*:', '"ruleText":')
    listed = answers.select("doc", F.posexplode(F.from_json(F.when(F.try_parse_json(keys).isNotNull(), keys), "array<struct<id:string,category:string,ruleText:string>>")).alias("pos", "r"))
    own = F.when(F.trim(F.coalesce("r.id", F.lit(""))) != "", F.col("r.id")).otherwise(F.sha2(F.concat_ws("|", F.col("doc").cast("string"), F.col("pos").cast("string")), 256))
    return listed.select("doc", "pos", own.alias("id"), F.coalesce("r.category", F.lit("")).alias("category"), F.coalesce("r.ruleText", F.lit("")).alias("text"))


def from_review(rules: DataFrame, include_flagged: bool = False) -> DataFrame:
    """gt_id, category, text, source_ref of accepted (and flagged) rules (rule_id, type, decision, description, source_reference)."""
    wanted = ["Accepted", "Flagged"] if include_flagged else ["Accepted"]
    kept = rules.where(F.col("decision").isin(wanted))
    return kept.select(F.col("rule_id").alias("gt_id"), lookup(F.col("type"), TYPE_CATEGORY, "BusinessRule").alias("category"), F.col("description").alias("text"), F.col("source_reference").alias("source_ref"))
