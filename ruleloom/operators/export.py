"""Reports, code scaffolds and prompts as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.kernels import brackets_match
from ruleloom.functions.text import display_type, pascal_case, shortened, xml_escape


def in_order(order: list[str], line: Column, between: str = "\n") -> Column:
    """Aggregate: the lines joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), between)


def file_report(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Every file (file_id, file_name) with its rules: rules, high, accepted, types; files without rules stay."""
    per = rules.groupBy("file_id").agg(
        F.count("*").alias("rules"), F.count_if(F.col("confidence") == "High").alias("high"), F.count_if(F.col("decision") == "Accepted").alias("accepted"), F.countDistinct("type").alias("types")
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("rules", "high", "accepted", "types")]
    return files.select("file_id", "file_name").join(per, "file_id", "left").select("file_id", "file_name", *zero)


def report_rows(rules: DataFrame, most: int = 500) -> DataFrame:
    """file_id, no, rule_id, type, label, description of a report: numbered within the file, long texts shortened."""
    from pyspark.sql import Window

    order = Window.partitionBy("file_id").orderBy("rule_id")
    return rules.select("file_id", F.row_number().over(order).alias("no"), "rule_id", display_type(F.col("type")).alias("type"), "label", shortened(F.col("description"), most).alias("description"))


def markdown(rules: DataFrame) -> DataFrame:
    """file_id and a Markdown table of the file's rules."""
    cell = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[|\r\n]+", " ")
    row = F.concat_ws("", F.lit("| "), F.col("no").cast("string"), F.lit(" | "), cell("type"), F.lit(" | "), cell("label"), F.lit(" | "), cell("description"), F.lit(" |"))
    return report_rows(rules).groupBy("file_id").agg(F.concat(F.lit("| No | Type | Label | Description |\n|-|-|-|-|\n"), in_order(["no"], row)).alias("report"))


def scaffold(rules: DataFrame) -> DataFrame:
    """scope, type, source: a class file for each type of a scope's accepted rules (scope, rule_id, type, label, description)."""
    body = F.concat(
        F.lit("    /// <summary>"), xml_escape(F.coalesce("description", F.lit(""))), F.lit("</summary>\n    public void "), pascal_case(F.coalesce("label", F.lit("Rule"))), F.lit("()\n    {\n        throw new NotImplementedException();\n    }")
    )
    listed = rules.groupBy("scope", "type").agg(in_order(["rule_id"], body, "\n\n").alias("methods"))
    return listed.select("scope", "type", F.concat(F.lit("public sealed class "), "type", F.lit("Rules\n{\n"), "methods", F.lit("\n}\n")).alias("source"))


def scaffold_map(rules: DataFrame) -> DataFrame:
    """scope and a map from file name to source."""
    return scaffold(rules).groupBy("scope").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat("type", F.lit(".cs")), "source")))).alias("files"))


def balanced(source: Column) -> Column:
    """True if the brackets of a source close in the order they open, strings and comments apart; null counts as empty."""
    return F.pandas_udf(lambda s: s.map(brackets_match), "boolean")(source)


def source_text(files: DataFrame) -> DataFrame:
    """scope and the whole texts of its files (scope, file_id, file_name, text), each under its name, in order; files without text are left out."""
    part = F.concat(F.lit("=== "), "file_name", F.lit(" ===\n"), "text", F.lit("\n\n"))
    return files.where("text is not null").groupBy("scope").agg(in_order(["file_id"], part, "").alias("source"))


def context_blocks(files: DataFrame, most: int = 8000) -> DataFrame:
    """scope and the context text of its files (scope, file_id, file_name, text), each shortened, in order."""
    part = F.concat(F.lit("=== "), "file_name", F.lit(" ===\n"), F.substring("text", 1, most))
    return files.groupBy("scope").agg(in_order(["file_id"], part, "\n\n").alias("context"))


def extraction_prompt(language: Column, label: Column, profile: Column, hints: Column, context: Column, code: Column) -> Column:
    """The prompt for one chunk; null and empty parts are left out."""
    part = lambda title, c: F.when(F.length(c) > 0, F.concat(F.lit(title), c))
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("List the rules in this "), language, F.lit(" code as JSON: {\"rules\": [...]}.")),
        part("Part: ", label), part("Structure:\n", profile), part("", hints), part("Context:\n", context), F.concat(F.lit("Code:\n"), code),
    )


def chat_prompt(rules: DataFrame) -> DataFrame:
    """session_id and a system prompt that lists the session's rules (session_id, rule_id, type, label, description)."""
    from pyspark.sql import Window

    no = F.row_number().over(Window.partitionBy("session_id").orderBy("rule_id"))
    line = F.concat_ws("", F.col("no").cast("string"), F.lit(". ["), F.coalesce("type", F.lit("")), F.lit("] "), F.coalesce("label", F.lit("")), F.lit(": "), F.coalesce("description", F.lit("")))
    listed = rules.withColumn("no", no).groupBy("session_id").agg(F.count("*").alias("n"), in_order(["no"], line).alias("lines"))
    return listed.select("session_id", F.concat(F.lit("Answer about these "), F.col("n").cast("string"), F.lit(" rules.\n"), "lines").alias("prompt"))
