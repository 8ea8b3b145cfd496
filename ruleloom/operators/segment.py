"""Segmentation of source texts into labelled chunks, all in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions.text import estimate_tokens, family


@dataclass(frozen=True)
class ChunkSpec:
    """How one language is segmented: a boundary pattern, a label of a boundary line, and the preamble's name."""

    boundary: str
    label: str
    preamble: str


#: The boundary patterns of the three languages (Java and RE2 read them alike).
COBOL_DIVISION = r"(?i)^\s{6,7}((?:IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION)"
COBOL_PARAGRAPH = r"(?i)^\s{6,7}([A-Z][A-Z0-9-]*)\s*\.\s*$"
VB_UNIT = (
    r"(?i)^\s*(?:(?:Public|Private|Protected|Friend|Shared|Overrides|Overridable|MustOverride|Shadows|Static|ReadOnly|WriteOnly|NotInheritable|MustInherit|Partial|Abstract)\s+)*"
    r"(?:Sub|Function|Property|Class|Module|Namespace|Interface|Structure|Enum)\s+(\w+)"
)
SQL_UNIT = r"(?i)^\s*CREATE\s+(?:OR\s+ALTER\s+)?(?:PROCEDURE|PROC|FUNCTION)\s+(?:\[?[\w.]+\]?\.)?(\[?\w+\]?)"
SPECS = {
    "cobol": ChunkSpec(COBOL_DIVISION[:-1] + r"|^\s{6,7}[A-Z][A-Z0-9-]*\s*\.\s*$)", "", "PREAMBLE"),
    "vb": ChunkSpec(VB_UNIT, "", "MODULE-PREAMBLE"),
    "sql": ChunkSpec(SQL_UNIT, "", "SQL-PREAMBLE"),
}
#: Estimated tokens below which neighbours are merged, and beyond which complex chunks are split.
MERGE_BELOW, SPLIT_BEYOND = 300, 800


def lines(df: DataFrame) -> DataFrame:
    """Rows of (id, name, text) by line: id, name, family, line_no (from 1), line. Null texts have no lines."""
    return df.select("id", "name", family(F.col("name")).alias("family"), F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).select(
        "id", "name", "family", (F.col("p") + 1).alias("line_no"), "line"
    )


def is_boundary(kind: Column, line: Column) -> Column:
    """True of a line that begins a chunk in its language."""
    return (
        F.when(kind == "cobol", line.rlike(COBOL_DIVISION) | line.rlike(COBOL_PARAGRAPH))
        .when(kind == "vb", line.rlike(VB_UNIT))
        .when(kind == "sql", line.rlike(SQL_UNIT))
        .otherwise(F.lit(False))
    )


def boundary_label(kind: Column, line: Column) -> Column:
    """Label of a boundary line: division or paragraph in upper case, or the unit's name without brackets."""
    own = F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in (COBOL_DIVISION, COBOL_PARAGRAPH)])
    name = F.when(kind == "vb", F.regexp_extract(line, VB_UNIT, 1)).otherwise(F.regexp_replace(F.regexp_extract(line, SQL_UNIT, 1), r"[\[\]]", ""))
    return F.when(kind == "cobol", F.upper(own)).otherwise(name)


def segments(df: DataFrame) -> DataFrame:
    """Chunks of (id, name, text) before merging: id, name, family, seq, label, start_line, end_line, text.

    Lines before the first boundary are the language's preamble; a chunk of blank lines is dropped; a text of
    another language is one chunk ``FULL-FILE``. Each text is numbered within itself, so texts spread freely.
    """
    by_line = Window.partitionBy("id").orderBy("line_no")
    marked = lines(df).withColumn("opens", is_boundary(F.col("family"), F.col("line")))
    marked = marked.withColumn("seq", F.sum(F.col("opens").cast("int")).over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = marked.groupBy("id", "name", "family", "seq").agg(
        F.min("line_no").alias("start_line"),
        F.max("line_no").alias("end_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"),
        F.min_by("line", "line_no").alias("first"),
    )
    preamble = F.when(F.col("family") == "cobol", "PREAMBLE").when(F.col("family") == "vb", "MODULE-PREAMBLE").when(F.col("family") == "sql", "SQL-PREAMBLE").otherwise("FULL-FILE")
    label = F.when(F.col("seq") == 0, preamble).otherwise(boundary_label(F.col("family"), F.col("first")))
    return grouped.where(F.col("text").rlike(r"\S")).select("id", "name", "family", F.col("seq").cast("int").alias("seq"), label.alias("label"), "start_line", "end_line", "text")


def merged(segs: DataFrame, below: int = MERGE_BELOW) -> DataFrame:
    """Neighbouring chunks merged from the first on while their estimated tokens stay below ``below`` together.

    The fold needs the chunks of one text in order; it runs as one expression over them.
    """
    item = F.struct("seq", "label", "start_line", "end_line", "text")
    ordered = segs.groupBy("id", "name", "family").agg(F.array_sort(F.collect_list(item)).alias("s"))
    folded = ordered.withColumn(
        "m",
        F.expr(
            f"""aggregate(slice(s, 2, size(s)), named_struct('done', slice(s, 1, 0), 'held', s[0]),
            (a, x) -> if(length(a.held.text) div 4 + length(x.text) div 4 < {int(below)},
              named_struct('done', a.done, 'held', named_struct('seq', a.held.seq, 'label', concat(a.held.label, ' + ', x.label),
                'start_line', a.held.start_line, 'end_line', x.end_line, 'text', concat(a.held.text, '\\n', x.text))),
              named_struct('done', concat(a.done, array(a.held)), 'held', x)),
            a -> concat(a.done, array(a.held)))"""
        ),
    )
    return folded.select("id", "name", "family", F.posexplode("m").alias("chunk_seq", "c")).select("id", "name", "family", "chunk_seq", "c.label", "c.start_line", "c.end_line", "c.text", estimate_tokens(F.col("c.text")).alias("tokens"))


def split_complex(chunks: DataFrame, beyond: int = SPLIT_BEYOND) -> DataFrame:
    """Chunks of (id, chunk_seq, label, start_line, end_line, text): deep ones beyond the limit by top-level branch.

    A part keeps its chunk's lines and is labelled with its branch; ``tier`` is the whole chunk's.
    """
    from ruleloom.functions.kernels import analyse_blocks, split_branches

    schema = "id long, chunk_seq int, part int, label string, start_line int, end_line int, tier string, text string"

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                tier = analyse_blocks(r.text)["tier"]
                parts = split_branches(r.text) if tier in ("HIGH", "CRITICAL") and len(r.text) // 4 > beyond else [("whole", r.text)]
                for n, (name, text) in enumerate(parts):
                    rows.append((r.id, r.chunk_seq, n, r.label if len(parts) == 1 else f"{r.label} [{name}]", r.start_line, r.end_line, tier, text))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return chunks.select(F.col("id").cast("long"), "chunk_seq", "label", "start_line", "end_line", "text").mapInPandas(run, schema)
