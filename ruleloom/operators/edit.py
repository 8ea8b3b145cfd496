"""Edit requests: reading them from chat answers, previewing and applying them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.kernels import apply_edit, line_diff, parse_response

CHANGE = "array<struct<description:string,original:string,modified:string>>"
REQUEST = f"id long, plain_text string, intent string, file string, changes {CHANGE}"


def edit_requests(df: DataFrame) -> DataFrame:
    """id, plain_text, intent, file, changes of answers (id, answer); without a request the last three are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, answer in zip(batch["id"], batch["answer"], strict=True):
                plain, edit = parse_response(answer or "")
                rows.append((i, plain, *((edit["intent"], edit["file"], edit["changes"]) if edit else (None, None, None))))
            yield pd.DataFrame(rows, columns=["id", "plain_text", "intent", "file", "changes"])

    return df.select("id", "answer").mapInPandas(run, REQUEST)


def diffs(df: DataFrame) -> DataFrame:
    """id, no, kind, line of the line diff of rows (id, before, after); null counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, k, x) for i, a, b in zip(batch["id"], batch["before"], batch["after"], strict=True) for n, (k, x) in enumerate(line_diff(a or "", b or ""))]
            yield pd.DataFrame(rows, columns=["id", "no", "kind", "line"])

    return df.select("id", "before", "after").mapInPandas(run, "id long, no int, kind string, line string")


def applied(df: DataFrame) -> DataFrame:
    """id, success, content, error of rows (id, content, changes): all changes or none.

    A change that is only found over white space across other line ends counts as success and changes nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *apply_edit(c or "", [] if ch is None else list(ch))) for i, c, ch in zip(batch["id"], batch["content"], batch["changes"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", "success", "content", "error"])

    return df.select("id", "content", F.col("changes").cast(CHANGE).alias("changes")).mapInPandas(run, "id long, success boolean, content string, error string")


def applied_to_files(requests: DataFrame, files: DataFrame, at: str) -> DataFrame:
    """id, success, error, path, content, backup_path, backup of requests (id, scope, file, changes) on files (scope, file_name, path, content).

    A request names a file of its scope, without case; of several the first path is taken. Nothing is written and no
    backup made unless all changes can be located; then ``content`` is the new text of ``path`` and ``backup`` the
    old one, kept at ``backup_path`` (the path, ``.bak_`` and the time ``at``). A request without changes succeeds.
    """
    own = files.select("scope", F.lower("file_name").alias("name"), "path", "content").groupBy("scope", "name").agg(F.min_by(F.struct("path", "content"), "path").alias("f"))
    found = requests.withColumn("name", F.lower("file")).join(own, ["scope", "name"], "left")
    done = applied(found.select("id", F.col("f.content").alias("content"), "changes"))
    out = found.select("id", "file", "f").join(done, "id")
    missing = F.when(F.col("f").isNull(), F.concat(F.lit("file not in session: "), F.coalesce("file", F.lit("")))).when(F.col("f.content").isNull(), F.concat(F.lit("file has no text: "), "f.path"))
    ok = missing.isNull() & F.col("success")
    return out.select(
        "id", ok.alias("success"), F.coalesce(missing, "error").alias("error"), F.col("f.path").alias("path"), F.when(ok, F.col("content")).otherwise(F.col("f.content")).alias("content"),
        F.when(ok, F.concat("f.path", F.lit(".bak_" + at))).alias("backup_path"), F.when(ok, F.col("f.content")).alias("backup"),
    )
