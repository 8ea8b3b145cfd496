"""Kernels as SQL functions: register them to use them in ``spark.sql``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ruleloom.functions import kernels as K

EDIT = "struct<intent:string,file:string,changes:array<struct<description:string,original:string,modified:string>>>"


class _SplitBranches:
    def eval(self, code: str) -> Iterator[tuple[int, str, str]]:
        for n, (label, text) in enumerate(K.split_branches(code or "")):
            yield n, label, text


def register(spark: SparkSession) -> list[str]:
    """Register the functions with the session and return their names.

    ``lcs_length``, ``lcs_ratio``, ``repair_json``, ``line_diff`` (an array of kind and line), ``parse_edit``,
    ``block_tier`` and ``brackets_match`` take Arrow batches; ``split_branches`` is a table function (part, label, code).
    Null texts count as empty.
    """
    each = lambda f: lambda s: pd.Series([f(x or "") for x in s], dtype=object)
    pair = lambda f: lambda s, t: pd.Series([f(x or "", y or "") for x, y in zip(s, t, strict=True)], dtype=object)
    diff = lambda a, b: [{"kind": k, "line": x} for k, x in K.line_diff(a, b)]
    scalar = {
        "lcs_length": (pair(K.lcs_length), "int", 2), "lcs_ratio": (pair(K.lcs_ratio), "double", 2), "repair_json": (each(K.repair_json), "string", 1),
        "line_diff": (pair(diff), "array<struct<kind:string,line:string>>", 2), "block_tier": (each(lambda t: K.analyse_blocks(t)["tier"]), "string", 1), "brackets_match": (each(K.brackets_match), "boolean", 1),
    }
    for name, (f, kind, n) in scalar.items():
        spark.udf.register(name, F.pandas_udf(_typed1(f) if n == 1 else _typed2(f), kind))

    def edits(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([K.parse_edit(x or "") for x in s], columns=["intent", "file", "changes"])

    spark.udf.register("parse_edit", F.pandas_udf(edits, EDIT))
    spark.udtf.register("split_branches", F.udtf(_SplitBranches, returnType="part: int, label: string, code: string"))
    return [*scalar, "parse_edit", "split_branches"]


def _typed1(f):
    def run(s: pd.Series) -> pd.Series:
        return f(s)

    return run


def _typed2(f):
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        return f(s, t)

    return run
