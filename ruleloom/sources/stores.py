"""JSON stores of sessions, validation runs, templates, knowledge and cached responses, read tolerantly."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions.text import DECISIONS, enum_name

SESSION = "Id string, Name string, CreatedAt string, UpdatedAt string, ModelUsed string, Rules array<struct<Id:string,Label:string,Type:string,Confidence:string,Decision:string>>, Broken string"
VALIDATION = "Id string, SessionId string, SessionName string, ModelName string, RunAt string, GroundTruthCount int, TpCount int, FpCount int, FnCount int, Precision float, Recall float, F1 float, Threshold float, Broken string"
TEMPLATE = "id string, name string, createdAt string, isActive boolean, instructions string, history array<struct<f1:double>>, Broken string"
KNOWLEDGE = "Id string, Label string, Description string, Type string, MigrationNotes string, AddedAt string, Broken string"


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The readable documents of a folder (one JSON document a file) with their file's name; broken ones are left out.

    Only the schema's fields are read; missing ones are null, other ones ignored.
    """
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "Broken").json(path)
    names = [f.name for f in raw.schema.fields if f.name != "Broken"]
    return raw.select(*names, F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("file_key"), "Broken").where("Broken is null").drop("Broken")


def parse_store(docs: DataFrame, schema: str) -> DataFrame:
    """As ``read_store`` from documents (file_name, text) that have been read already."""
    read = docs.select("file_name", F.from_json("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "Broken"}).alias("d"))
    return read.where("d is not null and d.Broken is null").select("d.*", F.regexp_replace("file_name", r"\.json$", "").alias("file_key")).drop("Broken")


def validation_runs(runs: DataFrame) -> DataFrame:
    """The summary of validation runs (``VALIDATION`` and file_key), missing fields as empty, zero, or the file's name for the id. Sort by run_at descending to list them."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(snake(c))
    number = lambda c: F.coalesce(c, F.lit(0)).alias(snake(c))
    return runs.select(
        F.coalesce("Id", "file_key").alias("id"), text("SessionId"), text("SessionName"), text("ModelName"), F.try_to_timestamp("RunAt").alias("run_at"), number("GroundTruthCount"),
        number("TpCount"), number("FpCount"), number("FnCount"), number("Precision"), number("Recall"), number("F1"), number("Threshold"),
    )


def snake(name: str) -> str:
    """``SessionId`` as ``session_id``."""
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()


def template_list(templates: DataFrame) -> DataFrame:
    """Templates (``TEMPLATE``) as id, name, created_at, is_active, runs. Sort by created_at to list them."""
    return templates.select("id", "name", F.try_to_timestamp("createdAt").alias("created_at"), F.coalesce("isActive", F.lit(False)).alias("is_active"), F.coalesce(F.size("history"), F.lit(0)).alias("runs"))


def knowledge_entries(docs: DataFrame) -> DataFrame:
    """store, pos, id, label, type of knowledge documents (store, text), each a list of entries; an unreadable one has none."""
    entry = "array<struct<Id:string,Label:string,Description:string,Type:string,MigrationNotes:string,AddedAt:string>>"
    read = docs.where(F.try_parse_json("text").isNotNull()).select("store", F.posexplode(F.from_json("text", entry)).alias("pos", "e"))
    return read.where("e is not null").select("store", "pos", F.col("e.Id").alias("id"), F.col("e.Label").alias("label"), F.col("e.Type").alias("type"))


def cache_entries(docs: DataFrame) -> DataFrame:
    """key, response, rules of cached responses (file_name, text): the key is the file's name; what is no list of objects is left out."""
    listed = F.from_json(F.when(F.try_parse_json("text").isNotNull(), F.col("text")), "array<map<string,string>>")
    return docs.select(F.regexp_replace("file_name", r"\.json$", "").alias("key"), F.col("text").alias("response"), listed.alias("l")).where("l is not null and not exists(l, x -> x is null)").select("key", "response", F.size("l").alias("rules"))


def session_list(sessions: DataFrame) -> DataFrame:
    """id, name, created_at, model, total, accepted, rejected, flagged; missing fields as empty or zero.

    ``sessions`` is of ``SESSION``; decisions may be names or ordinals. Sort by created_at descending to list them.
    """
    count = lambda d: F.coalesce(F.size(F.filter("Rules", lambda r: enum_name(r["Decision"], DECISIONS, "Pending") == d)), F.lit(0))
    text = lambda c: F.coalesce(c, F.lit(""))
    total = F.when(F.col("Rules").isNull(), 0).otherwise(F.size("Rules"))
    zero = lambda d: F.when(F.col("Rules").isNull(), 0).otherwise(count(d))
    return sessions.select(
        text("Id").alias("id"), text("Name").alias("name"), F.try_to_timestamp("CreatedAt").alias("created_at"), text("ModelUsed").alias("model"),
        total.alias("total"), zero("Accepted").alias("accepted"), zero("Rejected").alias("rejected"), zero("Flagged").alias("flagged"),
    )


def by_id(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row with that key; no row if there is none."""
    return df.where(F.col(key) == value)


def newest_first(df: DataFrame, at: Column, key: str) -> DataFrame:
    """Sorted by time, newest first, then by key."""
    return df.orderBy(at.desc_nulls_last(), key)
