"""Running an extractor over chunks and reading what it answers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.kernels import repair_json
from ruleloom.functions.text import rule_type, reported_confidence
from ruleloom.operators.review import cached

#: A function from a prompt to an answer; a table of answers or a service.
Extractor = Callable[[str], str]


def run_extractor(chunks: DataFrame, extractor: Extractor) -> DataFrame:
    """id, answer, error of chunks (id, prompt); a failure is a row, not the end of the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, prompt in zip(batch["id"], batch["prompt"], strict=True):
                try:
                    rows.append((i, extractor(prompt), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((i, None, str(e)))
            yield pd.DataFrame(rows, columns=["id", "answer", "error"])

    return chunks.select("id", "prompt").mapInPandas(run, "id long, answer string, error string")


def answered(requests: DataFrame, cache: DataFrame, extractor: Extractor) -> DataFrame:
    """id, chunk_label, key, answer, error, cached of requests (id, chunk_label, key, prompt).

    What the cache (key, response, stored_at) holds is taken from it; only the rest is asked for, once for each key.
    """
    known = cached(requests, cache)
    asked = known.where("response is null")
    once = asked.groupBy("key").agg(F.min_by(F.struct("id", "prompt"), "id").alias("r")).select("key", "r.*")
    new = run_extractor(once, extractor).join(once.select("id", "key"), "id").select("key", F.col("answer").alias("new"), "error")
    out = known.join(new, "key", "left")
    return out.select("id", "chunk_label", "key", F.coalesce("response", "new").alias("answer"), "error", F.col("response").isNotNull().alias("cached"))


def repaired(df: DataFrame) -> DataFrame:
    """id and json: the answers (id, answer) repaired; null where no repair parses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "json": [repair_json(a) for a in batch["answer"]]})

    return df.select("id", "answer").mapInPandas(run, "id long, json string")


FIELDS = ("label", "type", "description", "source_reference", "cobol_reference", "confidence", "migration_notes", "risk", "code_snippet", "notes")
RULE = "id long, pos int, status string, rule_key string, label string, type string, description string, reference string, confidence string, migration_notes string, risk string, code_snippet string, cobol_origin boolean, notes string"


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, list):
        return "; ".join(v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False) for v in value)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def answers_to_rules(df: DataFrame) -> DataFrame:
    """The rules in answers (id, chunk_label, answer), one row each, with the answer's ``status``.

    ``ok``: a list of rules, maybe empty (then one row without rule); ``unreadable``: no repair parses, as good as
    empty; ``failed``: the answer parses but is no object, or its rules are no list of objects. Lists in text fields
    are joined with ``; ``, other values kept as JSON; a missing label is ``Unknown Rule``, a blank one drops the rule.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RULE.split(", ")]
        for batch in batches:
            rows = []
            none = [None] * (len(names) - 3)
            for i, chunk, answer in zip(batch["id"], batch["chunk_label"], batch["answer"], strict=True):
                text = repair_json(answer)
                if text is None:
                    rows.append((i, None, "unreadable", *none))
                    continue
                root = json.loads(text)
                own = root.get("rules", []) if isinstance(root, dict) else None
                if not isinstance(own, list) or not all(isinstance(r, dict) for r in own):
                    rows.append((i, None, "failed", *none))
                    continue
                kept = 0
                for k, r in enumerate(own):
                    v = {f: _text(r.get(f)) for f in (*FIELDS, "id")}
                    label = "Unknown Rule" if v["label"] is None else v["label"]
                    if not label.strip():
                        continue
                    kept += 1
                    reference = next((x for x in (v["source_reference"], v["cobol_reference"], chunk) if x is not None), None)
                    rows.append((i, k, "ok", v["id"], label, v["type"] or "BusinessRule", v["description"] or "", reference, v["confidence"], v["migration_notes"] or "", v["risk"] or "low", v["code_snippet"] or "", r.get("cobol_origin") is True, v["notes"] or ""))
                if not kept:
                    rows.append((i, None, "ok", *none))
            out = pd.DataFrame(rows, columns=names)
            out["pos"] = out["pos"].astype("Int32")
            out["cobol_origin"] = out["cobol_origin"].astype("boolean")
            yield out

    read = df.select("id", "chunk_label", "answer").mapInPandas(run, RULE)
    typed = {"type": F.when(F.col("pos").isNotNull(), rule_type(F.col("type"))), "confidence": F.when(F.col("pos").isNotNull(), reported_confidence(F.col("confidence")))}
    key = F.when(F.col("pos").isNotNull(), F.coalesce("rule_key", F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.col("pos").cast("string"), "label"), 256)))
    return read.withColumns(typed).withColumn("rule_key", key)
