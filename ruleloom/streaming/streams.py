"""Token streams, progress and chat events: batch forms and Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ruleloom.operators.extract import answers_to_rules

MESSAGE = "struct<message:struct<content:string>,done:boolean>"


def fold_tokens(lines: DataFrame) -> DataFrame:
    """request_id, text, finished of NDJSON lines (request_id, seq, line).

    Blank and malformed lines are skipped; the first line that says done ends the answer, its content and all later
    lines do not count; without one the text so far is the answer.
    """
    read = lines.select("request_id", "seq", F.from_json(F.when(F.try_parse_json("line").isNotNull(), F.col("line")), MESSAGE).alias("m")).where("m is not null")
    # one aggregate: a request's lines in order and where it ends; requests without content stay
    content = F.when(~F.coalesce("m.done", F.lit(False)), F.struct("seq", F.coalesce("m.message.content", F.lit("")).alias("c")))
    whole = read.groupBy("request_id").agg(F.min(F.when(F.col("m.done"), F.col("seq"))).alias("end"), F.array_sort(F.collect_list(content)).alias("l"))
    before = F.when(F.col("end").isNull(), F.col("l")).otherwise(F.filter("l", lambda x: x["seq"] < F.col("end")))
    return whole.select("request_id", F.array_join(F.transform(before, lambda x: x["c"]), "").alias("text"), F.col("end").isNotNull().alias("finished"))


def cancelled(lines: DataFrame, stops: DataFrame) -> DataFrame:
    """The lines (request_id, seq, line) that came before their request was stopped (request_id, at_seq), the first stop counting.

    ``fold_tokens`` of them is the partial answer that a cancelled chat keeps.
    """
    first = stops.groupBy("request_id").agg(F.min("at_seq").alias("at_seq"))
    return lines.join(first, "request_id", "left").where("at_seq is null or seq < at_seq").drop("at_seq")


def completed(answers: DataFrame, stops: DataFrame) -> DataFrame:
    """Answers of chunks whose request was not stopped; a cancelled chunk is left out, not reported as failed."""
    return answers.join(stops.select("request_id").distinct(), "request_id", "left_anti")


def live_rules(texts: DataFrame) -> DataFrame:
    """request_id, seq, n_rules: the rules that can be read from an answer so far, after each token (request_id, seq, token).

    Each prefix is read anew, so repeating one changes nothing. An answer's tokens are folded in order within it.
    """
    order = Window.partitionBy("request_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    so_far = texts.withColumn("answer", F.array_join(F.collect_list(F.coalesce("token", F.lit(""))).over(order), ""))
    key = F.struct("request_id", "seq")
    read = answers_to_rules(so_far.select(F.xxhash64(key).alias("id"), F.lit(None).cast("string").alias("chunk_label"), "answer"))
    n = read.where("pos is not null").groupBy("id").agg(F.count("*").alias("n_rules"))
    return so_far.select("request_id", "seq", F.xxhash64(key).alias("id")).join(n, "id", "left").select("request_id", "seq", F.coalesce("n_rules", F.lit(0)).alias("n_rules"))


def stream_rules(lines: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Streaming form: after every batch the rules of each growing answer are read again and handed to ``sink`` (rules, batch no)."""

    def again(batch: DataFrame, no: int) -> None:
        texts = batch.select(F.col("request_id").alias("id"), F.lit(None).cast("string").alias("chunk_label"), F.col("text").alias("answer"))
        sink(answers_to_rules(texts), no)

    return stream_tokens(lines).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(again).start()


def stream_tokens(lines: DataFrame) -> DataFrame:
    """Streaming form: the text so far of each request after every batch (update mode).

    State is the text and whether it is finished; lines of a batch are taken by seq.
    """
    import json

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, finished = state.get if state.exists else ("", False)
        rows = pd.concat(list(frames)).sort_values("seq")
        for line in rows["line"]:
            if finished:
                break
            try:
                m = json.loads(line or "")
            except ValueError:
                continue
            if not isinstance(m, dict):
                continue
            if m.get("done") is True:
                finished = True
            else:
                text += (m.get("message") or {}).get("content") or ""
        state.update((text, finished))
        yield pd.DataFrame({"request_id": [key[0]], "text": [text], "finished": [finished]})

    schema = "request_id long, text string, finished boolean"
    return lines.groupBy("request_id").applyInPandasWithState(fold, schema, "text string, finished boolean", "update", GroupStateTimeout.NoTimeout)


def progress(events: DataFrame) -> DataFrame:
    """label, status, at: the latest event (label, status, at, event_id) of each label; works on a stream as well."""
    return events.groupBy("label").agg(F.max(F.struct("at", "event_id", "status")).alias("e")).select("label", "e.status", "e.at")


def chat_history(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the user's and the assistant's turns, numbered anew."""
    kept = turns.where(F.col("role").isin("user", "assistant"))
    return kept.withColumn("no", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type) counted by window and type, with a watermark; batch or stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
