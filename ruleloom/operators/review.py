"""Review state: decisions, counts, knowledge, versions, templates and the response cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions.text import CONFIDENCES, DECISIONS, enum_name


def decisions(events: DataFrame) -> DataFrame:
    """rule_id, decision, decided_at, n_events from events (event_id, rule_id, decision, decided_at, received_at).

    Deciding the same again takes a decision back to Pending, so the state depends on how often the last decision
    stands at the end: odd keeps it, even clears it. Redelivered events count once (the first received); events of
    unknown decision, or without rule or time, do not count. Order is decided_at, then event_id.
    """
    known = events.select("event_id", "rule_id", enum_name(F.col("decision"), DECISIONS).alias("decision"), "decided_at", "received_at").where("decision is not null and rule_id is not null and decided_at is not null")
    once = known.groupBy("event_id").agg(F.min_by(F.struct("rule_id", "decision", "decided_at"), F.struct(F.col("received_at").isNull(), "received_at", "decided_at")).alias("e")).select("event_id", "e.*")
    order = Window.partitionBy("rule_id").orderBy("decided_at", "event_id")
    changed = once.withColumn("turn", F.coalesce((F.lag("decision").over(order) != F.col("decision")).cast("int"), F.lit(1)))
    runs = changed.withColumn("run", F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    by_run = runs.groupBy("rule_id", "run").agg(F.count("*").alias("n"), F.first("decision").alias("decision"), F.max("decided_at").alias("at"))
    last = by_run.groupBy("rule_id").agg(F.max_by(F.struct("n", "decision", "at"), "run").alias("l"), F.sum("n").alias("n_events"))
    return last.select("rule_id", F.when(F.col("l.n") % 2 == 1, F.col("l.decision")).otherwise("Pending").alias("decision"), F.col("l.at").alias("decided_at"), "n_events")


def session_counts(rules: DataFrame) -> DataFrame:
    """session_id, total, accepted, rejected, flagged, pending, decided of rules (session_id, decision)."""
    state = enum_name(F.col("decision"), DECISIONS, "Pending")
    count = lambda d: F.count_if(state == d).alias(d.lower())
    return rules.groupBy("session_id").agg(F.count("*").alias("total"), count("Accepted"), count("Rejected"), count("Flagged"), count("Pending"), F.count_if(state != "Pending").alias("decided"))


def filtered(rules: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows equal to each given value; empty and None pass everything."""
    for column, value in wanted.items():
        if value:
            rules = rules.where(F.col(column) == value)
    return rules


def learn(accepted: DataFrame, known: DataFrame, at_least: str = "High") -> DataFrame:
    """``known`` with the rules (id, label, description, type, confidence, added_at) not yet in it.

    A rule enters if its confidence is at least the given one; of several with one id the first added enters.
    """
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(CONFIDENCES) for x in (c, i)])[F.col("confidence")]
    new = accepted.where(rank <= CONFIDENCES.index(at_least)).join(known.select("id"), "id", "left_anti")
    first = new.groupBy("id").agg(F.min_by(F.struct(*[c for c in new.columns if c != "id"]), "added_at").alias("r")).select("id", "r.*")
    return known.unionByName(first.select(*known.columns))


def knowledge_state(entries: DataFrame) -> DataFrame:
    """entries, last_updated (null without entries)."""
    return entries.agg(F.count("*").alias("entries"), F.max("added_at").alias("last_updated"))


def latest(versions: DataFrame, key: str, at: str) -> DataFrame:
    """The newest version of each key; of equal times any one, of null times the last resort."""
    row = F.struct(*versions.columns)
    return versions.groupBy(key).agg(F.max_by(row, F.coalesce(at, F.lit("0001-01-01").cast("timestamp_ntz"))).alias("v")).select("v.*")


def replaced(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``rows`` in which the rows of the keys of ``new`` are replaced by those of ``new``."""
    return rows.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def removed(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` without those whose key is in ``gone``."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def activated(templates: DataFrame, chosen: Column) -> DataFrame:
    """Templates of which exactly the chosen one is active; ``changed`` marks rows to be written again."""
    active = F.coalesce(F.col("id") == chosen, F.lit(False))
    return templates.withColumn("changed", active != F.col("is_active")).withColumn("is_active", active)


def derived(templates: DataFrame, parent: str, child: str, name: str) -> DataFrame:
    """``templates`` with a copy of ``parent`` under a new id and name, its lineage noted, not active, without history."""
    copy = templates.where(F.col("id") == parent).withColumns({"parent_id": F.col("id"), "id": F.lit(child), "name": F.lit(name), "is_active": F.lit(False), "history": F.slice("history", 1, 0)})
    return templates.unionByName(copy.select(*templates.columns))


def recorded(templates: DataFrame, template: str, f1: Column) -> DataFrame:
    """``templates`` with one more F1 in the history of one of them."""
    return templates.withColumn("history", F.when(F.col("id") == template, F.concat("history", F.array(f1))).otherwise(F.col("history")))


def template_scores(templates: DataFrame) -> DataFrame:
    """id, best_f1, latest_f1, runs of templates with a history; null without runs."""
    return templates.select("id", F.array_max("history").alias("best_f1"), F.try_element_at("history", F.lit(-1)).alias("latest_f1"), F.size("history").alias("runs"))


def baseline(templates: DataFrame, instructions: str) -> DataFrame:
    """Templates in which one named ``Baseline`` with blank instructions gets the given ones."""
    blank = (F.col("name") == "Baseline") & (F.trim(F.coalesce("instructions", F.lit(""))) == "")
    return templates.withColumn("instructions", F.when(blank, F.lit(instructions)).otherwise(F.col("instructions")))


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests whose key is not in the cache."""
    return requests.join(cache.select("key"), "key", "left_anti")


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their stored response; null where there is none."""
    return requests.join(cache.groupBy("key").agg(F.max_by("response", "stored_at").alias("response")), "key", "left")


def counters(calls: DataFrame, host: str, port: int) -> DataFrame:
    """connections and violations of calls (host, port): those to another host (without case) or port than the allowed one."""
    allowed = F.coalesce((F.lower("host") == host.lower()) & (F.col("port") == port), F.lit(False))
    return calls.agg(F.count("*").alias("connections"), F.count_if(~allowed).alias("violations"))
