"""Mixing sources to target weights by repetition rates and hash-seeded copies.

Tokens are counted for every document with a public tokenizer and added up by source. A source's rate is its share
of the mixture's size over its own size; a document is emitted floor(rate) times and once more if its hash, seeded,
falls below the fraction. Counts, rates and emission are one pass each; only a row a source reaches the driver.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.plans.lineage import settle

#: Fixed value: the public split pattern that belongs to the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How many sources may have targets, a row each on the driver; more are an error, none is left out.
MOST_SOURCES = 100_000


def source_name(value: Column) -> Column:
    """One spelling of a source: trimmed, lower case; blank is null."""
    clean = F.lower(F.trim(value))
    return F.when(clean != "", clean)


def count_tokens(df: DataFrame, vocabulary: str = VOCABULARY, pattern: str = SPLIT) -> DataFrame:
    """``df`` (id, source, text) as (id, source, n_tokens); null and empty texts have no tokens.

    The vocabulary (a public file of fixed size) is read on the driver and shipped with the tasks. Special tokens'
    strings in a text are ordinary text.
    """
    data = Path(vocabulary).read_bytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "source": batch["source"], "n_tokens": [len(encode(t)) if t else 0 for t in batch["text"]]})

    return df.select(F.col("id").cast("long").alias("id"), "source", "text").mapInPandas(run, "id long, source string, n_tokens long")


def rates(totals: DataFrame, targets: DataFrame, size: float | None = None) -> list[dict]:
    """A row for each target source: share, cap, tokens and the rate at which its documents are emitted.

    Without ``size`` the mixture is the largest in which every source has exactly its share within its cap. With
    ``size`` tokens a source that would pass its cap is held at it and the others share the rest by weight. Sources
    without tokens are left out, and the shares are taken relative to the remaining ones; targets of null, zero or
    negative share get nothing. More than ``MOST_SOURCES`` target sources are an error.
    """
    weights = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("cap"))
    weights = weights.where("source is not null and share > 0 and cap > 0").groupBy("source").agg(F.sum("share").alias("share"), F.max("cap").alias("cap"))
    rows = [r.asDict() for r in weights.join(totals, "source", "left").select("source", "share", "cap", F.coalesce("tokens", F.lit(0)).alias("tokens")).limit(MOST_SOURCES + 1).collect()]
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources with a target")
    live = [r for r in rows if r["tokens"] > 0]
    whole = sum(r["share"] for r in live) or 1.0
    for r in rows:
        r["rate"] = 0.0
    if size is None:
        size = min((r["cap"] * r["tokens"] * whole / r["share"] for r in live), default=0.0)
    free, left = list(live), size
    while free:
        total = sum(r["share"] for r in free)
        full = [r for r in free if left * r["share"] / total > r["cap"] * r["tokens"] * (1 + 1e-12)]
        if not full:
            for r in free:
                r["rate"] = min(r["cap"], left * r["share"] / total / r["tokens"])
            break
        for r in full:
            r["rate"] = float(r["cap"])
            left -= r["cap"] * r["tokens"]
        free = [r for r in free if not any(r is f for f in full)]
    return rows


def mixture(df: DataFrame, targets: DataFrame, size: float | None = None, seed: int = 17, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixture (id, source, n_tokens, copy_no) of ``df`` (id, source, text), and a report by target source.

    No document stands more than its source's cap. Documents without tokens, or of a source without a target
    (null included), are not used. The same seed gives the same mixture, however the rows are partitioned; rows
    that repeat an id are drawn alike.
    """
    spark = df.sparkSession
    counted = settle(count_tokens(df.withColumn("source", source_name(F.col("source"))), vocabulary), "tokens")
    totals = counted.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    rows = rates(totals, targets, size)
    rate = spark.createDataFrame([(r["source"], float(r["share"]), int(r["cap"]), float(r["rate"])) for r in rows], "source string, share double, cap int, rate double")
    drawn = counted.where("n_tokens > 0").join(F.broadcast(rate), "source")
    chance = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    copies = F.floor("rate").cast("int") + (chance < F.col("rate") - F.floor("rate")).cast("int")
    drawn = drawn.withColumn("copies", copies).where("copies > 0")
    out = drawn.select("id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"))
    used = drawn.groupBy("source").agg(F.count("*").alias("documents_used"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_used"))
    report = rate.join(totals, "source", "left").join(used, "source", "left").select(
        "source", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        "rate", F.coalesce("documents_used", F.lit(0)).alias("documents_used"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
    )
    whole = report.agg(F.sum("tokens_used").alias("whole"))
    report = report.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.when(F.col("whole") > 0, F.col("tokens_used") / F.col("whole"))).drop("whole")
    return out, report
