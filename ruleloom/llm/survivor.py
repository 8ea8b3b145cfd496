"""Best representative of each duplicate group, field by field.

Fields are unpivoted to long rows. Each row votes for its normalised value with its trust times a decay by age;
the value with the most votes wins by max_by, and the winners are pivoted back to one record a group. With trust
falling by 2^-50 a level and a half-life of the clock's tick, a better level outvotes any number of worse ones and
the newest row any number of older ones; a longer half-life lets repeated values outvote a newer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.truncation import PLACEHOLDERS

#: Spellings of the confidence levels, best first; the digits are the levels' ordinals.
LEVELS = (("high", "h", "hi", "0"), ("medium", "med", "m", "mid", "1"), ("low", "l", "lo", "2"))


def missing(value: Column) -> Column:
    """True of null, blank and placeholder texts."""
    return value.isNull() | F.lower(F.trim(value)).isin(*PLACEHOLDERS)


def folded(value: Column) -> Column:
    """The value without case and extra white space; only texts that have any go through the regular expression."""
    extra = value.contains("  ")
    for c in "\t\n\x0b\f\r":
        extra = extra | value.contains(c)
    return F.lower(F.trim(F.when(extra, F.regexp_replace(value, r"\s+", " ")).otherwise(value)))


def confidence_level(value: Column) -> Column:
    """0 High, 1 Medium, 2 Low in any spelling or as ordinal; otherwise null."""
    clean = F.lower(F.trim(value))
    out = F.lit(None).cast("int")
    for k, names in enumerate(LEVELS):
        out = F.when(clean.isin(*names), k).otherwise(out)
    return out


def reference_level(value: Column) -> Column:
    """0 with a paragraph name and a line range, 1 with one of them, 2 with neither, null if missing."""
    bare = F.regexp_replace(F.lower(value), r"\b\d{4}-[a-z][a-z0-9-]*", " ")
    para = F.lower(value).rlike(r"\b\d{4}-[a-z]")
    lines = bare.rlike(r"\d+\s*(?:-|–|to|through|\.\.)\s*l?\d+")
    return F.when(missing(value), F.lit(None)).otherwise(2 - para.cast("int") - lines.cast("int"))


def votes(long: DataFrame, half_life: float = 1.0, trust_step: float = 50.0) -> DataFrame:
    """Winners (``group_id``, ``field``, ``id``, ``votes``) of rows (group_id, field, id, level, value, at).

    ``level`` 0 is trusted most; rows with a null level do not vote, and a group without voters has no winner.
    ``at`` is a number (ticks); null counts as oldest. Equal votes go to the newer row, then to the larger id.
    One shuffle serves the newest row, the ballots and the winners: a group's rows of a field are sorted in a task,
    on disk if they are many, and never collected.
    """
    rows = long.where("level is not null").withColumn("at", F.coalesce("at", F.lit(-(1 << 62)))).repartition("group_id", "field")
    newest = F.max("at").over(Window.partitionBy("group_id", "field", "level"))
    weight = F.pow(F.lit(2.0), -(F.col("newest") - F.col("at")).cast("double") / half_life - trust_step * F.col("level"))
    ballots = rows.withColumn("newest", newest).groupBy("group_id", "field", "value").agg(
        F.sum(weight).alias("votes"), F.max(F.struct((-F.col("level")).alias("level"), "at", "id")).alias("best")
    )
    return ballots.groupBy("group_id", "field").agg(F.max_by("best", F.struct("votes", "best")).alias("w"), F.max("votes").alias("votes")).select("group_id", "field", F.col("w.id").alias("id"), "votes")


def shared(groups: DataFrame) -> DataFrame:
    """The rows (id, group_id) of groups of two records or more."""
    several = groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    return groups.join(several, "group_id").select("id", "group_id")


def survivors(df: DataFrame, members: DataFrame, id_col: str, time_col: str, levels: dict[str, Column | None], half_life: float = 1.0, told: DataFrame | None = None) -> DataFrame:
    """Winning rows (``group_id``, ``field``, ``id``, ``votes``) for each field of ``levels`` (field to trust level).

    ``members`` has ``id`` and ``group_id``; see ``shared``. Values are compared without case and extra white space.
    Null levels stand for missing values. A field whose entry is None has its levels in the column of its name of
    ``told``, which has one row an id at most. Texts are hashed before any join.
    """
    hashed = [F.xxhash64(folded(F.col(f).cast("string"))).alias(f"_value{k}") for k, f in enumerate(levels)]
    known = [level.cast("int").alias(f"_level{k}") for k, level in enumerate(levels.values()) if level is not None]
    at = F.unix_micros(F.col(time_col).cast("timestamp"))
    own = df.select(F.col(id_col).cast("long").alias("id"), at.alias("at"), *hashed, *known).join(members, "id")
    if told is not None:
        own = own.join(told.select("id", *[F.col(f).cast("int").alias(f"_level{k}") for k, (f, level) in enumerate(levels.items()) if level is None]), "id", "left")
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_level{k}").alias("level"), F.col(f"_value{k}").alias("value")) for k, f in enumerate(levels)])
    return votes(own.select("id", "group_id", "at", F.explode(parts).alias("p")).select("id", "group_id", "at", "p.*"), half_life)


def golden(winners: DataFrame, df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """One record a group (``group_id`` and ``fields``): the winning values pivoted back; null where none won."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    own = df.select(F.col(id_col).cast("long").alias("id"), F.explode(parts).alias("p")).select("id", "p.*")
    return winners.join(own, ["id", "field"]).groupBy("group_id").pivot("field", fields).agg(F.first("value"))
