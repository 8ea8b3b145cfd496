"""Texts cut off by field limits: a backward character n-gram model of how texts end.

For the last characters of every value (contexts of several lengths, read backwards from its end) the model
compares how often the corpus ends there, with a terminator or as the end of a value, with how often it goes on.
Longer contexts refine shorter ones by interpolation. The log-odds of going on, corrected by a column's surplus
of values of exactly that length in that source (a field limit shows as such a surplus), decide against a
threshold for each language and column.

Counts cover every position of every value. A bitmap of fixed size holds the contexts that are asked for, so that
only their counts are shuffled; it saves work and does not change any count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.ruletext import DATA_NAME, PARAGRAPH
from ruleloom.plans.lineage import settle

#: Context lengths in characters, short to long.
ORDERS = (4, 8, 15, 24)
#: log2 of the bits of the bitmap of contexts: 2 MB when shipped, 16 MB in a worker.
BITMAP_BITS = 24
#: Words that stand for a missing text.
PLACEHOLDERS = ("", "n/a", "na", "none", "null", "nil", "-", "--", "tbd", "unknown", "?", ".")
_LONGEST = max(map(len, PLACEHOLDERS))

_SHAPES = re.compile(rf"(?P<name>\b{DATA_NAME}\b)|(?P<para>\b{PARAGRAPH}\b)|(?P<code>\b[a-z]\d{{2}}\b)|(?P<num>\d[\d,]*(?:\.\d+)?)")
_NAMES = re.compile(rf"\b(?:{DATA_NAME}|{PARAGRAPH})\b")
_STAND_FOR = {"name": "\x01", "para": "\x02", "code": "\x03", "num": "\x04"}
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes before the first text, so that every place has a window of the longest context.
_MARGIN = bytes(ORDERS[-1])


class Shapes(dict):
    """Remembers the shape of space-free strings; starts anew at half a million."""

    def __missing__(self, raw: str) -> str:
        if len(self) > 500_000:
            self.clear()
        out = self[raw] = _SHAPES.sub(lambda m: _STAND_FOR[m.lastgroup], raw)
        return out


_shapes = Shapes()


def shape(text: str) -> str:
    """Lower case, with one character for each data name, paragraph, code, number and run of white space."""
    return " ".join(map(_shapes.__getitem__, text.lower().split()))


def ending(text: str, *companions: str | None) -> tuple[str, str]:
    """The shaped text without its ellipsis, and ``done``, ``open`` or ``cut``: what its end looks like.

    ``done`` ends with a terminator; ``cut`` ends with an ellipsis, or with the beginning of a name that the
    companion texts (the row's other fields and ``context``) have in full. Both are evidence beside the model's odds.
    """
    body = text.strip()
    bare = body.rstrip("…").rstrip()
    while bare.endswith(".."):
        bare = bare.rstrip(".").rstrip()
    norm = shape(bare)
    if bare != body and norm:
        return norm, "cut"
    if norm[-1:] in ".!?":
        return norm, "done"
    last = bare[-60:].rpartition(" ")[2].strip("'\"(),;:\n\r\t").lower().replace("_", "-")
    if len(last) > 3 and "-" in last:
        for m in _NAMES.finditer(" ".join([t for t in companions if t]).lower().replace("_", "-")):
            if m.group().startswith(last) and len(m.group()) > len(last):
                return norm, "cut"
    return norm, "open"


def _mix(h: np.ndarray, order: int) -> np.ndarray:
    h = h + _BASE
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9 + 2 * order)
    return h ^ (h >> np.uint64(32))


def _windows(data: bytes) -> np.ndarray:
    """The eight bytes that begin at each place of the margin and ``data``, as a number."""
    raw = _MARGIN + data
    return np.ascontiguousarray(np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,)))


def _contexts(windows: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the last ``order`` characters before each place of the data."""
    at = place + (len(_MARGIN) - 8)
    h = windows[at]
    if order < 8:
        return _mix(h >> np.uint64(64 - 8 * order), order)
    for back in (*range(16, order, 8), *[order] * (order > 8)):
        h = (h ^ (h >> np.uint64(32))) * _BASE + windows[at + (8 - back)]
    return _mix(h, order)


VALUES = "id long, field string, source string, lang string, state string, size int, asks array<long>, norm string"


def values(fields: list[str]):
    """mapInArrow: (id, source, lang, the texts of ``fields``, context texts) to the shaped values that are not missing, with
    their state and the hashes of their final contexts: those before the terminator where there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, own, full, ends = [], [], [], []
            for i, texts in enumerate(zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True)):
                for k, text in enumerate(texts[: len(fields)]):
                    bare = (text or "").strip(" ")
                    if len(bare) <= _LONGEST and bare.lower() in PLACEHOLDERS:
                        continue
                    rows.append(i)
                    own.append(k)
                    full.append(len(text))
                    ends.append(ending(text, *texts[:k], *texts[k + 1 :]))
            norms, states = [e[0] for e in ends], [e[1] for e in ends]
            texts = [(n.rstrip(".!? ") if s == "done" else n).encode() for n, s in ends]
            # of the longest context and all shorter ones only the last bytes count
            tails = [t[-ORDERS[-1] :] for t in texts]
            sizes = np.array([len(t) for t in tails], dtype=np.int64)
            windows, at = _windows(b"".join(tails)), np.cumsum(sizes)
            found = [np.where(n <= sizes, _contexts(windows, at, n).view(np.int64), 0) for n in ORDERS]
            asks = pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1, dtype=np.int32) * len(ORDERS)), pa.array(np.stack(found, axis=1).ravel()))
            names = pa.array(fields, pa.string()).take(pa.array(own, pa.int32()))
            columns = [batch[0].take(pa.array(rows, pa.int32())), names, *(batch[k].take(pa.array(rows, pa.int32())) for k in (1, 2)), pa.array(states, pa.string()), pa.array(full, pa.int32()), asks, pa.array(norms, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in VALUES.split(", ")])

    return run


#: Characters that a counting task looks at together, so that its arrays stay in the processor's memory, and log2 of the
#: contexts that it counts in place; those whose place is taken are sorted.
AT_ONCE, PLACES = 100_000, 18


class Tally:
    """Counts of contexts by the kind of what follows: ended, closed, more. Its size is fixed."""

    def __init__(self) -> None:
        self.held = np.zeros(1 << PLACES, dtype=np.uint64)
        self.counts = np.zeros(3 << PLACES, dtype=np.int64)
        self.rest: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, h: np.ndarray, kind: np.ndarray) -> None:
        at = (h >> np.uint64(64 - PLACES)).view(np.int64)
        there = self.held[at]
        free = there == 0
        if free.any():
            self.held[at[free]] = h[free]
            there = self.held[at]
        same = there == h
        if not same.all():
            self.rest.append((h[~same], kind[~same]))
            at, kind = at[same], kind[same]
        np.add.at(self.counts, at * 3 + kind, 1)

    def sorted(self) -> pd.DataFrame:
        """What found its place taken, which is forgotten."""
        h, kind = (np.concatenate(x) for x in zip(*self.rest, strict=True)) if self.rest else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        self.rest = []
        keys, inverse = np.unique(h, return_inverse=True)
        return self._frame(keys, np.bincount(inverse * 3 + kind, minlength=3 * len(keys)))

    def placed(self) -> pd.DataFrame:
        at = np.flatnonzero(self.held)
        return self._frame(self.held[at], self.counts.reshape(-1, 3)[at].ravel())

    @staticmethod
    def _frame(keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        n_of = counts.reshape(-1, 3)
        return pd.DataFrame({"ask": keys.view(np.int64), "ended": n_of[:, 0], "closed": n_of[:, 1], "more": n_of[:, 2]})


_TERMINATOR, _SPACE = (np.isin(np.arange(256), list(x)) for x in (b".!?", b" \n"))


def counter(bits: bytes):
    """A mapInPandas function: counts of ended, closed and continued contexts that the bitmap asks for.

    A context is asked for together with its shorter ones, so only positions found at one length are looked at
    for the next.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little").view(bool)
        mask = np.int64((1 << BITMAP_BITS) - 1)
        tally = Tally()
        for batch in batches:
            for texts in _blocks([t.encode() for t in batch["norm"] if t]):
                data = b"\n".join(texts) + b"\n\n"
                windows, chars = _windows(data), np.frombuffer(data, dtype=np.uint8)
                ends = np.cumsum([len(t) + 1 for t in texts])
                # what follows position i: the end of a value, a terminator before white space, or more text
                kind = 2 - (_TERMINATOR[chars[:-1]] & _SPACE[chars[1:]]).view(np.int8)
                kind[ends - 1] = 0
                since = np.arange(ends[-1], dtype=np.int64) - np.repeat(np.r_[0, ends[:-1]], np.diff(ends, prepend=0))
                place = np.flatnonzero(since >= ORDERS[0])
                for n in ORDERS:
                    if n > ORDERS[0]:
                        place = place[since[place] >= n]
                    h = _contexts(windows, place, n)
                    ok = wanted[h.view(np.int64) & mask]
                    place, h = place[ok], h[ok]
                    if not len(place):
                        break
                    tally.add(h, kind[place])
            if tally.rest:
                yield tally.sorted()
        yield tally.placed()

    return run


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in blocks of about ``AT_ONCE`` characters; a longer one is a block of its own."""
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > AT_ONCE:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


#: Evidence of an end beside the model's odds of going on: a terminator stands at nearly every end and at one position
#: in some fifty within a text; an ellipsis or half a name says the opposite with hardly an exception.
EVIDENCE = {"done": -4.0, "open": 0.0, "cut": 40.0}


def truncated(df: DataFrame, fields: list[str], id_col: str, source: str | None = None, lang: str | None = None, context: tuple[str, ...] = (), sources: DataFrame | None = None, wanted: DataFrame | None = None, default_threshold: float = 2.5, thresholds: dict[tuple[str, str], float] | None = None, kappa: float = 1.5, end_weight: float = 0.3) -> DataFrame:
    """``id``, ``field``, ``source``, ``lang``, ``log_odds`` and ``is_cut`` of every non-missing value of ``fields``.

    Null, empty and placeholder values give no row. Every value is scored by the model; a terminator, an ellipsis
    and an end within a name count as evidence. ``thresholds`` holds log-odds by (language, column); values of
    unknown language share one entry. With ``sources`` (key, source) the source column holds keys. With ``wanted``
    (id) only those rows are scored, while the model counts all. Texts of any length are read whole. Repeated rows
    count as often as they stand.
    """
    spark = df.sparkSession
    texts = [F.col(f).cast("string").alias(f"text{k}") for k, f in enumerate((*fields, *context))]
    flat = df.select(
        F.col(id_col).cast("long").alias("id"),
        (F.col(source) if source else F.lit(None)).cast("string").alias("source"),
        (F.lower(F.col(lang)) if lang else F.lit("")).cast("string").alias("lang"),
        *texts,
    )
    held = settle(flat.mapInArrow(values(fields), VALUES), "values")
    named = held.drop("norm")
    if sources is not None:
        named = named.withColumnRenamed("source", "key").join(_small(sources.select("key", "source")), "key", "left").drop("key")
    scored = named if wanted is None else settle(named.join(wanted.select("id"), "id", "left_semi"), "asking")
    asking = (held if wanted is None else scored).select("id", "field", "asks")
    asks = asking.select("id", "field", F.posexplode("asks").alias("n", "ask")).where("ask <> 0")
    counts = held.select("norm").mapInPandas(counter(_bitmap(spark, asks)), "ask long, ended long, closed long, more long")
    counts = settle(counts.groupBy("ask").agg(F.sum("ended").alias("ended"), F.sum("closed").alias("closed"), F.sum("more").alias("more")), "counts")
    few = _small(counts)
    if few is not counts:
        for k in range(len(ORDERS)):
            of = few.select(F.col("ask").alias(f"ask{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("ended", "closed", "more")])
            scored = scored.join(of, F.col("asks")[k] == F.col(f"ask{k}"), "left").drop(f"ask{k}")
    else:
        of = [(c, k) for k in range(len(ORDERS)) for c in ("ended", "closed", "more")]
        seen = asks.join(counts, "ask").groupBy("id", "field").agg(*[F.max(F.when(F.col("n") == k, F.col(c))).alias(f"{c}{k}") for c, k in of])
        scored = scored.join(seen, ["id", "field"], "left")
    # one end of each context is the value itself, one terminator that of the value itself
    self = F.when(F.col("state") == "done", 0).otherwise(1)
    # a column for each length, as each step names the one before twice
    scored = scored.withColumn("going", F.lit(0.5))
    going = F.col("going")
    for ended, closed, more in (map(F.col, (f"ended{k}", f"closed{k}", f"more{k}")) for k in range(len(ORDERS))):
        step = (more + kappa * going) / (more + F.greatest(closed - (1 - self), F.lit(0)) + end_weight * F.greatest(ended - self, F.lit(0)) + kappa)
        scored = scored.withColumn("going", F.coalesce(step, going))
    scored = scored.withColumn("going", F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), going)))
    surplus = settle(named.groupBy("source", "field", "size").agg(F.count("*").alias("here")), "sizes")
    beside = F.explode(F.array(*[F.col("size") + d for d in (-3, -2, -1, 1, 2, 3)]))
    around = surplus.select("source", "field", beside.alias("size"), F.col("here").alias("near"))
    around = around.groupBy("source", "field", "size").agg((F.sum("near") / 6).alias("near"))
    surplus = surplus.join(around, ["source", "field", "size"], "left")
    surplus = surplus.select(F.col("source").alias("s"), F.col("field").alias("f"), F.col("size").alias("z"), F.log((F.col("here") + 3) / (F.coalesce("near", F.lit(0.0)) + 3)).alias("surplus"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f")) & (F.col("size") == F.col("z"))
    scored = scored.join(surplus.where("surplus > 1"), same, "left")
    odds = F.log(going / (1 - going)) + F.coalesce("surplus", F.lit(0.0))
    limit = F.lit(default_threshold)
    for (language, column), value in (thresholds or {}).items():
        limit = F.when((F.col("lang") == language) & (F.col("field") == column), F.lit(value)).otherwise(limit)
    evidence = F.create_map(*[F.lit(x) for kv in EVIDENCE.items() for x in kv])[F.col("state")]
    odds = F.when(F.coalesce(*[f"more{k}" for k in range(len(ORDERS))]).isNotNull(), odds).otherwise(F.coalesce("surplus", F.lit(0.0))) + evidence
    cut = odds > limit
    return scored.select("id", "field", "source", "lang", odds.alias("log_odds"), cut.alias("is_cut"))


#: Tables of up to so many rows of a few numbers or a name are broadcast.
SMALL_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    """``df`` itself, or to be broadcast if its rows, which are counted first, are few."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def _bitmap(spark: SparkSession, asks: DataFrame) -> bytes:
    """The bitmap of the low bits of all asked contexts, aggregated on the executors; its size is fixed."""
    slot = asks.select(F.pmod(F.col("ask"), F.lit(1 << BITMAP_BITS)).alias("slot"))
    slot = slot.select(F.expr("slot div 32768").alias("b"), F.expr("slot % 32768").alias("at"))
    rows = slot.groupBy("b").agg(F.expr("bitmap_construct_agg(at)").alias("bits")).collect()
    whole = bytearray(1 << (BITMAP_BITS - 3))
    for b, bits in rows:
        whole[b * 4096 : b * 4096 + len(bits)] = bits
    return bytes(whole)
