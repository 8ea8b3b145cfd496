"""Similarity by longest common subsequence: pruned joins, greedy duplicates, greedy matching."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions.kernels import PackedTexts, TextIndex, lcs_length
from ruleloom.functions.text import content_words, duplicate_form, matching_form
from ruleloom.plans.lineage import release, settle


def _pandas_lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings; null counts as empty."""
    return F.pandas_udf(_pandas_lcs, "int")(a, b)


#: Columns of the counts of characters; characters that share a column can only raise a bound.
CHARACTER_COLUMNS = 64


def character_bags(texts: list[str]) -> np.ndarray:
    """How often characters occur in each text, by code point modulo ``CHARACTER_COLUMNS``."""
    out = np.zeros((len(texts), CHARACTER_COLUMNS), dtype=np.int32)
    for i, t in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) % CHARACTER_COLUMNS, minlength=CHARACTER_COLUMNS)
    return out


def ratio_join(rows: DataFrame, left: str, right: str, threshold: float, bonus: Column | None = None, as_float: bool = False) -> DataFrame:
    """``rows`` with ``similarity`` = 2 LCS / (both lengths) of two columns, where it reaches the threshold.

    Two bounds spare most pairs the subsequence without losing one: the shorter length, and the characters in
    common, are never below the subsequence. Two empty strings have similarity 1, or 0 with ``as_float`` (single
    precision, plus ``bonus``, at most 1).
    """
    a, b = F.col(left), F.col(right)
    total = F.length(a) + F.length(b)
    extra = bonus if bonus is not None else F.lit(0.0)
    near = rows.where((2 * F.least(F.length(a), F.length(b)) + extra * total >= F.lit(threshold) * total - F.lit(1e-6) * total))

    def score(x: pd.Series, y: pd.Series, slack: pd.Series) -> pd.Series:
        out = np.full(len(x), -1, dtype=np.int32)
        p, forms_x = pd.factorize(x)
        q, forms_y = pd.factorize(y)
        bag_x, bag_y = character_bags(forms_x), character_bags(forms_y)
        need = (threshold - slack.to_numpy() - 1e-6) * (x.str.len() + y.str.len()).to_numpy() / 2
        for at in range(0, len(x), 2000):
            some = np.arange(at, min(at + 2000, len(x)))
            shared = np.minimum(bag_x[p[some]], bag_y[q[some]]).sum(axis=1)
            for i in some[shared >= need[some]]:
                out[i] = lcs_length(forms_x[p[i]], forms_y[q[i]])
        return pd.Series(out)

    common = F.pandas_udf(score, "int")(a, b, extra.cast("double"))
    scored = near.withColumn("common", common).where("common >= 0")
    if as_float:
        raw = (F.lit(2.0).cast("float") * F.col("common").cast("float")).cast("float") / total.cast("float")
        value = F.when(total == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0).cast("float"), (raw.cast("float") + extra.cast("float")).cast("float")))
        return scored.withColumn("similarity", value.cast("float")).where(F.col("similarity") >= F.lit(threshold).cast("float")).drop("common")
    value = F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.col("common") / total)
    return scored.withColumn("similarity", value).where(F.col("similarity") >= threshold).drop("common")


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, keeper): what a pass in order keeps, a row being dropped by the first kept row it is close to.

    ``nodes`` has id; ``edges`` has id and earlier (id > earlier). ``keeper`` is null of kept rows. All rows whose
    earlier neighbours are decided are decided at once, so the rounds are as many as the longest chain of
    dependence, not as the rows; every round is written to the shared folder.
    """
    state = settle(nodes.select("id", F.lit(None).cast("long").alias("keeper"), F.lit(False).alias("decided")), "mis")
    while True:
        left = state.where("not decided").select("id")
        links = edges.join(left, "id").join(state.select(F.col("id").alias("earlier"), F.col("decided").alias("known"), F.col("keeper").isNull().alias("kept")), "earlier")
        seen = links.groupBy("id").agg(F.min(F.when(F.col("known") & F.col("kept"), F.col("earlier"))).alias("by"), F.min(F.when(~F.col("known"), F.col("earlier"))).alias("open"))
        step = state.join(seen, "id", "left")
        # a kept neighbour before every undecided one drops the row for good; without undecided ones it is decided
        drop = F.col("by").isNotNull() & (F.col("open").isNull() | (F.col("by") < F.col("open")))
        keep = F.col("by").isNull() & F.col("open").isNull()
        before, state = state, settle(step.select("id", F.when(~F.col("decided") & drop, F.col("by")).otherwise(F.col("keeper")).alias("keeper"), (F.col("decided") | drop | keep).alias("decided")), "mis")
        release(before)
        if state.where("not decided").isEmpty():
            return state.select("id", "keeper")


#: Similarities beyond which a rule repeats an earlier one of any type, and of the same type.
ANY_TYPE, SAME_TYPE = 0.80, 0.72


#: Up to so many texts of a few hundred characters are broadcast to be compared; beyond that hot scopes are salted.
BROADCAST_TEXTS, SALTS = 100_000, 16


def scope_pairs(lead: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(id, form, earlier, other) of the texts (lead, form) of each scope whose lengths allow the threshold.

    The length bound is part of the join: texts stand in bands of which one may reach the next but one only at a
    ratio of lengths that the threshold forbids, so each meets its own band and the two beside it. A scope
    however large is spread over all tasks.
    """
    step = float(np.log((2 - threshold) / threshold))
    band = F.floor(F.log(F.greatest(F.length("form"), F.lit(1)).cast("double")) / step)
    left = lead.select(*keys, F.col("lead").alias("id"), "form", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    right = lead.select(*keys, F.col("lead").alias("earlier"), F.col("form").alias("other"), band.alias("band"))
    if lead.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        return _spread(left).join(F.broadcast(right), [*keys, "band"]).where("id > earlier").drop("band")
    left = left.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right, [*keys, "band", "salt"]).where("id > earlier").drop("band", "salt")


def deduplicate(rules: DataFrame) -> DataFrame:
    """id, scope, keeper, occurrences and is_cross_cutting of rules (id, scope, type, text), ids in order.

    Within a scope, a rule that repeats an earlier kept one (first any type at 0.80, then of the rest the same type
    at 0.72) is dropped and credited to the first such rule. ``keeper`` is null of kept rules; a kept rule with a
    dropped one is cross-cutting. Rules with the same normalised text are compared once. Null texts count as empty.
    """
    base = settle(rules.select(F.col("id").cast("long").alias("id"), "scope", "type", duplicate_form(F.col("text")).alias("form")), "forms")

    def one_pass(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
        # equal texts behave alike: the first stands for all
        lead = rows.groupBy(*keys, "form").agg(F.min("id").alias("lead"))
        pairs = scope_pairs(settle(lead, "lead"), keys, threshold)
        close = settle(ratio_join(pairs, "form", "other", threshold).select("id", "earlier"), "close")
        kept = first_independent(lead.select(F.col("lead").alias("id")), close)
        own = rows.join(lead, [*keys, "form"]).join(kept.select(F.col("id").alias("lead"), "keeper"), "lead")
        return own.select("id", F.coalesce("keeper", F.when(F.col("id") != F.col("lead"), F.col("lead"))).alias("keeper"))

    first = settle(one_pass(base, ["scope"], ANY_TYPE), "pass")
    rest = base.join(first.where("keeper is null").select("id"), "id")
    second = settle(one_pass(rest, ["scope", "type"], SAME_TYPE), "pass")
    both = first.where("keeper is not null").unionByName(second)
    count = both.where("keeper is not null").groupBy(F.col("keeper").alias("id")).agg(F.count("*").alias("n"))
    return base.select("id", "scope").join(both, "id").join(count, "id", "left").select("id", "scope", "keeper", F.when(F.col("keeper").isNull(), F.coalesce("n", F.lit(0)) + 1).cast("int").alias("occurrences"), (F.col("keeper").isNull() & F.col("n").isNotNull()).alias("is_cross_cutting"))


#: Added where a rule's type is the entry's category; the least similarity of a match.
CATEGORY_BONUS, MATCH_FROM = 0.05, 0.40


def candidates(rules: DataFrame, entries: DataFrame, threshold: float = MATCH_FROM) -> DataFrame:
    """rule_id, gt_id, similarity (float) of rules (rule_id, scope, label, text, type) and entries (gt_id, scope, category, text)
    of the same scope that reach the threshold; similarity 0 never does."""
    left = rules.select("rule_id", "scope", "type", matching_form(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("text", F.lit("")))).alias("a"))
    right = entries.select("gt_id", "scope", "category", matching_form(F.col("text")).alias("b"))
    bonus = F.when(F.lower("type") == F.lower("category"), CATEGORY_BONUS).otherwise(0.0)
    return ratio_join(left.join(right, "scope"), "a", "b", threshold, bonus, as_float=True).where("similarity > 0").select("rule_id", "gt_id", "similarity")


#: Entries packed at once; up to so many of a pack are compared with a rule pair by pair; rules compared at once.
PACK, FEW, BATCH = 4096, 3000, 128
#: Hits (8 bytes each) that a wave of rules may send to the driver; rules in a wave at most.
WAVE_SCORES, WAVE_RULES = 8_000_000, 1_000_000


class Packs:
    """Entries (id, kind, form) in packs of about the same length, to be compared with rules."""

    def __init__(self, entries: list[tuple[int, str, str]]) -> None:
        self.size = len(entries)
        self.order = np.array(sorted(range(self.size), key=lambda i: -len(entries[i][2])), dtype=np.int64)
        forms = [entries[i][2] for i in self.order]
        self.kind_no = {k: n for n, k in enumerate(sorted({e[1] for e in entries}))}
        self.kinds = np.array([self.kind_no[entries[i][1]] for i in self.order], dtype=np.int64)
        self.index = TextIndex(forms)
        words = [-(-len(f) // 63) for f in forms]
        self.packs: list[tuple[int, int, PackedTexts]] = []
        at = 0
        while at < self.size:
            end = next((i for i in range(at, self.size) if i == at + PACK or words[i] < words[at]), self.size)
            self.packs.append((at, end, PackedTexts(forms[at:end])))
            at = end

    def _bonus(self, kind: str | None) -> np.ndarray:
        """Where the bonus is added."""
        return self.kinds == (-1 if kind is None else self.kind_no.get(kind, -1))

    def hits(self, rows: list[tuple[str | None, str]], least: np.ndarray, most: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the row, entries, similarities in single precision) of the pairs that reach ``least``, one for
        each row or, as a row of its own, for each entry.

        The characters in common bound the similarity of a pair, so pairs below ``least`` are spared the subsequence;
        with ``most``, only so many entries of the highest bound are compared with each row. The bonus is added where
        a row's kind is the entry's, never for None.
        """
        coded = [self.index.code(form) for _, form in rows]
        least = np.broadcast_to(least, (len(rows), self.size))
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, (kind, form) in enumerate(rows):
            total, least_i = self.index.lengths + len(form), least[i]
            if least.strides[1]:
                least_i = least_i[self.order]
            bonus = np.where(self._bonus(kind), CATEGORY_BONUS, 0.0)
            need = (least_i - bonus - 1e-6) * total / 2
            shared = self.index.shared(coded[i])
            possible = shared >= need
            if most is not None and most < self.size:
                bound = 2 * shared / np.maximum(total, 1) + bonus
                possible &= np.isin(np.arange(self.size), np.argpartition(-bound, most)[:most])
            for at, end, texts in self.packs:
                own = np.flatnonzero(possible[at:end])
                if len(own) > FEW:
                    common = texts.lcs(form)[own] if 2 * len(own) > end - at else texts.lcs(form, own)
                    yield self._reached(i, kind, form, at + own, common, least_i)
                elif len(own):
                    pairs.append((np.full(len(own), i), at + own, need[at + own]))
        if pairs:
            row, own, need = (np.concatenate(x) for x in zip(*pairs, strict=True))
            common = self.index.lcs(coded, row, own, need)
            ends = np.flatnonzero(np.r_[row[1:] != row[:-1], True]) + 1
            for at, end in zip([0, *ends[:-1]], ends, strict=True):
                i, some = int(row[at]), np.flatnonzero(common[at:end] >= 0) + at
                least_i = least[i][self.order] if least.strides[1] else least[i]
                yield self._reached(i, *rows[i], own[some], common[some], least_i)

    def _reached(self, i: int, kind: str | None, form: str, own: np.ndarray, common: np.ndarray, least: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        total = self.index.lengths[own] + len(form)
        raw = np.float32(2) * common.astype(np.float32) / np.maximum(total, 1).astype(np.float32)
        raw = np.where(self._bonus(kind)[own], raw + np.float32(CATEGORY_BONUS), raw)
        score = np.where(total == 0, np.float32(0), np.minimum(raw, np.float32(1)))
        keep = score >= least[own]
        return i, self.order[own[keep]], score[keep]


#: A worker's packs by token, those of the last broadcast only.
_MADE: dict[str, Packs] = {}


def _packs(held: Broadcast, token: str) -> Packs:
    """The packs of broadcast entries, made once by each worker."""
    if token not in _MADE:
        _MADE.clear()
        _MADE[token] = Packs(held.value)
    return _MADE[token]


def _batches(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), size):
            yield batch.iloc[at : at + size]


def _sides(rules: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, kind, form) of rules and entries: what their similarity depends on."""
    left = rules.select(F.col("rule_id").cast("long").alias("id"), F.lower("type").alias("kind"), matching_form(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("text", F.lit("")))).alias("form"))
    return left, entries.select(F.col("gt_id").cast("long").alias("id"), F.lower(F.coalesce("category", F.lit(""))).alias("kind"), matching_form(F.coalesce("text", F.lit(""))).alias("form"))


def _spread(rows: DataFrame) -> DataFrame:
    """Short rows with much work each, over all cores."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def match_all(rules: DataFrame, entries: DataFrame, threshold: float = MATCH_FROM) -> DataFrame:
    """rule_id, gt_id, similarity: every rule in order takes the most similar of all entries still free, from the threshold on.

    Rules (rule_id, label, text, type), entries (gt_id, category, text); of equally similar entries the first is
    taken, similarity 0 never. Rules are scored in waves, in parallel, against the entries free before the wave, and
    take them in order on the driver, which holds the entries and at most ``WAVE_SCORES`` hits. A rule sends its best
    hits; should others have taken all of them and it has more, the next wave begins with it. A wave is as large as
    may take a fifth of the free entries, and grows when far fewer are taken. No pair is left out: once no entry is
    free, no later rule can match.
    """
    spark = rules.sparkSession
    left, right = _sides(rules, entries)
    left = settle(left, "rules")
    free = sorted((r["id"], r["kind"], r["form"]) for r in right.collect())
    least = float(np.float32(threshold))
    found: list[tuple[int, int, float]] = []
    rest, growth = left, 1
    while free:
        wave = max(1, min(WAVE_RULES, WAVE_SCORES // 16, growth * max(32, len(free) // 5)))
        most = max(1, WAVE_SCORES // wave)
        upto = rest.select("id").orderBy("id").limit(wave).agg(F.max("id")).first()[0]
        if upto is None:
            break
        held, token = spark.sparkContext.broadcast(free), uuid.uuid4().hex

        def score(batches: Iterator[pd.DataFrame], held=held, token=token, most=most) -> Iterator[pd.DataFrame]:
            packs = _packs(held, token)
            for batch in _batches(batches, BATCH):
                own: dict[int, list] = {}
                for i, entry, s in packs.hits(list(zip(batch["kind"], batch["form"], strict=True)), np.float32([[least]])):
                    if len(entry):
                        own.setdefault(i, []).append((entry, s))
                rows = []
                for i, parts in own.items():
                    entry, s = (np.concatenate(x) for x in zip(*parts, strict=True))
                    best = np.lexsort((entry, -s))[:most]
                    rows.append((batch["id"].iloc[i], entry[best].astype(np.int32).tobytes(), s[best].tobytes(), len(s) > most))
                yield pd.DataFrame(rows, columns=["id", "entries", "scores", "more"])

        scored = _spread(rest.where(F.col("id") <= upto)).mapInPandas(score, "id long, entries binary, scores binary, more boolean").toPandas().sort_values("id", kind="stable")
        taken = np.zeros(len(free), dtype=bool)
        for i, own, raw, more in zip(scored["id"], scored["entries"], scored["scores"], scored["more"], strict=True):
            entry, s = np.frombuffer(own, dtype=np.int32), np.frombuffer(raw, dtype=np.float32)
            at = np.flatnonzero(~taken[entry])
            if len(at) and s[at[0]] > 0:
                taken[entry[at[0]]] = True
                found.append((int(i), free[entry[at[0]]][0], float(s[at[0]])))
            elif more and not len(at):
                upto = int(i) - 1
                break
        held.destroy()
        growth = growth * 2 if 16 * taken.sum() < len(free) else max(1, growth // 2)
        free = [e for e, t in zip(free, taken, strict=True) if not t]
        rest = left.where(F.col("id") > upto)
    return spark.createDataFrame(found, "rule_id long, gt_id long, similarity float")


#: Entries of the highest bound from which the search for a rule's best begins.
FIRST = 32


def best_of_rules(rules: DataFrame, entries: DataFrame) -> DataFrame:
    """rule_id, best: each rule's highest similarity to any of the entries, without a threshold; no rows without entries."""
    left, right = _sides(rules, entries)
    held, token = rules.sparkSession.sparkContext.broadcast([(r["id"], r["kind"], r["form"]) for r in right.collect()]), uuid.uuid4().hex

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packs = _packs(held, token)
        for batch in _batches(batches, BATCH):
            if packs.size:
                top, rows = np.zeros(len(batch), dtype=np.float32), list(zip(batch["kind"], batch["form"], strict=True))
                for most in (FIRST, None):
                    for i, _, s in packs.hits(rows, top.copy()[:, None], most):
                        top[i] = max(top[i], s.max(initial=0))
                yield pd.DataFrame({"rule_id": batch["id"].to_numpy(), "best": top})

    return _spread(left).mapInPandas(best, "rule_id long, best float")


def best_of_entries(rules: DataFrame, entries: DataFrame) -> DataFrame:
    """gt_id, best: each entry's highest similarity to any of the rules, without threshold and bonus; no rows without rules."""
    left, right = _sides(rules, entries)
    held, token = rules.sparkSession.sparkContext.broadcast([(r["id"], r["kind"], r["form"]) for r in right.collect()]), uuid.uuid4().hex

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packs = _packs(held, token)
        top, seen = np.zeros(packs.size, dtype=np.float32), False
        for batch in _batches(batches, BATCH):
            # a few first, so that the others have a bound
            for part in (batch.iloc[:4], batch.iloc[4:]):
                seen |= len(part) > 0
                for _, own, s in packs.hits([(None, form) for form in part["form"]], top.copy()[None, :]):
                    top[own] = np.maximum(top[own], s)
        if seen and packs.size:
            yield pd.DataFrame({"gt_id": [e[0] for e in held.value], "best": top})

    return _spread(left).mapInPandas(best, "gt_id long, best float").groupBy("gt_id").agg(F.max("best").alias("best"))


def greedy_match(pairs: DataFrame) -> DataFrame:
    """rule_id, gt_id, similarity: rules in order each take the most similar entry that is still free.

    Of equally similar entries the first is taken. Solved by rounds of proposals: every unmatched rule proposes to
    its best entry left, every entry keeps its first rule; a refused entry is struck off. The result is that of the
    sequential loop, since all entries prefer rules in the same order.
    """
    open_pairs = settle(pairs.select("rule_id", "gt_id", "similarity"), "pairs")
    while True:
        best = open_pairs.groupBy("rule_id").agg(F.max_by("gt_id", F.struct("similarity", -F.col("gt_id"))).alias("gt_id"))
        holds = best.groupBy("gt_id").agg(F.min("rule_id").alias("holder"))
        refused = settle(best.join(holds, "gt_id").where("rule_id <> holder").select("rule_id", "gt_id"), "refused")
        if refused.isEmpty():
            return open_pairs.join(best, ["rule_id", "gt_id"])
        before, open_pairs = open_pairs, settle(open_pairs.join(refused, ["rule_id", "gt_id"], "left_anti"), "pairs")
        release(before, refused)


#: Up to so many words of entries (12 bytes each) are shipped to the tasks as an index; more are joined.
MOST_POSTINGS = 4_000_000


def top_entries(queries: DataFrame, entries: DataFrame, k: int = 3, most: int = MOST_POSTINGS) -> DataFrame:
    """query_id, entry_id, score, rank: the k entries (entry_id, text) that share most content words with a query (query_id, text).

    Entries that share none are left out; of equal ones the earlier id comes first. An index of the entries' words
    whose size was counted goes to the queries, which are then never shuffled and of which each is scored by itself;
    beyond ``most`` words both sides are joined on words, salted, and the scores added up before the ranking.
    """
    e = settle(entries.select("entry_id", F.explode(content_words(F.col("text"))).alias("word")), "words")
    if e.limit(most + 1).count() <= most:
        return _top_by_index(queries, e, k)
    q = queries.select("query_id", F.explode(content_words(F.col("text"))).alias("word")).withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)))
    salted = e.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    scored = q.join(salted, ["word", "salt"]).groupBy("query_id", "entry_id").agg(F.count("*").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _top_by_index(queries: DataFrame, words: DataFrame, k: int) -> DataFrame:
    held = words.toPandas().sort_values(["word", "entry_id"], kind="stable")
    ids = np.unique(held["entry_id"].to_numpy(dtype=np.int64))
    posted = np.searchsorted(ids, held["entry_id"].to_numpy(dtype=np.int64)).astype(np.int32)
    names, starts = np.unique(held["word"].to_numpy(dtype=object).astype(str), return_index=True)
    ends = [*starts[1:].tolist(), len(posted)][: len(names)]
    index = queries.sparkSession.sparkContext.broadcast((ids, posted, dict(zip(names.tolist(), zip(starts.tolist(), ends, strict=True), strict=True))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, posted, where = index.value
        for batch in batches:
            rows = []
            for i, words in zip(batch["query_id"], batch["words"], strict=True):
                lists = [posted[slice(*where[w])] for w in ([] if words is None else words) if w in where]
                if not lists:
                    continue
                score = np.bincount(np.concatenate(lists), minlength=len(ids))
                least = np.partition(score, -k)[-k] if len(score) > k else 0
                best = np.flatnonzero(score >= max(1, least))
                best = best[np.lexsort((best, -score[best]))][:k]
                rows.extend((i, ids[b], score[b], r) for r, b in enumerate(best, 1))
            yield pd.DataFrame(rows, columns=["query_id", "entry_id", "score", "rank"])

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), content_words(F.col("text")).alias("words"))
    return asked.mapInPandas(run, "query_id long, entry_id long, score long, rank int")


def lcs_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas form of ``lcs`` for rows (id, a, b)."""
    for batch in batches:
        yield pd.DataFrame({"id": batch["id"], "length": [lcs_length(x or "", y or "") for x, y in zip(batch["a"], batch["b"], strict=True)]})
