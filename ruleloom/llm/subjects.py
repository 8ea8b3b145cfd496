"""Subject areas of documents: bisecting k-means leaves, their discriminative terms and mixtures.

Documents are read once into hashed terms by unit: a sentence of prose, a paragraph or routine of code. Bisecting
k-means grows a tree over the normalised vectors of all documents, and every document goes to a leaf. Hand labels
name the leaves: a leaf's mixture of subjects is that of its labelled documents. The leaves label the terms that are
more frequent in them than elsewhere, a term's subjects being the mixtures of the leaves that hold it, with the
subjects' descriptions beside. A unit is assigned by its terms and by the mixture of its document's leaf, the terms
are counted again by unit, and a document has every subject that a quarter of its speaking units speak of.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.plans.lineage import release, settle

#: Rows of the hashed term table; bounds every model that is shipped or collected.
TERM_BITS = 17
#: Function words that speak of nothing.
STOP = frozenset("the and for with from that this then than into its are was were has have had not but all any can may must who which what when where while will would should there their they them these those one two our out over under per via der die das und ein eine einer mit von den dem des ist bei que los las del una con por para end exit move perform pic value select else".split())
_NO_LETTER = re.compile(r"[\W\d_]")
_ASCII = bytes(range(128))
#: Of the bytes, letters of ASCII, those of other characters and the marks stay; all others become spaces.
_LETTERS = bytes(b if b > 127 or b < 2 or chr(b).isalpha() else 32 for b in range(256))
# these begin with a character of their own, which is looked for faster than what stands before it
_CAMEL = re.compile(r"[A-Z](?<=[a-z][A-Z])")
_SENTENCE = re.compile(r"\s(?:(?<=[.!?]\s)\s*|(?<=\n)\n*)")
_COBOL = re.compile(r"\n(?=.{6} (?:[A-Z0-9][A-Z0-9-]*(?: +SECTION| +DIVISION)?\.|0?1 |FD )[^\n]*)", re.IGNORECASE)
_VB = re.compile(r"\n(?=[ \t]*(?:(?:Public|Private|Friend|Protected|Static|Shared)\s+)*(?:Sub|Function|Property)\b)", re.IGNORECASE)
_SQL = re.compile(r"\n(?=[ \t]*CREATE\s+(?:OR\s+\w+\s+)?(?:PROC|FUNC))", re.IGNORECASE)


@dataclass(frozen=True)
class Clustering:
    """``levels`` of bisection give at most 2^levels leaves; a leaf below ``least_leaf`` documents is not split.
    The tree is grown from all documents; the part below a node of up to ``task`` documents grows in one task, larger nodes are
    split in passes over all tasks, of which there are ``most_tasks`` at most. ``leaf_weight`` is
    that of a leaf's mixture in the decision on a unit. ``noise`` and ``least_score`` are shares of the lift that a
    term of one subject alone would have, the log of the number of subjects."""

    dim: int = 128
    levels: int = 10
    iterations: int = 8
    least_leaf: int = 20
    rounds: int = 3
    task: int = 20_000
    most_tasks: int = 64
    leaf_weight: float = 0.3
    prior: float = 2.0
    noise: float = 0.32
    least_sharp: float = 0.35
    enough: float = 8.0
    least_purity: float = 0.4
    least_score: float = 0.2
    least_share: float = 0.25
    most: int = 2


#: Stand between two units and between two texts; no term row is as large.
UNIT, TEXT = (1 << 32) - 2, (1 << 32) - 1
_MASK = (1 << TERM_BITS) - 1


class Words(dict):
    """Remembers the hashed rows of words (in UTF-8), 0 of short and function words; starts anew at half a million."""

    def __missing__(self, raw: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        word = raw.decode()
        if word <= "\x01":
            row = UNIT if word == "\x00" else TEXT
        else:
            row = 0 if len(word) < 3 or word in STOP else xxhash.xxh32_intdigest(raw) % _MASK + 1
        self[raw] = row
        return row


def words_of(text: str) -> list[bytes]:
    """The runs of letters and the marks, which stand between spaces, in UTF-8."""
    raw = text.encode()
    for c in set(raw.translate(None, _ASCII).decode()):
        if _NO_LETTER.match(c):
            raw = raw.replace(c.encode(), b" ")
    return raw.translate(_LETTERS).split()


_MENTION = re.compile(r"[pPgG'](?:(?<=\b[pP])(?i:erform)\s+[\w-]+|(?<=\b[gG])[oO]\s+(?i:to)\s+[\w-]+|(?<=')[^'\n]*')")
_NO_UNIT = re.compile(r"^.{0,7}\s*(?:PROGRAM-ID|FILE-CONTROL|0?1 |FD )", re.IGNORECASE)


def cobol_units(text: str) -> list[str]:
    """The paragraphs. Comments above a header belong to it, calls of other paragraphs and literals are passing
    mentions, the header's name counts twice; the program's name, its files and its records of data are no units."""
    out, above = [], ""
    for part in _COBOL.split(text):
        lines = part.split("\n")
        n = len(lines)
        while n > 1 and (not lines[n - 1].strip() or lines[n - 1][6:7] in ("*", "/")):
            n -= 1
        if not _NO_UNIT.match(lines[0]):
            out.append("\n".join([lines[0], above, lines[0], _MENTION.sub(" ", "\n".join(lines[1:n]))]))
        above = "\n".join(lines[n:])
    return out


def units(text: str, code: str | None) -> list[str]:
    """Sentences of prose; paragraphs or routines of code."""
    kind = (code or "").lower()
    if kind.startswith("cob"):
        return cobol_units(text)
    if kind.startswith("vb") or kind == "bas":
        return _VB.split(text)
    if kind.startswith("sql"):
        return _SQL.split(text)
    return _SENTENCE.split(text)


def text_terms(texts: list[list[str]], known: Words) -> list[np.ndarray]:
    """For each text, given by its units, the rows of the units' words, each followed by that of the pair it begins,
    and a zero after each unit that has any.

    Pairs do not reach over short or function words, nor over the end of a unit.
    """
    found = words_of(" \x01 ".join([" \x00 ".join(own) for own in texts]).lower())
    rows = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    # the end of a text ends its last unit
    last = rows == TEXT
    rows = np.insert(np.append(rows, np.uint64(UNIT)), np.flatnonzero(last), np.uint64(UNIT))
    out = np.zeros((len(rows), 2), dtype=np.uint64)
    out[:, 0] = rows
    a, b = rows[:-1], rows[1:]
    pair = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    pair = (pair ^ (pair >> np.uint64(29))) % np.uint64(_MASK) + np.uint64(1)
    out[:-1, 1] = np.where((a > 0) & (b > 0) & (a < UNIT) & (b < UNIT), pair, 0)
    flat = out.ravel()
    flat = flat[flat > 0]
    # units without terms leave no mark
    ends = flat == UNIT
    flat = flat[~(ends & np.r_[True, flat[:-1] >= UNIT])]
    flat = np.where(flat == UNIT, 0, flat)
    at = np.flatnonzero(flat == TEXT)
    return [part.astype(np.uint32) for part in np.split(flat[flat != TEXT], at - np.arange(len(at)))]


def reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas: (id, text, code) to (id, terms): 32-bit rows, a zero after each unit that has any."""
    known = Words()
    for batch in batches:
        for at in range(0, len(batch), 250):
            part = batch.iloc[at : at + 250]
            own = []
            for text, code in zip(part["text"], part["code"], strict=True):
                text = text.replace("\r", "").replace("\x00", " ").replace("\x01", " ")
                if code and not (code or "").lower().startswith("cob"):
                    text = _CAMEL.sub(r" \g<0>", text)
                own.append(units(text, code))
            yield pd.DataFrame({"id": part["id"], "terms": [t.tobytes() for t in text_terms(own, known)]})


def flatten(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All rows of a batch and the length of each document."""
    sizes = column.str.len().to_numpy() // 4
    return np.frombuffer(b"".join(column), dtype=np.uint32).astype(np.int64), sizes


def once(column: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The document, by its place, and the row of each term that a document holds, each once, in blocks in order."""
    for at in range(0, len(column), 500):
        flat, sizes = flatten(column.iloc[at : at + 500])
        # place and row in 32 bits, which are sorted fastest
        keys = np.sort((np.repeat(np.arange(len(sizes)), sizes) << TERM_BITS | flat).astype(np.uint32))
        keys = keys[np.diff(keys, prepend=keys[:1] - np.uint32(1)) != 0]
        yield (keys >> TERM_BITS).astype(np.int64) + at, (keys & _MASK).astype(np.int64)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each term row, and all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(1 << TERM_BITS, dtype=np.int64), 0
        for batch in batches:
            for _, rows in once(batch["terms"]):
                np.add.at(total, rows, 1)
            n += len(batch)
        total[0] = n
        at = np.flatnonzero(total)
        yield pd.DataFrame({"row": at, "n": total[at]})

    frame = docs.select("terms").mapInPandas(count, "row long, n long").groupBy("row").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << TERM_BITS, dtype=np.int64)
    out[frame["row"].to_numpy(dtype=np.int64)] = frame["n"]
    return out, int(out[0])


def doc_vectors(terms: pd.Series, table: np.ndarray) -> np.ndarray:
    """The documents' weighted terms, projected by ``table`` and normalised; zero without terms."""
    live = table.any(axis=1)
    own = np.zeros((len(terms), table.shape[1]), dtype=np.float32)
    for i, raw in enumerate(terms):
        flat = np.frombuffer(raw, dtype=np.uint32)
        # terms without weight add nothing
        flat = flat[live[flat]]
        if len(flat):
            np.add.reduce(table[flat], axis=0, out=own[i])
    return own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)


def projection(idf: np.ndarray, c: Clustering) -> np.ndarray:
    """``dim`` random directions of the term rows, weighted by their idf."""
    return np.random.default_rng(3).standard_normal((1 << TERM_BITS, c.dim), dtype=np.float32) * idf[:, None].astype(np.float32)


def descend(own: np.ndarray, tree: dict[int, np.ndarray], root: int = 1) -> np.ndarray:
    """Leaf of each vector: node k has the children 2k and 2k + 1; the root of the whole tree is 1."""
    node = np.full(len(own), root, dtype=np.int64)
    while True:
        moved = False
        for k in np.unique(node):
            if 2 * k in tree:
                at = np.flatnonzero(node == k)
                right = (own if len(at) == len(own) else own[at]) @ (tree[2 * k + 1] - tree[2 * k]) > (tree[2 * k + 1] @ tree[2 * k + 1] - tree[2 * k] @ tree[2 * k]) / 2
                node[at] = 2 * k + right
                moved = True
        if not moved:
            return node


def start(mean: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Two centres a little beside the mean."""
    push = rng.normal(size=len(mean))
    push *= 0.1 / np.linalg.norm(push)
    return [mean + push, mean - push]


def rightward(part: np.ndarray, two: list[np.ndarray]) -> np.ndarray:
    """Which vectors are nearer to the second centre."""
    return part @ (two[1] - two[0]) > (two[1] @ two[1] - two[0] @ two[0]) / 2


def bisect(own: np.ndarray, c: Clustering, root: int = 1) -> dict[int, np.ndarray]:
    """The tree of centres below ``root``, whose vectors are ``own``, grown a level at a time by two-means within every leaf
    that is large enough."""
    tree: dict[int, np.ndarray] = {}
    rng = np.random.default_rng(8 + root)
    for _ in range(c.levels + 1 - root.bit_length()):
        node = descend(own, tree, root)
        grown = [int(k) for k, n in zip(*np.unique(node, return_counts=True), strict=True) if n >= 2 * c.least_leaf]
        if not grown:
            break
        for k in grown:
            part = own[node == k]
            two = start(part.mean(axis=0), rng)
            for _ in range(c.iterations):
                right = rightward(part, two)
                two = [part[~right].mean(axis=0) if (~right).any() else two[0], part[right].mean(axis=0) if right.any() else two[1]]
            tree[2 * k], tree[2 * k + 1] = two
    return tree


def sums(vecs: DataFrame, tree: dict[int, np.ndarray], split: dict[int, list[np.ndarray]], c: Clustering) -> dict[int, tuple[int, np.ndarray]]:
    """Number and sum of the vectors of each leaf, or of each side of a leaf that ``split`` has two centres of (2k and 2k + 1).

    A task sends one row a leaf, so the driver gets a table of fixed size from each of its few tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0)
            first, last = np.frombuffer(column.buffers()[1], dtype=np.int32)[[column.offset, column.offset + batch.num_rows]]
            own = np.frombuffer(column.buffers()[2], dtype=np.float32, count=(last - first) // 4, offset=first).reshape(batch.num_rows, -1)
            node = descend(own, tree)
            for k in map(int, np.unique(node)):
                here = node == k
                part = own if here.all() else own[here]
                if k in split:
                    right = rightward(part, split[k])
                    parts = [(2 * k, ~right), (2 * k + 1, right)]
                elif split:
                    continue
                else:
                    parts = [(k, np.ones(len(part), dtype=bool))]
                for at, own_side in parts:
                    n, total = held.get(at, (0, 0.0))
                    held[at] = n + int(own_side.sum()), total + (own_side.astype(np.float32) @ part).astype(np.float64)
        columns = [pa.array(list(held), pa.int64()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([total.tobytes() for _, total in held.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["node", "n", "total"])

    out: dict[int, tuple[int, np.ndarray]] = {}
    tasks = min(c.most_tasks, vecs.sparkSession.sparkContext.defaultParallelism)
    for r in vecs.select("vec").coalesce(tasks).mapInArrow(run, "node long, n long, total binary").collect():
        n, total = out.get(r["node"], (0, 0.0))
        out[r["node"]] = n + r["n"], total + np.frombuffer(r["total"], dtype=np.float64)
    return out


def grow(vecs: DataFrame, n_docs: int, c: Clustering) -> dict[int, np.ndarray]:
    """The tree of centres of all documents, from settled (id, vec).

    Nodes of more than ``task`` documents are split level by level, each iteration of two-means a pass over all vectors;
    what is below the smaller ones grows in a task each. Both do the same, up to the last digits of sums.
    """
    tree: dict[int, np.ndarray] = {}
    held = {1: n_docs}
    while any(n > c.task and k.bit_length() <= c.levels for k, n in held.items()):
        leaves = sums(vecs, tree, {}, c)
        held = {k: n for k, (n, _) in leaves.items()}
        large = [k for k, n in held.items() if n > c.task and n >= 2 * c.least_leaf and k.bit_length() <= c.levels]
        if not large:
            break
        split = {k: start(leaves[k][1] / held[k], np.random.default_rng(8 + k)) for k in large}
        for _ in range(c.iterations):
            found, before = sums(vecs, tree, split, c), split
            split = {k: [(found[at][1] / found[at][0]).astype(np.float32) if found.get(at, (0,))[0] else old for at, old in zip((2 * k, 2 * k + 1), two, strict=True)] for k, two in split.items()}
            # what no longer moves stays
            if all(np.array_equal(x, y) for k in split for x, y in zip(before[k], split[k], strict=True)):
                break
        for k, two in split.items():
            tree[2 * k], tree[2 * k + 1] = two

    small = [k for k, n in held.items() if 2 * c.least_leaf <= n <= c.task and k.bit_length() <= c.levels]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            node = descend(np.frombuffer(b"".join(batch["vec"]), dtype=np.float32).reshape(-1, c.dim), tree)
            yield batch.assign(node=node)[np.isin(node, small)]

    def fit_tree(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        below = bisect(np.frombuffer(b"".join(frame["vec"]), dtype=np.float32).reshape(-1, c.dim), c, int(frame["node"].iloc[0]))
        return pd.DataFrame([(k, np.asarray(v, dtype=np.float64).tobytes()) for k, v in below.items()], columns=["node", "centre"])

    rows = vecs.select("id", "vec").mapInPandas(place, "id long, vec binary, node long").groupBy("node").applyInPandas(fit_tree, "node long, centre binary").collect()
    return tree | {r["node"]: np.frombuffer(r["centre"], dtype=np.float64) for r in rows}


def lifts(counts: np.ndarray, silent: np.ndarray, c: Clustering) -> np.ndarray:
    """Log of how much more a term's units speak of each subject than units at large, less ``noise`` towards zero.

    Rare terms shrink to zero, and so do terms of all subjects (frames of a language or a format), whose slight
    leanings would otherwise add up over a unit.
    """
    share = counts.sum(axis=0) + 1e-9
    share = share / share.sum()
    total = counts.sum(axis=1) + silent
    raw = np.log((counts + c.prior * share) / ((total + c.prior)[:, None] * share)).clip(-3, 4)
    # a term that leans to no subject tells nothing against one either
    noise = c.noise * np.log(max(2, counts.shape[1]))
    raw[raw.max(axis=1) < noise] = 0
    return (np.sign(raw) * (np.abs(raw) - noise).clip(0)).astype(np.float32)


def scores(batch: pd.DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat terms, unit of each, document of each unit, and the units' scores by subject."""
    flat, sizes = flatten(batch["terms"])
    if not len(flat):
        return flat, flat, flat, np.zeros((0, weights.shape[1]))
    unit = np.cumsum(flat == 0) - (flat == 0)
    doc = np.repeat(np.arange(len(sizes)), sizes)[flat == 0]
    starts = np.concatenate([[0], np.flatnonzero(flat == 0)[:-1] + 1])
    # column by column, which is several times as fast as rows
    return flat, unit, doc, np.stack([np.add.reduceat(column[flat], starts) for column in np.ascontiguousarray(weights.T)], axis=1)


def shares(doc: np.ndarray, score: np.ndarray, prior: np.ndarray, c: Clustering) -> tuple[np.ndarray, np.ndarray]:
    """Subject of each unit (-1: none) and the documents' shares of their speaking units.

    ``prior`` is the log of the mixture of each document's leaf. Units are judged by their terms and the leaf, then again
    with the document's own mixture as well, which settles the units whose terms belong to several subjects.
    """
    least = c.least_score * np.log(max(2, score.shape[1]))
    leaning = score + c.leaf_weight * prior[doc]
    best = np.where(score.max(axis=1) >= least, leaning.argmax(axis=1), -1)
    out = np.zeros(prior.shape)
    for _ in range(2):
        out[:] = 0
        speaks = best >= 0
        np.add.at(out, (doc[speaks], best[speaks]), 1)
        mix = (out + 0.3) / (out.sum(axis=1, keepdims=True) + 0.3 * out.shape[1])
        best = np.where(score.max(axis=1) >= least, (leaning + np.log(mix)[doc]).argmax(axis=1), -1)
    out[:] = 0
    speaks = best >= 0
    np.add.at(out, (doc[speaks], best[speaks]), 1)
    return best, out


def _add_up(rows: DataFrame, n: int) -> np.ndarray:
    """Sum of (row, v0..vn) by row as a table of fixed size."""
    frame = rows.groupBy("row").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(n)]).toPandas()
    out = np.zeros((1 << TERM_BITS, n))
    out[frame["row"].to_numpy(dtype=np.int64)] = frame[[f"v{k}" for k in range(n)]].to_numpy(dtype=float)
    return out


def leaf_priors(leaf: pd.Series, mixtures: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Log of the mixture of each document's leaf, smoothed; of a leaf without labels the same for all subjects."""
    known = {k: np.log(0.95 * v + 0.05 / n) for k, v in mixtures.items()}
    flat = np.full(n, -np.log(n))
    return np.array([known.get(k, flat) for k in leaf]).reshape(len(leaf), n)


def _emit(table: np.ndarray) -> pd.DataFrame:
    at = np.flatnonzero(table.any(axis=1))
    return pd.DataFrame({"row": at} | {f"v{k}": table[at, k] for k in range(table.shape[1])})


@dataclass
class SubjectModel:
    """Subjects, the tree of leaves, the leaves' mixtures, the leaves' telling terms and the terms' lifts."""

    names: list[str]
    tree: dict[int, np.ndarray]
    mixtures: dict[int, np.ndarray]
    weights: np.ndarray


def fit(docs: DataFrame, subjects: list[tuple[str, str]], labels: DataFrame, c: Clustering) -> tuple[SubjectModel, DataFrame]:
    """The model of settled ``docs`` (id, terms), and the documents with their leaf; ``labels`` has id and subject, repeated
    and wrong rows included. Labels name the leaves only; terms learn from the leaves."""
    names = sorted({s for s, _ in subjects})
    at = {s: k for k, s in enumerate(names)}
    n_sub = len(names)
    df, n = frequencies(docs)
    idf = np.where(df > 0, np.log((n + 1) / (df + 0.5)), 0).clip(0)
    idf[0] = 0
    # what half of the documents or a single one holds draws none together
    idf[(df > 0.5 * n) | (df < 2)] = 0

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = projection(idf, c)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "terms": batch["terms"], "vec": [v.tobytes() for v in doc_vectors(batch["terms"], table)]})

    vecs = settle(docs.mapInPandas(project, "id long, terms binary, vec binary"), "vectors")
    release(docs)
    tree = grow(vecs, n, c)

    def leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch["vec"]), dtype=np.float32).reshape(-1, c.dim)
            yield pd.DataFrame({"id": batch["id"], "leaf": descend(own, tree), "terms": batch["terms"]})

    docs = settle(vecs.mapInPandas(leaf, "id long, leaf long, terms binary"), "leaves")
    release(vecs)
    told = labels.where(F.col("subject").isin(names)).select("id", "subject").distinct()
    by_leaf = docs.select("id", "leaf").join(told, "id").groupBy("leaf", "subject").agg(F.count("*").alias("n")).collect()
    base = np.full(n_sub, 1.0 / max(1, n_sub))
    mixtures: dict[int, np.ndarray] = {}
    for k, subject, count in by_leaf:
        mixtures.setdefault(k, base * 0.5)[at[subject]] += count
    mixtures = {k: v / v.sum() for k, v in mixtures.items()}
    # a leaf tells as much as its mixture is sharp: one of all subjects (a language, say) tells nothing
    sharp = {k: float(1 + (v * np.log(v)).sum() / np.log(max(2, n_sub))) for k, v in mixtures.items()}

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((n_sub, 1 << TERM_BITS))
        nothing = np.zeros(n_sub)
        for batch in batches:
            told = np.array([mixtures[k] * sharp[k] if sharp.get(k, 0) >= c.least_sharp else nothing for k in batch["leaf"]]).reshape(len(batch), n_sub)
            for doc, rows in once(batch.loc[:, "terms"]):
                for column, own in zip(table, told.T, strict=True):
                    np.add.at(column, rows, own[doc])
        table[:, 0] = 0
        yield _emit(table.T)

    schema = "row long, " + ", ".join(f"v{k} double" for k in range(n_sub))
    counts = _add_up(docs.select("terms", "leaf").mapInPandas(first, schema), n_sub)
    known = Words()
    for s, about in subjects:
        rows = np.unique(text_terms([[s.replace("_", " "), about or ""]], known)[0])
        counts[rows, at[s]] += c.prior
    weights = lifts(counts, np.zeros(len(counts)), c)
    # terms that the labels show to lean to no subject stay neutral, whatever the rounds would make of them
    neutral = (counts.sum(axis=1) >= c.enough) & (counts.max(axis=1) < c.least_purity * counts.sum(axis=1))
    neutral[0] = True
    weights[neutral] = 0
    for _ in range(c.rounds):

        def again(batches: Iterator[pd.DataFrame], weights: np.ndarray = weights) -> Iterator[pd.DataFrame]:
            table = np.zeros((1 << TERM_BITS, n_sub + 1))
            weights = np.asfortranarray(weights)
            for batch in batches:
                for part in (batch.iloc[i : i + 500] for i in range(0, len(batch), 500)):
                    flat, unit, doc, score = scores(part, weights)
                    if len(flat):
                        best, _ = shares(doc, score, leaf_priors(part["leaf"], mixtures, n_sub), c)
                        keys = flat * (n_sub + 1) + np.where(best < 0, n_sub, best)[np.minimum(unit, len(best) - 1)]
                        np.add.at(table.reshape(-1), keys, 1)
            table[0] = 0
            yield _emit(table)

        more = _add_up(docs.select("terms", "leaf").mapInPandas(again, schema + f", v{n_sub} double"), n_sub + 1)
        weights = lifts(more[:, :n_sub], more[:, n_sub], c)
        weights[neutral] = 0
    return SubjectModel(names, tree, mixtures, weights), docs


def read(df: DataFrame, id_col: str, text_col: str, code_col: str | None) -> DataFrame:
    """Settled (id, terms) of the non-empty texts."""
    code = F.col(code_col) if code_col else F.lit(None).cast("string")
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), code.alias("code")).where(F.length("text") > 0)
    return settle(own.mapInPandas(reader, "id long, terms binary"), "terms")


def assign(docs: DataFrame, model: SubjectModel, c: Clustering) -> DataFrame:
    """(id, subject, share, units) of ``docs`` (id, leaf, terms): subjects with enough of the document's speaking units, the largest first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = np.asfortranarray(model.weights)
        for batch in batches:
            rows = []
            for part in (batch.iloc[i : i + 500] for i in range(0, len(batch), 500)):
                _, _, doc, score = scores(part, weights)
                _, count = shares(doc, score, leaf_priors(part["leaf"], model.mixtures, len(model.names)), c) if len(score) else (None, np.zeros((len(part), len(model.names))))
                total = count.sum(axis=1)
                for d, k in zip(*np.nonzero(count), strict=True):
                    share = count[d, k] / total[d]
                    rank = (count[d] > count[d, k]).sum() + (count[d, :k] == count[d, k]).sum()
                    if share >= c.least_share and rank < c.most:
                        rows.append((part["id"].iloc[d], model.names[k], share, int(total[d])))
            yield pd.DataFrame(rows, columns=["id", "subject", "share", "units"])

    return docs.mapInPandas(run, "id long, subject string, share double, units int")


def document_subjects(df: DataFrame, id_col: str, text_col: str, code_col: str | None, subjects: DataFrame, labels: DataFrame, c: Clustering = Clustering()) -> DataFrame:
    """``id``, ``subject``, ``share`` and speaking ``units`` of each document's one or two subjects.

    ``subjects`` has subject and about, ``labels`` id and subject. Null and empty texts, and texts that speak of no
    subject, give no row; ties go to the subject first in the alphabet; repeated documents are read alike; without
    labels only the subjects' descriptions tell.
    """
    about = [(r["subject"], r["about"]) for r in subjects.select("subject", "about").where("subject is not null").collect()]
    docs = read(df, id_col, text_col, code_col)
    if not about:
        return docs.sparkSession.createDataFrame([], "id long, subject string, share double, units int")
    model, docs = fit(docs, about, labels, c)
    return assign(docs, model, c)
