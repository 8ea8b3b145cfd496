"""Evaluation texts leaking into training text, by latent semantic retrieval and exact alignment.

Documents and items are read as words without case, punctuation, comment marks, escapes and markup, and cut into
passages of three blocks of 13 words, one block apart, so that any run of 25 words lies within one. Term weights
come from document frequencies over all documents. A randomised SVD of the weighted passages gives latent vectors;
passages whose latent cosine with an item's passage is high are compared again with the whole term vectors, and
what remains is aligned word by word: a longest common subsequence, within which a run of the item's words with
few errors must be found. How many of its telling words (numbers and codes: the answer) agree is reported only.
Where only leaks are asked for, documents that share no stretch of words with an item, as every leak surely does,
are left before that (``sure_words``, lossless).

The items are the stated query set: they are taken in blocks of bounded size, each against all documents, so that a
task holds the vectors of one block only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.plans.lineage import settle

BLOCK, PASSAGE = 13, 3
#: Rows of the hashed term table; bounds what is counted, shipped and held.
TERM_BITS = 18
_NOISE = re.compile(r"<[^<>\n]{1,60}>|&[a-z]{2,6};|&#\d+;|\\u[0-9a-f]{4}|\\[nrtbf\"'\\/]")
_COLUMNS = re.compile(r"(?m)^\d{6}(?=[ *])")
_TAGS = re.compile(r"(?m)^(.{65})(.{7})[a-z]{1,3}\d{5}[ \r]*$")
_WORD = re.compile(r"[a-z0-9]+(?:['-][a-z0-9]+)*")


@dataclass(frozen=True)
class Leakage:
    """``latent_cosine`` proposes passages, ``term_cosine`` items; a leak is a run of ``least_run`` item words with
    at most one error in ``error_every`` words. ``sample`` is about the number of documents, taken by the hash of
    their ids, that the SVD is fitted on beside all items; the search covers every passage of every document."""

    dim: int = 64
    latent_cosine: float = 0.16
    term_cosine: float = 0.35
    least_run: int = 25
    error_every: int = 8
    items_per_block: int = 4_000
    sample: int = 1_000
    power_steps: int = 2


def words(text: str) -> list[str]:
    """The words of a text, without case, markup, escapes, source columns and punctuation."""
    low = text.lower()
    if "\\" in low or "<" in low or "&" in low:
        low = _NOISE.sub(" ", low)
    if _COLUMNS.search(low):
        low = _COLUMNS.sub(" ", low)
    if _TAGS.search(low):
        low = _TAGS.sub(r"\1\2", low)
    return _WORD.findall(low)


def term(word: str) -> int:
    """Row of a word in the term table; row 0 is padding."""
    return xxhash.xxh32_intdigest(word) % ((1 << TERM_BITS) - 1) + 1


class Terms(dict):
    """Remembers the rows of words, starting anew when it has grown to half a million."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        row = self[word] = term(word)
        return row


def blocks(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Term rows padded to whole blocks, two blocks of padding between documents; first block of each document."""
    out, starts, at = [], [], 0
    for d in docs:
        n = -(-max(len(d), 1) // BLOCK) + PASSAGE - 1
        own = np.zeros(n * BLOCK, dtype=np.int32)
        own[: len(d)] = d
        out.append(own)
        starts.append(at)
        at += n
    return np.concatenate(out), np.array(starts)


def passages(flat: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the table's rows over each passage; passage i starts with block i."""
    own = table[flat].reshape(-1, BLOCK, *table.shape[1:]).sum(axis=1)
    own = np.concatenate([own, np.zeros((PASSAGE - 1, *own.shape[1:]), dtype=own.dtype)])
    return own[:-2] + own[1:-1] + own[2:]


def lcs_pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions matched by one longest common subsequence (bit-parallel, then traced back)."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = [full]
    for w in b:
        v = rows[-1]
        u = v & masks.get(w, 0)
        rows.append(((v + u) | (v - u)) & full)
    common = lambda i, j: i - (rows[j] & ((1 << i) - 1)).bit_count()
    i, j, out = len(a), len(b), []
    here = common(i, j)
    while here and i and j:
        if a[i - 1] == b[j - 1] and common(i - 1, j - 1) == here - 1:
            out.append((i - 1, j - 1))
            i, j, here = i - 1, j - 1, here - 1
        elif common(i - 1, j) == here:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def longest_run(item: list[str], doc: list[str], error_every: int) -> tuple[int, int, int]:
    """(words, errors, telling) of the longest run of the item's words in the document within the error rate.

    An error is a word replaced, dropped or added; ``telling`` is the per cent of the run's item words with a
    digit that are matched (100 if it has none). A run begins and ends with a match.
    """
    pairs = lcs_pairs(item, doc)
    if not pairs:
        return 0, 0, 0
    p, q = np.array(pairs).T
    gaps = np.maximum(np.diff(p), np.diff(q)) - 1
    err = np.concatenate([[0], np.cumsum(gaps)])
    span = p[None, :] - p[:, None] + 1
    errors = err[None, :] - err[:, None]
    ok = (span >= 1) & (errors * error_every <= np.maximum(span, 0))
    a, b = np.unravel_index(np.argmax(np.where(ok, span, 0)), span.shape)
    inside = [i for i in range(p[a], p[b] + 1) if any(c.isdigit() for c in item[i])]
    hit = set(p[a : b + 1].tolist())
    telling = 100 * sum(i in hit for i in inside) // len(inside) if inside else 100
    return int(span[a, b]), int(errors[a, b]), telling


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Number of documents that hold each term row, over all documents, and the number of documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, total, n = Terms(), np.zeros(1 << TERM_BITS, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                rows = np.unique(np.fromiter(map(known.__getitem__, set(words(text))), dtype=np.int64))
                total[rows] += 1
                n += 1
        total[0] = n
        at = np.flatnonzero(total)
        yield pd.DataFrame({"row": at, "n": total[at]})

    counts = texts.select("text").mapInPandas(count, "row long, n long").groupBy("row").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << TERM_BITS, dtype=np.int64)
    frame = counts.toPandas()  # at most 2^TERM_BITS rows
    out[frame["row"].to_numpy(dtype=np.int64)] = frame["n"]
    return out, int(out[0])


#: Rows of the basis that are added up in one group; bounds what a task of the SVD's sum holds.
ROWS_TOGETHER = 4096


def randomised_svd(texts: DataFrame, n_texts: int, items: list[np.ndarray], idf: np.ndarray, m: Leakage) -> np.ndarray:
    """Right singular vectors (term rows x dim) of weighted passages: all items' and those of a sample of the corpus.

    Distributed subspace iteration: every task multiplies its documents' passages with the current basis and back, the
    products are added up by blocks of rows, and the sum is orthogonalised. Documents are sampled by the hash of
    their ids and read whole. Only words of the items have a row in the basis, as only they can speak for an item.
    """
    vocabulary = np.unique(np.concatenate(items)) if items else np.zeros(0, dtype=np.int64)
    vocabulary = vocabulary[vocabulary > 0]
    column = np.zeros(1 << TERM_BITS, dtype=np.int32)
    column[vocabulary] = np.arange(1, len(vocabulary) + 1)
    weight = np.concatenate([[0], idf[vocabulary]]).astype(np.float32)
    square = (idf**2)[:, None]

    def product(docs: list[np.ndarray], basis: np.ndarray) -> np.ndarray:
        """A^T (A basis) of the passages of the documents, normalised by their whole weight."""
        out = np.zeros_like(basis)
        for at in range(0, len(docs), 200):
            flat, _ = blocks(docs[at : at + 200])
            norm = np.sqrt(np.maximum(passages(flat, square), 1e-9))
            own = column[flat]
            y = passages(own, weight[:, None] * basis) / norm**2
            for k in range(PASSAGE):
                rows = own.reshape(-1, BLOCK)[k : len(y)]
                np.add.at(out, rows.ravel(), np.repeat(y[: len(rows)], BLOCK, axis=0) * weight[rows.ravel()][:, None])
        out[0] = 0
        return out

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Terms()
        for batch in batches:
            yield pd.DataFrame({"terms": [np.fromiter(map(known.__getitem__, words(t)), dtype=np.int32).tobytes() for t in batch["text"]]})

    spread = 1 << 30
    chosen = F.pmod(F.xxhash64("id"), F.lit(spread)) < max(1, int(spread * min(1.0, m.sample / max(1, n_texts))))
    sampled = settle(texts.where(chosen).select("text").mapInPandas(read, "terms binary"), "sample")
    documents = sampled.count()

    def corpus(basis: np.ndarray) -> np.ndarray:
        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(basis)
            for batch in batches:
                total += product([np.frombuffer(t, dtype=np.int32) for t in batch["terms"]], basis)
            at = range(0, len(total), ROWS_TOGETHER)
            yield pd.DataFrame({"block": [b // ROWS_TOGETHER for b in at], "part": [total[b : b + ROWS_TOGETHER].tobytes() for b in at]})

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            part = np.frombuffer(frame["part"].iloc[0], dtype=np.float32).copy()
            for other in frame["part"].iloc[1:]:
                part += np.frombuffer(other, dtype=np.float32)
            return pd.DataFrame({"block": frame["block"].iloc[:1], "part": [part.tobytes()]})

        parts = sampled.mapInPandas(multiply, "block int, part binary").groupBy("block").applyInPandas(add, "block int, part binary")
        out = np.zeros_like(basis)
        for b, part in parts.collect():  # the basis itself, in blocks
            own = np.frombuffer(part, dtype=np.float32).reshape(-1, basis.shape[1])
            out[b * ROWS_TOGETHER : b * ROWS_TOGETHER + len(own)] = own
        return out

    rng = np.random.default_rng(5)
    basis = rng.normal(size=(len(vocabulary) + 1, m.dim)).astype(np.float32)
    basis[0] = 0
    for _ in range(m.power_steps):
        # the items stand for the queries' space and weigh as much as the corpus sample
        z = product(items, basis) * max(1, documents // max(1, len(items))) + corpus(basis)
        basis = np.linalg.qr(z)[0].astype(np.float32)
    out = np.zeros((1 << TERM_BITS, m.dim), dtype=np.float32)
    out[vocabulary] = basis[1:, : m.dim] if basis.shape[1] == m.dim else np.pad(basis[1:], ((0, 0), (0, m.dim - basis.shape[1])))
    return out


def first_sentence(text: str) -> tuple[str, str | None]:
    """The words of the first sentence, and the text behind it (None if there is none)."""
    parts = re.split(r"(?<=[.!?:])\s", text.strip(), maxsplit=1)
    return " ".join(words(parts[0])), parts[1] if len(parts) > 1 else None


def opening_sentences(items: DataFrame) -> set[str]:
    """First sentences that several of all items (text) share: instructions, not passages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"sentence": [first_sentence(t)[0] for t in batch["text"]]})

    first = items.select("text").mapInPandas(run, "sentence string").where("sentence <> ''")
    return {r[0] for r in first.groupBy("sentence").agg(F.count("*").alias("n")).where("n > 1").select("sentence").collect()}


def without_opening(text: str, shared: set[str]) -> list[str]:
    """The item's words without a shared opening sentence."""
    first, rest = first_sentence(text)
    return words(rest) if rest is not None and first in shared else words(text)


def sure_words(least: int, error_every: int) -> int:
    """Words in a row that every run of ``least`` words or more repeats without an error; 0 if none are sure.

    The e errors of a run of n words, at most n / error_every, leave n - e words in e + 1 groups at most, one of which
    holds the average. That is least for the shortest run, or the shortest with one error more.
    """
    if error_every < 2:
        return 0
    most = [(n, n // error_every) for n in (least, -(-least // error_every) * error_every)]
    return min(-(-(n - e) // (e + 1)) for n, e in most)


def grams(rows: np.ndarray, size: int) -> np.ndarray:
    """A number for each ``size`` term rows in a row; equal ones have equal numbers."""
    n = max(0, len(rows) - size + 1)
    wide, out = rows.astype(np.uint64), np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out += wide[k : k + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
    return out


class Shared:
    """Which documents share ``size`` words in a row with which items; term rows or numbers that coincide only add some."""

    def __init__(self, items: list[np.ndarray], size: int) -> None:
        own = [grams(rows, size) for rows in items]
        numbers = np.concatenate(own)
        order = np.argsort(numbers, kind="stable")
        self.size, self.n_items, self.numbers = size, len(items), numbers[order]
        self.item = np.repeat(np.arange(len(items)), [len(o) for o in own])[order]
        bits = (16 * len(numbers) + 1).bit_length()
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[numbers >> self.shift] = True

    def __call__(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Documents x items, for documents in blocks: no run reaches over the padding, as no item holds any."""
        out = np.zeros((len(starts), self.n_items), dtype=bool)
        here = grams(flat, self.size)
        at = np.flatnonzero(self.seen[here >> self.shift])
        first, behind = (np.searchsorted(self.numbers, here[at], side=side) for side in ("left", "right"))
        n = behind - first
        doc = np.searchsorted(starts * BLOCK, at, side="right") - 1
        out[np.repeat(doc, n), self.item[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        return out


def searcher(items: list[tuple[int, list[str]]], idf: np.ndarray, basis: np.ndarray, m: Leakage, least: int = 0):
    """mapInPandas: (id, text) to (item_id, id, run, errors, telling) of aligned pairs; with ``least``, pairs that cannot
    have a run of so many words may be missing."""
    rows = [np.array([term(w) for w in ws], dtype=np.int32) for _, ws in items]
    size = sure_words(least, m.error_every)
    shared = Shared(rows, size) if size else None
    # passages of the items, a third of a block apart
    step = max(1, BLOCK // 3)
    spans = [(k, s) for k, ws in enumerate(rows) for s in range(0, max(1, len(ws) - BLOCK * PASSAGE + step), step)]
    length = BLOCK * PASSAGE
    vocabulary = np.unique(np.concatenate(rows))
    column = np.zeros(1 << TERM_BITS, dtype=np.int32)
    column[vocabulary] = np.arange(1, len(vocabulary) + 1)
    weight = np.concatenate([[0], idf[vocabulary]]).astype(np.float32)
    small = np.concatenate([np.zeros((1, basis.shape[1])), basis[vocabulary]]).astype(np.float32)
    # the passages' weights by term: postings of each column, one after the other
    span, col, value = [], [], []
    latent = np.zeros((len(spans), basis.shape[1]), dtype=np.float32)
    for r, (k, s) in enumerate(spans):
        own, n = np.unique(column[rows[k][s : s + length]], return_counts=True)
        w = n * weight[own]
        w /= max(np.linalg.norm(w), 1e-9)
        latent[r] = w @ small[own]
        span.append(np.full(len(own), r, dtype=np.int32))
        col.append(own)
        value.append((w * weight[own]).astype(np.float32))
    cols = np.concatenate(col)
    order = np.argsort(cols, kind="stable")
    posted, worth = np.concatenate(span)[order], np.concatenate(value)[order]
    begins = np.searchsorted(cols[order], np.arange(len(vocabulary) + 2))
    item_of = np.array([k for k, _ in spans])
    # neighbouring spans share nearly all words: every third, the first of each item among them, is enough to propose
    latent = latent[[s % (3 * step) == 0 for _, s in spans]]
    table = weight[:, None] * small
    square = (idf**2).astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Terms()
        for batch in batches:
            found = []
            for at in range(0, len(batch), 100):
                part = batch.iloc[at : at + 100]
                ids = part["id"].tolist()
                texts = [words(t) for t in part["text"]]
                terms = [np.fromiter(map(known.__getitem__, ws), dtype=np.int32, count=len(ws)) for ws in texts]
                flat, starts = blocks(terms)
                if shared:
                    pairs = shared(flat, starts)
                    kept = np.flatnonzero(pairs.any(axis=1)).tolist()
                    if not kept:
                        continue
                    pairs, ids, texts = pairs[kept], [ids[d] for d in kept], [texts[d] for d in kept]
                    flat, starts = blocks([terms[d] for d in kept])
                compact = column[flat]
                norm = np.sqrt(np.maximum(passages(flat, square), 1e-9))
                mine = passages(compact, table)
                # a passage's cosine is at most the length of its latent vector
                near = np.flatnonzero(np.einsum("ij,ij->i", mine, mine) >= (m.latent_cosine * norm) ** 2)
                if not len(near):
                    continue
                near = near[((mine[near] / norm[near, None]) @ latent.T).max(axis=1) >= m.latent_cosine]
                regions: dict[tuple[int, int], list[int]] = {}
                grid = compact.reshape(-1, BLOCK)
                for i in near.tolist():
                    own = grid[i : i + PASSAGE].ravel()
                    n = begins[own + 1] - begins[own]
                    at_term = np.repeat(begins[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    cosine = np.bincount(posted[at_term], weights=worth[at_term], minlength=len(item_of)) / norm[i]
                    doc = int(np.searchsorted(starts, i, side="right")) - 1
                    for k in np.unique(item_of[cosine >= m.term_cosine]):
                        if not shared or pairs[doc, k]:
                            regions.setdefault((doc, int(k)), []).append(int(i - starts[doc]))
                for (doc, k), places in regions.items():
                    best = (0, 0, 0)
                    ws = texts[doc]
                    for first, last in stretches(places):
                        best = max(best, longest_run(items[k][1], ws[max(0, (first - 1) * BLOCK) : (last + PASSAGE + 1) * BLOCK], m.error_every))
                    found.append((items[k][0], ids[doc], *best))
            yield pd.DataFrame(found, columns=["item_id", "id", "run", "errors", "telling"])

    return run


def stretches(places: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of passages that touch."""
    first = last = None
    for p in sorted(places):
        if last is not None and p > last + PASSAGE:
            yield first, last
            first = p
        first, last = p if first is None else first, p
    if first is not None:
        yield first, last


def aligned(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, m: Leakage = Leakage(), least: int = 0) -> DataFrame:
    """``item_id``, ``id``, ``run``, ``errors``, ``telling`` of every document and item with a similar passage.

    With ``least``, pairs that cannot have a run of so many words may be missing, which spares most of the search.
    Null and empty texts match nothing; a document of any length is read whole; repeated documents match alike.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    schema = "item_id long, id long, run int, errors int, telling int"
    df, n = document_frequencies(texts)
    idf = np.log((n + 1) / (df + 0.5)).clip(0.05).astype(np.float32)
    idf[0] = 0
    own = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text")).where(F.length("text") > 0)
    shared = opening_sentences(own)
    n_blocks = max(1, -(-own.count() // m.items_per_block))
    out = None
    for b in range(n_blocks):
        rows = own.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).collect()
        held = [(r["id"], ws) for r in rows if (ws := without_opening(r["text"], shared))]
        if not held:
            continue
        basis = randomised_svd(texts, n, [np.array([term(w) for w in ws], dtype=np.int32) for _, ws in held], idf, m)
        pairs = texts.mapInPandas(searcher(held, idf, basis, m, least), schema)
        out = pairs if out is None else out.unionByName(pairs)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def leaks(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, m: Leakage = Leakage()) -> DataFrame:
    """The aligned pairs that are leaks: a long enough run within the error rate, whichever words the errors are."""
    found = aligned(docs, items, id_col, text_col, item_col, item_text, m, m.least_run)
    return found.where(F.col("run") >= m.least_run)
