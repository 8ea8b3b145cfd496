"""Reading a rule's field, amount and kind of logic from its texts.

A field phrase is a qualifier, an entity and a measure, in any of the orders people write: "annual bonus charge",
"charge of the annual bonus", "bonus charge (annual)". The vocabulary of the three parts and the label affixes that
name a kind ("Upper Bound", "Validate") are learnt from a bounded sample of labelled rows; the kind of logic is
a naive Bayes decision over the words, learnt from the same sample.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np

from ruleloom.llm.ruletext import amount

_WORDS = re.compile(r"[a-z]+(?:['-][a-z]+)*|[(),:;.]")
_AMOUNT = re.compile(r"(?<![a-z0-9-])\d[\d,]*(?:\.\d+)?(?![\d-]|[a-z]*-)")
#: Largest vocabularies that are kept (most frequent first), which bounds what is shipped to the workers.
MOST_QUALIFIERS, MOST_MEASURES, MOST_ENTITIES, MOST_WORDS = 500, 500, 20_000, 8_000


def amounts(text: str) -> list[str]:
    """The amounts of a text in order, each in one spelling."""
    return [amount(m) for m in _AMOUNT.findall(text.lower())]


def words(text: str) -> list[str]:
    """Lower-case words and punctuation marks."""
    return _WORDS.findall(text.lower().replace("_", " "))


def edits(a: str, b: str, most: int) -> int:
    """Edits (swaps of neighbours included) that turn a into b; ``most`` + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def close(a: str, b: str) -> bool:
    """True if one edit turns a into b, or two from eight letters on."""
    most = 2 if min(len(a), len(b)) >= 8 else 1
    return edits(a, b, most) <= most


@dataclass
class Spelling:
    """Corrects a word to the closest word of a vocabulary if it is the only one as close; remembers what it has seen."""

    known: frozenset[str]
    by_size: dict[int, list[str]] = field(default_factory=dict)
    seen: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for w in sorted(self.known):
            self.by_size.setdefault(len(w), []).append(w)

    def __call__(self, word: str) -> str:
        if word in self.known or len(word) < 4:
            return word
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            near = [w for n in range(len(word) - 2, len(word) + 3) for w in self.by_size.get(n, ()) if set(w) & set(word) and close(word, w)]
            if len(near) > 1:
                far = [edits(word, w, 2) for w in near]
                near = [w for w, d in zip(near, far, strict=True) if d == min(far)]
            found = self.seen[word] = near[0] if len(near) == 1 else word
        return found


@dataclass
class Reader:
    """What was learnt: affixes by kind, the field vocabulary, and the words' log-probabilities by kind."""

    kinds: list[str]
    prefixes: list[tuple[str, ...]]
    suffixes: list[tuple[str, ...]]
    qualifiers: frozenset[str]
    measures: frozenset[tuple[str, ...]]
    entities: frozenset[tuple[str, ...]]
    index: dict[str, int]
    weights: np.ndarray
    spell: Spelling | None = None

    def prepare(self) -> Reader:
        """Build the speller; done once in each worker."""
        if self.spell is None:
            parts = {w for m in self.measures for w in m} | {w for e in self.entities for w in e}
            affix = {w for a in [*self.prefixes, *self.suffixes] for w in a}
            self.spell = Spelling(frozenset(self.qualifiers | parts | affix | {"of", "the"}))
        return self

    def label_field(self, label: list[str]) -> tuple[str, str, str] | None:
        """Qualifier, entity and measure of a label's corrected words, or None."""
        w = [x for x in label if x[0].isalpha()]
        for p in self.prefixes:
            if tuple(w[: len(p)]) == p and len(w) > len(p) + 2:
                w = w[len(p) :]
                break
        else:
            for s in self.suffixes:
                if tuple(w[-len(s) :]) == s and len(w) > len(s) + 2:
                    w = w[: -len(s)]
                    break
        if len(w) < 3 or w[0] not in self.qualifiers:
            return None
        for n in (2, 1):
            if tuple(w[-n:]) in self.measures and len(w) > n + 1:
                return w[0], " ".join(w[1:-n]), " ".join(w[-n:])
        return None

    def text_field(self, text: str) -> tuple[str, str, str] | None:
        """Qualifier, entity and measure of the first field phrase in a text, or None."""
        w = [self.spell(x) if x[0].isalpha() else x for x in words(text)]
        found = None
        for i in range(len(w)):
            for n in (2, 1):
                if tuple(w[i : i + n]) not in self.measures:
                    continue
                own = self._around(w, i, i + n)
                if own:
                    return own[0], own[1], " ".join(w[i : i + n])
                found = found or self._between(w, i, i + n)
                break
        return found

    def _between(self, w: list[str], i: int, j: int) -> tuple[str, str, str] | None:
        """A field phrase whose entity no sampled label has: the words between a qualifier and the measure."""
        for k in range(i - 2, max(-1, i - 6), -1):
            if w[k] in self.qualifiers and all(x[0].isalpha() and x not in ("of", "the") for x in w[k + 1 : i]):
                return w[k], " ".join(w[k + 1 : i]), " ".join(w[i:j])
        return None

    def _around(self, w: list[str], i: int, j: int) -> tuple[str, str] | None:
        k = j + 2 if w[j : j + 2] == ["of", "the"] else j + 1 if w[j : j + 1] == ["of"] else 0
        if k and k < len(w) and w[k] in self.qualifiers:
            for n in (4, 3, 2, 1):
                if tuple(w[k + 1 : k + 1 + n]) in self.entities and len(w) >= k + 1 + n:
                    return w[k], " ".join(w[k + 1 : k + 1 + n])
        for n in (4, 3, 2, 1):
            if i - n < 0 or tuple(w[i - n : i]) not in self.entities:
                continue
            if i - n > 0 and w[i - n - 1] in self.qualifiers:
                return w[i - n - 1], " ".join(w[i - n : i])
            if w[j : j + 1] in (["("], [","]) and j + 1 < len(w) and w[j + 1] in self.qualifiers:
                return w[j + 1], " ".join(w[i - n : i])
        return None

    def kind_of(self, bags: list[list[str]]) -> np.ndarray:
        """Index of the most likely kind of each bag of words."""
        return bayes(self.index, self.weights, bags)


def bayes(index: dict[str, int], weights: np.ndarray, bags: list[list[str]]) -> np.ndarray:
    """The best column of ``weights`` for each bag; row 0 is the prior."""
    ids = [[0, *(index[w] for w in set(bag) if w in index)] for bag in bags]
    flat = np.fromiter((i for own in ids for i in own), dtype=np.int64)
    starts = np.cumsum([0, *(len(own) for own in ids)])[:-1]
    return np.add.reduceat(weights[flat], starts, axis=0).argmax(axis=1) if len(bags) else np.zeros(0, dtype=int)


def learn_bayes(bags: list[list[str]], kinds: list[int], n_kinds: int) -> tuple[dict[str, int], np.ndarray]:
    """Word index and log-probabilities (row 0: prior) of a Bernoulli-style naive Bayes with add-half smoothing."""
    total = np.bincount(np.asarray(kinds, dtype=int), minlength=n_kinds).astype(float)
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n_kinds))
    for bag, k in zip(bags, kinds, strict=True):
        for w in set(bag):
            counts[w][k] += 1
    top = sorted(counts, key=lambda w: (-counts[w].sum(), w))[:MOST_WORDS]
    rows = [np.log(total + 1)] + [np.log((counts[w] + 0.5) / (total + 1)) for w in top]
    return {w: i + 1 for i, w in enumerate(top)}, np.array(rows)


def _affixes(labels: list[list[str]], kinds: list[int], from_end: bool) -> list[tuple[str, ...]]:
    """Shortest pure starts (or ends) of labels, lengthened while the next word is nearly always the same."""
    turned = [w[::-1] if from_end else w for w in labels]
    first: dict[str, Counter] = defaultdict(Counter)
    for w, k in zip(turned, kinds, strict=True):
        if w:
            first[w[0]][k] += 1
    least = max(3, len(labels) // 500)
    out = []
    for word, by_kind in first.items():
        n = by_kind.total()
        if n < least or by_kind.most_common(1)[0][1] < 0.6 * n:
            continue
        affix = [word]
        while len(affix) < 4:
            follow = Counter(w[len(affix)] for w in turned if w[: len(affix)] == affix and len(w) > len(affix))
            if not follow or follow.most_common(1)[0][1] < 0.85 * n:
                break
            affix.append(follow.most_common(1)[0][0])
        out.append(tuple(affix[::-1] if from_end else affix))
    return sorted(out, key=lambda a: (-len(a), a))


def _frequent(counts: Counter, most: int) -> list:
    """The most frequent items without the misspellings: those close to an item twenty times as frequent."""
    items = [x for x, _ in counts.most_common(4 * most)]
    by_size = defaultdict(list)
    kept = []
    for x in items:
        text = x if isinstance(x, str) else " ".join(x)
        near = (y for n in range(len(text) - 2, len(text) + 3) for y in by_size[n])
        if any(counts[y] >= 20 * counts[x] and close(text, t) for y, t in near):
            continue
        by_size[len(text)].append((x, text))
        kept.append(x)
    return kept[:most]


def learn(rows: list[tuple[str, str, str]]) -> Reader:
    """A reader from (label, kind, description) rows. Without rows it knows no kind and reads no field."""
    kinds = sorted({k for _, k, _ in rows})
    at = {k: i for i, k in enumerate(kinds)}
    labels = [[x for x in words(label) if x[0].isalpha()] for label, _, _ in rows]
    ks = [at[k] for _, k, _ in rows]
    prefixes, suffixes = _affixes(labels, ks, False), _affixes(labels, ks, True)
    bare = []
    for w in labels:
        for p in prefixes:
            if tuple(w[: len(p)]) == p:
                bare.append(w[len(p) :])
                break
        else:
            for s in suffixes:
                if tuple(w[-len(s) :]) == s:
                    bare.append(w[: -len(s)])
                    break
    bare = [w for w in bare if len(w) >= 3]
    qualifiers = _frequent(Counter(w[0] for w in bare), MOST_QUALIFIERS)
    last: dict[str, Counter] = defaultdict(Counter)
    for w in bare:
        last[w[-1]][w[-2]] += 1
    measures: Counter = Counter()
    for word, before in last.items():
        n = before.total()
        double = n >= 5 and sum(c for _, c in before.most_common(2)) >= 0.8 * n
        for b, c in before.items():
            measures[(b, word) if double else (word,)] += c
    kept = set(_frequent(measures, MOST_MEASURES))
    entities: Counter = Counter()
    for w in bare:
        n = 2 if tuple(w[-2:]) in kept and len(w) > 3 else 1
        if tuple(w[-n:]) in kept:
            entities[tuple(w[1:-n])] += 1
    entities = Counter({e: c for e, c in entities.items() if c > 1 and len(e) <= 4})
    frequent = _frequent(Counter({" ".join(e): c for e, c in entities.items()}), MOST_ENTITIES)
    bags = [rule_bag(words(label), text) for label, _, text in rows]
    index, weights = learn_bayes(bags, ks, max(1, len(kinds)))
    return Reader(kinds or [""], prefixes, suffixes, frozenset(qualifiers), frozenset(kept), frozenset(tuple(e.split(" ")) for e in frequent), index, weights)


def rule_bag(own: list[str], text: str | None) -> list[str]:
    """Words that speak of a rule's kind: those of the label, marked, and those of the text."""
    starts = ["^" + x for x in own[:1]] + [x + "$" for x in own[-1:]]
    return [*starts, *("l:" + x for x in own), *words(text or "")]
