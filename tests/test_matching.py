import random

import numpy as np
import pytest

from ruleloom.functions.kernels import PackedTexts, TextIndex, lcs_length
from ruleloom.operators import similarity
from ruleloom.queries import QUERIES

WORDS = "rate pay tax limit total hour bonus shift the of is checked".split()


def sentence(rng, least, most):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(least, most)))


def single(common, total, bonus=False):
    """The similarity in single precision."""
    raw = np.float32(2 * common) / np.float32(total) if total else np.float32(0)
    return min(np.float32(1), raw + np.float32(0.05)) if bonus and total else raw


def test_packed_texts_equal_lcs():
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in (0, 1, 62, 63, 64, 125, 126, 127, 189, 260)]
    for n in (0, 1, 63, 200):
        a = "".join(rng.choice("abcdefgé ") for _ in range(n))
        assert list(PackedTexts(texts).lcs(a)) == [lcs_length(a, t) for t in texts]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Rules and entries without a common program: entries without reference, rules of unknown files."""
    rng, at = random.Random(8), tmp_path_factory.mktemp("matching")
    types = ["Validation", "Calculation", "Constraint"]
    rules = [(5000 + i, i % 4, f"s{i % 3}", sentence(rng, 0, 3), rng.choice(types), sentence(rng, 0, 30), rng.choice(["High", "Low"]), "Pending") for i in range(50)]
    entries = [(100 + i, rng.choice([*types, None]), sentence(rng, 0, 25), rng.choice([None, "F0001", "ZZ9"])) for i in range(40)]
    entries += [(200, "Validation", "qqq zzz vvv xxx kkk jjj www yyy", None), (201, "Validation", "", None)]
    spark.createDataFrame(rules, "rule_id long, file_id long, session_id string, label string, type string, description string, confidence string, decision string").write.parquet(f"{at}/rules.parquet")
    spark.createDataFrame(entries, "gt_id long, category string, rule_text string, source_ref string").write.parquet(f"{at}/gt_rules.parquet")
    spark.createDataFrame([(0, "F0001.cbl")], "file_id long, file_name string").write.parquet(f"{at}/source_files.parquet")
    return str(at), rules, entries


def brute(rules, entries):
    """All similarities, with bonus and without, and the sequential matching."""
    with_bonus, plain, taken, matches = {}, {}, set(), {}
    for r in rules:
        a = f"{r[3]} {r[5]}".strip()
        for g in entries:
            n = lcs_length(a, g[2])
            plain[r[0], g[0]] = single(n, len(a) + len(g[2]))
            with_bonus[r[0], g[0]] = single(n, len(a) + len(g[2]), r[4] == g[1])
        best, at = max((with_bonus[r[0], g[0]], -g[0]) for g in entries if g[0] not in taken)
        if best >= np.float32(0.4):
            taken.add(-at)
            matches[r[0]] = (-at, best)
    return with_bonus, plain, matches


@pytest.mark.parametrize("scores", [8_000_000, 100])
def test_all_rules_meet_all_entries(spark, folder, monkeypatch, scores):
    monkeypatch.setattr(similarity, "WAVE_SCORES", scores)
    monkeypatch.setattr(similarity, "PACK", 7)
    at, rules, entries = folder
    _, _, want = brute(rules, entries)
    got = {r["rule_id"]: (r["gt_id"], np.float32(r["similarity"])) for r in QUERIES["jn5_matches"](spark, at).collect()}
    assert got == want and 5 < len(want) < 40
    total = QUERIES["g2_overall"](spark, at).first()
    assert (total["tp"], total["fp"], total["fn"]) == (len(want), len(rules) - len(want), len(entries) - len(want))
    cats = {r["category"]: r["fn"] for r in QUERIES["g3_by_category"](spark, at).collect()}
    left = [g for g in entries if g[0] not in {m for m, _ in want.values()}]
    assert all(cats[c] == sum((g[1] or "").lower() == c for g in left) for c in ("validation", "calculation", "constraint"))


def test_matching_without_entries_or_rules(spark):
    rules = spark.createDataFrame([(1, "a", "b", "Validation")], "rule_id long, label string, text string, type string")
    entries = spark.createDataFrame([(1, "Validation", "a b")], "gt_id long, category string, text string")
    assert similarity.match_all(rules, entries.limit(0)).count() == 0 and similarity.match_all(rules.limit(0), entries).count() == 0
    assert similarity.match_all(rules, entries).count() == 1


def test_diagnoses_tell_the_best_similarity_below_the_threshold(spark, folder):
    at, rules, entries = folder
    with_bonus, plain, matches = brute(rules, entries)
    rules_df = spark.createDataFrame([(r[0], r[3], r[5], r[4]) for r in rules], "rule_id long, label string, text string, type string")
    entries_df = spark.createDataFrame([g[:3] for g in entries], "gt_id long, category string, text string")
    for part in (entries_df, entries_df.where("gt_id in (200, 201)")):
        ids = [r["gt_id"] for r in part.collect()]
        got = {r["rule_id"]: np.float32(r["best"]) for r in similarity.best_of_rules(rules_df, part).collect()}
        assert got == {r[0]: max(with_bonus[r[0], i] for i in ids) for r in rules}
    assert any(np.float32(0.1) < v < np.float32(0.4) for v in got.values())
    got = {r["gt_id"]: np.float32(r["best"]) for r in similarity.best_of_entries(rules_df, entries_df).collect()}
    assert got == {g[0]: max(plain[r[0], g[0]] for r in rules) for g in entries}
    reasons = {(r["side"], r["id"]): r["reason"] for r in QUERIES["g10_diagnoses"](spark, at).collect()}
    assert len(reasons) == len(rules) + len(entries) - 2 * len(matches)
    assert 0.10 < got[200] < 0.40 and reasons["missed", 200] == f"best similarity {got[200]:.2f}, found in part"
    for r in rules:
        if r[0] not in matches and r[6] == "High" and len(r[5]) >= 40:
            best = max(with_bonus[r[0], g[0]] for g in entries)
            assert reasons["extra", r[0]] == ("no similar entry" if best < 0.15 else f"best similarity {best:.2f}, below the threshold of 0.40")
    low = sum(s == "extra" and "low" in reason for (s, _), reason in reasons.items())
    assert any(r["advice"].startswith(f"{low} low-confidence") for r in QUERIES["g12_guidance"](spark, at).collect())


def test_text_index_equals_lcs_or_is_surely_below():
    rng = random.Random(9)
    own = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in (0, 1, 7, 8, 9, 64, 120)]
    others = ["".join(rng.choice("abcdefgé ") for _ in range(n)) for n in (0, 1, 63, 64, 200)]
    index = TextIndex(own)
    coded = [index.code(t) for t in others]
    at, to = (x.ravel() for x in np.meshgrid(np.arange(len(others)), np.arange(len(own))))
    want = np.array([lcs_length(others[i], own[j]) for i, j in zip(at, to, strict=True)])
    assert list(index.lcs(coded, at, to, np.zeros(len(at)))) == list(want)
    need = index.lengths[to] * 0.6
    got = index.lcs(coded, at, to, need)
    assert all(g == w or g == -1 and w < n for g, w, n in zip(got, want, need, strict=True)) and (got < 0).any()
    assert all((index.shared(c) >= want[at == i]).all() for i, c in enumerate(coded))


@pytest.mark.parametrize("few", [0, 3000])
def test_pairs_out_of_reach_are_never_compared(monkeypatch, few):
    monkeypatch.setattr(similarity, "FEW", few)
    rng, compared = random.Random(10), []
    entries = [(i, rng.choice("ab"), sentence(rng, 0, 25)) for i in range(60)]
    rows = [(rng.choice(["a", None]), sentence(rng, 5, 30)) for _ in range(20)]
    packs = similarity.Packs(entries)
    real, packed = TextIndex.lcs, PackedTexts.lcs
    monkeypatch.setattr(TextIndex, "lcs", lambda self, o, i, j, need: compared.append(len(j)) or real(self, o, i, j, need))
    monkeypatch.setattr(PackedTexts, "lcs", lambda self, t, own=None: compared.append(len(self.lengths) if own is None else len(own)) or packed(self, t, own))
    got = {(i, int(j)): s for i, own, score in packs.hits(rows, np.float32([[0.7]])) for j, s in zip(own, score, strict=True)}
    want = {(i, j): single(lcs_length(f, e[2]), len(f) + len(e[2]), k == e[1]) for i, (k, f) in enumerate(rows) for j, e in enumerate(entries)}
    assert got == {k: s for k, s in want.items() if s >= np.float32(0.7)} and got
    assert sum(compared) < (0.9 if few else 1.01) * len(want)


def test_a_wave_ends_where_the_hits_sent_are_all_taken(spark, monkeypatch):
    monkeypatch.setattr(similarity, "WAVE_SCORES", 32)
    rules = spark.createDataFrame([(i, "a", "rate of pay", "x") for i in range(40)], "rule_id long, label string, text string, type string")
    entries = spark.createDataFrame([(i, "y", "a rate of pay") for i in range(40)], "gt_id long, category string, text string")
    got = sorted((r["rule_id"], r["gt_id"]) for r in similarity.match_all(rules, entries).collect())
    assert got == [(i, i) for i in range(40)]
