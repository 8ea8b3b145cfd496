import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ruleloom.functions import text as T
from ruleloom.functions.kernels import lcs_ratio
from ruleloom.operators import evaluate, export, extract, profile, review, segment, similarity
from ruleloom.operators.components import components


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_scalars(spark):
    lit = F.lit
    assert one(spark, T.role(lit("a/x.cbl"), lit(3999))) == "Context"
    assert one(spark, T.role(lit("x.cpy"), lit(5000))) == "Context"
    assert one(spark, T.role(lit("defaults.cbl"), lit(5000))) == "Context"
    assert one(spark, T.role(lit("pay.cbl"), lit(5000))) == "Analyze"
    assert one(spark, T.duplicate_form(lit("Pay\tthe tax"))) == "paythe tax"
    assert one(spark, T.matching_form(lit("Pay\tthe  tax."))) == "pay the tax"
    assert [one(spark, T.rule_type(lit(x))) for x in ("data_mapping", "Data Transform", "foo", "4")] == ["DataMapping", "DataTransformation", "BusinessRule", "ControlFlow"]
    assert [one(spark, T.reported_confidence(lit(x))) for x in ("high", "High", None)] == ["Medium", "High", "Medium"]
    assert one(spark, T.edit_intent(lit("what is the address"))) is True
    assert one(spark, T.pascal_case(lit("2nd rate, new"))) == "_2ndRateNew"
    assert one(spark, T.display_type(lit("BusinessRule"))) == "Business Rule"
    assert one(spark, T.model_limit(lit("x-13b"))) == 800
    assert one(spark, T.estimate_tokens(lit("1234567"))) == 1
    assert one(spark, T.content_words(lit("The rate, the RATE of pay-roll"))) == ["rate", "pay", "roll"]
    assert one(spark, T.language(lit("x.SQL"))) == "SQL" and one(spark, T.language(lit(None).cast("string"))) == "Unknown"
    assert one(spark, T.human_size(lit(2048))) == "2.0 KB" and one(spark, T.safe_name(lit("a b/ü-1"))) == "a_b_ü-1"


def test_segments_and_merge(spark):
    code = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. X.\n       MAIN-PARA.\n           DISPLAY 'A'.\n" + "\n".join(["           ADD 1 TO B."] * 100)
    rows = [(1, "a.cbl", code), (2, "b.vb", "Option X\nPublic Sub One()\nEnd Sub"), (3, "c.txt", "x\ny"), (4, "d.cbl", ""), (5, "e.cbl", None), (6, None, "z")]
    df = spark.createDataFrame(rows, "id long, name string, text string")
    segs = segment.segments(df)
    got = {(r["id"], r["label"]): (r["start_line"], r["end_line"]) for r in segs.collect()}
    assert got[1, "IDENTIFICATION DIVISION"] == (1, 2) and got[1, "MAIN-PARA"] == (3, 104)
    assert got[2, "MODULE-PREAMBLE"] == (1, 1) and got[2, "One"] == (2, 3) and got[3, "FULL-FILE"] == (1, 2) and got[6, "FULL-FILE"] == (1, 1)
    assert not any(i in (4, 5) for i, _ in got)
    merged = segment.merged(segs).where("id = 2").collect()
    assert [r["label"] for r in merged] == ["MODULE-PREAMBLE + One"] and merged[0]["text"] == rows[1][2]


@pytest.mark.parametrize(("a", "b", "n"), [(149, 150, 1), (150, 150, 2)])
def test_merge_limit(spark, a, b, n):
    text = "x" * (4 * a)
    rows = [(1, "n", "vb", 0, "L0", 1, 1, text), (1, "n", "vb", 1, "L1", 2, 2, "y" * (4 * b))]
    df = spark.createDataFrame(rows, "id long, name string, family string, seq int, label string, start_line int, end_line int, text string")
    assert segment.merged(df).count() == n


def test_split_complex(spark):
    deep = "If a Then\nIf b Then\nIf c Then\nIf d Then\nIf e Then\n" + "x = 1\n" * 700 + "End If\nEnd If\nEnd If\nEnd If\nElse\ny = 2\nEnd If"
    df = spark.createDataFrame([(1, 0, "L", 1, 9, deep), (2, 0, "M", 1, 2, "x = 1")], "id long, chunk_seq int, label string, start_line int, end_line int, text string")
    got = segment.split_complex(df).orderBy("id", "part").collect()
    assert [r["label"] for r in got] == ["L [branch 1: If a Then]", "L [branch 2: Else]", "M"] and got[0]["tier"] == "HIGH"


def test_profile(spark):
    df = spark.createDataFrame([(1, "vb", "On Error Resume Next\nDim x"), (2, "sql", "declare c cursor"), (3, "vb", None)], "id long, family string, text string")
    got = {(r["id"], r["pattern"]): r["indicator"] for r in profile.prescan(df).collect()}
    assert got == {(1, "flat_record_struct"): "Dim ", (1, "error_handling"): "On Error", (2, "cursor_processing"): "DECLARE"}
    block = profile.prescan_text(profile.prescan(df)).where("id = 1").first()["block"]
    assert block.index("[LOW]") < block.index("[HIGH]")
    assert {r["depth"] for r in profile.block_profile(df).collect()} == {0}
    files = spark.createDataFrame([("a.vb", "vb", 1, "Public Sub Foo()\nSub FOO()\nSub Ab()"), ("b.vb", "vb", 2, "call xfoox and ab")], "name string, family string, pos long, text string")
    syms = profile.symbols(files)
    assert {(r["name"], r["symbol"]) for r in syms.collect()} == {("a.vb", "Foo"), ("a.vb", "Ab")}
    refs = profile.references(files.select(F.col("pos").alias("id"), "name", "text"), syms)
    assert {tuple(r) for r in refs.collect()} == {(2, "a.vb", "Foo"), (2, "a.vb", "Ab")}


def reference_case():
    rng = random.Random(6)
    names = ["run", "file-control", "pay-tax", "ab", "taxes", "é-rate"]
    table = [(f"f{k}", s.upper() if rng.random() < 0.3 else s) for k in range(12) for s in names if s == "run" or rng.random() < 0.5]
    texts = [(i, rng.choice([f"f{i % 14}", None]) if i % 9 == 0 else f"f{i % 14}", " ".join(rng.choice([*names, "CABLE", "Pay-Taxes", "x"]) for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(90, "f1", None)]
    want = {(i, f, s) for i, n, t in texts for f, s in table if n is not None and f != n and t and s.lower() in t.lower()}
    return table, texts, want


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_references_list_each_symbol_of_other_files_once(spark, most):
    table, texts, want = reference_case()
    df = spark.createDataFrame(texts, "id long, name string, text string")
    syms = spark.createDataFrame([*table, *table[:3]], "name string, symbol string")
    got = [tuple(r) for r in profile.references(df, syms, most).collect()]
    assert set(got) == want and len(got) == len(want)
    blocks = {r["id"]: r["block"] for r in profile.reference_blocks(df, syms, most).collect()}
    lines = {i: {} for i, _, _ in want}
    for i, f, s in want:
        lines[i].setdefault(f, []).append(s)
    assert blocks == {i: "\n".join(f"{f}: {', '.join(sorted(own[f]))}" for f in sorted(own)) for i, own in lines.items()}


def test_references_of_a_common_symbol_take_little_room(spark, tmp_path):
    names = [f"f{k}" for k in range(3001)]
    df = spark.createDataFrame([(i, names[7 * i], "call Get and get") for i in range(300)], "id long, name string, text string")
    syms = spark.createDataFrame([(n, "Get" if k % 3 else "GET") for k, n in enumerate(names)], "name string, symbol string")
    out = profile.references(df, syms)
    out.write.parquet(str(tmp_path / "r"))
    got = spark.read.parquet(str(tmp_path / "r"))
    assert got.count() == got.distinct().count() == 300 * 3000
    assert got.join(df, (df["id"] == got["id"]) & (df["name"] == got["file"])).count() == 0
    assert sum(p.stat().st_size for p in (tmp_path / "r").glob("*.parquet")) < 0.4 * 300 * 3000


@pytest.mark.parametrize(("run", "listed"), [(1, 3), (8, 5), (16, 1 << 16)])
def test_references_are_whole_whatever_the_runs(monkeypatch, run, listed):
    rng = random.Random(9)
    cell = [(i, f"f{rng.randint(0, 12)}") for i in range(37)]
    own = [(f"f{k}", s) for k in range(10) for s in ("a", "A")[: 1 + k % 2]]
    monkeypatch.setattr(profile, "RUN", run)
    monkeypatch.setattr(profile, "LISTED", listed)
    arrays = [[c.to_pylist() for c in x] for x in profile._listed(pa.array([i for i, _ in cell]), [n for _, n in cell], *map(list, zip(*own, strict=True)))]
    got = [r for x in arrays for r in zip(*x, strict=True)]
    assert sorted(got) == sorted((i, f, s) for i, n in cell for f, s in own if f != n)


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_occurrences_of_symbols_that_begin_alike(spark, most):
    known = ["old_rate", "old_rates", "old_rate_x", "old_", "ol", "o", "rate", "rates_", "aaaaaa", "aaaaaaa", "é-rate-é", "get"]
    texts = ["old_rate", "xold_rate_xy rates", "aaaaaaaa", "ol", "", "é-rate-é", "get" * 40, "old_rates_" * 30, None]
    held = spark.createDataFrame([(i, "n", t) for i, t in enumerate(texts)], "id long, name string, folded_text string")
    folded = spark.createDataFrame([(k,) for k in known], "folded string")
    got = [(r["id"], r["folded"]) for r in profile.occurrences(held, folded, most).collect()]
    assert sorted(got) == sorted((i, k) for i, t in enumerate(texts) for k in known if t and k in t)


@pytest.mark.parametrize("common", [0, 4, 100])
def test_lines_laid_out_once_equal_those_made_anew(monkeypatch, common):
    monkeypatch.setattr(profile.ReferenceLines, "COMMON", common)
    table, texts, want = reference_case()
    made = profile.ReferenceLines([(f, s, s.lower()) for f, s in table])
    for i, n, t in texts:
        own = {}
        for _, f, s in (w for w in want if w[0] == i):
            own.setdefault(f, []).append(s)
        held = sorted({s.lower() for _, s in table if t and s.lower() in t.lower()})
        block = "\n".join(f"{f}: {', '.join(sorted(own[f]))}" for f in sorted(own))
        assert made.block(n, held) == (block or None)


def test_greedy_dedup_equals_the_loop(spark):
    rng = random.Random(3)
    words = "rate pay tax limit total hour bonus shift".split()
    rows = [(i, f"s{i % 2}", rng.choice("AB"), " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    got = {r["id"]: (r["keeper"], r["occurrences"]) for r in similarity.deduplicate(spark.createDataFrame(rows, "id long, scope string, type string, text string")).collect()}
    form = {r["id"]: r["f"] for r in spark.createDataFrame(rows, "id long, scope string, type string, text string").select("id", T.duplicate_form(F.col("text")).alias("f")).collect()}
    keeper, count = {}, {}
    for scope in ("s0", "s1"):
        left = [r for r in rows if r[1] == scope]
        for same, t in ((False, 0.80), (True, 0.72)):
            kept = []
            for r in left:
                hit = next((k for k in kept if (not same or k[2] == r[2]) and lcs_ratio(form[k[0]], form[r[0]]) >= t), None)
                if hit:
                    keeper[r[0]] = hit[0]
                    count[hit[0]] = count.get(hit[0], 1) + 1
                else:
                    kept.append(r)
            left = kept
    want = {r[0]: (keeper[r[0]], None) if r[0] in keeper else (None, count.get(r[0], 1)) for r in rows}
    assert got == want


def test_greedy_match_equals_the_loop(spark):
    rng = random.Random(4)
    pairs = [(r, g, rng.choice([0.4, 0.5, 0.6])) for r in range(25) for g in range(12) if rng.random() < 0.4]
    got = {(r["rule_id"], r["gt_id"]) for r in similarity.greedy_match(spark.createDataFrame(pairs, "rule_id long, gt_id long, similarity float")).collect()}
    taken, want = set(), set()
    for r in range(25):
        free = [(-s, g) for a, g, s in pairs if a == r and g not in taken]
        if free:
            taken.add(min(free)[1])
            want.add((r, min(free)[1]))
    assert got == want
    empty = spark.createDataFrame([], "rule_id long, gt_id long, similarity float")
    assert similarity.greedy_match(empty).count() == 0


def test_matching_bonus_and_metrics(spark):
    rules = spark.createDataFrame([(1, "s", "Rate", "the rate is checked", "Validation", "High"), (2, "s", None, None, "Calculation", "Low")], "rule_id long, scope string, label string, text string, type string, confidence string")
    entries = spark.createDataFrame([(7, "s", "Constraint", "rate the rate is checked"), (8, "s", "Validation", "zzz qqq")], "gt_id long, scope string, category string, text string")
    m = similarity.greedy_match(similarity.candidates(rules, entries))
    assert [(r["rule_id"], r["gt_id"]) for r in m.collect()] == [(1, 7)]
    total = evaluate.overall(m, rules, entries).first()
    assert (total["tp"], total["fp"], total["fn"], total["precision"]) == (1, 1, 1, 0.5)
    cats = {r["category"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.by_category(m, rules, entries).collect()}
    assert cats == {"validation": (1, 0, 1), "constraint": (1, 0, 0), "calculation": (0, 1, 0)}
    assert evaluate.overall(m.limit(0), rules.limit(0), entries.limit(0)).first()["f1"] == 0.0


def test_toggles(spark):
    rows = [(1, 5, "Accepted", "2024-01-01"), (2, 5, "accepted", "2024-01-02"), (3, 6, "1", "2024-01-01"), (4, 6, "Rejected", "2024-01-02"), (4, 6, "Rejected", "2024-01-02"), (5, 7, "what", "2024-01-01"), (6, None, "Accepted", "2024-01-01")]
    df = spark.createDataFrame(rows, "event_id long, rule_id long, decision string, d string").select("event_id", "rule_id", "decision", F.col("d").cast("timestamp_ntz").alias("decided_at"), F.col("d").cast("timestamp_ntz").alias("received_at"))
    got = {r["rule_id"]: (r["decision"], r["n_events"]) for r in review.decisions(df).collect()}
    assert got == {5: ("Pending", 2), 6: ("Rejected", 2)}


def test_templates_and_knowledge(spark):
    t = spark.createDataFrame([("a", "Baseline", None, True, [0.5, 0.7]), ("b", "B", "x", False, [])], "id string, name string, instructions string, is_active boolean, history array<double>").withColumn("parent_id", F.lit(None).cast("string"))
    assert {(r["id"], r["is_active"], r["changed"]) for r in review.activated(t, F.lit("b")).collect()} == {("a", False, True), ("b", True, True)}
    assert review.derived(t, "a", "c", "C").where("id = 'c'").first()["parent_id"] == "a"
    assert review.recorded(t, "b", F.lit(0.9)).where("id = 'b'").first()["history"] == [0.9]
    best = {r["id"]: (r["best_f1"], r["latest_f1"]) for r in review.template_scores(t).collect()}
    assert best == {"a": (0.7, 0.7), "b": (None, None)}
    assert review.baseline(t, "z").where("id = 'a'").first()["instructions"] == "z"
    k = spark.createDataFrame([(1, "l", "d", "T", "High", 2), (1, "m", "d", "T", "High", 1), (2, "l", "d", "T", "Low", 1)], "id long, label string, description string, type string, confidence string, added_at long")
    got = review.learn(k, k.limit(0), "High").collect()
    assert [(r["id"], r["label"]) for r in got] == [(1, "m")]


def test_answers(spark):
    rows = [(1, "C", '{"rules":[{"label":"A","notes":["a","b"],"risk":5},{"label":" "},{"description":"x"}]}'), (2, "C", "[1]"), (3, "C", "no json {"), (4, "C", "{}"), (5, "C", None), (6, "C", '{"rules":5}')]
    got = extract.answers_to_rules(spark.createDataFrame(rows, "id long, chunk_label string, answer string")).orderBy("id", "pos").collect()
    assert [(r["id"], r["status"], r["label"]) for r in got] == [(1, "ok", "A"), (1, "ok", "Unknown Rule"), (2, "failed", None), (3, "unreadable", None), (4, "ok", None), (5, "unreadable", None), (6, "failed", None)]
    assert got[0]["notes"] == "a; b" and got[0]["risk"] == "5" and got[0]["confidence"] == "Medium" and got[0]["reference"] == "C"
    run = extract.run_extractor(spark.createDataFrame([(1, "a"), (2, "bad")], "id long, prompt string"), lambda p: p.upper() if p != "bad" else 1 / 0)
    assert {(r["id"], r["answer"], r["error"] is None) for r in run.collect()} == {(1, "A", True), (2, None, False)}


def test_report_and_scaffold(spark):
    rules = spark.createDataFrame([(1, 10, "s", "Validation", "Check <x>", "a & b"), (1, 11, "s", "Validation", None, None)], "file_id long, rule_id long, scope string, type string, label string, description string")
    md = export.markdown(rules).first()["report"]
    assert md.splitlines()[2] == "| 1 | Validation | Check <x> | a & b |"
    files = export.scaffold_map(rules).first()["files"]
    assert list(files) == ["Validation.cs"] and "a &amp; b" in files["Validation.cs"] and "CheckX()" in files["Validation.cs"]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, 101), (101, 102), (102, 103), (103, 104), (1, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
