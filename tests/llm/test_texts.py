import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ruleloom.llm import leakage, mixing, subjects
from ruleloom.llm.leakage import Leakage, aligned, lcs_pairs, leaks, longest_run, sure_words, words
from ruleloom.llm.mixing import count_tokens, mixture, rates
from ruleloom.llm.packing import balanced, items, pack
from ruleloom.llm.splitting import family, headers, pieces, split
from ruleloom.llm.subjects import Clustering, document_subjects, fit, read as read_terms

COBOL = """000100 PROCEDURE DIVISION.
000200 MAIN SECTION.
000300 1000-START.
000400     DISPLAY 'X-PARA.'
000500* OLD-PARA.
000600     EXIT.                                                        TAG00001
       free-para.                                                       ABC00002
       01  WS-REC.
           05  WS-A PIC 9.
       FILE-CONTROL."""


def test_headers():
    got = {i: v for i, v in headers(COBOL.split("\n"), "cobol").items()}
    assert {i: v[0] for i, v in got.items()} == {0: "division", 1: "section", 2: "paragraph", 6: "paragraph", 9: "paragraph"}
    assert got[6][1] == "FREE-PARA"
    vb = ["Private Declare Function T Lib \"x\" () As Long", "Public Sub A()", "    ' Public Sub B()", "End Sub", "  Exit Function", "Property Get C()", "    Call Sub1(2)", "Friend Shared Function D(x)\r"]
    assert [i for i in headers(vb, "vb")] == [1, 5, 7]
    sql = ["-- CREATE PROCEDURE a", "/* CREATE PROC b", "CREATE PROC c */", "create or alter proc [dbo].[d]", "EXEC('CREATE PROCEDURE e')", "CREATE TABLE f", "CREATE FUNCTION dbo.g"]
    assert [v[1] for v in headers(sql, "sql").values()] == ["dbo.d", "dbo.g"]
    assert family("A.CBL", "") == "cobol" and family(None, "select a from b") == "sql"


def without_overlap(text, got):
    """The text again: each piece from its own line on."""
    out = []
    for p in got:
        shared = p["own_line"] - p["start_line"]
        out.append("\n".join(p["text"].split("\n")[shared:]) if shared else p["text"])
    return "".join(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab .'", max_size=30), max_size=40), st.integers(12, 80), st.integers(0, 3), st.sampled_from(["cobol", "vb", "sql"]))
def test_pieces_are_the_text(lines, capacity, overlap, kind):
    text = "\n".join(lines)
    got = split(text, capacity, overlap, kind)
    assert all(0 < len(p["text"]) <= capacity for p in got)
    assert without_overlap(text, got) == text


def test_pieces_share_lines_and_begin_at_routines(spark):
    unit = "Public Sub U{}()\n" + "    x = 1\n" * 30 + "End Sub\n"
    text = "".join(unit.format(i) for i in range(6))
    got = split(text, 800, 3, "vb", first_line=11, label="L")
    assert all(b["own_line"] - b["start_line"] == 3 and b["start_line"] == a["end_line"] - 2 for a, b in zip(got, got[1:], strict=False))
    assert [p["label"] for p in got][:2] == ["U0", "U2"] and got[0]["start_line"] == 11
    df = spark.createDataFrame([(1, "a.vb", None, None, text, "x"), (2, None, "l", 5, None, "x"), (3, "a.vb", "l", 1, "", "x"), (4, "a.txt", "l", 1, "y" * 3000, "x")], "id long, name string, label string, start_line int, text string, piece_no string")
    rows = pieces(df, 800, 3).collect()
    assert {r["id"] for r in rows} == {1, 4} and max(r["n_chars"] for r in rows) <= 800
    assert [h for r in sorted(rows) if r["id"] == 1 for h in r["headers"]] == [1 + 32 * i for i in range(6)]
    assert pieces(df.limit(0), 800, 3).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_packing_keeps_the_capacity(sizes):
    place = balanced(sizes, 100)
    used = {}
    for s, c in zip(sizes, place, strict=True):
        used.setdefault(c, []).append(s)
    assert all(sum(v) + len(v) - 1 <= 100 for v in used.values())
    least = -(-sum(sizes) // 100)
    assert len(used) <= 2 * least + 1


def test_packing_whole(spark):
    rng = random.Random(1)
    rows = [(i, "a.vb", 1, "x\n" * rng.randrange(1, 400)) for i in range(300)] + [(900, "a.vb", None, "y" * 2500), (901, None, 1, None), (902, None, 1, ""), (5, "a.vb", 1, "x")]
    df = spark.createDataFrame(rows, "id long, name string, start_line int, text string")
    got = pack(items(df, 1000), 1000, containers_per_block=20).collect()
    used = {}
    for r in got:
        used[r["container"]] = used.get(r["container"], -1) + r["n_chars"] + 1
    assert max(used.values()) <= 1000 and sum(used.values()) / (1000 * len(used)) > 0.85
    assert sum(r["n_chars"] for r in got) == sum(len(t or "") for *_, t in rows)
    assert len([r for r in got if r["id"] == 900]) == 3
    assert pack(items(df.limit(0), 1000), 1000).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_alignment_is_a_longest_one(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    pairs = lcs_pairs(a, b)
    assert len(pairs) == row[-1] and all(a[i] == b[j] for i, j in pairs) and all(p < q and s < t for (p, s), (q, t) in zip(pairs, pairs[1:], strict=False))


def test_words_without_marks():
    assert words("000100* The <b>rate</b> &quot;is\\n8-fold&quot;\n000110* it's DONE") == ["the", "rate", "is", "8-fold", "it's", "done"]


def test_leaks(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    telling = lambda: f"{rng.randrange(10_000, 99_999)}"
    items_ = [(i, "Name the rule. " + " ".join(telling() if k % 9 == 0 else rng.choice(vocabulary) for k in range(70)) + ".") for i in range(12)]
    docs, want = [], set()
    for d in range(200):
        body = [rng.choice(vocabulary) for _ in range(rng.choice([5, 150, 400]))]
        if d % 4 == 0:
            i = rng.randrange(12)
            own = items_[i][1].removeprefix("Name the rule. ").rstrip(".").split()
            start = rng.randrange(0, 30)
            run = own[start : start + (40 if d % 8 else 15)]
            if d % 16 == 4:
                run[7], run[20] = "zzz", "yyy"
            at = rng.randrange(len(body))
            body[at:at] = [w.upper() + "," for w in run]
            if d % 8:
                want.add((i, 1000 + d))
        docs.append((1000 + d, "Name the rule. " + " ".join(body)))
    docs += [(5000, None), (5001, ""), (5002, "x " * 200_000), (5003, docs[4][1])]
    want |= {(i, 5003) for i, d in want if d == 1004}
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items_, (99, None)], "item_id long, text string")
    got = {(r["item_id"], r["id"]) for r in leaks(df, it, "doc_id", "text", "item_id", "text").collect()}
    assert len(got & want) >= 0.95 * len(want) and not got - want
    assert leaks(df, it.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert leaks(df.limit(0), it, "doc_id", "text", "item_id", "text").count() == 0


def test_a_leak_whose_only_number_is_replaced(spark):
    word = lambda k: "".join(chr(97 + int(c)) for c in str(1000 + k))
    items_ = [(i, " ".join("4711" if k == 15 else word(100 * i + k) for k in range(32))) for i in range(4)]
    docs = [(50 + i, " ".join(["before", *text.replace("4711", "4712").split(), "after"])) for i, text in items_]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items_, "item_id long, text string")
    got = {(r["item_id"], r["id"], r["errors"], r["telling"]) for r in leaks(df, it, "doc_id", "text", "item_id", "text").collect()}
    assert got == {(i, 50 + i, 1, 0) for i in range(4)}


def test_items_in_blocks_share_their_instructions(spark):
    """An instruction that two items of different blocks share is none of either's passages."""
    head = "State the rule that this fragment enforces and name each of the fields that it reads or writes, then say where it stands, who may change it and why it holds."
    items_ = [(i, f"{head} " + " ".join(f"w{i}x{k}" for k in range(30))) for i in range(6)]
    df = spark.createDataFrame([(90, head + " And so on."), (91, items_[3][1])], "doc_id long, text string")
    it = spark.createDataFrame(items_, "item_id long, text string")
    got = {(r["item_id"], r["id"]) for r in leaks(df, it, "doc_id", "text", "item_id", "text", Leakage(items_per_block=1)).collect()}
    assert got == {(3, 91)}


def test_run_and_errors():
    item = [f"a{i}" for i in range(40)]
    assert longest_run(item, item[5:35], 8)[:2] == (30, 0)
    assert longest_run(item, [*item[5:15], "x", *item[16:35]], 8)[:2] == (30, 1)
    assert longest_run(item, ["q"], 8) == (0, 0, 0)


def test_words_that_a_leak_surely_repeats():
    """The bound holds for errors of every kind, and is met where they part the run evenly."""
    assert [sure_words(*x) for x in [(25, 8), (32, 8), (33, 8), (25, 100), (8, 8), (25, 2), (25, 1), (25, 0), (0, 8)]] == [6, 6, 6, 25, 4, 1, 0, 0, 0]
    rng, least, seen = random.Random(8), 25, set()
    for _ in range(400):
        item = [f"a{i}" for i in range(60)]
        doc = item[rng.randrange(20) : 60 - rng.randrange(20)]
        for at in range(rng.randrange(3, 9), len(doc), rng.randrange(4, 12)):
            doc[at : at + rng.randrange(2)] = ["x"] * rng.randrange(2)
        run, errors, _ = longest_run(item, doc, 8)
        if run >= least:
            held = {tuple(doc[i : i + 6]) for i in range(len(doc) - 5)}
            assert any(tuple(item[i : i + 6]) in held for i in range(55))
            seen.add(errors)
    assert {1, 2, 3} <= seen


def test_only_texts_that_may_leak_are_aligned(spark, monkeypatch):
    item = [f"w{i}" for i in range(60)]
    errors = [f"x{i}" if i in (6, 12, 19) else w for i, w in enumerate(item[10:35])]
    texts = [[*item[45:], *errors], [w for i in range(0, 60, 5) for w in reversed(item[i : i + 5])], ["other"] * 50, item[:6], item[20:50]]
    calls, run = [], leakage.longest_run
    monkeypatch.setattr(leakage, "longest_run", lambda *x: calls.append(x) or run(*x))
    idf, rng = np.ones(1 << leakage.TERM_BITS, dtype=np.float32), np.random.default_rng(1)
    idf[0], basis = 0, rng.normal(size=(1 << leakage.TERM_BITS, 8)).astype(np.float32)
    docs = pd.DataFrame({"id": range(5), "text": [" ".join(t) for t in texts]})

    def found(*least):
        calls.clear()
        return pd.concat(leakage.searcher([(7, item)], idf, basis, Leakage(latent_cosine=0.01), *least)(iter([docs]))), len(calls)

    every, n_every = found()
    most, n_most = found(25)
    assert set(every["id"]) >= {0, 1, 4} and not set(most["id"]) & {1, 2}
    assert n_most < n_every
    as_rows = lambda f: f[f["run"] >= 25].astype(int).to_numpy().tolist()
    assert as_rows(most) == as_rows(every) and [r[1:3] for r in as_rows(most)] == [[0, 25], [4, 30]]
    df, it = spark.createDataFrame(docs), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert {r["id"] for r in leaks(df, it, "id", "text", "item_id", "text").collect()} == {0, 4}
    assert 1 in {r["id"] for r in aligned(df, it, "id", "text", "item_id", "text").collect()}


def test_mixture(spark):
    docs = [(i, "big" if i % 10 else " Small ", "word " * (5 + i % 7)) for i in range(4000)] + [(9000, None, "a b"), (9001, "big", None), (9002, "big", ""), (9003, "other", "x y")]
    df = spark.createDataFrame(docs, "id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("absent", 0.2, 2)], "source string, target_share double, max_repeats int")
    out, report = mixture(df, targets)
    rows = {r["source"]: r for r in report.collect()}
    assert abs(rows["big"]["actual_share"] - 0.6) < 0.05 and abs(rows["small"]["actual_share"] - 0.4) < 0.05 and rows["absent"]["tokens_used"] == 0
    per = out.groupBy("id").count().groupBy().max("count").first()[0]
    assert per == 3 and out.where("source = 'big'").groupBy("id").count().where("count > 1").count() == 0
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixture(df.repartition(7), targets)[0].collect()))
    assert mixture(df.limit(0), targets)[0].count() == 0 and mixture(df, targets.limit(0))[0].count() == 0
    counted = {r["id"]: r["n_tokens"] for r in count_tokens(df).where("id in (9000, 9001, 9002)").collect()}
    assert counted[9001] == counted[9002] == 0 and counted[9000] > 0


def test_too_many_target_sources_are_an_error(spark, monkeypatch):
    totals = spark.createDataFrame([("a", 100)], "source string, tokens long")
    targets = spark.createDataFrame([(f"s{i}", 0.1, 1) for i in range(3)], "source string, target_share double, max_repeats int")
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    assert len(rates(totals, targets)) == 3
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(ValueError, match="2 sources"):
        rates(totals, targets)


def test_rates_with_a_size(spark):
    totals = spark.createDataFrame([("a", 100), ("b", 1000)], "source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r["rate"] for r in rates(totals, targets, 1000)}
    assert got["a"] == 2.0 and abs(got["b"] - 0.8) < 1e-9
    assert {r["source"]: r["rate"] for r in rates(totals, targets)}["b"] == pytest.approx(0.2)


def test_subjects(spark):
    rng = random.Random(6)
    terms = {"pay": "wage salary overtime bonus payslip pension garnishment".split(), "law": "court statute judge verdict appeal clause tribunal".split(), "sport": "goal match referee league striker penalty season".split()}
    generic = ["Please keep the layout of this page.", "Nothing was changed since the last meeting.", "Questions go to the desk."]
    docs, labels, want = [], [], set()
    for d in range(450):
        own = rng.sample(sorted(terms), rng.choice([1, 1, 2]))
        lines = [f"The {rng.choice(terms[s])} follows the {rng.choice(terms[s])} in step {rng.randrange(99)}." for s in own for _ in range(6)] + rng.sample(generic, 2)
        rng.shuffle(lines)
        docs.append((d, " ".join(lines), None))
        want |= {(d, s) for s in own}
        if d % 6 == 0:
            labels += [(d, s) for s in (own if rng.random() < 0.93 else ["sport"])]
    docs += [(900, None, None), (901, "", None), (902, generic[0], None), (903, "MOVE WAGE TO PAYSLIP.\n       PAY-BONUS.\n           ADD 1 TO PENSION.", "cobol")]
    df = spark.createDataFrame(docs, "doc_id long, text string, code string")
    subjects = spark.createDataFrame([("pay", "wages"), ("law", "courts"), ("sport", "games")], "subject string, about string")
    told = spark.createDataFrame(labels + labels[:5], "id long, subject string")
    c = Clustering(levels=5, least_leaf=12)
    got = {(r["id"], r["subject"]) for r in document_subjects(df, "doc_id", "text", "code", subjects, told, c).collect()}
    assert (903, "pay") in got and not {g for g in got if g[0] in (900, 901)}
    got = {g for g in got if g[0] < 900}
    assert len(got & want) >= 0.93 * len(want) and len(got - want) <= 0.07 * len(got)
    assert document_subjects(df.limit(0), "doc_id", "text", "code", subjects, told, c).count() == 0
    assert document_subjects(df, "doc_id", "text", "code", subjects.limit(0), told, c).count() == 0
    document_subjects(df, "doc_id", "text", "code", subjects, told.limit(0), c).count()
    assert np.isfinite([r["share"] for r in document_subjects(df, "doc_id", "text", "code", subjects, told, c).collect()]).all()


def test_the_tree_grows_from_all_documents(spark):
    """Split in passes over all tasks the tree has the same first centres as grown in one task, and goes on below them."""
    rng = random.Random(12)
    topics = [[f"{a}{b}word" for b in "bcdfghjk"] for a in ("ka", "lo", "mi", "nu", "pe", "ri")]
    docs = [(d, " ".join(rng.choices(topics[d % 6], k=12) + rng.choices(topics[d % 2], k=3)), None) for d in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, code string").repartition(5)
    subjects, labels = [("a", "kabword"), ("b", "lobword")], spark.createDataFrame([(0, "a"), (1, "b")], "id long, subject string")
    trees, leaves = [], []
    for task in (10_000, 150):
        model, placed = fit(read_terms(df, "doc_id", "text", "code"), subjects, labels, Clustering(levels=4, least_leaf=20, task=task))
        trees.append(model.tree)
        leaves.append({r["id"]: r["leaf"] for r in placed.select("id", "leaf").collect()})
    whole, passes = trees
    assert all(np.allclose(whole[k], passes[k], atol=1e-5) for k in (2, 3))
    n = [{k: sum(1 for leaf in own.values() if bin(leaf).startswith(bin(k))) for k in tree} for own, tree in zip(leaves, trees, strict=True)]
    assert all(c < 40 or 2 * k in passes or k.bit_length() > 4 for k, c in n[1].items())
    assert set(leaves[1]) == set(range(600)) and abs(len(whole) - len(passes)) <= 8


def test_words_are_runs_of_letters_of_any_script():
    texts = ["Zürich\u2013Fee: naïve_name x2y, ½ 10²", "\ufeffΣίσυφος\u00a0ΟΔΟΣ \u4e2d\u6587\u3002\u0661", "don't a\tb\x1cc\U0001f600d", "", "plain ASCII-words"]
    joined = " \x01 ".join(" \x00 ".join([t, t]) for t in texts).lower()
    assert subjects.words_of(joined) == [w.encode() for w in re.findall(r"[^\W\d_]+|[\x00\x01]", joined)]


@settings(max_examples=200, deadline=None)
@given(st.text("aA.!? \n\t'gopPerfGtm-", max_size=40))
def test_units_are_cut_where_they_were(text):
    assert subjects._SENTENCE.split(text) == re.split(r"(?<=[.!?])\s+|\n+", text)
    assert subjects._CAMEL.sub(r" \g<0>", text) == re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text)
    for t in (text, f"PERFORM {text} go  to {text} 'x' xperform y"):
        assert subjects._MENTION.sub(" ", t) == re.sub(r"\b(?:perform|go\s+to)\s+[\w-]+|'[^'\n]*'", " ", t, flags=re.IGNORECASE)


def test_terms_count_once_a_document():
    own = [[5, 5, 0, 7, 0], [], [7, 0, 7, 0], [(1 << subjects.TERM_BITS) - 1]] * 400
    got = [(d, r) for docs, rows in subjects.once(pd.Series([np.array(t, dtype=np.uint32).tobytes() for t in own])) for d, r in zip(docs.tolist(), rows.tolist(), strict=True)]
    assert got == [(d, r) for d, t in enumerate(own) for r in sorted(set(t))]
    assert [len(d) for d, _ in subjects.once(pd.Series([b""]))] == [0]
