import json
import random

import pytest
from pyspark.sql import functions as F

from ruleloom.flow_queries import _echo
from ruleloom.functions.kernels import brackets_match, line_diff
from ruleloom.functions.udfs import register
from ruleloom.operators import edit, extract, review, similarity
from ruleloom.plans.lineage import release, settle
from ruleloom.sources import stores
from ruleloom.streaming import streams


def table_diff(a, b):
    """Lengths of the common lines as a whole table, and the lines that the walk back from its end takes."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], row[-1]))
        rows.append(row)
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif rows[i - 1][j] > rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def test_diff_keeps_the_lines_of_the_table():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert [x for k, x in line_diff("\n".join(a), "\n".join(b)) if k == "Context"] == table_diff(a, b)
    long = [f"line {i}" for i in range(6000)]
    assert len(line_diff("\n".join(long), "\n".join(long[::-1]))) > 6000


@pytest.mark.parametrize(("source", "fine"), [("{()[]}", True), (")(", False), ("{", False), ('f("}")', True), ("// {\n{}", True), ("/* { */", True), ("'{'", True), ("([)]", False), ('"a\\"{"', True), ("", True), (None, True)])
def test_brackets(source, fine):
    assert brackets_match(source) is fine


def test_top_entries_by_index_and_by_join(spark):
    rng = random.Random(6)
    names = [f"word{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(names) for _ in range(n))
    entries = [(i, text(rng.randint(1, 6))) for i in range(60)] + [(90, None), (91, "")]
    queries = [(1000 + i, text(rng.randint(1, 15))) for i in range(40)] + [(2000, None), (2001, "nothing"), (2002, "word1 " * 5000)]
    want = set()
    for q, t in queries:
        scored = sorted((-len(set((t or "").split()) & set((e or "").split())), i) for i, e in entries)
        want |= {(q, i, -s, r) for r, (s, i) in enumerate(scored[:3], 1) if s}
    left, right = spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(entries, "entry_id long, text string")
    for most in (1000, 0):
        got = {(r["query_id"], r["entry_id"], r["score"], r["rank"]) for r in similarity.top_entries(left, right, 3, most).collect()}
        assert got == want
    assert similarity.top_entries(left, right.limit(0)).count() == 0 and similarity.top_entries(left.limit(0), right).count() == 0


def test_duplicates_are_the_same_broadcast_and_salted(spark, monkeypatch):
    rng = random.Random(7)
    base = ["the total of the order is checked against the limit", "rates are taken from the table of the branch", "a tax is added"]
    rows = [(i, "s", rng.choice(["A", "B"]), " ".join(w for w in rng.choice(base).split() if rng.random() > 0.15)) for i in range(80)] + [(90, "s", "A", None), (91, "s", "A", ""), (92, None, "A", "alone")]
    df = spark.createDataFrame(rows, "id long, scope string, type string, text string")
    first = {tuple(r) for r in similarity.deduplicate(df).collect()}
    monkeypatch.setattr(similarity, "BROADCAST_TEXTS", 0)
    assert {tuple(r) for r in similarity.deduplicate(df).collect()} == first and len(first) >= 82


def test_bag_bound_is_never_below_the_subsequence():
    from ruleloom.functions.kernels import lcs_length

    rng = random.Random(9)
    texts = ["".join(rng.choice("abcé漢 😀") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    bags = similarity.character_bags(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert min(len(a), len(b)) >= 0 and lcs_length(a, b) <= sum(min(x, y) for x, y in zip(bags[i], bags[j], strict=True))


def test_extraction_with_cache(spark):
    requests = spark.createDataFrame([(1, "a", "k1", "p"), (2, "a", "k2", "q"), (3, "a", "k2", "q"), (4, "a", "k3", "x\n" * 500), (5, None, None, "n")], "id long, chunk_label string, key string, prompt string")
    cache = spark.createDataFrame([("k1", "old", 1), ("k1", "new", 2)], "key string, response string, stored_at long")
    got = {r["id"]: (r["answer"], r["error"], r["cached"]) for r in extract.answered(requests, cache, _echo).collect()}
    assert got[1] == ("new", None, True) and got[2] == got[3] and got[2][0].startswith("```json") and got[4] == (None, "too long", False)
    assert set(got) == {1, 2, 3, 4, 5} and extract.answered(requests.limit(0), cache, _echo).count() == 0


def test_files_with_backup(spark):
    one = [{"description": "d", "original": "b", "modified": "B"}]
    lost = [*one, {"description": "e", "original": "zz", "modified": ""}]
    requests = spark.createDataFrame([(1, "s", "A.VB", one), (2, "s", "a.vb", lost), (3, "t", "a.vb", one), (4, "s", None, one), (5, "s", "c.vb", one), (6, "s", "a.vb", [])], "id long, scope string, file string, changes " + edit.CHANGE)
    files = spark.createDataFrame([("s", "a.vb", "1/a.vb", "a b c"), ("s", "A.vb", "2/a.vb", "other"), ("s", "c.vb", "c.vb", None)], "scope string, file_name string, path string, content string")
    got = {r["id"]: r for r in edit.applied_to_files(requests, files, "T").collect()}
    assert (got[1]["success"], got[1]["content"], got[1]["backup"], got[1]["backup_path"]) == (True, "a B c", "a b c", "1/a.vb.bak_T")
    assert not got[2]["success"] and got[2]["content"] == "a b c" and got[2]["backup"] is None and "e" in got[2]["error"]
    assert [got[i]["success"] for i in (3, 4, 5, 6)] == [False, False, False, True] and "no text" in got[5]["error"] and len(got) == 6


def test_stores_of_documents(spark):
    docs = spark.createDataFrame([("a.json", '{"Id":"1","F1":0.5,"RunAt":"2024-01-02T03:04:05"}'), ("b.json", "{}"), ("c.json", '{"Id"'), ("d.json", None), ("e.json", "")], "file_name string, text string")
    got = {r["id"]: r for r in stores.validation_runs(stores.parse_store(docs, stores.VALIDATION)).collect()}
    assert set(got) == {"1", "b"} and got["1"]["f1"] == 0.5 and got["b"]["tp_count"] == 0 and got["b"]["session_name"] == ""
    held = spark.createDataFrame([("s", '[{"Id":"1"},null]'), ("t", "[{"), ("u", None)], "store string, text string")
    assert [(r["store"], r["id"]) for r in stores.knowledge_entries(held).collect()] == [("s", "1")]
    cached = spark.createDataFrame([("k.json", '[{"a":1}]'), ("l.json", "{}"), ("m.json", "[1]"), ("n.json", "[]")], "file_name string, text string")
    assert {r["key"]: r["rules"] for r in stores.cache_entries(cached).collect()}.items() >= {"k": 1, "n": 0}.items()


def test_stopped_answers(spark):
    lines = spark.createDataFrame([(1, 0, '{"message":{"content":"a"}}'), (1, 1, '{"message":{"content":"b"}}'), (2, 0, '{"message":{"content":"c"}}'), (2, 1, '{"done":true}')], "request_id long, seq int, line string")
    stops = spark.createDataFrame([(1, 1), (1, 2)], "request_id long, at_seq int")
    got = {r["request_id"]: (r["text"], r["finished"]) for r in streams.fold_tokens(streams.cancelled(lines, stops)).collect()}
    assert got == {1: ("a", False), 2: ("c", True)}
    assert [r["request_id"] for r in streams.completed(lines.select("request_id").distinct(), stops).collect()] == [2]


def test_live_stream(spark, tmp_path):
    """Rules of growing answers, read again after every batch."""
    seen = []
    (tmp_path / "in").mkdir()
    lines = spark.readStream.schema("request_id long, seq int, line string").json(str(tmp_path / "in"))
    query = streams.stream_rules(lines, lambda rules, no: seen.append(rules.where("pos is not null").count()), str(tmp_path / "cp"))
    for k, token in enumerate(['{"rules":[{"label":"a"}', ',{"label":"b"}', "]}"]):
        row = {"request_id": 1, "seq": k, "line": json.dumps({"message": {"content": token}})}
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(row) + "\n")
        query.processAllAvailable()
    query.stop()
    assert seen == [1, 2, 2]


def test_counters(spark):
    calls = spark.createDataFrame([("H", 1), ("h", 1), ("h", 2), ("x", 1), (None, 1)], "host string, port int")
    assert tuple(review.counters(calls, "h", 1).first()) == (5, 3) and tuple(review.counters(calls.limit(0), "h", 1).first()) == (0, 0)


def test_release_deletes_what_settle_wrote(spark):
    df = settle(spark.range(3), "released")
    assert df.count() == 3
    release(df)
    release(df.select("id"))
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(df._settled_at).count()


def test_functions_in_sql(spark):
    assert "split_branches" in register(spark)
    row = spark.sql("SELECT lcs_length('abc', 'ac') AS a, lcs_ratio(NULL, NULL) AS b, repair_json('{\"a\":[1,') AS c, line_diff('a', 'b')[0].kind AS d, brackets_match(')(') AS e, block_tier(NULL) AS f").first()
    assert tuple(row) == (2, 1.0, '{"a":[1]}', "Removed", False, "LOW") or row["c"] is None
    assert spark.sql("SELECT count(*) FROM split_branches('x = 1')").first()[0] == 1
    assert spark.range(1).select(F.expr("parse_edit('INTENT: i')").getField("intent")).first()[0] == "i"
