import io
import json
import zipfile

from pyspark.sql import functions as F

from ruleloom.sources import files, ground_truth, stores
from ruleloom.streaming import streams


def test_scan(spark, tmp_path):
    (tmp_path / "a.cbl").write_text("x\ny\n")
    (tmp_path / "b.bin").write_bytes(b"1")
    (tmp_path / "c.vb").write_bytes(b"caf\xe9")
    got = {r["name"]: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert got["a.cbl"]["line_count"] == 3 and got["a.cbl"]["role"] == "Context" and len(got["a.cbl"]["content_hash"]) == 64
    assert got["b.bin"]["status"] == "unsupported" and got["b.bin"]["text"] is None
    assert got["c.vb"]["text"] == "caf�"


def test_documents(spark, tmp_path):
    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t> A | B | C </w:t></w:r></w:p><w:p/></w:body></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "x.docx").write_bytes(raw.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"nope")
    (tmp_path / "y.doc").write_bytes("a\x00b\né".encode("latin-1"))
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.scan_documents(spark, str(tmp_path)).collect()}
    assert got == {"x.docx": "A | B | C", "bad.docx": None, "y.doc": "ab\n"}


def test_ground_truth_lines(spark):
    docs = spark.createDataFrame([(1, "a | b\n# x\nGT-1||r|s\n\nfree text"), (2, None), (3, "")], "doc long, text string")
    strict = [(r["id"], r["category"], r["text"]) for r in ground_truth.parse_strict(docs).collect()]
    assert strict == [("GT-1", "", "r|s")]
    lenient = [(r["id"], r["category"], r["text"]) for r in ground_truth.parse_lenient(docs).orderBy("line_no").collect()]
    assert lenient == [("GT-001", "Business Rules", "a | b"), ("GT-1", "", "r|s"), ("GT-005", "Business Rules", "free text")]
    answers = spark.createDataFrame([(1, 'Sure: [{"ID":"1","RuleText":"t"}] ok'), (2, "none"), (3, "[broken")], "doc long, answer string")
    assert [(r["doc"], r["id"], r["text"]) for r in ground_truth.parse_answer(answers).collect()] == [(1, "1", "t")]


def test_stores(spark, tmp_path):
    (tmp_path / "s1.json").write_text(json.dumps({"Id": "1", "Name": "n", "CreatedAt": "2024-01-01T00:00:00Z", "Rules": [{"Decision": 1}, {"Decision": "Rejected"}], "Extra": {"a": 1}}))
    (tmp_path / "s2.json").write_text("{broken")
    (tmp_path / "s3.json").write_text("{}")
    got = {r["id"]: (r["total"], r["accepted"], r["rejected"]) for r in stores.session_list(stores.read_store(spark, str(tmp_path), stores.SESSION)).collect()}
    assert got == {"1": (2, 1, 1), "": (0, 0, 0)}
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "run.json").write_text(json.dumps({"Id": "7", "F1": 0.5, "Matches": [1, 2]}))
    row = stores.read_store(spark, str(tmp_path / "v"), stores.VALIDATION).first()
    assert (row["Id"], row["F1"], row["file_key"]) == ("7", 0.5, "run")


LINES = [(1, 0, '{"message":{"content":"a"}}'), (1, 1, ""), (1, 2, "{bad"), (1, 3, '{"message":{"content":"b"},"done":false}'), (1, 4, '{"message":{"content":"x"},"done":true}'), (1, 5, '{"message":{"content":"y"}}'), (2, 0, '{"message":{"content":"open"}}')]


def test_token_fold(spark):
    df = spark.createDataFrame(LINES, "request_id long, seq int, line string")
    assert {tuple(r) for r in streams.fold_tokens(df).collect()} == {(1, "ab", True), (2, "open", False)}


def test_token_stream(spark, tmp_path):
    spark.createDataFrame(LINES, "request_id long, seq int, line string").coalesce(1).write.json(str(tmp_path / "in"))
    source = spark.readStream.schema("request_id long, seq int, line string").json(str(tmp_path / "in"))
    q = streams.stream_tokens(source).writeStream.outputMode("update").format("memory").queryName("tokens").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("tokens").collect()} == {(1, "ab", True), (2, "open", False)}


def test_event_windows_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:05:00", "a", 1.0), (1, "2024-01-01 00:10:00", "a", 2.0), (2, "2024-01-01 02:00:00", "b", 1.0)]
    df = spark.createDataFrame(rows, "user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.event_windows(source).writeStream.outputMode("complete").format("memory").queryName("wins").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["event_type"], r["n"]) for r in spark.table("wins").collect()) == [("a", 2), ("b", 1)]
    assert streams.event_sessions(df).count() == 2
    assert streams.progress(df.select(F.col("event_type").alias("label"), F.col("user_id").alias("event_id"), "ts", F.lit("s").alias("status")).withColumnRenamed("ts", "at")).count() == 2
