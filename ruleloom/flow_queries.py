"""Queries of the stores, the extraction flow, edits on files, live answers and the SQL functions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions import text as T
from ruleloom.functions.udfs import register
from ruleloom.operators import edit, export, extract, review, similarity
from ruleloom.plans.lineage import settle
from ruleloom.queries import RULES_SQL, _rules, query
from ruleloom.sources import files, stores
from ruleloom.sources.tables import table
from ruleloom.streaming import streams

# --- stores --------------------------------------------------------------------------------------------------------


@query("""SELECT CASE WHEN rn % 3 = 0 THEN 'run-' || session_id ELSE session_id END AS id, CASE WHEN rn % 3 = 1 THEN '' ELSE session_id END AS session_id, name AS session_name, coalesce(model_used, '') AS model_name, created_at AS run_at,
 (rn % 50)::INT AS ground_truth_count, (rn % 7)::INT AS tp_count, 0 AS fp_count, (rn % 5)::INT AS fn_count, (rn % 11)::FLOAT / 16 AS f1, 0::FLOAT AS threshold FROM (SELECT *, hash_no AS rn FROM (SELECT *, length(session_id) + length(coalesce(name, '')) AS hash_no FROM sessions)) WHERE rn % 13 <> 0""")
def s10_validation_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Validation runs as JSON documents, some without id or fields and some broken, summarised."""
    s = table(spark, folder, "sessions").withColumn("rn", F.length("session_id") + F.length(F.coalesce("name", F.lit(""))))
    doc = F.to_json(F.struct(
        F.when(F.col("rn") % 3 != 0, F.col("session_id")).alias("Id"), F.when(F.col("rn") % 3 != 1, F.col("session_id")).alias("SessionId"), F.col("name").alias("SessionName"), F.col("model_used").alias("ModelName"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("RunAt"), (F.col("rn") % 50).alias("GroundTruthCount"), (F.col("rn") % 7).alias("TpCount"), (F.col("rn") % 5).alias("FnCount"), ((F.col("rn") % 11) / 16).alias("F1"), F.array(F.lit(1)).alias("Other"),
    ))
    docs = s.select(F.concat(F.lit("run-"), "session_id", F.lit(".json")).alias("file_name"), F.when(F.col("rn") % 13 == 0, F.substring(doc, 1, 20)).otherwise(doc).alias("text"))
    return stores.validation_runs(stores.parse_store(docs, stores.VALIDATION)).withColumn("run_at", F.col("run_at").cast("timestamp_ntz")).drop("precision", "recall")


TEMPLATE_ROWS = "(SELECT prompt_template_id AS id, max(prompt_template_name) AS name, min(created_at) AS created_at, count(*) AS n FROM sessions WHERE prompt_template_id IS NOT NULL GROUP BY 1)"


def _template_docs(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "sessions").where("prompt_template_id is not null").groupBy(F.col("prompt_template_id").alias("id"))
    t = t.agg(F.max("prompt_template_name").alias("name"), F.min("created_at").alias("created_at"), F.count("*").cast("int").alias("n"))
    history = F.transform(F.sequence(F.lit(1), F.least("n", F.lit(5))), lambda k: F.struct((k / 8).alias("f1")))
    doc = F.to_json(F.struct("id", "name", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("createdAt"), F.when(F.col("n") % 2 == 0, True).alias("isActive"), F.lit("say").alias("instructions"), history.alias("history")))
    return t.select(F.concat("id", F.lit(".json")).alias("file_name"), F.when(F.length("name") % 11 == 0, F.lit("{no")).otherwise(doc).alias("text"))


@query(f"SELECT id, name, created_at, n % 2 = 0 AS is_active, least(n, 5)::INT AS runs, row_number() OVER (ORDER BY created_at, id)::INT AS place FROM {TEMPLATE_ROWS} WHERE length(name) % 11 <> 0 OR name IS NULL")
def s11_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt templates by the time they were created; unreadable ones are left out."""
    from pyspark.sql import Window

    t = stores.template_list(stores.parse_store(_template_docs(spark, folder), stores.TEMPLATE)).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    # a row a template: the whole list is one page
    return t.withColumn("place", F.row_number().over(Window.orderBy("created_at", "id")))


@query(f"WITH {RULES_SQL}, kept AS (SELECT session_id AS store, rule_id, label, type FROM rules_named WHERE decision = 'Accepted' AND session_id IS NOT NULL) SELECT store, (row_number() OVER (PARTITION BY store ORDER BY rule_id) - 1)::INT AS pos, rule_id::VARCHAR AS id, label, type FROM kept WHERE (SELECT count(*) FROM kept k WHERE k.store = kept.store) % 4 <> 0")
def s12_knowledge(spark: SparkSession, folder: str) -> DataFrame:
    """A knowledge store for each session's accepted rules, read back; a broken store is empty."""
    r = _rules(spark, folder).where("decision = 'Accepted' and session_id is not null")
    entry = F.struct(F.col("rule_id"), F.col("rule_id").cast("string").alias("Id"), F.col("label").alias("Label"), F.col("type").alias("Type"))
    listed = r.groupBy(F.col("session_id").alias("store")).agg(F.array_sort(F.collect_list(entry)).alias("l"))
    doc = F.to_json(F.transform("l", lambda x: F.struct(x["Id"].alias("Id"), x["Label"].alias("Label"), x["Type"].alias("Type"))))
    return stores.knowledge_entries(listed.select("store", F.when(F.size("l") % 4 == 0, F.substring(doc, 1, 30)).otherwise(doc).alias("text")))


CACHE_KEY_SQL = "sha256(source_text || 'p1' || 'm1')"


@query(f"SELECT chunk_id, {CACHE_KEY_SQL} AS key, CASE WHEN complexity = 'Low' AND chunk_id % 5 <> 0 THEN 2 END AS rules FROM chunks WHERE source_text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks o WHERE o.source_text = chunks.source_text AND o.chunk_id <> chunks.chunk_id)")
def s13_cache_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with the rules that a warm cache holds for them; its keys are file names, unreadable entries are misses. Texts that stand twice are left out, as they share a key."""
    c = table(spark, folder, "chunks").where("source_text is not null").withColumn("key", T.cache_key(F.col("source_text"), F.lit("p1"), F.lit("m1")))
    c = c.join(c.groupBy("key").agg(F.count("*").alias("times")).where("times = 1").select("key"), "key")
    stored = c.where("complexity = 'Low'").select(F.concat("key", F.lit(".json")).alias("file_name"), F.when(F.col("chunk_id") % 5 == 0, F.lit('[{"label":')).otherwise(F.lit('[{"label":"a"},{"label":"b","n":3}]')).alias("text"))
    return c.select("chunk_id", "key").join(stores.cache_entries(stored).select("key", "rules"), "key", "left").select("chunk_id", "key", "rules")


def _documents_as_files(rows: DataFrame) -> DataFrame:
    """(path, content): each text as a plain, an old binary or a zipped document, by its number."""
    head = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                if i % 3 == 0:
                    out.append((f"f/{i}.txt", text.encode()))
                elif i % 3 == 1:
                    out.append((f"f/{i}.DOC", b"\xd0\xcf\x00" + text.encode("latin-1", "replace") + b"\x01\x07\xff"))
                else:
                    body = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
                    held = io.BytesIO()
                    with zipfile.ZipFile(held, "w") as z:
                        z.writestr("word/document.xml", f"{head}<w:p><w:r><w:t> {body} </w:t></w:r></w:p><w:p/><w:p><w:r><w:t>en</w:t></w:r><w:r><w:t>d</w:t></w:r></w:p></w:body></w:document>")
                    out.append((f"f/{i}.docx", held.getvalue() if i % 2 else held.getvalue()[:30]))
            yield pd.DataFrame(out, columns=["path", "content"])

    return rows.mapInPandas(run, "path string, content binary")


@query("""SELECT CASE gt_id % 3 WHEN 0 THEN 'f/' || gt_id || '.txt' WHEN 1 THEN 'f/' || gt_id || '.DOC' ELSE 'f/' || gt_id || '.docx' END AS path,
 CASE gt_id % 3 WHEN 0 THEN rule_text WHEN 1 THEN regexp_replace(rule_text, '[^\\n\\r\\x20-\\x7e]', CASE WHEN ascii(regexp_extract(rule_text, '[^\\n\\r\\x20-\\x7e]')) > 255 THEN '?' ELSE '' END, 'g') ELSE CASE WHEN gt_id % 2 = 1 THEN trim(rule_text) || chr(10) || 'end' END END AS text FROM gt_rules""")
def s14_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Ground truth from .txt, .doc and .docx files, broken ones included."""
    g = table(spark, folder, "gt_rules").select(F.col("gt_id").alias("id"), F.col("rule_text").alias("text"))
    return files.document_texts(_documents_as_files(g))


# --- the extraction flow -----------------------------------------------------------------------------------------


def _echo(prompt: str) -> str:
    """An extractor for tests: it fails on prompts with many lines, else it tells the prompt's length, twice in two wordings."""
    if prompt.count("\n") > 400:
        raise TimeoutError("too long")
    n = len(prompt)
    return f'```json\n{{"rules":[{{"label":"Length {n}","description":"the part is {n} characters long"}},{{"label":"Length again","description":"the part is {n} characters long."}}]}}'


@query(f"""WITH c AS (SELECT chunk_id, source_text, complexity, {CACHE_KEY_SQL} AS key, 'Say it: ' || source_text AS prompt FROM chunks WHERE source_text IS NOT NULL),
 u AS (SELECT *, key IN (SELECT key FROM c WHERE complexity = 'Low') AS cached FROM c)
 SELECT chunk_id AS id, cached, CASE WHEN NOT cached AND length(prompt) - length(replace(prompt, chr(10), '')) > 400 THEN 'too long' END AS error, CASE WHEN cached THEN 1 WHEN length(prompt) - length(replace(prompt, chr(10), '')) > 400 THEN 0 ELSE 2 END::BIGINT AS rules, CASE WHEN cached THEN 1 WHEN length(prompt) - length(replace(prompt, chr(10), '')) > 400 THEN 0 ELSE 1 END::BIGINT AS distinct_rules FROM u""")
def s20_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """From chunk to rules: prompt, cache, extractor for what is missing, repair, rules, and near-duplicates within the chunk."""
    c = table(spark, folder, "chunks").where("source_text is not null").withColumn("key", T.cache_key(F.col("source_text"), F.lit("p1"), F.lit("m1")))
    requests = c.select(F.col("chunk_id").alias("id"), F.col("label").alias("chunk_label"), "key", F.concat(F.lit("Say it: "), "source_text").alias("prompt"))
    cache = c.where("complexity = 'Low'").select("key", F.lit('{"rules":[{"label":"stored","description":"known before"}]}').alias("response"), F.lit(1).alias("stored_at"))
    answers = settle(extract.answered(requests, cache, _echo), "answers")
    rules = settle(extract.answers_to_rules(answers).where("pos is not null"), "rules")
    numbered = rules.select((F.col("id") * 1000 + F.col("pos")).alias("id"), F.col("id").cast("string").alias("scope"), "type", F.col("description").alias("text"))
    kept = similarity.deduplicate(numbered).groupBy(F.col("scope").cast("long").alias("id")).agg(F.count("*").alias("rules"), F.count_if(F.col("keeper").isNull()).alias("distinct_rules"))
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in ("rules", "distinct_rules")]
    return answers.select("id", "cached", "error").join(kept, "id", "left").select("id", "cached", "error", *zero)


@query(f"SELECT chunk_id, {CACHE_KEY_SQL} AS key, CASE WHEN max(complexity = 'Low') OVER (PARTITION BY {CACHE_KEY_SQL}) THEN 'r' END AS response FROM chunks WHERE source_text IS NOT NULL")
def k7_cache_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with their cached response, null where there is none."""
    asked = table(spark, folder, "chunks").where("source_text is not null").withColumn("key", T.cache_key(F.col("source_text"), F.lit("p1"), F.lit("m1")))
    cache = asked.where("complexity = 'Low'").select("key", F.lit("r").alias("response"), F.col("chunk_id").alias("stored_at"))
    return review.cached(asked.select("chunk_id", "key"), cache)


# --- templates -----------------------------------------------------------------------------------------------------


def _template_rows(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "sessions").where("prompt_template_id is not null").groupBy(F.col("prompt_template_id").alias("id"))
    t = t.agg(F.max("prompt_template_name").alias("name"), F.count("*").cast("int").alias("n"))
    history = F.transform(F.sequence(F.lit(1), F.least("n", F.lit(4))), lambda k: (F.pmod(k * F.col("n"), F.lit(9)) / 16).cast("double"))
    return t.select("id", "name", F.lit(True).alias("is_active"), F.lit(None).cast("string").alias("parent_id"), history.alias("history"))


@query(f"""SELECT id, name, true AS is_active, NULL::VARCHAR AS parent_id, least(n, 4)::INT AS runs FROM {TEMPLATE_ROWS} UNION ALL
 SELECT 'copy', 'A copy', false, id, 0 FROM {TEMPLATE_ROWS} WHERE id = (SELECT min(prompt_template_id) FROM sessions)""")
def k8_derived(spark: SparkSession, folder: str) -> DataFrame:
    """The templates with a copy of the first: not active, without history, its parent noted."""
    first = table(spark, folder, "sessions").agg(F.min("prompt_template_id")).first()[0]
    out = review.derived(_template_rows(spark, folder), first, "copy", "A copy")
    return out.select("id", "name", "is_active", "parent_id", F.size("history").alias("runs"))


@query(f"""WITH h AS (SELECT id, n, list_transform(range(1, least(n, 4) + 1), lambda k: ((k * n) % 9) / 16.0) AS l FROM {TEMPLATE_ROWS}), r AS (SELECT id, CASE WHEN id = (SELECT max(prompt_template_id) FROM sessions) THEN list_append(l, 0.75) ELSE l END AS l FROM h)
 SELECT id, list_max(l)::DOUBLE AS best_f1, l[len(l)]::DOUBLE AS latest_f1, len(l)::INT AS runs FROM r""")
def k8_recorded(spark: SparkSession, folder: str) -> DataFrame:
    """Best and latest F1 of each template after one more run of the last."""
    last = table(spark, folder, "sessions").agg(F.max("prompt_template_id")).first()[0]
    return review.template_scores(review.recorded(_template_rows(spark, folder), last, F.lit(0.75).cast("double")))


# --- edits on files ------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT chunk_id AS id, file_name, source_text, rtrim(string_split(source_text, chr(10))[1], chr(13)) AS head, 'x' || chunk_id || '/' || file_name AS path FROM chunks WHERE source_text IS NOT NULL),
 k AS (SELECT *, CASE WHEN id % 4 = 1 THEN 'name' WHEN id % 4 = 2 AND instr(source_text, '@@@') = 0 THEN 'text' ELSE 'ok' END AS way FROM t)
 SELECT id, way = 'ok' AS success, CASE way WHEN 'name' THEN 'file not in session: no.such' WHEN 'text' THEN 'Could not locate text for change: "second"' ELSE '' END AS error, CASE WHEN way <> 'name' THEN path END AS path,
 CASE WHEN way = 'name' THEN NULL WHEN way = 'ok' AND head <> '' THEN 'NEW ' || source_text ELSE source_text END AS content, CASE WHEN way = 'ok' THEN path || '.bak_20240101000000' END AS backup_path, CASE WHEN way = 'ok' THEN source_text END AS backup FROM k""")
def k13_applied_to_files(spark: SparkSession, folder: str) -> DataFrame:
    """Edit requests on files with backup: unknown files, and changes of which one cannot be located, leave everything as it is."""
    c = table(spark, folder, "chunks").where("source_text is not null")
    path = F.concat(F.lit("x"), F.col("chunk_id").cast("string"), F.lit("/"), "file_name")
    own = c.select(F.col("chunk_id").cast("string").alias("scope"), F.upper("file_name").alias("file_name"), path.alias("path"), F.col("source_text").alias("content"))
    head = F.regexp_replace(F.element_at(F.split("source_text", "\n", -1), 1), "\r+$", "")
    change = lambda d, a, b: F.struct(F.lit(d).alias("description"), a.alias("original"), b.alias("modified"))
    first = F.when(head != "", F.array(change("first", head, F.concat(F.lit("NEW "), head)))).otherwise(F.array().cast(edit.CHANGE))
    both = F.concat(first.cast(edit.CHANGE), F.when(F.col("chunk_id") % 4 == 2, F.array(change("second", F.lit("@@@"), F.lit("!!!")))).otherwise(F.array().cast(edit.CHANGE)).cast(edit.CHANGE))
    name = F.when(F.col("chunk_id") % 4 == 1, F.lit("no.such")).otherwise(F.lower("file_name"))
    requests = c.select(F.col("chunk_id").alias("id"), F.col("chunk_id").cast("string").alias("scope"), name.alias("file"), both.alias("changes"))
    return edit.applied_to_files(requests, own, "20240101000000")


@query("""WITH f AS (SELECT file_id, string_agg(source_text, chr(10) ORDER BY chunk_seq, chunk_id) AS text FROM chunks GROUP BY 1)
 SELECT substr(s.file_name, 1, 3) AS scope, sha256(string_agg('=== ' || s.file_name || ' ===' || chr(10) || f.text || chr(10) || chr(10), '' ORDER BY s.file_id)) AS hash FROM f JOIN source_files s USING (file_id) WHERE f.text IS NOT NULL GROUP BY 1""")
def e7_source_concat(spark: SparkSession, folder: str) -> DataFrame:
    """Hash of the whole source of each family of files, under their names."""
    whole = table(spark, folder, "chunks").groupBy("file_id").agg(export.in_order(["chunk_seq", "chunk_id"], F.col("source_text")).alias("text"))
    named = whole.join(table(spark, folder, "source_files").select("file_id", "file_name"), "file_id")
    return export.source_text(named.select(F.substring("file_name", 1, 3).alias("scope"), "file_id", "file_name", "text")).select("scope", F.sha2("source", 256).alias("hash"))


# --- streams and counters ------------------------------------------------------------------------------------------


@query("SELECT gt_id AS request_id, unnest([0, 1, 2, 3]) AS seq, unnest([1, 2, 3, 3])::BIGINT AS n_rules FROM gt_rules WHERE gt_id % 2 = 0 UNION ALL SELECT gt_id, unnest([0, 1, 2, 3]), unnest([0, 0, 1, 1])::BIGINT FROM gt_rules WHERE gt_id % 2 = 1")
def t3_live_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that can be read from a growing answer after each of its tokens; tokens cut between rules or within one."""
    g = table(spark, folder, "gt_rules").select("gt_id", F.col("gt_id").cast("string").alias("n"))
    rule = F.concat(F.lit('{"label":"r'), "n", F.lit('","description":"d"}'))
    whole = F.array(F.concat(F.lit('{"rules":['), rule), F.concat(F.lit(","), rule), F.concat(F.lit(","), rule), F.lit("]}"))
    within = F.array(F.lit('{"rul'), F.lit('es":'), F.concat(F.lit("["), rule), F.lit("]}"))
    tokens = g.select(F.col("gt_id").alias("request_id"), F.posexplode(F.when(F.col("gt_id") % 2 == 0, whole).otherwise(within)).alias("seq", "token"))
    return streams.live_rules(tokens)


@query("SELECT chunk_id AS request_id, CASE WHEN chunk_id % 3 = 0 THEN array_to_string(list_slice(string_split(source_text, chr(10)), 1, 4), chr(10)) ELSE source_text END AS text FROM chunks WHERE source_text <> ''")
def t5_cancelled(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of which some are stopped after four lines: the text so far stays."""
    c = table(spark, folder, "chunks").where("source_text <> ''").select(F.col("chunk_id").alias("request_id"), F.posexplode(F.split("source_text", "\n", -1)).alias("seq", "piece"))
    content = F.concat(F.when(F.col("seq") > 0, F.lit("\n")).otherwise(""), F.col("piece"))
    lines = c.select("request_id", "seq", F.to_json(F.struct(F.struct(content.alias("content")).alias("message"))).alias("line"))
    stops = c.where("seq = 0 and request_id % 3 = 0").select("request_id", F.explode(F.array(F.lit(4), F.lit(6))).alias("at_seq"))
    return streams.fold_tokens(streams.cancelled(lines, stops)).select("request_id", "text")


@query("SELECT count(*) AS connections, count(*) FILTER (lower(event_type) <> 'click' OR user_id % 7 <> 3) AS violations FROM events")
def g13_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Connections counted, and those that go elsewhere than allowed."""
    calls = table(spark, folder, "events").select(F.col("event_type").alias("host"), (F.col("user_id") % 7).alias("port"))
    return review.counters(calls, "Click", 3)


# --- SQL functions and kernels -------------------------------------------------------------------------------------


@query("""SELECT gt_id, length(rule_text)::INT AS own, CASE WHEN rule_text = '' THEN 1.0 ELSE 2.0 * length(rule_text) / (2 * length(rule_text) + 1) END AS near, '[1]' AS json, 2 AS lines, gt_code AS file, rule_text AS original, 'LOW' AS tier, true AS pairs FROM gt_rules WHERE rule_text IS NOT NULL AND regexp_matches(rule_text, '\\S')""")
def udf_functions(spark: SparkSession, folder: str) -> DataFrame:
    """The registered functions in SQL."""
    register(spark)
    table(spark, folder, "gt_rules").where(r"rule_text rlike '\\S'").createOrReplaceTempView("_udf_rows")
    return spark.sql(
        """SELECT gt_id, lcs_length(rule_text, rule_text) AS own, lcs_ratio(rule_text, concat(rule_text, '~')) AS near, repair_json(concat('[', length('a'))) AS json, size(line_diff(gt_code, 'x y')) AS lines, e.file, e.changes[0].original AS original, tier, pairs
        FROM (SELECT gt_id, gt_code, rule_text, parse_edit(concat('FILE: ', gt_code, '\\nCHANGE:\\nORIGINAL:\\n', rule_text, '\\nMODIFIED:\\nx\\nEND_CHANGE')) AS e, block_tier('x = 1') AS tier, brackets_match('{()}') AS pairs FROM _udf_rows)"""
    )


@query("""SELECT gt_id, unnest([0, 1, 2])::INT AS part, unnest(['branch 1: If x = ' || gt_id || ' Then', 'branch 2: ElseIf y Then', 'branch 3: Else']) AS label,
 unnest(['a = 1' || chr(10) || ''' part 1 of 3: branch of the outermost IF' || chr(10) || ''' begins with: If x = ' || gt_id || ' Then' || chr(10) || 'If x = ' || gt_id || ' Then' || chr(10) || '  b = 1' || chr(10) || 'End If' || chr(10) || 'c = 2' || chr(10),
 'a = 1' || chr(10) || ''' part 2 of 3: branch of the outermost IF' || chr(10) || ''' begins with: ElseIf y Then' || chr(10) || 'If y Then' || chr(10) || 'ElseIf y Then' || chr(10) || '  For i = 1 To 2' || chr(10) || '  Next' || chr(10) || 'End If' || chr(10) || 'c = 2' || chr(10),
 'a = 1' || chr(10) || ''' part 3 of 3: branch of the outermost IF' || chr(10) || ''' begins with: Else' || chr(10) || 'If True Then  '' what the outer Else does' || chr(10) || 'Else' || chr(10) || '  d = 3' || chr(10) || 'End If' || chr(10) || 'c = 2' || chr(10)]) AS code FROM gt_rules""")
def c10_branches(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of a text by the branches of its outermost block, through the table function."""
    register(spark)
    text = F.concat(F.lit("a = 1\nIf x = "), F.col("gt_id").cast("string"), F.lit(" Then ' why\n  b = 1\nElseIf y Then\n  For i = 1 To 2\n  Next\nElse\n  d = 3\nEnd If\nc = 2"))
    table(spark, folder, "gt_rules").select("gt_id", text.alias("code")).createOrReplaceTempView("_branch_rows")
    return spark.sql("SELECT gt_id, s.part, s.label, s.code FROM _branch_rows, LATERAL split_branches(code) s")
