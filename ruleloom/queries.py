"""The engine's queries over a data folder, each with its SQL where SQL can express it on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ruleloom.functions import kernels
from ruleloom.functions import text as T
from ruleloom.operators import edit, evaluate, export, extract, profile, review, segment, similarity
from ruleloom.sources import ground_truth, stores
from ruleloom.sources.tables import table
from ruleloom.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str | Callable[[], str]] = {}


def query(sql: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; SQL that needs what is defined further down is a function."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(key: str, values: dict[str, str], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in values.items()) + f" ELSE {default} END"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


EXT = "lower(regexp_extract({0}, '\\.([^./\\\\]*)$', 1))"
FAMILY = _case(EXT.format("file_name"), {e: k for k, es in T.CORE.items() for e in es}, "'other'")
TYPE_KEYS = {t.lower(): t for t in T.RULE_TYPES} | {"datatransform": "DataTransformation"} | {str(i): t for i, t in enumerate(T.RULE_TYPES)}
TYPE_SQL = _case("regexp_replace(lower(trim(type)), '[ _]', '', 'g')", TYPE_KEYS, "'BusinessRule'")
DECISION_KEYS = {n.lower(): n for n in T.DECISIONS} | {str(i): n for i, n in enumerate(T.DECISIONS)}
DECISION_SQL = _case("lower(trim(decision))", DECISION_KEYS, "'Pending'")
CONFIDENCE_KEYS = {n.lower(): n for n in T.CONFIDENCES} | {str(i): n for i, n in enumerate(T.CONFIDENCES)}
CONFIDENCE_SQL = _case("lower(trim(confidence))", CONFIDENCE_KEYS, "'Medium'")
CONTENT_SQL = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[ \\t\\n\\r.,:;()_-]'), lambda w: length(w) > 2 AND NOT list_contains(" + _list(T.STOP_WORDS) + ", w)))"
DUPLICATE_SQL = "array_to_string(list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{Nd}} ]', '', 'g'), ' '), lambda w: w <> '' AND NOT list_contains(" + _list(T.DUPLICATE_STOP_WORDS) + ", w)), ' ')"
MATCHING_SQL = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{Nd}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"
DIV, PARA, VB, SQLU = (_q(p) for p in (segment.COBOL_DIVISION, segment.COBOL_PARAGRAPH, segment.VB_UNIT, segment.SQL_UNIT))
LINES_SQL = f"""lines AS (SELECT id, name, family, unnest(list) AS line, generate_subscripts(list, 1) AS line_no FROM
 (SELECT chunk_id AS id, file_name AS name, {FAMILY} AS family, string_split(source_text, chr(10)) AS list FROM chunks))"""
MARKED_SQL = f"""{LINES_SQL}, marked AS (SELECT *, CASE family WHEN 'cobol' THEN regexp_matches(line, {DIV}) OR regexp_matches(line, {PARA})
 WHEN 'vb' THEN regexp_matches(line, {VB}) WHEN 'sql' THEN regexp_matches(line, {SQLU}) ELSE false END AS opens FROM lines)"""
LABEL_SQL = f"""CASE WHEN seq = 0 THEN CASE family WHEN 'cobol' THEN 'PREAMBLE' WHEN 'vb' THEN 'MODULE-PREAMBLE' WHEN 'sql' THEN 'SQL-PREAMBLE' ELSE 'FULL-FILE' END
 WHEN family = 'cobol' THEN upper(CASE WHEN regexp_extract(first, {DIV}, 1) <> '' THEN regexp_extract(first, {DIV}, 1) ELSE regexp_extract(first, {PARA}, 1) END)
 WHEN family = 'vb' THEN regexp_extract(first, {VB}, 1) ELSE regexp_replace(regexp_extract(first, {SQLU}, 1), '[\\[\\]]', '', 'g') END"""
SEGMENTS_SQL = f"""{MARKED_SQL}, numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY id ORDER BY line_no) AS seq FROM marked),
 grouped AS (SELECT id, name, family, seq::INT AS seq, min(line_no)::INT AS start_line, max(line_no)::INT AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS text, arg_min(line, line_no) AS first FROM numbered GROUP BY ALL),
 segs AS (SELECT id, name, family, seq, {LABEL_SQL} AS label, start_line, end_line, text FROM grouped WHERE regexp_matches(text, '\\S'))"""
MERGED_SQL = f"""WITH RECURSIVE {SEGMENTS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS r FROM segs),
 fold AS (SELECT id, name, family, r, 0 AS chunk_seq, label, start_line, end_line, text FROM ranked WHERE r = 1
  UNION ALL SELECT n.id, n.name, n.family, n.r,
   CASE WHEN length(f.text) // 4 + length(n.text) // 4 < 300 THEN f.chunk_seq ELSE f.chunk_seq + 1 END,
   CASE WHEN length(f.text) // 4 + length(n.text) // 4 < 300 THEN f.label || ' + ' || n.label ELSE n.label END,
   CASE WHEN length(f.text) // 4 + length(n.text) // 4 < 300 THEN f.start_line ELSE n.start_line END, n.end_line,
   CASE WHEN length(f.text) // 4 + length(n.text) // 4 < 300 THEN f.text || chr(10) || n.text ELSE n.text END
   FROM fold f JOIN ranked n ON n.id = f.id AND n.r = f.r + 1),
 merged AS (SELECT id, name, family, chunk_seq, arg_max(label, r) AS label, arg_max(start_line, r) AS start_line, arg_max(end_line, r) AS end_line, arg_max(text, r) AS text FROM fold GROUP BY ALL)"""
TIER_SQL = "CASE WHEN depth <= 1 AND branches <= 3 THEN 'Low' WHEN depth <= 2 OR branches <= 8 THEN 'Medium' ELSE 'High' END"
DEPTH_SQL = f"len(regexp_extract_all({{0}}, {_q(profile.OPENERS)})) AS depth, len(regexp_extract_all({{0}}, {_q(profile.BRANCHES)})) AS branches"


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select(F.col("chunk_id").alias("id"), F.col("file_name").alias("name"), F.col("source_text").alias("text"))


def _rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules with type, confidence and decision by name."""
    named = {"type": T.rule_type(F.col("type")), "confidence": T.enum_name(F.col("confidence"), T.CONFIDENCES, "Medium"), "decision": T.enum_name(F.col("decision"), T.DECISIONS, "Pending")}
    return table(spark, folder, "rules").withColumns(named)


RULES_SQL = f"rules_named AS (SELECT * REPLACE ({TYPE_SQL} AS type, {CONFIDENCE_SQL} AS confidence, {DECISION_SQL} AS decision) FROM rules)"


@query(f"{MERGED_SQL} SELECT family, tier, count(*) AS chunks, round(avg(length(text) // 4), 6) AS avg_tokens FROM (SELECT *, {TIER_SQL} AS tier FROM (SELECT *, {DEPTH_SQL.format('text')} FROM merged)) GROUP BY ALL")
def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Source texts by line, boundary, segment and merged chunk, counted by language and complexity tier."""
    chunks = segment.merged(segment.segments(_texts(spark, folder)))
    return chunks.groupBy("family", profile.simple_tier(F.col("text")).alias("tier")).agg(F.count("*").alias("chunks"), F.round(F.avg("tokens"), 6).alias("avg_tokens"))


# --- scans ---------------------------------------------------------------------------------------------------------


@query(f"SELECT file_id, {_case(EXT.format('file_name'), T.LANGUAGES, 'NULL')} IS NOT NULL AS supported, CASE WHEN {_case(EXT.format('file_name'), T.LANGUAGES, 'NULL')} IS NULL THEN 'unsupported' WHEN size_bytes > 512000 THEN 'too large' ELSE 'ok' END AS status FROM source_files")
def s1_scan_status(spark: SparkSession, folder: str) -> DataFrame:
    """Which scanned files are accepted: by extension and by size."""
    known = T.lookup(T.extension(F.col("file_name")), T.LANGUAGES, None).isNotNull()
    status = F.when(~known, "unsupported").when(F.col("size_bytes") > T.MOST_BYTES, "too large").otherwise("ok")
    return table(spark, folder, "source_files").select("file_id", known.alias("supported"), status.alias("status"))


@query("SELECT doc_id, sha256(text) AS content_hash, len(string_split(text, chr(10)))::INT AS line_count FROM documents")
def s2_content_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Hash and line count of every document."""
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.size(F.split("text", "\n", -1)).alias("line_count"))


@query("SELECT doc_id, length(text)::INT AS n_chars, strlen(text)::INT AS n_bytes FROM documents")
def s3_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Documents through bytes and back: characters and bytes."""
    back = F.decode(F.encode("text", "UTF-8"), "UTF-8")
    return table(spark, folder, "documents").select("doc_id", F.length(back).alias("n_chars"), F.octet_length("text").alias("n_bytes"))


@query(f"SELECT file_id, {_case(EXT.format('file_name'), T.LANGUAGES, _q('Unknown'))} AS language FROM source_files")
def s4_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of each file by its extension."""
    return table(spark, folder, "source_files").select("file_id", T.language(F.col("file_name")).alias("language"))


S5 = "CASE WHEN size_bytes < 4000 OR " + EXT.format("file_path") + " = 'cpy' OR regexp_matches(lower(regexp_extract(file_path, '([^/\\\\]*)$', 1)), " + _q("|".join(T.CONTEXT_WORDS)) + ") THEN 'Context' ELSE 'Analyze' END"


@query(f"SELECT file_id, {S5} AS role FROM source_files")
def s5_role(spark: SparkSession, folder: str) -> DataFrame:
    """Role of each file by size, extension and name."""
    return table(spark, folder, "source_files").select("file_id", T.role(F.col("file_path"), F.col("size_bytes")).alias("role"))


@query("SELECT CASE lower(trim(role)) WHEN 'context' THEN 'Context' WHEN '1' THEN 'Context' WHEN 'skip' THEN 'Skip' WHEN '2' THEN 'Skip' ELSE 'Analyze' END AS role, count(*) AS files, sum(coalesce(line_count, 0))::BIGINT AS lines FROM source_files GROUP BY 1")
def s6_role_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Files by stored role (name or ordinal); a missing role means Analyze."""
    role = T.enum_name(F.col("role"), ("Analyze", "Context", "Skip"), "Analyze")
    return table(spark, folder, "source_files").groupBy(role.alias("role")).agg(F.count("*").alias("files"), F.sum(F.coalesce("line_count", F.lit(0))).alias("lines"))


@query("""SELECT scope, string_agg('=== ' || file_name || ' ===' || chr(10) || substr(text, 1, 8000), chr(10) || chr(10) ORDER BY file_id) AS context FROM
 (SELECT substr(c.file_name, 1, 3) AS scope, c.file_id, f.file_name, string_agg(source_text, chr(10) ORDER BY chunk_seq, chunk_id) AS text FROM chunks c JOIN source_files f USING (file_id) GROUP BY ALL) GROUP BY scope""")
def s7_context_block(spark: SparkSession, folder: str) -> DataFrame:
    """Context text of each family of files (first three letters of the name), files in order and shortened."""
    chunks = table(spark, folder, "chunks").select("file_id", F.substring("file_name", 1, 3).alias("scope"), "chunk_seq", "chunk_id", "source_text")
    whole = chunks.groupBy("scope", "file_id").agg(export.in_order(["chunk_seq", "chunk_id"], F.col("source_text")).alias("text"))
    return export.context_blocks(whole.join(table(spark, folder, "source_files").select("file_id", "file_name"), "file_id"))


@query(f"""WITH {RULES_SQL} SELECT s.session_id AS id, name, model_used AS model, count(r.rule_id)::INT AS total, count(*) FILTER (r.decision = 'Accepted')::INT AS accepted, count(*) FILTER (r.decision = 'Rejected')::INT AS rejected, count(*) FILTER (r.decision = 'Flagged')::INT AS flagged
 FROM sessions s LEFT JOIN rules_named r USING (session_id) GROUP BY ALL""")
def s8_session_list(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions as JSON documents with their rules, listed tolerantly."""
    decision = F.struct(F.col("decision").alias("Decision"))
    rules = table(spark, folder, "rules").groupBy("session_id").agg(F.collect_list(decision).alias("Rules"))
    docs = table(spark, folder, "sessions").join(rules, "session_id", "left").select(F.to_json(F.struct(F.col("session_id").alias("Id"), F.col("name").alias("Name"), F.col("model_used").alias("ModelUsed"), F.col("Rules"))).alias("j"))
    read = docs.select(F.from_json("j", stores.SESSION).alias("d")).select("d.*")
    return stores.session_list(read).drop("created_at")


@query("SELECT session_id, name FROM sessions WHERE session_id = (SELECT min(session_id) FROM sessions)")
def s9_point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One session by its id (the smallest there is)."""
    sessions = table(spark, folder, "sessions")
    first = sessions.agg(F.min("session_id")).first()[0]
    return stores.by_id(sessions, "session_id", first).select("session_id", "name")


@query("""SELECT gt_id, id, category, text FROM (SELECT gt_id, trim(gt_code) AS id, trim(coalesce(category, '')) AS category, trim(rule_text) AS text FROM gt_rules WHERE instr(rule_text, chr(10)) = 0) WHERE id <> '' AND text <> '' AND NOT starts_with(id, '#')""")
def s15_gt_strict(spark: SparkSession, folder: str) -> DataFrame:
    """Ground truth written as lines and read strictly."""
    g = table(spark, folder, "gt_rules").where(~F.contains("rule_text", F.lit("\n")))
    docs = g.select(F.col("gt_id").alias("doc"), F.concat(F.lit("# set\n\n"), F.col("gt_code"), F.lit(" | "), F.coalesce("category", F.lit("")), F.lit(" | "), F.col("rule_text"), F.lit("\na | b")).alias("text"))
    return ground_truth.parse_strict(docs).select(F.col("doc").alias("gt_id"), "id", "category", "text")


@query("""SELECT gt_id, 1 AS line_no, 'GT-001' AS id, 'Business Rules' AS category, trim(rule_text) AS text FROM gt_rules WHERE instr(rule_text, chr(10)) = 0 AND trim(rule_text) <> '' AND NOT starts_with(trim(rule_text), '#') AND instr(rule_text, '|') = 0""")
def s16_gt_lenient(spark: SparkSession, folder: str) -> DataFrame:
    """Ground truth typed as plain lines and read leniently."""
    g = table(spark, folder, "gt_rules").where(~F.contains("rule_text", F.lit("\n")))
    return ground_truth.parse_lenient(g.select(F.col("gt_id").alias("doc"), F.col("rule_text").alias("text"))).select(F.col("doc").alias("gt_id"), "line_no", "id", "category", "text")


@query("SELECT gt_id, 0 AS pos, gt_code AS id, coalesce(category, '') AS category, rule_text AS text FROM gt_rules WHERE trim(gt_code) <> ''")
def s17_gt_answer(spark: SparkSession, folder: str) -> DataFrame:
    """Ground truth as a model answers it: JSON within chatter, keys in other case."""
    g = table(spark, folder, "gt_rules")
    body = F.to_json(F.array(F.struct(F.col("gt_code").alias("ID"), F.col("category").alias("Category"), F.col("rule_text").alias("ruletext"))))
    answers = g.select(F.col("gt_id").alias("doc"), F.concat(F.lit("Here you are:\n"), body, F.lit("\nDone.")).alias("answer"))
    return ground_truth.parse_answer(answers).select(F.col("doc").alias("gt_id"), "pos", "id", "category", "text")


@query(f"WITH {RULES_SQL} SELECT rule_id AS gt_id, {_case('type', ground_truth.TYPE_CATEGORY, _q('BusinessRule'))} AS category, description AS text, source_reference AS source_ref FROM rules_named WHERE decision IN ('Accepted', 'Flagged')")
def s18_gt_from_review(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted and flagged rules as ground truth."""
    return ground_truth.from_review(_rules(spark, folder), include_flagged=True)


# --- sinks and state ---------------------------------------------------------------------------------------------


@query("SELECT session_id, name, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY updated_at DESC NULLS LAST) AS r FROM sessions) WHERE r = 1")
def k1_latest_session(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of each session."""
    return review.latest(table(spark, folder, "sessions").select("session_id", "name", "updated_at"), "session_id", "updated_at")


LAST_SESSION = "(SELECT max(session_id) FROM sessions)"


@query(f"SELECT rule_id, session_id, CASE WHEN session_id = {LAST_SESSION} THEN 'Pending' ELSE decision END AS decision FROM rules")
def k2_replace_rules(spark: SparkSession, folder: str) -> DataFrame:
    """One session's rules replaced by undecided ones."""
    rules = table(spark, folder, "rules").select("rule_id", "session_id", "decision")
    last = table(spark, folder, "sessions").agg(F.max("session_id").alias("session_id"))
    return review.replaced(rules, rules.join(last, "session_id").select("rule_id", "session_id", F.lit("Pending").alias("decision")), "session_id")


@query(f"SELECT session_id, count(*) AS rules FROM rules WHERE session_id IS NOT NULL AND session_id <> {LAST_SESSION} GROUP BY 1")
def k3_delete_session(spark: SparkSession, folder: str) -> DataFrame:
    """The rules without those of a deleted session, counted."""
    last = table(spark, folder, "sessions").agg(F.max("session_id").alias("session_id"))
    return review.removed(table(spark, folder, "rules").where("session_id is not null"), last, "session_id").groupBy("session_id").agg(F.count("*").alias("rules"))


@query(f"""WITH known AS (SELECT event_id, rule_id, {DECISION_SQL.replace("ELSE 'Pending'", 'ELSE NULL')} AS d, decided_at, received_at FROM decision_events),
 once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_at NULLS LAST, decided_at) AS r FROM known WHERE d IS NOT NULL AND rule_id IS NOT NULL AND decided_at IS NOT NULL) WHERE r = 1),
 turned AS (SELECT *, CASE WHEN lag(d) OVER w = d THEN 0 ELSE 1 END AS turn FROM once WINDOW w AS (PARTITION BY rule_id ORDER BY decided_at, event_id)),
 runs AS (SELECT *, sum(turn) OVER (PARTITION BY rule_id ORDER BY decided_at, event_id) AS run FROM turned),
 by_run AS (SELECT rule_id, run, count(*) AS n, min(d) AS d, max(decided_at) AS last_at FROM runs GROUP BY ALL)
 SELECT rule_id, CASE WHEN arg_max(n, run) % 2 = 1 THEN arg_max(d, run) ELSE 'Pending' END AS decision, arg_max(last_at, run) AS decided_at, sum(n)::BIGINT AS n_events FROM by_run GROUP BY rule_id""")
def k4_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """The decision of each rule after all events, toggles included."""
    return review.decisions(table(spark, folder, "decision_events"))


@query(f"WITH {RULES_SQL} SELECT rule_id AS id, label, type FROM rules_named WHERE decision = 'Accepted' AND confidence IN ('High', 'Medium')")
def k5_knowledge(spark: SparkSession, folder: str) -> DataFrame:
    """Knowledge learnt from accepted rules of at least medium confidence."""
    own = _rules(spark, folder).where("decision = 'Accepted'").select(F.col("rule_id").alias("id"), "label", "description", "type", "confidence", F.col("decided_at").alias("added_at"))
    return review.learn(own, own.limit(0), "Medium").select("id", "label", "type")


@query(f"WITH {RULES_SQL} SELECT count(*) AS entries, max(decided_at) AS last_updated FROM rules_named WHERE decision = 'Accepted'")
def k6_knowledge_state(spark: SparkSession, folder: str) -> DataFrame:
    """Number of entries and the time of the last one."""
    return review.knowledge_state(_rules(spark, folder).where("decision = 'Accepted'").select(F.col("decided_at").alias("added_at")))


KEY_SQL = "sha256(source_text || {0} || 'm1')"


@query(f"SELECT chunk_id, {KEY_SQL.format(_q('p1'))} AS key FROM chunks WHERE {KEY_SQL.format(_q('p1'))} NOT IN (SELECT {KEY_SQL.format(_q('p1'))} FROM chunks WHERE complexity = 'Low' AND source_text IS NOT NULL) AND source_text IS NOT NULL")
def k7_cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose response is not cached, where those of low complexity are."""
    asked = table(spark, folder, "chunks").where("source_text is not null").withColumn("key", T.cache_key(F.col("source_text"), F.lit("p1"), F.lit("m1")))
    return review.cache_misses(asked, asked.where("complexity = 'Low'")).select("chunk_id", "key")


TEMPLATES_SQL = "templates AS (SELECT prompt_template_id AS id, max(prompt_template_name) AS name, min(created_at) AS created_at FROM sessions WHERE prompt_template_id IS NOT NULL GROUP BY 1)"


def _templates(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "sessions").where("prompt_template_id is not null")
    return s.groupBy(F.col("prompt_template_id").alias("id")).agg(F.max("prompt_template_name").alias("name"), F.min("created_at").alias("created_at"))


@query(f"WITH {TEMPLATES_SQL} SELECT id, name, id = (SELECT max(id) FROM templates) AS is_active, (id = (SELECT max(id) FROM templates)) <> (id = (SELECT min(id) FROM templates)) AS changed FROM templates")
def k8_activate_template(spark: SparkSession, folder: str) -> DataFrame:
    """Activation moved from the first template to the last."""
    t = _templates(spark, folder)
    ends = t.agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    t = t.crossJoin(F.broadcast(ends)).withColumn("is_active", F.col("id") == F.col("lo"))
    return review.activated(t, F.col("hi")).select("id", "name", "is_active", "changed")


@query(f"WITH {TEMPLATES_SQL} SELECT id, name, CASE WHEN name = 'Baseline' THEN 'default' ELSE '' END AS instructions FROM templates")
def k9_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Blank baseline instructions filled."""
    return review.baseline(_templates(spark, folder).withColumn("instructions", F.lit("")), "default").select("id", "name", "instructions")


REPORT_SQL = f"""WITH {RULES_SQL}, numbered AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY rule_id) AS no, rule_id, regexp_replace(type, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g') AS type, label,
 CASE WHEN length(description) > 500 THEN substr(description, 1, 500) || '…' ELSE description END AS description FROM rules_named)"""


@query(f"{REPORT_SQL} SELECT file_id, no::INT AS no, rule_id, type, label, description FROM numbered")
def k10_report_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of each file's report."""
    return export.report_rows(_rules(spark, folder))


@query(f"""{REPORT_SQL}, cells AS (SELECT file_id, no, '| ' || no || ' | ' || regexp_replace(coalesce(type, ''), '[|\\r\\n]+', ' ', 'g') || ' | ' || regexp_replace(coalesce(label, ''), '[|\\r\\n]+', ' ', 'g') || ' | ' || regexp_replace(coalesce(description, ''), '[|\\r\\n]+', ' ', 'g') || ' |' AS row FROM numbered)
 SELECT file_id, '| No | Type | Label | Description |' || chr(10) || '|-|-|-|-|' || chr(10) || string_agg(row, chr(10) ORDER BY no) AS report FROM cells GROUP BY 1""")
def k10_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Each file's report as a Markdown table."""
    return export.markdown(_rules(spark, folder))


PASCAL_SQL = "array_to_string(list_transform(list_filter(string_split(regexp_replace(coalesce(label, ''), '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '')"
METHOD_SQL = "'    /// <summary>' || replace(replace(replace(coalesce(description, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</summary>' || chr(10) || '    public void ' || CASE WHEN label IS NULL THEN 'Rule' WHEN regexp_matches(p, '^[0-9]') THEN '_' || p ELSE p END || '()' || chr(10) || '    {' || chr(10) || '        throw new NotImplementedException();' || chr(10) || '    }'"
SCAFFOLD_SQL = f"""WITH {RULES_SQL}, methods AS (SELECT session_id AS scope, type, string_agg({METHOD_SQL}, chr(10) || chr(10) ORDER BY rule_id) AS m FROM (SELECT *, {PASCAL_SQL} AS p FROM rules_named WHERE decision = 'Accepted' AND session_id IS NOT NULL) GROUP BY ALL),
 sources AS (SELECT scope, type, 'public sealed class ' || type || 'Rules' || chr(10) || '{{' || chr(10) || m || chr(10) || '}}' || chr(10) AS source FROM methods)"""


def _scaffold(spark: SparkSession, folder: str) -> DataFrame:
    return export.scaffold(_rules(spark, folder).where("decision = 'Accepted' and session_id is not null").withColumnRenamed("session_id", "scope"))


@query(f"{SCAFFOLD_SQL} SELECT * FROM sources")
def k11_scaffold(spark: SparkSession, folder: str) -> DataFrame:
    """A class for each session and type of accepted rules."""
    return _scaffold(spark, folder)


_BARE = "regexp_replace(regexp_replace(source, '/\\*.*?\\*/|//[^\\n]*', ' ', 'g'), '[^()\\[\\]{}]', '', 'g')"
PAIRS = "regexp_replace({0}, '\\(\\)|\\[\\]|\\{{\\}}', '', 'g')"


@query(f"""{SCAFFOLD_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)}, shrink AS (SELECT scope, type, {_BARE} AS s, 0 AS n FROM sources
 UNION ALL SELECT scope, type, {PAIRS.format('s')}, n + 1 FROM shrink WHERE {PAIRS.format('s')} <> s)
 SELECT scope, type, arg_max(s, n) = '' AS balanced FROM shrink GROUP BY ALL""")
def k12_balanced(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the brackets of each generated class close in the order they open."""
    return _scaffold(spark, folder).select("scope", "type", export.balanced(F.col("source")).alias("balanced"))


@query("SELECT session_id, regexp_replace(name, '[^\\p{L}\\p{Nd}-]', '_', 'g') AS safe_name FROM sessions")
def k14_safe_name(spark: SparkSession, folder: str) -> DataFrame:
    """File names of sessions."""
    return table(spark, folder, "sessions").select("session_id", T.safe_name(F.col("name")).alias("safe_name"))


# --- segmentation ------------------------------------------------------------------------------------------------


@query(f"WITH {LINES_SQL} SELECT id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars, max(line_no)::INT AS last_line FROM lines GROUP BY id")
def c1_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Texts by line."""
    return segment.lines(_texts(spark, folder)).groupBy("id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.max("line_no").alias("last_line"))


def _boundaries(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    own = segment.lines(_texts(spark, folder)).where(F.col("family") == kind)
    return own.where(segment.is_boundary(F.col("family"), F.col("line"))).select("id", "line_no", segment.boundary_label(F.col("family"), F.col("line")).alias("label"))


BOUNDARY_SQL = f"WITH {MARKED_SQL} SELECT id, line_no::INT AS line_no, label FROM (SELECT id, line_no, {LABEL_SQL.replace('seq = 0', 'false').replace('first', 'line')} AS label FROM marked WHERE opens AND family = '{{0}}')"


@query(BOUNDARY_SQL.replace("{0}", "cobol"))
def c2_cobol_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """Division and paragraph lines of COBOL texts."""
    return _boundaries(spark, folder, "cobol")


@query(BOUNDARY_SQL.replace("{0}", "vb"))
def c3_vb_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that begin a unit of Visual Basic."""
    return _boundaries(spark, folder, "vb")


@query(BOUNDARY_SQL.replace("{0}", "sql"))
def c4_sql_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that create a procedure or function."""
    return _boundaries(spark, folder, "sql")


@query(f"WITH {SEGMENTS_SQL} SELECT id, seq, label, start_line, end_line, text FROM segs")
def c5_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks by boundary, with label and lines."""
    return segment.segments(_texts(spark, folder)).select("id", "seq", "label", "start_line", "end_line", "text")


@query(f"{MERGED_SQL} SELECT id, chunk_seq, label, start_line, end_line, text, (length(text) // 4)::INT AS tokens FROM merged")
def c8_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks merged while small."""
    return segment.merged(segment.segments(_texts(spark, folder))).select("id", "chunk_seq", "label", "start_line", "end_line", "text", "tokens")


@query(lambda: f"""{MERGED_SQL}, units AS (SELECT row_number() OVER (ORDER BY id, chunk_seq) AS uid, * FROM merged), {BLOCKS_SQL.replace('chunk_id', 'uid').replace('source_text', 'text').replace('FROM chunks', 'FROM units')}
 SELECT u.id, chunk_seq, 0 AS part, label, start_line, end_line, tier, text FROM units u JOIN profiled p ON p.id = u.uid""")
def c9_split_complex(spark: SparkSession, folder: str) -> DataFrame:
    """Deep, large chunks split by top-level branch."""
    return segment.split_complex(segment.merged(segment.segments(_texts(spark, folder))))


@query("SELECT doc_id AS id, 'FULL-FILE' AS label, 1 AS start_line, len(string_split(text, chr(10)))::INT AS end_line FROM documents WHERE code_lang IS NULL AND regexp_matches(text, '\\S')")
def c7_full_files(spark: SparkSession, folder: str) -> DataFrame:
    """Prose documents, whose language has no boundaries: one chunk each."""
    d = table(spark, folder, "documents").where("code_lang is null").select(F.col("doc_id").alias("id"), F.lit("note.txt").alias("name"), "text")
    return segment.segments(d).select("id", "label", "start_line", "end_line")


@query("SELECT doc_id, (length(text) // 4)::INT AS tokens FROM documents")
def c11_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated tokens of each document."""
    return table(spark, folder, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


# --- profiling and text --------------------------------------------------------------------------------------------


@query(f"SELECT chunk_id, depth::INT AS depth, branches::INT AS branches, {TIER_SQL} AS tier FROM (SELECT chunk_id, {DEPTH_SQL.format('source_text')} FROM chunks)")
def profile_p1_tier(spark: SparkSession, folder: str) -> DataFrame:
    """Tier of each chunk by openers and branches."""
    t = F.col("source_text")
    return table(spark, folder, "chunks").select("chunk_id", F.regexp_count(t, F.lit(profile.OPENERS)).alias("depth"), F.regexp_count(t, F.lit(profile.BRANCHES)).alias("branches"), profile.simple_tier(t).alias("tier"))


#: SQL of the block profile: logical lines, what each does to the stack of blocks, the stack and the branch path after
#: every line, and the variables assigned and read on each path.
CLOSERS = "(?i)^(?:" + "|".join(c for _, _, c in kernels.BLOCKS) + ")"
STATEMENTS_SQL = """list_filter(list_transform(regexp_extract_all({0}, '(?:[^":]|"[^"]*(?:"|$))+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"""
LOGICAL_SQL = """lined AS (SELECT chunk_id AS id, unnest(string_split(source_text, chr(10))) AS line, generate_subscripts(string_split(source_text, chr(10)), 1) AS no FROM chunks WHERE regexp_matches(source_text, '\\S')),
 bare AS (SELECT id, no, regexp_replace(regexp_replace(line, '^((?:[^"'']|"[^"]*(?:"|$))*)''.*$', '\\1'), '\\s+$', '') AS t FROM lined),
 parted AS (SELECT *, coalesce(sum((right(t, 2) <> ' _')::INT) OVER (PARTITION BY id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS g FROM bare),
 logical AS (SELECT id, g + 1 AS g, string_agg(CASE WHEN right(t, 2) = ' _' THEN left(t, length(t) - 2) || ' ' ELSE t END, '' ORDER BY no) AS line FROM parted GROUP BY ALL)"""
OPEN_SQL = "CASE " + " ".join(f"WHEN regexp_matches(l, {_q('(?i)^' + o)}) THEN {_q(k)}" for k, o, _ in kernels.BLOCKS) + " END"
BLOCKS_SQL = f"""{LOGICAL_SQL},
 bared AS (SELECT id, g, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS l FROM logical WHERE g <= 5000),
 typed_lines AS (SELECT id, g, l, CASE WHEN regexp_matches(l, {_q(CLOSERS)}) THEN 'close' WHEN regexp_matches(l, '(?i)^ElseIf\\b.*?\\bThen(?:\\s+\\S.*)?\\s*$') THEN 'elseif' WHEN regexp_matches(l, '(?i)^Else(?:\\s+\\S.*)?\\s*$') THEN 'else' WHEN regexp_matches(l, '(?i)^Case\\b') THEN 'case' ELSE coalesce({OPEN_SQL}, 'plain') END AS k
  FROM bared WHERE l <> '' AND NOT regexp_matches(l, '^[A-Za-z_]\\w*\\s*:\\s*$')),
 steps AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY g) AS r FROM typed_lines),
 fold_blocks AS (SELECT DISTINCT id, 0::BIGINT AS r, ''::VARCHAR AS k, ''::VARCHAR AS l, ''::VARCHAR AS before, ''::VARCHAR AS stack, ''::VARCHAR AS path FROM steps
  UNION ALL SELECT s.id, s.r, s.k, s.l, f.stack,
   CASE WHEN s.k = 'close' THEN left(f.stack, greatest(length(f.stack) - 1, 0)) WHEN s.k IN ('elseif', 'else', 'case', 'plain') THEN f.stack ELSE f.stack || CASE s.k WHEN 'while' THEN 'h' ELSE left(s.k, 1) END END,
   CASE WHEN s.k = 'close' THEN regexp_replace(f.path, ',?[^,]+$', '') WHEN s.k IN ('elseif', 'else', 'case') AND f.stack <> '' THEN regexp_replace(f.path, '[^,]+$', '') || (regexp_extract(f.path, '[^,]+$')::INT + 1)
    WHEN s.k IN ('close', 'elseif', 'else', 'case', 'plain') THEN f.path ELSE f.path || CASE WHEN f.path = '' THEN '' ELSE ',' END || CASE s.k WHEN 'select' THEN '0' ELSE '1' END END
   FROM fold_blocks f JOIN steps s ON s.id = f.id AND s.r = f.r + 1),
 told AS (SELECT id, path, l AS t, false AS runs FROM fold_blocks WHERE k IN ('elseif', 'case', 'if', 'select') OR (k = 'plain' AND regexp_matches(l, '(?i)^If\\b.*?\\bThen\\s+(\\S.*)$'))
  UNION ALL SELECT id, path, unnest({STATEMENTS_SQL.format("CASE k WHEN 'elseif' THEN regexp_extract(l, '(?i)^ElseIf\\b.*?\\bThen(?:\\s+(\\S.*))?\\s*$', 1) WHEN 'else' THEN regexp_extract(l, '(?i)^Else(?:\\s+(\\S.*))?\\s*$', 1) ELSE CASE WHEN regexp_matches(l, '(?i)^If\\b.*?\\bThen\\s+(\\S.*)$') THEN regexp_extract(l, '(?i)^If\\b.*?\\bThen\\s+(\\S.*)$', 1) ELSE l END END")}), true FROM fold_blocks WHERE k IN ('elseif', 'else', 'plain')),
 aimed AS (SELECT *, CASE WHEN runs THEN lower(regexp_extract(t, '(?i)^(?:Set\\s+)?([A-Za-z_]\\w*)(?:\\s*\\([^)]*\\))?(?:\\.[A-Za-z_]\\w*)*\\s*=(?:[^=]|$)', 1)) ELSE '' END AS target, regexp_extract_all(lower(t), '\\b[a-z_]\\w*\\b') AS names FROM told),
 aims AS (SELECT id, path, names, CASE WHEN list_contains({_list(tuple(sorted(kernels.NO_VARIABLES)))}, target) THEN '' ELSE target END AS target FROM aimed),
 assigns AS (SELECT DISTINCT id, target AS v, path FROM aims WHERE target <> ''),
 reads AS (SELECT DISTINCT id, v, path FROM (SELECT id, path, unnest(CASE WHEN target = '' THEN names ELSE list_concat(names[1:list_position(names, target) - 1], names[list_position(names, target) + 1:len(names)]) END) AS v FROM aims) WHERE NOT list_contains({_list(tuple(sorted(kernels.NO_VARIABLES)))}, v)),
 crossing AS (SELECT DISTINCT a.id, a.v FROM assigns a JOIN reads u ON u.id = a.id AND u.v = a.v WHERE NOT starts_with(u.path, a.path) AND NOT starts_with(a.path, u.path) AND NOT EXISTS (SELECT 1 FROM assigns o WHERE o.id = a.id AND o.v = a.v AND o.path = '')),
 crossed AS (SELECT id, list(v ORDER BY v) AS vars FROM crossing GROUP BY 1),
 counted AS (SELECT id, max(length(stack))::INT AS depth, count(*) FILTER (k IN ('elseif', 'else', 'case') AND before <> '')::INT AS branches, count(*) FILTER (k IN ('if', 'select') AND regexp_matches(before, '[fdh]'))::INT AS in_loops FROM fold_blocks GROUP BY 1),
 kinds AS (SELECT id, string_agg(k || '=' || n, ', ' ORDER BY k) AS kinds FROM (SELECT id, k, count(*) AS n FROM fold_blocks WHERE k IN ('if', 'for', 'do', 'select', 'with', 'while') GROUP BY ALL) GROUP BY 1),
 sizes AS (SELECT id, max(g) > 5000 AS truncated FROM logical GROUP BY 1),
 profiled AS (SELECT c.chunk_id AS id, coalesce(depth, 0) AS depth, CASE WHEN coalesce(depth, 0) <= 2 THEN 'LOW' WHEN depth <= 4 THEN 'MEDIUM' WHEN depth <= 8 THEN 'HIGH' ELSE 'CRITICAL' END AS tier, coalesce(branches, 0) AS branches, coalesce(in_loops, 0) AS in_loops, coalesce(kinds, '') AS kinds, coalesce(vars, []) AS vars, coalesce(truncated, false) AS truncated
  FROM chunks c LEFT JOIN counted n ON n.id = c.chunk_id LEFT JOIN kinds k ON k.id = c.chunk_id LEFT JOIN crossed x ON x.id = c.chunk_id LEFT JOIN sizes z ON z.id = c.chunk_id),
 summed AS (SELECT *, 'Nesting: ' || tier || ' (depth ' || depth || ')' || chr(10) || 'Branches: ' || branches || CASE WHEN kinds <> '' THEN chr(10) || 'Blocks: ' || kinds ELSE '' END || CASE WHEN in_loops > 0 THEN chr(10) || 'Conditions within loops: ' || in_loops ELSE '' END
  || CASE WHEN len(vars) > 0 THEN chr(10) || 'Interdependent variables: ' || array_to_string(vars[1:{profile.MOST_SHOWN}], ', ') || CASE WHEN len(vars) > {profile.MOST_SHOWN} THEN ' (+' || (len(vars) - {profile.MOST_SHOWN}) || ' more)' ELSE '' END ELSE '' END || chr(10) || 'Extract ' || {_case('tier', profile.TIER_HINTS, 'NULL')} AS summary FROM profiled)"""


@query("WITH " + LOGICAL_SQL + ", n AS (SELECT id, count(*)::INT AS n_lines, sha256(string_agg(line, chr(10) ORDER BY g)) AS logical FROM logical GROUP BY 1), s AS (SELECT id, sha256(string_agg(t, chr(10) ORDER BY no)) AS stripped FROM bare GROUP BY 1), st AS (SELECT id, g, unnest(" + STATEMENTS_SQL.format("line") + ") AS t FROM logical) SELECT n.id, n_lines, logical, stripped, (SELECT count(*) FROM st WHERE st.id = n.id)::INT AS n_statements FROM n JOIN s USING (id)")
def profile_p2_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines without comments, logical lines and statements of every chunk: numbers and hashes."""
    return profile.logical_profile(_texts(spark, folder))


@query(f"WITH RECURSIVE {BLOCKS_SQL} SELECT id, depth, tier, branches, in_loops, kinds, array_to_string(vars, ', ') AS variables, truncated, summary FROM summed")
def profile_p5_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Block structure of every chunk: depth, tier, branches, loops, kinds, interdependent variables and the summary."""
    p = profile.profile_text(profile.block_profile(_texts(spark, folder).select("id", "text")))
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("kinds")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    return p.select("id", "depth", "tier", "branches", "in_loops", kinds.alias("kinds"), F.array_join("interdependent", ", ").alias("variables"), "truncated", "summary")


PRESCAN_SQL = " UNION ALL ".join(
    f"SELECT chunk_id AS id, {_q(n)} AS pattern, {_q(r)} AS risk, CASE " + " ".join(f"WHEN contains(lower(source_text), {_q(i.lower())}) THEN {_q(i)}" for i in own) + f" END AS indicator FROM typed WHERE {'' if is_sql else 'NOT '}(family = 'sql')"
    for n, r, _, _, sql, other in profile.PATTERNS
    for is_sql, own in ((True, sql), (False, other))
    if own
)

PATTERN_LINE_SQL = _case('pattern', {n: f'  - [{r.upper()}] {d}: {note}' for n, r, d, note, _, _ in profile.PATTERNS}, 'NULL')
PATTERN_PLACE_SQL = _case('pattern', {n: f'{k:02d}' for k, (n, *_) in enumerate(profile.PATTERNS)}, 'NULL')


def _prescan(spark: SparkSession, folder: str) -> DataFrame:
    return profile.prescan(_texts(spark, folder).withColumn("family", T.family(F.col("name"))))


@query(f"WITH typed AS (SELECT *, {FAMILY} AS family FROM chunks) SELECT * FROM ({PRESCAN_SQL}) WHERE indicator IS NOT NULL")
def profile_p11_prescan(spark: SparkSession, folder: str) -> DataFrame:
    """Translation patterns of each chunk, with the first indicator found."""
    return _prescan(spark, folder)


@query(f"""WITH typed AS (SELECT *, {FAMILY} AS family FROM chunks), hits AS (SELECT * FROM ({PRESCAN_SQL}) WHERE indicator IS NOT NULL)
 SELECT id, 'Signs of translated code in this part:' || chr(10) || string_agg({PATTERN_LINE_SQL}, chr(10) ORDER BY {PATTERN_PLACE_SQL}) || chr(10) AS block FROM hits GROUP BY id""")
def profile_p12_block(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt block of each chunk's patterns."""
    return profile.prescan_text(_prescan(spark, folder))


SYMBOL_SQL = f"""raw AS (SELECT file_name AS name, chunk_id AS pos, unnest(l) AS raw, generate_subscripts(l, 1) AS k FROM (SELECT file_name, chunk_id, CASE {FAMILY} WHEN 'sql' THEN regexp_extract_all(source_text, {_q(profile.SYMBOLS['sql'])}, 1)
 WHEN 'cobol' THEN regexp_extract_all(source_text, {_q(profile.SYMBOLS['cobol'])}, 1) ELSE regexp_extract_all(source_text, {_q(profile.SYMBOLS['vb'])}, 1) END AS l FROM chunks)),
 cleaned AS (SELECT name, pos, k, regexp_replace(raw, '[\\[\\]]', '', 'g') AS symbol FROM raw),
 syms AS (SELECT name, arg_min(symbol, (pos, k)) AS symbol FROM cleaned WHERE symbol <> '' GROUP BY name, lower(symbol))"""


def _symbols(spark: SparkSession, folder: str) -> DataFrame:
    texts = _texts(spark, folder).withColumn("family", T.family(F.col("name")))
    return profile.symbols(texts.select("name", "family", F.col("id").alias("pos"), "text"))


@query(f"WITH {SYMBOL_SQL} SELECT name, symbol FROM syms")
def profile_p13_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols that each file declares, in their first spelling."""
    return _symbols(spark, folder)


@query(f"WITH {SYMBOL_SQL}, t AS (SELECT chunk_id AS id, file_name AS name, lower(source_text) AS body FROM chunks) SELECT DISTINCT t.id, s.name AS file, s.symbol FROM t JOIN syms s ON s.name <> t.name AND contains(t.body, lower(s.symbol))")
def profile_p14_references(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols of other files that occur in each chunk."""
    return profile.references(_texts(spark, folder), _symbols(spark, folder))


@query(f"WITH {SYMBOL_SQL}, t AS (SELECT chunk_id AS id, file_name AS name, lower(source_text) AS body FROM chunks), r AS (SELECT DISTINCT t.id, s.name AS file, s.symbol FROM t JOIN syms s ON s.name <> t.name AND contains(t.body, lower(s.symbol))) SELECT id, string_agg(file || ': ' || list, chr(10) ORDER BY file) AS block FROM (SELECT id, file, string_agg(symbol, ', ' ORDER BY symbol) AS list FROM r GROUP BY ALL) GROUP BY id")
def profile_p15_reference_text(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk's references as lines by file."""
    return profile.reference_blocks(_texts(spark, folder), _symbols(spark, folder))


@query(f"SELECT rule_id, array_to_string(list_sort({CONTENT_SQL.format('description')}), ' ') AS words FROM rules")
def profile_p16_content_words(spark: SparkSession, folder: str) -> DataFrame:
    """Content words of each rule's description."""
    return table(spark, folder, "rules").select("rule_id", F.array_join(F.array_sort(T.content_words(F.col("description"))), " ").alias("words"))


@query(f"SELECT rule_id, {DUPLICATE_SQL.format('description')} AS duplicate_form, {MATCHING_SQL.format('description')} AS matching_form, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS squeezed FROM rules")
def profile_p17_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The three normal forms of each description."""
    d = F.col("description")
    return table(spark, folder, "rules").select("rule_id", T.duplicate_form(d).alias("duplicate_form"), T.matching_form(d).alias("matching_form"), T.squeezed(d).alias("squeezed"))


@query(f"SELECT rule_id, {TYPE_SQL} AS type, {_case('trim(confidence)', {n: n for n in T.CONFIDENCES} | {str(i): n for i, n in enumerate(T.CONFIDENCES)}, _q('Medium'))} AS confidence, regexp_replace({TYPE_SQL}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g') AS shown FROM rules")
def profile_p20_enums(spark: SparkSession, folder: str) -> DataFrame:
    """Type, reported confidence and displayed type of each rule."""
    kind = T.rule_type(F.col("type"))
    return table(spark, folder, "rules").select("rule_id", kind.alias("type"), T.reported_confidence(F.col("confidence")).alias("confidence"), T.display_type(kind).alias("shown"))


@query(f"SELECT rule_id, CASE WHEN regexp_matches(p, '^[0-9]') THEN '_' || p ELSE p END AS pascal, replace(replace(replace(description, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM (SELECT *, {PASCAL_SQL} AS p FROM rules)")
def profile_p23_names(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as class names, descriptions as XML."""
    return table(spark, folder, "rules").select("rule_id", T.pascal_case(F.col("label")).alias("pascal"), T.xml_escape(F.col("description")).alias("escaped"))


@query(f"SELECT doc_id, regexp_matches(lower(text), {_q('|'.join(T.EDIT_WORDS))}) AS edits FROM documents WHERE doc_type = 'chat'")
def profile_p24_edit_intent(spark: SparkSession, folder: str) -> DataFrame:
    """Chats that ask for an edit."""
    return table(spark, folder, "documents").where("doc_type = 'chat'").select("doc_id", T.edit_intent(F.col("text")).alias("edits"))


@query("SELECT rule_id, CASE WHEN length(description) > 80 THEN substr(description, 1, 80) || '…' ELSE description END AS short FROM rules")
def profile_p25_shortened(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions cut for display."""
    return table(spark, folder, "rules").select("rule_id", T.shortened(F.col("description"), 80).alias("short"))


MODEL_SQL = lambda i: "CASE " + " ".join(f"WHEN regexp_matches(lower(model_used), {_q('|'.join(m[0]))}) THEN {m[i]}" for m in T.MODEL_SIZES) + f" ELSE {1500 if i == 1 else 200} END"


@query(f"SELECT session_id, {MODEL_SQL(1)} AS tokens, {MODEL_SQL(2)} AS timeout FROM sessions")
def profile_p27_model_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Output budget and timeout of each session's model."""
    m = F.col("model_used")
    return table(spark, folder, "sessions").select("session_id", T.model_limit(m).alias("tokens"), T.model_limit(m, "timeout").alias("timeout"))


# --- extractor answers ---------------------------------------------------------------------------------------------


#: Ways in which an answer may come: whole, fenced, behind a thought, with a comma too many, cut within a rule, with a list as
#: text, with a number as text and a true flag, without rules, as a list, as no JSON at all, and cut within the first rule.
WAYS = 11


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers an extractor might give, by the rule's number."""
    r = table(spark, folder, "rules").select("rule_id", "label", "description", "type", "confidence", F.col("source_chunk").alias("chunk_label"))
    text = lambda c: F.coalesce(F.regexp_replace(F.regexp_replace(c, r"[\\\\\"\x00-\x1f]", " "), "^$", " "), F.lit("-"))
    field = lambda name, c: F.concat(F.lit(f'"{name}":"'), text(F.col(c)), F.lit('"'))
    head = F.concat(F.lit("{"), field("label", "label"), F.lit(","), field("type", "type"))
    rule = F.concat(head, F.lit(","), field("description", "description"), F.lit("}"))
    whole = F.concat(F.lit('{"rules":['), rule, F.lit("]}"))
    way = F.col("rule_id") % WAYS
    answer = (
        F.when(way == 0, whole).when(way == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(way == 2, F.concat(F.lit("<think>let me see</think>"), whole))
        .when(way == 3, F.concat(F.lit('{"rules":['), rule, F.lit(",]}"))).when(way == 4, F.concat(F.lit('{"rules":['), rule, F.lit(',{"label":"next","description":"cut he')))
        .when(way == 5, F.concat(F.lit('{"rules":['), head, F.lit(',"description":["a",null,"b"],"notes":{"k":[1,2]}}]}')))
        .when(way == 6, F.concat(F.lit('{"rules":['), head, F.lit(',"description":12,"cobol_origin":true},{"label":" "},{}]}')))
        .when(way == 10, F.concat(F.lit('{"rules":['), head, F.lit(',"description":"cut he'))).when(way == 7, F.lit('{"rules":[]}')).when(way == 8, F.concat(F.lit("["), rule, F.lit("]"))).otherwise(F.lit("no rules here"))
    )
    return r.select(F.col("rule_id").alias("id"), "chunk_label", answer.alias("answer"))


TEXT_SQL = "coalesce(regexp_replace(regexp_replace({0}, '[\\\\\"\\x00-\\x1f]', ' ', 'g'), '^$', ' '), '-')"
ANSWERS_SQL = f"""parts AS (SELECT rule_id AS id, rule_id % {WAYS} AS way, source_chunk, {TEXT_SQL.format('label')} AS label, {TEXT_SQL.format('type')} AS type, {TEXT_SQL.format('description')} AS description FROM rules),
 told AS (SELECT *, '{{"label":"' || label || '","type":"' || type || '"' AS head FROM parts)"""


@query(f"""WITH {ANSWERS_SQL}, whole AS (SELECT *, head || ',"description":"' || description || '"}}' AS rule FROM told)
 SELECT id, CASE WHEN way <= 3 THEN '{{"rules":[' || rule || ']}}' WHEN way = 4 THEN '{{"rules":[' || rule || ']}}' WHEN way = 10 THEN '{{"rules":[' || head || '}}]}}' WHEN way = 5 THEN '{{"rules":[' || head || ',"description":["a",null,"b"],"notes":{{"k":[1,2]}}}}]}}'
 WHEN way = 6 THEN '{{"rules":[' || head || ',"description":12,"cobol_origin":true}},{{"label":" "}},{{}}]}}' WHEN way = 7 THEN '{{"rules":[]}}' WHEN way = 8 THEN '[' || rule || ']' END AS json FROM whole""")
def j1_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Answers repaired to JSON that parses; null where no repair helps."""
    return extract.repaired(_answers(spark, folder))


#: The key that an answer's rule gets if it names none.
RULE_KEY_SQL = "sha256(id || '|' || pos || '|' || label)"


@query(rf"""WITH {ANSWERS_SQL}, one AS (SELECT id, 0 AS pos, 'ok' AS status, label, type, CASE way WHEN 5 THEN 'a; ; b' WHEN 6 THEN '12' WHEN 10 THEN '' ELSE description END AS description, source_chunk AS reference, way = 6 AS cobol_origin, CASE way WHEN 5 THEN '{{"k":[1,2]}}' ELSE '' END AS notes FROM told WHERE (way <= 6 OR way = 10) AND regexp_matches(label, '\S')
  UNION ALL SELECT id, 2, 'ok', 'Unknown Rule', 'BusinessRule', '', source_chunk, false, '' FROM told WHERE way = 6),
 none AS (SELECT id, NULL::INT AS pos, CASE way WHEN 8 THEN 'failed' WHEN 9 THEN 'unreadable' ELSE 'ok' END AS status FROM told WHERE way IN (7, 8, 9) OR (NOT regexp_matches(label, '\S') AND way <> 6))
 SELECT id, pos, status, {RULE_KEY_SQL} AS rule_key, label, {TYPE_SQL} AS type, description, reference, 'Medium' AS confidence, '' AS migration_notes, 'low' AS risk, '' AS code_snippet, cobol_origin, notes FROM one
 UNION ALL SELECT id, pos, status, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM none""")
def j6_rules_of_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Rules read from answers, with lists, numbers and flags in their fields, and answers that hold none."""
    return extract.answers_to_rules(_answers(spark, folder))


@query(f"SELECT rule_id, {CONFIDENCE_SQL.replace(_q('Medium') + ' END', 'NULL END')} AS confidence, {DECISION_SQL} AS decision FROM rules")
def j10_enums(spark: SparkSession, folder: str) -> DataFrame:
    """Stored enums by name or ordinal."""
    return table(spark, folder, "rules").select("rule_id", T.enum_name(F.col("confidence"), T.CONFIDENCES).alias("confidence"), T.enum_name(F.col("decision"), T.DECISIONS, "Pending").alias("decision"))


# --- similarity, retrieval, joins --------------------------------------------------------------------------------


LCS_SQL = """list_reduce(list_prepend(full_mask, list_transform(string_split(b, ''), lambda ch: coalesce(list_sum(list_transform(range(length(a)), lambda i: CASE WHEN a[(i + 1)::BIGINT] = ch THEN (1::HUGEINT << i::INT) ELSE 0::HUGEINT END)), 0)::HUGEINT)),
 lambda v, m: ((v + (v & m)) | (v - (v & m))) & full_mask)"""


@query(f"""WITH f AS (SELECT rule_id, {MATCHING_SQL.format('label')} AS a, {MATCHING_SQL.format('description')} AS b FROM rules),
 m AS (SELECT *, ((1::HUGEINT << length(a)::INT) - 1)::HUGEINT AS full_mask FROM f),
 c AS (SELECT rule_id, a, b, CASE WHEN a = '' OR b = '' THEN 0 ELSE length(a) - bit_count({LCS_SQL}) END::INT AS common FROM m)
 SELECT rule_id, common, round(CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * common / (length(a) + length(b)) END, 6)::DOUBLE AS ratio FROM c""")
def m1_label_lcs(spark: SparkSession, folder: str) -> DataFrame:
    """Common subsequence of each rule's label and description, and its ratio."""
    r = table(spark, folder, "rules").select("rule_id", T.matching_form(F.col("label")).alias("a"), T.matching_form(F.col("description")).alias("b"))
    common = r.withColumn("common", similarity.lcs(F.col("a"), F.col("b")))
    total = F.length("a") + F.length("b")
    return common.select("rule_id", "common", F.round(F.when(total == 0, 1.0).otherwise(2.0 * F.col("common") / total), 6).alias("ratio"))


KB_SQL = f"""WITH e AS (SELECT gt_id, unnest({CONTENT_SQL.format('rule_text')}) AS word FROM gt_rules), q AS (SELECT chunk_id, unnest({CONTENT_SQL.format('source_text')}) AS word FROM chunks),
 scored AS (SELECT chunk_id AS query_id, gt_id AS entry_id, count(*) AS score FROM q JOIN e USING (word) GROUP BY ALL)"""


@query(f"{KB_SQL} SELECT query_id, entry_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM scored) WHERE rank <= 3")
def m4_top_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The three ground-truth entries that share most words with each chunk."""
    chunks = table(spark, folder, "chunks").select(F.col("chunk_id").alias("query_id"), F.col("source_text").alias("text"))
    return similarity.top_entries(chunks, table(spark, folder, "gt_rules").select(F.col("gt_id").alias("entry_id"), F.col("rule_text").alias("text")))


@query("""WITH l AS (SELECT chunk_id AS id, unnest(string_split(source_text, chr(10))) AS line, generate_subscripts(string_split(source_text, chr(10)), 1) AS no, len(string_split(source_text, chr(10))) AS n FROM chunks WHERE source_text IS NOT NULL)
 SELECT id, no::INT AS no, 'Context' AS kind, line FROM l UNION ALL SELECT chunk_id, 0, 'Removed', '<<first>>' FROM chunks WHERE source_text IS NOT NULL UNION ALL SELECT id, (n + 1)::INT, 'Added', '<<last>>' FROM l WHERE no = 1""")
def m5_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Line diff of each chunk with a line before it and the chunk with a line behind it."""
    c = table(spark, folder, "chunks").where("source_text is not null")
    return edit.diffs(c.select(F.col("chunk_id").alias("id"), F.concat(F.lit("<<first>>\n"), "source_text").alias("before"), F.concat("source_text", F.lit("\n<<last>>")).alias("after")))


@query(f"""WITH {RULES_SQL} SELECT f.file_id, f.file_name, count(r.rule_id) AS rules, count(*) FILTER (r.confidence = 'High') AS high, count(*) FILTER (r.decision = 'Accepted') AS accepted, count(DISTINCT r.type) AS types FROM source_files f LEFT JOIN rules_named r USING (file_id) GROUP BY ALL""")
def jn1_file_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every file with its rules; files without rules stay."""
    return export.file_report(table(spark, folder, "source_files"), _rules(spark, folder))


@query("SELECT gt_id FROM gt_rules WHERE EXISTS (SELECT 1 FROM source_files WHERE starts_with(coalesce(source_ref, ''), split_part(file_name, '.', 1)))")
def jn7_entries_with_file(spark: SparkSession, folder: str) -> DataFrame:
    """Entries whose reference names a scanned file."""
    g = table(spark, folder, "gt_rules").withColumn("stem", F.regexp_extract(F.coalesce("source_ref", F.lit("")), r"^([A-Z0-9]+)", 1))
    stems = table(spark, folder, "source_files").select(F.split_part("file_name", F.lit("."), F.lit(1)).alias("stem")).distinct()
    return g.join(stems, "stem", "left_semi").select("gt_id")


@query("SELECT a.session_id, count(b.session_id) AS others FROM sessions a JOIN sessions b ON a.model_used = b.model_used AND a.session_id <> b.session_id GROUP BY 1")
def jn8_other_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """For each session the number of others of its model, from counts instead of pairs."""
    s = table(spark, folder, "sessions").where("model_used is not null and session_id is not null")
    n = s.groupBy("model_used").agg(F.count("*").alias("n")).where("n > 1")
    return s.join(n, "model_used").select("session_id", (F.col("n") - 1).alias("others"))


# --- evaluation ----------------------------------------------------------------------------------------------------


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All rules and all ground-truth entries, also those without file or reference."""
    rules = _rules(spark, folder).select("rule_id", "label", F.col("description").alias("text"), "type", "confidence")
    entries = table(spark, folder, "gt_rules").select("gt_id", F.regexp_replace(F.coalesce("category", F.lit("")), " ", "").alias("category"), F.col("rule_text").alias("text"))
    return rules, entries


def _matched(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rules, entries = _sides(spark, folder)
    return similarity.settle(similarity.match_all(rules, entries), "matches"), rules, entries


@query()
def jn5_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Rules matched one to one with the entries, each rule compared with every entry still free."""
    return _matched(spark, folder)[0]


@query()
def g2_overall(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and F1 of the matching."""
    m, rules, entries = _matched(spark, folder)
    return evaluate.overall(m, rules, entries).withColumn("band", T.f1_band(F.col("f1")))


@query()
def g3_by_category(spark: SparkSession, folder: str) -> DataFrame:
    """The same by category."""
    m, rules, entries = _matched(spark, folder)
    return evaluate.by_category(m, rules, entries)


def _diagnosed(m: DataFrame, rules: DataFrame, entries: DataFrame) -> DataFrame:
    extra, missed = rules.join(m, "rule_id", "left_anti"), entries.join(m, "gt_id", "left_anti")
    types = [r[0] for r in rules.select(F.lower("type")).distinct().limit(100).collect()]
    # the best similarity, without the threshold, is looked for only where the reason depends on it
    best_r = similarity.best_of_rules(extra.where(evaluate.plain_extra().isNull()), entries)
    best_g = similarity.best_of_entries(rules, missed.where(evaluate.plain_missed(types).isNull()))
    fp = extra.join(best_r, "rule_id", "left").select(F.lit("extra").alias("side"), F.col("rule_id").alias("id"), evaluate.diagnose_extra(rules, F.col("best")).alias("reason"))
    fn = missed.join(best_g, "gt_id", "left").select(F.lit("missed").alias("side"), F.col("gt_id").alias("id"), evaluate.diagnose_missed(types, F.col("best")).alias("reason"))
    return fp.unionByName(fn)


@query()
def g10_diagnoses(spark: SparkSession, folder: str) -> DataFrame:
    """Why rules and entries were not matched."""
    return _diagnosed(*_matched(spark, folder))


@query()
def g12_guidance(spark: SparkSession, folder: str) -> DataFrame:
    """Advice from the evaluation."""
    m, rules, entries = _matched(spark, folder)
    reasons = similarity.settle(_diagnosed(m, rules, entries), "reasons")
    missed = reasons.where("side = 'missed'").join(entries.select(F.col("gt_id").alias("id"), "category"), "id")
    return evaluate.guidance(evaluate.overall(m, rules, entries), reasons.where("side = 'extra'"), missed, evaluate.by_category(m, rules, entries))


@query()
def g9_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of each session without near-duplicates, with their occurrences."""
    r = _rules(spark, folder).select(F.col("rule_id").alias("id"), F.coalesce("session_id", F.lit("")).alias("scope"), "type", F.col("description").alias("text"))
    return similarity.deduplicate(r)


@query(f"""WITH {RULES_SQL} SELECT session_id, count(*) AS total, count(*) FILTER (decision = 'Accepted') AS accepted, count(*) FILTER (decision = 'Rejected') AS rejected, count(*) FILTER (decision = 'Flagged') AS flagged, count(*) FILTER (decision = 'Pending') AS pending, count(*) FILTER (decision <> 'Pending') AS decided FROM rules_named GROUP BY 1""")
def g1_session_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions counted by session."""
    return review.session_counts(table(spark, folder, "rules"))


@query(f"WITH {RULES_SQL} SELECT rule_id, label FROM rules_named WHERE type = 'Validation' AND confidence = 'High'")
def fl1_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Rules by optional equality filters."""
    return review.filtered(_rules(spark, folder), type="Validation", confidence="High", decision="", file=None).select("rule_id", "label")


@query(f"WITH {RULES_SQL} SELECT file_id, type, count(*) AS n, count(DISTINCT session_id) AS sessions, max(extracted_at) AS newest FROM rules_named GROUP BY 1, 2")
def g4_by_type_and_file(spark: SparkSession, folder: str) -> DataFrame:
    """Rules counted by file and type."""
    return _rules(spark, folder).groupBy("file_id", "type").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.max("extracted_at").alias("newest"))


@query("SELECT model_used, count(*) AS runs, max(created_at) AS latest, arg_max(session_id, (created_at, session_id)) AS last_session FROM sessions GROUP BY 1")
def g6_last_of_model(spark: SparkSession, folder: str) -> DataFrame:
    """Runs and the last session of each model."""
    return table(spark, folder, "sessions").groupBy("model_used").agg(F.count("*").alias("runs"), F.max("created_at").alias("latest"), F.max_by("session_id", F.struct("created_at", "session_id")).alias("last_session"))


@query("SELECT session_id, created_at, row_number() OVER (ORDER BY created_at DESC, session_id)::INT AS place FROM sessions ORDER BY created_at DESC, session_id LIMIT 12")
def o2_newest_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve newest sessions (a top-k report), numbered."""
    top = table(spark, folder, "sessions").orderBy(F.desc("created_at"), "session_id").limit(12)
    return top.select("session_id", "created_at", F.row_number().over(Window.orderBy(F.desc("created_at"), "session_id")).alias("place"))


@query(f"SELECT category, count(*) AS n, bool_or(side = 'rule') AS in_rules FROM (SELECT lower({TYPE_SQL}) AS category, 'rule' AS side FROM rules UNION ALL SELECT lower(replace(category, ' ', '')), 'entry' FROM gt_rules WHERE category <> '') GROUP BY 1")
def u1_category_universe(spark: SparkSession, folder: str) -> DataFrame:
    """Types and categories together, counted without case."""
    r = _rules(spark, folder).select(F.lower("type").alias("category"), F.lit(True).alias("r"))
    g = table(spark, folder, "gt_rules").where("category <> ''").select(F.lower(F.regexp_replace("category", " ", "")).alias("category"), F.lit(False).alias("r"))
    return r.unionByName(g).groupBy("category").agg(F.count("*").alias("n"), F.bool_or("r").alias("in_rules"))


# --- prompts and edits ---------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {BLOCKS_SQL}, typed AS (SELECT *, {FAMILY} AS family FROM chunks), hits AS (SELECT * FROM ({PRESCAN_SQL}) WHERE indicator IS NOT NULL),
 blocks AS (SELECT id, 'Signs of translated code in this part:' || chr(10) || string_agg({PATTERN_LINE_SQL}, chr(10) ORDER BY {PATTERN_PLACE_SQL}) || chr(10) AS block FROM hits GROUP BY id),
 contexts AS (SELECT file_id, string_agg(label, ', ' ORDER BY chunk_seq, chunk_id) AS context FROM chunks GROUP BY 1)
 SELECT c.chunk_id AS id, concat_ws(chr(10) || chr(10), 'List the rules in this ' || {_case(EXT.format('file_name'), T.LANGUAGES, _q('Unknown'))} || ' code as JSON: {{"rules": [...]}}.', CASE WHEN label <> '' THEN 'Part: ' || label END, 'Structure:' || chr(10) || summary, block, 'Context:' || chr(10) || context, 'Code:' || chr(10) || source_text) AS prompt
 FROM chunks c JOIN summed s ON s.id = c.chunk_id LEFT JOIN blocks b ON b.id = c.chunk_id LEFT JOIN contexts x ON x.file_id = c.file_id""")
def e1_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The extraction prompt of every chunk, with profile, patterns and the names of the file's parts as context."""
    chunks = table(spark, folder, "chunks")
    texts = chunks.select(F.col("chunk_id").alias("id"), "file_id", F.col("file_name").alias("name"), "label", F.col("source_text").alias("text"))
    parts = chunks.groupBy("file_id").agg(export.in_order(["chunk_seq", "chunk_id"], F.col("label"), ", ").alias("context"))
    summary = profile.profile_text(profile.block_profile(texts.select("id", "text"))).select("id", "summary")
    flags = profile.prescan_text(_prescan(spark, folder))
    joined = texts.join(summary, "id").join(flags, "id", "left").join(parts, "file_id", "left")
    return joined.select("id", export.extraction_prompt(T.language(F.col("name")), F.col("label"), F.col("summary"), F.col("block"), F.col("context"), F.col("text")).alias("prompt"))


@query(f"""WITH {RULES_SQL}, l AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY rule_id) AS no, '[' || coalesce(type, '') || '] ' || coalesce(label, '') || ': ' || coalesce(description, '') AS t FROM rules_named)
 SELECT session_id, 'Answer about these ' || count(*) || ' rules.' || chr(10) || string_agg(no || '. ' || t, chr(10) ORDER BY no) AS prompt FROM l GROUP BY 1""")
def e2_chat_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The system prompt of each session's chat."""
    return export.chat_prompt(_rules(spark, folder))


def _edit_answers(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "chunks").select(F.col("chunk_id").alias("id"), "file_name", F.col("source_text").alias("content"), F.element_at(F.split("source_text", "\n", -1), 1).alias("first"))
    answer = F.concat(F.lit("Here.\n[EDIT_REQUEST]\nINTENT: note\nFILE: "), "file_name", F.lit("\nCHANGE:\nDESCRIPTION: head\nORIGINAL:\n"), "first", F.lit("\nMODIFIED:\n"), "first", F.lit(" NOTED\nEND_CHANGE\n[/EDIT_REQUEST]\nBye"))
    return c.select("id", "content", "first", answer.alias("answer"))


@query("SELECT chunk_id AS id, 'Here.' || chr(10) || chr(10) || 'Bye' AS plain_text, 'note' AS intent, file_name AS file, CASE WHEN rtrim(string_split(source_text, chr(10))[1], chr(13)) = '' THEN 0 ELSE 1 END AS n_changes FROM chunks WHERE source_text IS NOT NULL")
def e4_edit_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Edit requests read from chat answers."""
    read = edit.edit_requests(_edit_answers(spark, folder).where("content is not null"))
    return read.select("id", "plain_text", "intent", "file", F.size("changes").alias("n_changes"))


@query("""SELECT chunk_id AS id, true AS success, CASE WHEN rtrim(first, chr(13)) = '' THEN source_text ELSE first || ' NOTED' || substr(source_text, length(rtrim(first, chr(13))) + 1) END AS content, '' AS error
 FROM (SELECT chunk_id, source_text, string_split(source_text, chr(10))[1] AS first FROM chunks WHERE source_text IS NOT NULL)""")
def e6_applied(spark: SparkSession, folder: str) -> DataFrame:
    """The requested edits applied to the chunks."""
    own = _edit_answers(spark, folder).where("content is not null")
    read = edit.edit_requests(own).select("id", "changes")
    return edit.applied(own.select("id", "content").join(read, "id"))


# --- streams -------------------------------------------------------------------------------------------------------


@query("SELECT chunk_id AS request_id, source_text AS text, true AS finished FROM chunks WHERE source_text <> ''")
def t1_fold_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Texts sent as a stream of JSON lines and put together again."""
    c = table(spark, folder, "chunks").where("source_text <> ''").select(F.col("chunk_id").alias("request_id"), F.posexplode(F.split("source_text", "\n", -1)).alias("p", "piece"), F.size(F.split("source_text", "\n", -1)).alias("n"))
    content = F.concat(F.when(F.col("p") > 0, F.lit("\n")).otherwise(""), F.col("piece"))
    line = F.to_json(F.struct(F.struct(content.alias("content")).alias("message"), F.lit(False).alias("done")))
    sent = c.select("request_id", (F.col("p") * 2).alias("seq"), line.alias("line"))
    noise = c.where("p = 0").select("request_id", F.lit(1).alias("seq"), F.lit("{broken").alias("line"))
    end = c.where("p = 0").select("request_id", (F.col("n") * 2).alias("seq"), F.lit('{"message":{"content":"ignored"},"done":true}').alias("line"))
    return streams.fold_tokens(sent.unionByName(noise).unionByName(end))


@query("SELECT user_id AS label, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS at FROM events GROUP BY 1")
def t2_progress(spark: SparkSession, folder: str) -> DataFrame:
    """The latest event of each user."""
    e = table(spark, folder, "events").select(F.col("user_id").alias("label"), F.col("event_type").alias("status"), F.col("ts").alias("at"), "event_id")
    return streams.progress(e)


CHAT = r"(?m)^(user|assistant|system): ?(.*)$"


@query(f"""WITH t AS (SELECT doc_id AS conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS turn FROM documents WHERE doc_type = 'chat'),
 s AS (SELECT conv_id, turn, regexp_extract(line, '^(user|assistant|system): ?', 1) AS role FROM t)
 SELECT conv_id, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS no FROM s WHERE role IN ('user', 'assistant')""")
def t4_chat_history(spark: SparkSession, folder: str) -> DataFrame:
    """The user's and the assistant's turns of each chat document."""
    d = table(spark, folder, "documents").where("doc_type = 'chat'").select(F.col("doc_id").alias("conv_id"), F.posexplode(F.split("text", "\n", -1)).alias("turn", "line"))
    turns = d.select("conv_id", "turn", F.regexp_extract("line", "^(user|assistant|system): ?", 1).alias("role"))
    return streams.chat_history(turns).select("conv_id", "role", "no")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x_event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events by hour and type, as a watermarked window (an extension: the batch form of the stream)."""
    e = table(spark, folder, "events")
    return streams.event_windows(e.withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT chunk_id AS id, contains(source_text, label) AS exact, contains(trim(regexp_replace(source_text, '\\s+', ' ', 'g')), trim(regexp_replace(label, '\\s+', ' ', 'g'))) AS squeezed FROM chunks")
def e5_located(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each chunk's label stands in its text, exactly or up to white space."""
    c = table(spark, folder, "chunks")
    return c.select(F.col("chunk_id").alias("id"), F.contains("source_text", "label").alias("exact"), F.contains(T.squeezed(F.col("source_text")), T.squeezed(F.col("label"))).alias("squeezed"))


@query(f"""WITH {RULES_SQL} SELECT s.session_id FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM rules_named r WHERE r.session_id = s.session_id AND r.decision = 'Rejected')
 INTERSECT SELECT session_id FROM rules_named WHERE decision = 'Accepted' EXCEPT SELECT session_id FROM rules_named WHERE decision = 'Flagged'""")
def u3_session_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions with accepted rules and neither rejected nor flagged ones, by set operations."""
    rules = _rules(spark, folder).select("session_id", "decision")
    of = lambda d: rules.where(F.col("decision") == d).select("session_id")
    clean = table(spark, folder, "sessions").select("session_id").join(of("Rejected"), "session_id", "left_anti")
    return clean.intersect(of("Accepted")).exceptAll(of("Flagged").distinct())


@query(f"WITH {RULES_SQL} SELECT type, confidence, count(*) AS n, grouping(type, confidence)::INT AS level FROM rules_named GROUP BY ROLLUP (type, confidence)")
def x_rules_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Rules by type and confidence with subtotals."""
    return _rules(spark, folder).rollup("type", "confidence").agg(F.count("*").alias("n"), F.grouping_id("type", "confidence").cast("int").alias("level"))


# --- relational extensions ---------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def x_pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Pricing summary of line items."""
    l = table(spark, folder, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, c_mktsegment, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, c_mktsegment)")
def x_orders_cube(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by nation and segment with all subtotals."""
    o = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.cube("n_name", "c_mktsegment").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, place::INT AS place, round(running, 2) AS running FROM (SELECT o_custkey, o_orderkey, row_number() OVER w AS place, sum(o_totalprice) OVER w AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))")
def x_running_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Running total of each customer's orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    running = F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"), F.round(running, 2).alias("running"))
