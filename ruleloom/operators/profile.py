"""Profiling of source texts: complexity, translation patterns, symbols and references between files."""

from __future__ import annotations

from hashlib import sha256
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ruleloom.functions.kernels import analyse_blocks, logical_lines, statements, strip_comment
from ruleloom.operators.export import in_order
from ruleloom.plans.lineage import settle

#: What opens a block and what begins a branch, for the simple score.
OPENERS = r"(?i)\bIF\b|\bEVALUATE\b|\bSelect\s+Case\b|\bDo\s+(?:While|Until)\b|\bFor\b"
BRANCHES = r"(?i)\bWHEN\b|\bELSE\b|\bALSO\b|\bElseIf\b|\bCase\b"
#: Patterns as (name, risk, description, note, indicators in SQL, indicators elsewhere); fixed values are all but descriptions and notes.
PATTERNS = (
    ("sequential_loop", "medium", "a conditional loop that may stem from PERFORM UNTIL", "check the first and the last pass", (), ("Do While", "Do Until", "Loop While", "Loop Until")),
    ("goto_spaghetti", "high", "jumps to labels", "follow every jump before stating a rule", (), ("GoTo ", "GoSub ", "Label:")),
    ("fixed_length_strings", "medium", "texts of fixed width", "the widths may come from picture clauses", (), ("Space(", "PadLeft", "PadRight", "Mid(", "Left(", "Right(")),
    ("flat_record_struct", "low", "variables of the whole module", "they may be the fields of one record", (), ("Public ", "Dim ", "Module ")),
    ("date_arithmetic", "high", "calculation with dates", "check centuries and the ends of months", (), ("DateDiff", "DateAdd", "DateSerial", "CDate", "Format(")),
    ("error_handling", "high", "handling of errors by state", "errors that are passed over may hide a rule", (), ("On Error", "Err.Number", "Resume Next", "Resume")),
    ("cursor_processing", "medium", "rows taken one by one", "one statement on the whole set may say the same", ("DECLARE", "CURSOR", "FETCH", "@@FETCH_STATUS"), ()),
    ("working_storage_sql", "low", "temporary tables as working storage", "see what is left behind after an error", ("#temp", "##temp", "CREATE TABLE #", "INSERT INTO #"), ()),
    ("compute_arithmetic", "medium", "arithmetic and conversion of numbers", "compare scale and rounding of decimals", ("ROUND(", "CAST(", "CONVERT(", "* 100", "/ 100"), ()),
)
#: Symbol patterns by language.
SYMBOLS = {
    "sql": r"(?i)CREATE\s+(?:OR\s+ALTER\s+)?(?:PROCEDURE|PROC|FUNCTION)\s+(?:\[?\w+\]?\.)?(\[?\w+\]?)",
    "cobol": r"(?im)^\s{6,7}([A-Z][A-Z0-9-]+)\s*\.",
    "vb": r"(?im)^\s*(?:Public|Friend)?\s*(?:Sub|Function|Property)\s+(\w+)",
}
#: What to tell the extractor about each tier.
TIER_HINTS = {
    "LOW": "one rule for each conditional block",
    "MEDIUM": "one rule for each branch outcome, ElseIf chains kept apart",
    "HIGH": "from the outermost condition inwards, one rule for each leaf branch",
    "CRITICAL": "by top-level branch first, each part on its own",
}
MOST_SHOWN = 12


def simple_tier(text: Column) -> Column:
    """``Low``, ``Medium`` or ``High`` by the number of openers and of branches; IF within END-IF counts as well."""
    depth, branches = F.regexp_count(text, F.lit(OPENERS)), F.regexp_count(text, F.lit(BRANCHES))
    return F.when((depth <= 1) & (branches <= 3), "Low").when((depth <= 2) | (branches <= 8), "Medium").otherwise("High")


PROFILE = "id long, depth int, tier string, branches int, in_loops int, kinds map<string,int>, interdependent array<string>, truncated boolean"


def block_profile(df: DataFrame) -> DataFrame:
    """Block structure of each text of (id, text); null texts have depth 0. Each text is profiled alone."""

    def run(batches):
        for batch in batches:
            rows = [(i, *analyse_blocks(t).values()) for i, t in zip(batch["id"], batch["text"], strict=True)]
            out = pd.DataFrame(rows, columns=["id", "depth", "tier", "branches", "in_loops", "kinds", "interdependent", "truncated"])
            yield out[["id", "depth", "tier", "branches", "in_loops", "kinds", "interdependent", "truncated"]]

    return df.select(F.col("id").cast("long").alias("id"), "text").mapInPandas(run, PROFILE)


def logical_profile(df: DataFrame) -> DataFrame:
    """id, n_lines, logical, stripped, n_statements of texts (id, text) that are not blank: logical lines and statements
    counted, and the hashes of the logical lines and of the lines without comments."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                lines = logical_lines(text)
                bare = "\n".join(strip_comment(x) for x in text.split("\n"))
                rows.append((i, len(lines), sha256("\n".join(lines).encode()).hexdigest(), sha256(bare.encode()).hexdigest(), sum(len(statements(x)) for x in lines)))
            yield pd.DataFrame(rows, columns=["id", "n_lines", "logical", "stripped", "n_statements"])

    kept = df.where(F.col("text").rlike(r"\S")).select(F.col("id").cast("long").alias("id"), "text")
    return kept.mapInPandas(run, "id long, n_lines int, logical string, stripped string, n_statements int")


def profile_text(profile: DataFrame) -> DataFrame:
    """``profile`` with a column ``summary``: the profile as lines for a prompt, at most twelve variables named."""
    shown = F.array_join(F.slice("interdependent", 1, MOST_SHOWN), ", ")
    more = F.when(F.size("interdependent") > MOST_SHOWN, F.concat(F.lit(" (+"), (F.size("interdependent") - MOST_SHOWN).cast("string"), F.lit(" more)"))).otherwise("")
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("kinds")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    hint = F.create_map(*[F.lit(x) for kv in TIER_HINTS.items() for x in kv])[F.col("tier")]
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Nesting: "), "tier", F.lit(" (depth "), F.col("depth").cast("string"), F.lit(")")),
        F.concat(F.lit("Branches: "), F.col("branches").cast("string")),
        F.when(F.size("kinds") > 0, F.concat(F.lit("Blocks: "), kinds)),
        F.when(F.col("in_loops") > 0, F.concat(F.lit("Conditions within loops: "), F.col("in_loops").cast("string"))),
        F.when(F.size("interdependent") > 0, F.concat(F.lit("Interdependent variables: "), shown, more)),
        F.concat(F.lit("Extract "), hint),
    )
    return profile.withColumn("summary", lines)


def pattern_indicators() -> list[tuple[str, str, bool, int, str]]:
    """(name, risk, for SQL, position, lower-case indicator) rows of the fixed patterns."""
    return [(n, r, s, k, i.lower()) for n, r, _, _, sql, other in PATTERNS for s, own in ((True, sql), (False, other)) for k, i in enumerate(own)]


def prescan(df: DataFrame) -> DataFrame:
    """id, pattern, risk and the first indicator in list order that occurs in each text of (id, family, text)."""
    found = []
    for name, risk, _, _, sql, other in PATTERNS:
        for is_sql, own in ((True, sql), (False, other)):
            if own:
                first = F.coalesce(*[F.when(F.contains(F.lower("text"), F.lit(i.lower())), F.lit(i)) for i in own])
                found.append(F.when((F.col("family") == "sql") == F.lit(is_sql), F.when(first.isNotNull(), F.struct(F.lit(name).alias("pattern"), F.lit(risk).alias("risk"), first.alias("indicator")))))
    return df.select("id", F.explode(F.array_compact(F.array(*found))).alias("p")).select("id", "p.*")


def prescan_text(flags: DataFrame) -> DataFrame:
    """One block of text an id with the descriptions of its patterns, in the patterns' order."""
    order = {n: k for k, (n, *_) in enumerate(PATTERNS)}
    text = {n: f"  - [{r.upper()}] {d}: {note}" for n, r, d, note, _, _ in PATTERNS}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("pattern")]
    line = F.create_map(*[F.lit(x) for kv in text.items() for x in kv])[F.col("pattern")]
    listed = flags.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(place.alias("k"), line.alias("line")))).alias("l"))
    head = F.array(F.lit("Signs of translated code in this part:"))
    return listed.select("id", F.concat(F.array_join(F.concat(head, F.transform("l", lambda x: x["line"])), "\n"), F.lit("\n")).alias("block"))


def symbols(df: DataFrame) -> DataFrame:
    """name, symbol (first spelling) of the units declared in the texts of (name, family, pos, text), case ignored."""
    found = F.when(F.col("family") == "sql", F.regexp_extract_all("text", F.lit(SYMBOLS["sql"]), F.lit(1))).when(F.col("family") == "cobol", F.regexp_extract_all("text", F.lit(SYMBOLS["cobol"]), F.lit(1))).otherwise(F.regexp_extract_all("text", F.lit(SYMBOLS["vb"]), F.lit(1)))
    each = df.select("name", "pos", F.posexplode(found).alias("k", "raw")).withColumn("symbol", F.regexp_replace("raw", r"[\[\]]", "")).where("symbol <> ''")
    return each.groupBy("name", F.lower("symbol").alias("folded")).agg(F.min_by("symbol", F.struct("pos", "k")).alias("symbol")).drop("folded")


#: Up to so many distinct symbols, and so many of files, are shipped to the tasks; more are joined. Texts of many lines are given out some characters at a time.
MOST_SYMBOLS, CHARS_AT_ONCE = 1_000_000, 4_000_000
#: References are listed by cells of about CELL texts and CELL files of one symbol, the rows of RUN texts for one file next to
#: each other and LISTED rows at a time, in partitions of about ROWS_AT_ONCE rows.
CELL, RUN, LISTED, ROWS_AT_ONCE = 2048, 512, 1 << 16, 8_000_000


def occurrences(held: DataFrame, folded: DataFrame, most: int = MOST_SYMBOLS) -> DataFrame:
    """id, name, folded: the symbols of ``folded`` that occur in the texts of (id, name, folded_text), within words as well.

    A symbol stands in a text as a substring, so its first characters are one of the text's shingles of that many
    characters: six characters, three or one for short symbols. Up to ``most`` symbols go to the tasks, and each text is
    read once: where the first characters of symbols stand, pieces of those symbols' lengths are looked up, so the work
    does not grow with the number of symbols that begin alike. More symbols are joined with the shingles, those of one
    or two characters, of which there are only so many, with every text.
    """
    if folded.limit(most + 1).count() <= most:
        known = {f for (f,) in folded.collect()}
        starts: dict[int, dict[str, set[int]]] = {6: {}, 3: {}, 1: {}}
        for f in known - {""}:
            n = 6 if len(f) >= 6 else 3 if len(f) >= 3 else 1
            starts[n].setdefault(f[:n], set()).add(len(f))
        same: dict[tuple[int, ...], tuple[int, ...]] = {}
        lengths = {n: {g: same.setdefault(t, t) for g, s in own.items() for t in [tuple(sorted(s))]} for n, own in starts.items() if own}
        shipped = held.sparkSession.sparkContext.broadcast((known, lengths))

        def find(batches):
            known, lengths = shipped.value
            for batch in batches:
                rows = []
                for i, name, text in zip(batch["id"], batch["name"], batch["folded_text"], strict=True):
                    if text is None:
                        continue
                    found = {""} & known
                    for n, own in lengths.items():
                        few = 4 * len(own) < len(text)
                        for g in [g for g in own if g in text] if few else own.keys() & {text[k : k + n] for k in range(len(text) - n + 1)}:
                            k = text.find(g)
                            while k >= 0:
                                found.update(p for m in own[g] if (p := text[k : k + m]) in known)
                                k = text.find(g, k + 1)
                    rows.extend((i, name, f) for f in found)
                yield pd.DataFrame(rows, columns=["id", "name", "folded"])

        schema = f"id {held.schema['id'].dataType.simpleString()}, name string, folded string"
        return held.mapInPandas(find, schema).distinct()
    short = folded.where(F.length("folded") < 3)
    out = held.join(F.broadcast(short), F.contains("folded_text", F.col("folded"))).select("id", "name", "folded")
    for n, least, most_n in ((6, 6, 1 << 20), (3, 3, 5)):
        shingles = F.expr(f"array_distinct(transform(sequence(1, greatest(length(folded_text) - {n - 1}, 1)), i -> substr(folded_text, i, {n})))")
        keyed = folded.where(F.length("folded").between(least, most_n)).withColumn("gram", F.substring("folded", 1, n))
        grams = held.select("id", "name", F.explode(shingles).alias("gram"))
        hits = grams.join(keyed, "gram").select("id", "name", "folded")
        out = out.unionByName(hits.join(held.select("id", "folded_text").hint("merge"), "id").where(F.contains("folded_text", F.col("folded"))).select("id", "name", "folded"))
    return out.distinct()


def _found(df: DataFrame, table: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Settled (id, name, folded) of the texts' symbols and (file, symbol, folded) of all symbols, each once."""
    own = settle(table.select(F.col("name").alias("file"), "symbol", F.lower("symbol").alias("folded")).distinct(), "symbols")
    held = df.select("id", "name", F.lower("text").alias("folded_text"))
    return settle(occurrences(held, own.select("folded").where("folded is not null").distinct(), most), "found"), own


def references(df: DataFrame, table: DataFrame, most: int = MOST_SYMBOLS) -> DataFrame:
    """id, file, symbol: symbols of other files that occur in the texts of (id, name, text), within words as well.

    ``table`` has name and symbol, ids are unique. Each symbol is looked for once however many files declare it, and
    only what was found is joined with the files, spread over all tasks: the result has a row for each of them.
    """
    return _of_files(*_found(df, table, most))


def _listed(ids: pa.Array, names: list[str], files: list[str], symbols: list[str]):
    """Rows as arrays of ids, files and symbols: each text for each file that isn't its own. Runs of texts have
    a whole number of eights where they can, and files that own a text of a run come last in it, so that runs repeat byte for byte."""
    at = {}
    for k, f in enumerate(files):
        at.setdefault(f, []).append(k)
    shown, spelled = pa.array(files, pa.string()), pa.array(symbols, pa.string())
    edges = [*range(0, len(ids), RUN), len(ids) - len(ids) % 8, len(ids)]
    for a, b in pairwise(sorted(set(edges))):
        own = [(j, k) for j in range(a, b) for k in at.get(names[j], ())]
        last = {k for _, k in own}
        order = np.array([k for k in range(len(files)) if k not in last] + sorted(last), dtype=np.int64)
        keep = np.ones((len(files), b - a), dtype=bool)
        if own:
            place = np.empty(len(files), dtype=np.int64)
            place[order] = np.arange(len(files))
            keep[place[[k for _, k in own]], [j - a for j, _ in own]] = False
        for k in range(0, len(files), step := max(1, LISTED // (b - a))):
            part, kept = order[k : k + step], keep[k : k + step]
            f, t = np.repeat(part, b - a), np.tile(np.arange(a, b), len(part))
            if not kept.all():
                f, t = f[kept.ravel()], t[kept.ravel()]
            f, t = pa.array(f), pa.array(t)
            yield [ids.take(t), shown.take(f), spelled.take(f)]


def _of_files(found: DataFrame, own: DataFrame) -> DataFrame:
    """id, file, symbol of every text and other file with a symbol in common.

    The rows of a symbol are all its texts times all its files. They are cut into cells, which spread over the tasks, and
    come in an order that columnar files hold in little room: a run of the same texts for one file after the other.
    """
    found, own = found.where("name is not null"), own.where("file is not null")
    texts, files = found.groupBy("folded").agg(F.count("*").alias("texts")), own.groupBy("folded").agg(F.count("*").alias("files"))
    cells = lambda n: F.ceil(F.col(n) / CELL).cast("long")
    sizes = settle(texts.join(files, "folded").select("folded", "texts", "files", cells("texts").alias("across"), cells("files").alias("down")), "sizes")
    rows = sizes.agg(F.sum(F.col("texts") * F.col("files"))).first()[0] or 0
    parts = max(4 * found.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_AT_ONCE))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    cut, key = sizes.select("folded", "across", "down"), ["folded", "x", "y"]
    held = found.join(cut, "folded").groupBy("folded", "down", of("id", "across").alias("x")).agg(F.collect_list(F.struct("id", "name")).alias("t"))
    held = held.select("folded", "x", each("down").alias("y"), F.col("t.id").alias("ids"), F.col("t.name").alias("names"))
    owned = own.join(cut, "folded").groupBy("folded", "across", of("file", "down").alias("y")).agg(F.collect_list(F.struct("file", "symbol")).alias("t"))
    owned = owned.select("folded", each("across").alias("x"), "y", F.col("t.file").alias("files"), F.col("t.symbol").alias("symbols"))
    kind = to_arrow_schema(found.select("id").schema).field("id").type
    schema = pa.schema([("id", kind), ("file", pa.string()), ("symbol", pa.string())])

    def lay(batches):
        kept, size = [], 0
        for batch in batches:
            ids = batch.column("ids")
            for i, (names, files, symbols) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("names", "files", "symbols")), strict=True)):
                for arrays in _listed(ids[i].values, names, files, symbols):
                    kept.append(pa.record_batch(arrays, schema=schema))
                    size += len(kept[-1])
                    if size >= LISTED:
                        yield from pa.Table.from_batches(kept, schema).combine_chunks().to_batches()
                        kept, size = [], 0
        yield from pa.Table.from_batches(kept, schema).combine_chunks().to_batches()

    both = held.repartition(parts, *key).join(owned.repartition(parts, *key), key)
    return both.select("ids", "names", "files", "symbols").mapInArrow(lay, f"id {found.schema['id'].dataType.simpleString()}, file string, symbol string")


class ReferenceLines:
    """The lines "file: symbols" of texts by the symbols they hold. What symbols of very many files have in common is
    laid out once for each set of such symbols; the lines that other symbols or the text's own file change are made anew."""

    COMMON = 500

    def __init__(self, rows: list[tuple[str, str, str]]) -> None:
        self.files: dict[str, list[str]] = {}
        self.spelled: dict[tuple[str, str], list[str]] = {}
        for file, symbol, folded in rows:
            if (file, folded) not in self.spelled:
                self.files.setdefault(folded, []).append(file)
            self.spelled.setdefault((file, folded), []).append(symbol)
        self.laid: dict[tuple[str, ...], tuple[list[str], dict[str, int], list[str]]] = {}

    def _line(self, file: str, folded: list[str]) -> str:
        return file + ": " + ", ".join(sorted(s for f in folded for s in self.spelled.get((file, f), ())))

    def _layout(self, common: tuple[str, ...]) -> tuple[list[str], dict[str, int], list[str]]:
        if common not in self.laid:
            if len(self.laid) >= 4:
                self.laid.clear()
            files = sorted({x for f in common for x in self.files[f]})
            self.laid[common] = files, {x: k for k, x in enumerate(files)}, [self._line(x, list(common)) for x in files]
        return self.laid[common]

    def block(self, name: str | None, folded: list[str]) -> str | None:
        """The block of a text of file ``name`` that holds the symbols ``folded``; None without a line."""
        if name is None:
            return None
        held = sorted(f for f in folded if f in self.files)
        common = tuple(f for f in held if len(self.files[f]) > self.COMMON)
        files, place, lines = self._layout(common)
        lines, more = list(lines), []
        for file in {x for f in held if f not in common for x in self.files[f]}:
            if file in place:
                lines[place[file]] = self._line(file, held)
            elif file != name:
                more.append((file, self._line(file, held)))
        if name in place:
            lines[place[name]] = None
        if more:
            both = sorted([*((f, x) for f, x in zip(files, lines, strict=True) if x is not None), *more])
            lines = [x for _, x in both]
        lines = [x for x in lines if x is not None]
        return "\n".join(lines) if lines else None


def reference_blocks(df: DataFrame, table: DataFrame, most: int = MOST_SYMBOLS) -> DataFrame:
    """id, block: the ``references`` of each text as lines by file, texts without any left out.

    Up to ``most`` symbols of files go to the tasks, and a block is made where its text's symbols are; more are joined.
    """
    found, own = _found(df, table, most)
    if own.limit(most + 1).count() > most:
        by_file = _of_files(found, own).groupBy("id", "file").agg(F.array_join(F.array_sort(F.collect_list("symbol")), ", ").alias("list"))
        return by_file.groupBy("id").agg(in_order(["file"], F.concat("file", F.lit(": "), "list")).alias("block"))
    shipped = df.sparkSession.sparkContext.broadcast([tuple(r) for r in own.where("folded is not null and file is not null").select("file", "symbol", "folded").collect()])

    def lay(batches):
        lines = ReferenceLines(shipped.value)
        for batch in batches:
            rows, size = [], 0
            for i, name, folded in zip(batch["id"], batch["name"], batch["all"], strict=True):
                text = lines.block(name, list(folded))
                if text is not None:
                    rows.append((i, text))
                    size += len(text)
                if size > CHARS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=["id", "block"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["id", "block"])

    sets = found.groupBy("id", "name").agg(F.collect_list("folded").alias("all"))
    spread = sets.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "id")
    return spread.mapInPandas(lay, f"id {found.schema['id'].dataType.simpleString()}, block string")
