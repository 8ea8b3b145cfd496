"""Scalar functions on text as Spark columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The languages of file extensions.
LANGUAGES = {
    "cbl": "COBOL", "cob": "COBOL", "cpy": "COBOL Copybook",
    "vb": "Visual Basic", "bas": "Visual Basic", "cls": "Visual Basic Class", "frm": "Visual Basic Form", "vbs": "VBScript",
    "sql": "SQL", "rpg": "RPG", "rpgle": "RPG ILE", "sqlrpgle": "SQL RPG ILE",
    "pli": "PL/I", "pl1": "PL/I", "plx": "PL/I", "nsp": "Natural", "nsa": "Natural", "nsg": "Natural",
    "f": "FORTRAN", "for": "FORTRAN", "f90": "Fortran 90", "f77": "FORTRAN 77", "f95": "Fortran 95",
    "srd": "PowerBuilder DataWindow", "srw": "PowerBuilder Window", "pbl": "PowerBuilder Library",
    "pas": "Pascal/Delphi", "dpr": "Delphi Project", "ada": "Ada", "adb": "Ada Body", "ads": "Ada Spec",
    "rexx": "REXX", "rex": "REXX", "jcl": "JCL",
}
#: Extensions that are segmented by their own rules.
CORE = {"cobol": ("cbl", "cob", "cpy"), "vb": ("vb", "bas", "cls", "frm", "vbs"), "sql": ("sql",)}
#: Name parts that make a file context.
CONTEXT_WORDS = ("copy", "const", "include", "common", "global", "header", "def", "decl")
#: Stop words of the retrieval tokenizer.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "of", "in", "on", "at", "to", "for", "and", "or", "but", "if", "then", "that", "this",
    "with", "from", "by", "as", "not", "no", "it", "its",
)
#: Stop words of the duplicate normaliser.
DUPLICATE_STOP_WORDS = ("the", "a", "an", "is", "are", "was", "were", "it", "its", "in", "on", "at", "to", "for", "and", "or", "but", "of", "with", "from")
#: Rule types in the order of their ordinals, confidence levels and decisions likewise.
RULE_TYPES = ("BusinessRule", "Validation", "Calculation", "DataTransformation", "ControlFlow", "HardcodedValue", "Workflow", "CobolArtifact", "Constraint", "ErrorHandling", "DataMapping")
CONFIDENCES = ("High", "Medium", "Low")
DECISIONS = ("Pending", "Accepted", "Rejected", "Flagged")
#: Words that make a message an edit request.
EDIT_WORDS = ("fix", "change", "update", "modify", "refactor", "replace", "edit", "rewrite", "rename", "add", "remove", "delete", "extract", "move")
#: Largest source file, and the estimate of characters in a token.
MOST_BYTES, CHARS_PER_TOKEN = 500 * 1024, 4


def lookup(key: Column, table: dict[str, str], default: str | None) -> Column:
    """The value of ``key`` in a fixed table."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; empty without one, null of null."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def base_name(path: Column) -> Column:
    """The part of a path after the last slash of either kind."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def language(path: Column) -> Column:
    """Language name by extension; ``Unknown`` for others and null."""
    return lookup(extension(path), LANGUAGES, "Unknown")


def family(path: Column) -> Column:
    """``cobol``, ``vb``, ``sql``, or ``other``."""
    return lookup(extension(path), {e: k for k, es in CORE.items() for e in es}, "other")


def role(path: Column, size: Column) -> Column:
    """``Context`` for small files, copybooks and names that say so, otherwise ``Analyze``."""
    name = F.lower(base_name(path))
    return F.when((size < 4000) | (extension(path) == "cpy") | name.rlike("|".join(CONTEXT_WORDS)), "Context").otherwise("Analyze")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / CHARS_PER_TOKEN).cast("int")


def content_words(text: Column) -> Column:
    """Distinct lower-case words of more than two characters that are no stop words, as an array; empty of null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r.,:;()_-]")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def duplicate_form(text: Column) -> Column:
    """For duplicates: letters, digits and spaces only (other white space is deleted), without stop words."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd} ]", "")
    stop = F.array(*[F.lit(w) for w in DUPLICATE_STOP_WORDS])
    return F.array_join(F.filter(F.split(kept, " "), lambda w: (w != "") & ~F.array_contains(stop, w)), " ")


def matching_form(text: Column) -> Column:
    """For matching: lower case, letters and digits, one space for any white space, trimmed."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def squeezed(text: Column) -> Column:
    """Trimmed, with one space for any white space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def rule_type(raw: Column) -> Column:
    """Rule type by name in any case, with spaces or underscores, or by ordinal; ``BusinessRule`` for anything else."""
    known = {t.lower(): t for t in RULE_TYPES} | {"datatransform": "DataTransformation"} | {str(i): t for i, t in enumerate(RULE_TYPES)}
    return lookup(F.regexp_replace(F.lower(F.trim(raw)), "[ _]", ""), known, "BusinessRule")


def enum_name(raw: Column, names: tuple[str, ...], default: str | None = None) -> Column:
    """A stored enum as its name: by name in any case, or by ordinal."""
    return lookup(F.lower(F.trim(raw)), {n.lower(): n for n in names} | {str(i): n for i, n in enumerate(names)}, default)


def reported_confidence(raw: Column) -> Column:
    """Confidence as an extractor reports it: exact names or ordinals only, otherwise ``Medium``."""
    return lookup(F.trim(raw), {n: n for n in CONFIDENCES} | {str(i): n for i, n in enumerate(CONFIDENCES)}, "Medium")


def display_type(name: Column) -> Column:
    """Words of a camel-case name apart: ``BusinessRule`` as ``Business Rule``."""
    return F.regexp_replace(name, r"(\p{Ll})(\p{Lu})", "$1 $2")


def pascal_case(text: Column) -> Column:
    """Capitalised words of letters and digits joined; ``_`` before a leading digit."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", " "), " "), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")
    return F.when(joined.rlike("^[0-9]"), F.concat(F.lit("_"), joined)).otherwise(joined)


def xml_escape(text: Column) -> Column:
    """Ampersands and angle brackets as entities."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def edit_intent(message: Column) -> Column:
    """True if any edit word stands anywhere in the message, even within a word."""
    return F.lower(message).rlike("|".join(EDIT_WORDS))


def f1_band(f1: Column) -> Column:
    """``high`` from 0.75, ``mid`` from 0.5, else ``low``."""
    return F.when(f1 >= 0.75, "high").when(f1 >= 0.5, "mid").otherwise("low")


#: Model-name parts in the order they are looked for, with output tokens and timeout in seconds.
MODEL_SIZES = ((("3b", "1b"), 800, 60), (("7b", "8b"), 1200, 120), (("14b",), 1500, 200), (("32b", "34b"), 2000, 400), (("70b", "72b"), 2500, 600))


def model_limit(model: Column, which: str = "tokens") -> Column:
    """Output tokens or timeout (``which``) by parts of the model's name; the first part that occurs decides."""
    out = F.lit(1500 if which == "tokens" else 200)
    for parts, tokens, timeout in reversed(MODEL_SIZES):
        out = F.when(F.lower(model).rlike("|".join(parts)), tokens if which == "tokens" else timeout).otherwise(out)
    return out


def safe_name(text: Column) -> Column:
    """Anything but letters, digits and hyphens as an underscore."""
    return F.regexp_replace(text, r"[^\p{L}\p{Nd}-]", "_")


def human_size(size: Column) -> Column:
    """Bytes as B, KB or MB with one decimal."""
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, F.concat(F.format_string("%.1f", size / 1024), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", size / (1 << 20)), F.lit(" MB")))


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, an ellipsis behind a text that was longer."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def cache_key(text: Column, prompt: Column, model: Column) -> Column:
    """Key of a response: SHA-256 of content, prompt and model without separators."""
    return F.sha2(F.concat(text, prompt, model), 256)
