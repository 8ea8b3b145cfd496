"""Splitting oversized items at natural boundaries, by agglomerative merging.

A text is cut into atoms (lines; longer lines at spaces), and every adjacent pair of pieces stands in a heap by the
strength of the boundary between them: a division, a section, a paragraph or routine, a blank line or comment, the
end of a statement, or nothing. The weakest boundaries are merged first while the merged piece and its overlap
with the piece before fit the limit, so what remains are the strongest boundaries the limit allows.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Extensions of each language family.
FAMILIES = {"cobol": ("cbl", "cob", "cpy", "cobol"), "vb": ("vb", "bas", "cls", "frm", "vbs"), "sql": ("sql", "prc", "fnc")}
DIVISION, SECTION, PARAGRAPH, ROUTINE = "division", "section", "paragraph", "routine"
_STRENGTH = {DIVISION: 6, SECTION: 5, PARAGRAPH: 4, ROUTINE: 4}
_COBOL_DIVISION = re.compile(r"(?i)^([a-z]+)\s+division(?:\s+using\b.*)?\s*\.?$")
_COBOL_SECTION = re.compile(r"(?i)^([a-z0-9][a-z0-9-]*)\s+section(?:\s+\d+)?\s*\.$")
_COBOL_PARAGRAPH = re.compile(r"(?i)^([a-z0-9-]*[a-z][a-z0-9-]*)\s*\.$")
_VB = re.compile(r"(?i)^\s*(?:(?:public|private|protected|friend|shared|static|overridable|overrides|overloads|mustoverride|notoverridable|shadows|partial|async|iterator|default|readonly|writeonly)\s+)*(?:sub|function|property(?:\s+(?:get|let|set))?)\s+\[?([a-z_]\w*)")
_SQL = re.compile(r"(?i)^\s*create\s+(?:or\s+(?:alter|replace)\s+)?(?:definer\s*=\s*\S+\s+)?(?:proc|procedure|function)\s+((?:\[[^\]]+\]|\"[^\"]+\"|`[^`]+`|[\w$#@]+)(?:\s*\.\s*(?:\[[^\]]+\]|\"[^\"]+\"|`[^`]+`|[\w$#@]+))*)")


def family(name: str | None, text: str) -> str:
    """Language family by the file's extension, otherwise by what the text looks like."""
    ext = (name or "").strip().lower().rpartition(".")[2]
    for kind, known in FAMILIES.items():
        if ext in known:
            return kind
    if re.search(r"(?im)^.{0,7}\s*[a-z]+\s+division\s*\.|\bpic\s+[sx9]", text):
        return "cobol"
    return "sql" if re.search(r"(?i)\bcreate\s+(?:or\s+alter\s+)?(?:proc|function)|\bselect\b.*\bfrom\b", text) else "vb"


def headers(lines: list[str], kind: str) -> dict[int, tuple[str, str]]:
    """Index of each line that opens a division, section, paragraph or routine: its level and its label.

    Comments, literals, ends, calls, data items and declarations of external functions open nothing.
    """
    found: dict[int, tuple[str, str]] = {}
    blocked = False
    for i, raw in enumerate(lines):
        line = raw.rstrip("\r").lstrip("﻿")
        if kind == "cobol":
            # columns 1-6 are a sequence area, 7 an indicator, 8-11 area A, 73-80 a tag; a free line has no columns
            fixed = len(line) > 7 and (line[:6].isdigit() or not line[:6].strip() or line[6] in "*/-")
            if fixed and line[6] != " ":
                continue
            body = line[7:72] if fixed else line.expandtabs(8)
            body = body.rstrip()
            if len(body) - len(body.lstrip()) > 3 or not body.strip() or body.lstrip().startswith("*>"):
                continue
            body = body.strip()
            for pattern, level in ((_COBOL_DIVISION, DIVISION), (_COBOL_SECTION, SECTION), (_COBOL_PARAGRAPH, PARAGRAPH)):
                m = pattern.match(body)
                if m:
                    found[i] = level, body.rstrip(" .").upper() if level == DIVISION else m.group(1).upper()
                    break
        elif kind == "vb":
            m = _VB.match(line)
            if m:
                found[i] = ROUTINE, m.group(1)
        else:
            code, blocked = _sql_code(line, blocked)
            m = _SQL.match(code)
            if m:
                found[i] = ROUTINE, re.sub(r"[\[\]\"`\s]", "", m.group(1))
    return found


def _sql_code(line: str, blocked: bool) -> tuple[str, bool]:
    """The line with comments blanked; whether a block comment stays open."""
    out = []
    i = 0
    quote = False
    while i < len(line):
        two = line[i : i + 2]
        if blocked:
            if two == "*/":
                blocked = False
                i += 1
        elif quote:
            out.append(line[i])
            quote = line[i] != "'"
        elif two == "--":
            break
        elif two == "/*":
            blocked = True
            out.append(" ")
            i += 1
        else:
            quote = line[i] == "'"
            out.append(line[i])
        i += 1
    return "".join(out), blocked


_COMMENT = {"cobol": re.compile(r"^.{6}[*/]"), "vb": re.compile(r"(?i)^\s*(?:'|rem\b)"), "sql": re.compile(r"^\s*(?:--|/\*)")}


def _is_comment(line: str, kind: str) -> bool:
    return bool(_COMMENT[kind].match(line))


def _strengths(lines: list[str], kind: str, opened: dict[int, tuple[str, str]]) -> list[int]:
    """Strength of the boundary before each line."""
    out = [0] * len(lines)
    comment = _COMMENT[kind]
    ends = {"cobol": re.compile(r"\.\s*$"), "vb": re.compile(r"(?i)^\s*(?:end|next|loop|wend)\b"), "sql": re.compile(r"(?i);\s*$|^\s*(?:go|end)\b")}[kind]
    for i in range(1, len(lines)):
        before = lines[i - 1].rstrip("\r")
        body = before[:72] if kind == "cobol" else before
        if i in opened:
            # comments and blanks straight above a header belong to it
            k = i
            while k > 1 and (not lines[k - 1].strip() or comment.match(lines[k - 1])) and k - 1 not in opened:
                k -= 1
            out[k] = max(out[k], _STRENGTH[opened[i][0]])
            if k != i:
                out[i] = max(out[i], 3)
        elif not before.strip() and lines[i].strip():
            out[i] = max(out[i], 3)
        elif comment.match(lines[i]) and not comment.match(lines[i - 1]):
            out[i] = max(out[i], 2)
        elif ends.search(body) and not comment.match(before):
            out[i] = max(out[i], 1)
    return out


def split(text: str, capacity: int, overlap: int, kind: str = "vb", first_line: int = 1, label: str | None = None) -> list[dict]:
    """Pieces of a text, each with piece_no, label, start_line, end_line, own headers and text of at most ``capacity`` characters.

    Each piece but the first begins with the ``overlap`` lines before it, with fewer if those do not fit beside a
    single line. A line longer than the capacity is cut at spaces, or anywhere if it has none; cuts within a line
    have no overlap. A text within the capacity is one piece, an empty one none. The pieces without their overlap
    are the text, in order.
    """
    if not text:
        return []
    lines = text.split("\n")
    opened = headers(lines, kind)
    strength = _strengths(lines, kind, opened)
    # atoms: (line, text, boundary strength before it)
    atoms: list[tuple[int, str, int]] = []
    for i, line in enumerate(lines):
        body = line + "\n" * (i < len(lines) - 1)
        force = strength[i]
        while len(body) > capacity:
            at = body.rfind(" ", capacity // 2, capacity) + 1 or capacity
            atoms.append((i, body[:at], force))
            body, force = body[at:], -1
        if body or i == 0:
            atoms.append((i, body, force))
    sizes = [0]
    for _, body, _ in atoms:
        sizes.append(sizes[-1] + len(body))
    # shared[k]: where the overlap of a piece that starts at atom k starts
    shared = [0] * len(atoms)
    for k in range(1, len(atoms)):
        s = k
        if atoms[k][2] >= 0:
            room = capacity - len(atoms[k][1])
            while s > 0 and k - s < overlap and atoms[s - 1][2] >= 0 and sizes[k] - sizes[s - 1] <= room:
                s -= 1
        shared[k] = s
    after = list(range(1, len(atoms) + 1))  # piece that starts at k ends before after[k]
    prior = list(range(-1, len(atoms) - 1))
    alive = [True] * len(atoms)
    heap = [(atoms[k][2], sizes[k + 1] - sizes[k - 1], k) for k in range(1, len(atoms))]
    heapq.heapify(heap)
    while heap:
        force, size, k = heapq.heappop(heap)
        if not alive[k]:
            continue
        left = prior[k]
        if sizes[after[k]] - sizes[left] != size:
            heapq.heappush(heap, (force, sizes[after[k]] - sizes[left], k))
            continue
        if sizes[after[k]] - sizes[shared[left]] > capacity:
            continue
        alive[k] = False
        after[left] = after[k]
        if after[k] < len(atoms):
            prior[after[k]] = left
    out = []
    heads = sorted(opened)
    for k in range(len(atoms)):
        if not alive[k]:
            continue
        start, last = atoms[k][0], atoms[after[k] - 1][0]
        # the first header within the piece if it opens with it, otherwise the one that is still open
        at = bisect.bisect_left(heads, start)
        opens = at < len(heads) and heads[at] <= last and all(not lines[n].strip() or n in opened or strength[n] >= 2 or _is_comment(lines[n], kind) for n in range(start, heads[at]))
        own = opened[heads[at]][1] if opens else opened[heads[at - 1]][1] if at else label
        body = "".join(a[1] for a in atoms[shared[k] : after[k]])
        # a line cut within itself belongs to the piece that it begins in
        begun = start if atoms[k][2] >= 0 else start + 1
        inside = [first_line + h for h in heads[bisect.bisect_left(heads, begun) : bisect.bisect_right(heads, last)]]
        out.append({"piece_no": len(out), "label": own, "start_line": first_line + atoms[shared[k]][0], "end_line": first_line + last, "own_line": first_line + start, "headers": inside, "text": body})
    return out


PIECES = "id long, piece_no int, label string, start_line int, end_line int, own_line int, headers array<int>, n_chars int, piece_text string"


def pieces(df: DataFrame, capacity: int, overlap: int) -> DataFrame:
    """Pieces of the rows of (id, name, label, start_line, text) that are longer than ``capacity`` characters.

    ``start_line`` null counts as 1; null texts have no pieces. ``own_line`` is where a piece starts without its
    overlap; ``headers`` are the lines of its own part that open a division, section, paragraph or routine, so that the
    pieces of a text have each of its headers once. Each row is split alone, whatever its length; repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, name, label, start, text in zip(batch["id"], batch["name"], batch["label"], batch["start_line"], batch["text"], strict=True):
                for p in split(text, capacity, overlap, family(name, text), 1 if start != start or start is None else int(start), label):
                    rows.append((i, p["piece_no"], p["label"], p["start_line"], p["end_line"], p["own_line"], p["headers"], len(p["text"]), p["text"]))
            yield pd.DataFrame(rows, columns=["id", "piece_no", "label", "start_line", "end_line", "own_line", "headers", "n_chars", "piece_text"])

    long = df.where(F.length("text") > capacity).select(F.col("id").cast("long").alias("id"), "name", "label", F.col("start_line").cast("int").alias("start_line"), "text")
    return long.mapInPandas(run, PIECES)
