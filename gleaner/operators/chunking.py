"""Row generators: one file to many chunks. Sequential packing, so they run as Arrow batches over whole files."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A chunk holds so many tokens of BYTES bytes at most; consecutive ones share so many.
MAX_TOKENS, OVERLAP_TOKENS, BYTES, LINE_BYTES = 512, 64, 4, 2048
SCHEMA = "path string, chunk_id string, kind string, title string, start_line int, end_line int, content string"


def chunk_key(path: str, content: str, part: str = "") -> str:
    inner = hashlib.sha256(content.encode()).hexdigest()[:16]
    return hashlib.sha256(":".join([path, inner, *([part] if part else [])]).encode()).hexdigest()[:16]


def cut_bytes(line: str, most: int = LINE_BYTES) -> list[str]:
    """Pieces of a line of so many bytes at most, cut between code points: together they are the line."""
    raw, at, out = line.encode("utf-8", "surrogatepass"), 0, []
    while len(raw) - at > most:
        end = at + most
        while raw[end] & 0xC0 == 0x80:  # within a code point
            end -= 1
        out.append(raw[at:end].decode("utf-8", "surrogatepass"))
        at = end
    return [*out, raw[at:].decode("utf-8", "surrogatepass")]


def _bytes(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def by_lines(text: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> Iterator[tuple[str, int, int, str]]:
    """(title, first line, last line, content): lines packed up to the budget, stepping back a few lines each time."""
    lines = [(n, c) for n, line in enumerate(text.split("\n"), 1) for c in cut_bytes(line)]
    back, at, budget = max(2, overlap * BYTES // 80), 0, max_tokens * BYTES
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + _bytes(lines[end][1]) + 1 <= budget):
            size += _bytes(lines[end][1]) + 1
            end += 1
        body = "\n".join(c for _, c in lines[at:end])
        if body.strip():
            yield "", lines[at][0], lines[end - 1][0], body
        if end >= len(lines):
            break
        at = max(at + 1, end - back)


#: Blocks of Markdown that stay whole: fences, tables, elements of components.
_ATOMIC = re.compile(r"\A\s*(?:```|~~~|\||<[A-Z])")
_BLOCK = re.compile(r"(?:```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|(?:(?!```|~~~).)+?(?:\n\s*\n|(?=```|~~~)|\Z))", re.S)
_SENTENCE = re.compile(r".+?(?:[.!?]+(?=\s)\s*|\Z)", re.S)


def _pieces(block: str, most: int) -> list[str]:
    """A block that is too large as sentences, those as words, those as pieces of so many bytes; fences and tables stay whole."""
    if _bytes(block) <= most or _ATOMIC.match(block):
        return [block]
    sentences = _SENTENCE.findall(block)
    if len(sentences) > 1:
        return [p for s in sentences for p in _pieces(s, most)]
    words = re.findall(r"\S+\s*|\s+", block)
    return [p for w in words for p in cut_bytes(w, most)] if len(words) > 1 else cut_bytes(block, most)


def packed(text: str, most: int) -> Iterator[tuple[str, int, int]]:
    """(part, lines before it, lines within) of a text in parts of `most` bytes, cut at blocks, then sentences, then words."""
    part, before, seen = "", 0, 0
    for piece in (p for b in _BLOCK.findall(text) for p in _pieces(b, most)):
        if part and _bytes(part + piece) > most:
            if part.strip():
                yield part, before, part.rstrip().count("\n")
            part, before = "", seen
        part += piece
        seen += piece.count("\n")
    if part.strip():
        yield part, before, part.rstrip().count("\n")


_HEADER = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")


def by_sections(text: str, max_tokens: int = MAX_TOKENS) -> Iterator[tuple[str, int, int, str]]:
    """Markdown sections titled by their path of headers; front matter is a chunk; fences aren't cut; long ones are packed by paragraph."""
    lines, at = text.split("\n"), 0
    if lines and lines[0].strip() == "---" and "---" in (x.strip() for x in lines[1:]):
        at = next(i for i, x in enumerate(lines[1:], 1) if x.strip() == "---") + 1
        yield "frontmatter", 1, at, "\n".join(lines[:at])
    stack: list[str] = []
    start, body, fence = at, [], False

    def done(end: int) -> Iterator[tuple[str, int, int, str]]:
        said = "\n".join(body)
        if not re.sub(r"^#{1,6}\s.*$", "", said, flags=re.M).strip():
            return
        title = " > ".join(x for x in stack if x)
        if len(said.encode()) <= max_tokens * BYTES:
            yield title, start + 1, end, said
            return
        for part, before, within in packed(said, max_tokens * BYTES):
            lead = len(part) - len(part.lstrip("\n"))
            yield title, start + 1 + before + lead, start + 1 + before + within, part.strip()

    for n in range(at, len(lines)):
        fence ^= lines[n].lstrip().startswith("```")
        head = None if fence else _HEADER.match(lines[n])
        if head:
            if stack or not re.sub(r"\s", "", "".join(body)) == "":
                if stack:
                    yield from done(n)
                    start, body = n, []
            depth = len(head[1])
            stack = [*stack[: depth - 1], *[""] * (depth - 1 - len(stack)), head[2]]
        body.append(lines[n])
    if not stack and not any(_HEADER.match(x) for x in body):  # no header at all: paragraphs
        for part, before, within in packed("\n".join(body), max_tokens * BYTES):
            lead = len(part) - len(part.lstrip("\n"))
            yield "", start + 1 + before + lead, start + 1 + before + within, part.strip()
        return
    yield from done(len(lines))


_PYTHON = re.compile(r"^(?:def|class|async def) \w+.*:", re.M)
_DECLARED = re.compile(r"^([ \t]*)(?:export\s+)?(?:default\s+)?(?:public\s+|private\s+|static\s+)*(?:async\s+)?(?:func(?:\s*\([^)]*\))?|function|class|interface|type|def|struct)\s+(\w+)|^([ \t]*)(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)\n]*\)|\w+)\s*=>", re.M)
_IMPORTS = re.compile(r"^(?:package\s+\w+|import\s+\((?:.|\n)*?\)|import\s.*|from\s+[\w.]+\s+import\s.*|(?:const|var|let)\s.*=\s*require\(.*)$", re.M)
#: Nested declarations are split to so many levels; file context holds so many bytes.
LEVELS, CONTEXT_BYTES = 8, 1024

Span = tuple[str, int, int]


def _python_spans(body: list[ast.stmt]) -> list[tuple[Span, list[ast.stmt]]]:
    kinds = ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef
    return [((n.name, min([n.lineno, *(d.lineno for d in n.decorator_list)]), n.end_lineno or n.lineno), n.body) for n in body if isinstance(n, kinds)]


def _declared_spans(lines: list[str], first: int, last: int, deeper_than: int) -> list[Span]:
    """Declarations of the least indentation beyond `deeper_than` among lines first..last; each ends before the next one."""
    marks = []
    for m in _DECLARED.finditer("\n".join(lines[first - 1 : last])):
        indent = m[1] if m[2] else m[3]
        marks.append((len(indent.expandtabs(4)), m[2] or m[4], first + m.string.count("\n", 0, m.start(2) if m[2] else m.start(4))))
    marks = [x for x in marks if x[0] > deeper_than]
    least = min((x[0] for x in marks), default=0)
    top = [(name, line) for indent, name, line in marks if indent == least]
    return [(name, a, top[i + 1][1] - 1 if i + 1 < len(top) else last) for i, (name, a) in enumerate(top)]


def file_context(text: str) -> str:
    """Package and imports of a file, as said before its chunks."""
    return "\n".join(m[0] for m in _IMPORTS.finditer(text[: 16 * CONTEXT_BYTES]))[:CONTEXT_BYTES].strip()


def by_symbols(text: str, context: bool = False) -> Iterator[tuple[str, int, int, str]]:
    """A chunk for each top-level function or class: by syntax tree for Python, by declarations for other languages, else by lines.

    A symbol that is too large is split at the declarations within it: its own lines before the first of them come first,
    once, then each of them, named after it, to LEVELS levels; what has none is split by lines. context: each chunk
    begins with the file's package and imports.
    """
    lines, most = text.split("\n"), MAX_TOKENS * BYTES
    tree: list[tuple[Span, list[ast.stmt]]] = []
    try:
        tree = _python_spans(ast.parse(text if _PYTHON.search(text) else "").body)
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # the parser reports nesting that is too deep as MemoryError
        pass

    def inner(span: Span, body: list[ast.stmt] | None) -> list[tuple[Span, list[ast.stmt] | None]]:
        if body is not None:
            return _python_spans(body)
        own = len(lines[span[1] - 1].expandtabs(4)) - len(lines[span[1] - 1].expandtabs(4).lstrip())
        return [(s, None) for s in _declared_spans(lines, span[1] + 1, span[2], own)]

    def split(span: Span, body: list[ast.stmt] | None, level: int) -> Iterator[tuple[str, int, int, str]]:
        name, a, b = span
        said = "\n".join(lines[a - 1 : b])
        if _bytes(said) <= most:
            yield name, a, b, said
            return
        parts = inner(span, body) if level < LEVELS else []
        if not parts:
            for i, (_, s, e, part) in enumerate(by_lines(said), 1):
                yield f"{name}_part{i}", a + s - 1, a + e - 1, part
            return
        at = a
        for child, below in parts:
            if child[1] > at and "".join(lines[at - 1 : child[1] - 1]).strip():
                yield from split((name if at == a else f"{name}_rest", at, child[1] - 1), [] if body is not None else None, LEVELS)
            yield from split((f"{name}.{child[0]}", child[1], child[2]), below, level + 1)
            at = child[2] + 1
        if at <= b and "".join(lines[at - 1 : b]).strip():
            yield from split((f"{name}_rest", at, b), [] if body is not None else None, LEVELS)

    spans: list[tuple[Span, list[ast.stmt] | None]] = list(tree) or [(s, None) for s in _declared_spans(lines, 1, len(lines), -1)]
    head = file_context(text) if context else ""
    if not spans:
        yield from by_lines(text)
        return
    for span, body in spans:
        for title, a, b, said in split(span, body, 0):
            yield title, a, b, f"{head}\n\n{said}" if head else said


def chunks(files: DataFrame, how: Callable, kind: str, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """The chunks of every file (SCHEMA)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, chunk_key(p, c, f"{s}-{e}"), kind, t, s, e, c) for p, text in zip(b["path"], b["content"], strict=True) if text for t, s, e, c in how(text)]
            yield pd.DataFrame(rows, columns=["path", "chunk_id", "kind", "title", "start_line", "end_line", "content"])

    return files.select(F.col(path_col).alias("path"), F.col(text_col).alias("content")).mapInPandas(work, SCHEMA)
