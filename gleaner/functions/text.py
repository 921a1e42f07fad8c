"""Text functions as native columns: tokens, identifiers, paths, query classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in program text.
STOP_WORDS = ("var", "let", "const", "func", "function", "def", "class", "return", "if", "else", "for", "while", "data", "result", "value", "item", "key", "err", "ctx", "tmp")
#: Patterns of query classes.
ERROR_CODE = r"(?i)^(ERR_\w+|E\d{4,5}|[A-Z]{2,}\d{3,}|\w+Exception)$"
QUOTED = r"""^["'].*["']$"""
FILE_PATH = r"(?i)^[\w\-\./\\]+\.(go|ts|tsx|js|jsx|py|md|pdf|json|yaml|yml|toml|css|scss|html|rs|java|kt|c|cpp|h|hpp|rb|php|swift|sh|bash|zsh)$"
IDENTIFIERS = (r"^[a-z]+([A-Z][a-z0-9]*)+$", r"^([A-Z][a-z0-9]*){2,}$", r"^[A-Z][A-Za-z0-9]{2,}$", r"^[a-z]+(_[a-z0-9]+)+$", r"^[A-Z]+(_[A-Z0-9]+)+$")
NATURAL = r"(?i)^(how|what|where|why|when|which|can|does|is|are|should|explain|describe|show|find|list)\s"
DECISION_REF = r"(?i)\bADR-\d+\b"


def tokens(text: Column) -> Column:
    """Code-aware tokens: runs of ASCII letters and digits, cut at case borders, lower case, two characters at least."""
    cut = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z0-9])([A-Z][a-z])", "$1 $2")
    return F.transform(F.filter(F.split(cut, "[^A-Za-z0-9]+"), lambda t: F.length(t) >= 2), F.lower)


def without_stop_words(words: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Tokens that aren't stop words, duplicates kept."""
    return F.filter(words, lambda t: ~t.isin(*stop))


def index_text(path: Column, content: Column) -> Column:
    """Content with a line naming its path, unless it names it already."""
    return F.when(F.contains(content, path), content).otherwise(F.concat(F.lit("File path: "), path, F.lit("\n"), content))


def chunk_id(path: Column, content: Column, part: Column | None = None) -> Column:
    """Content-addressed identifier: 16 hex digits of sha256 over path, content digest and an optional part."""
    inner = F.substring(F.sha2(content, 256), 1, 16)
    return F.substring(F.sha2(F.concat_ws(":", path, inner, *([part] if part is not None else [])), 256), 1, 16)


def estimated_tokens(text: Column) -> Column:
    """Four bytes a token, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def matched_terms(query_terms: Column, doc_terms: Column) -> Column:
    """Distinct query terms that the document has, in query order."""
    return F.filter(F.array_distinct(query_terms), lambda t: F.array_contains(doc_terms, t))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_lexical(q: Column) -> Column:
    q = F.trim(q)
    one_word = ~F.contains(q, F.lit(" ")) & any_of(*[q.rlike(p) for p in IDENTIFIERS])
    return q.rlike(DECISION_REF) | q.rlike(ERROR_CODE) | q.rlike(QUOTED) | q.rlike(FILE_PATH) | one_word


def query_class(q: Column) -> Column:
    """struct(kind, confidence, keyword weight, semantic weight) by the first pattern that fits."""
    words = F.size(F.filter(F.split(F.trim(q), r"\s+"), lambda w: w != ""))
    made = lambda kind, c, a, b: F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("confidence"), F.lit(a).alias("keyword_weight"), F.lit(b).alias("semantic_weight"))
    return (
        F.when(F.trim(q) == "", made("MIXED", 0.6, 0.35, 0.65)).when(is_lexical(q), made("LEXICAL", 0.9, 0.85, 0.15))
        .when(F.trim(q).rlike(NATURAL), made("SEMANTIC", 0.85, 0.2, 0.8)).when(words >= 3, made("SEMANTIC", 0.75, 0.2, 0.8)).otherwise(made("MIXED", 0.6, 0.35, 0.65))
    )


def is_test_path(path: Column) -> Column:
    name = F.regexp_extract(path, "([^/]*)$", 1)
    parts = [F.contains(path, F.lit(x)) for x in (".test.", ".spec.", "/test/", "/tests/", "/__tests__/")]
    starts = [path.startswith(x) for x in ("test/", "tests/", "__tests__/")]
    return any_of(path.endswith("_test.go"), *parts, *starts, name.startswith("test_") & name.endswith(".py"), name.endswith("_test.py"))


def in_scope(path: Column, scopes: list[str]) -> Column:
    """Whether a path lies under one of the prefixes; a prefix ends at a separator."""
    own = F.concat(F.trim(path, F.lit("/")), F.lit("/"))
    return any_of(*[own.startswith(s.strip("/") + "/") for s in scopes]) if scopes else F.lit(True)


def glob_regex(pattern: str) -> str:
    """Regular expression of a path pattern: `dir/**`, `**/*suffix`, `*` within a name, `?`."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "/_" else "\\" + c), i + 1
    return f"^{out}$"


def confidence_label(c: Column) -> Column:
    return F.when(c >= 1.0, "exact").when(c >= 0.9, "high").when(c >= 0.7, "medium").otherwise("low")


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's code points in bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
