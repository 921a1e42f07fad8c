"""Secrets in texts: ordered detectors, an entropy test, redaction or refusal."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH, LEAST_ENTROPY = 20, 3.5
#: Fixed values: (detector, pattern, group of the value, whether the value must look random).
DETECTORS = (
    ("private-key-block", r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", 0, False),
    ("github-token", r"\bgh[pousr]_[A-Za-z0-9_]{36,255}\b", 0, True),
    ("slack-token", r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b", 0, True),
    ("openai-api-key", r"\bsk-[A-Za-z0-9]{20,}\b", 0, True),
    ("aws-access-key-id", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", 0, False),
    ("bearer-token", r"(?i)\bbearer\s+([A-Za-z0-9][A-Za-z0-9._~+/=-]{19,})", 1, True),
    (
        "generic-secret-assignment",
        r"(?i)\b(?:api[_-]?key|apikey|access[_-]?token|accesstoken|auth[_-]?token|authtoken|secret[_-]?key|secretkey|client[_-]?secret|clientsecret|private[_-]?key|privatekey|token)\b\s*[:=]\s*[\"'`]?([A-Za-z0-9][A-Za-z0-9._~+/=-]{19,})[\"'`]?",
        1, True,
    ),
)
#: Any detector needs one of these; texts without are passed over by a native predicate.
CUES = r"(?i)PRIVATE KEY|gh[pousr]_|xox[baprs]-|sk-|AKIA|ASIA|bearer|key|token|secret"


def shannon(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def find(text: str, allowed: frozenset[str] = frozenset()) -> list[tuple[str, int, int]]:
    """(detector, start, end) in order; of overlapping findings the earlier detector's stays."""
    out: list[tuple[str, int, int]] = []
    for name, pattern, group, random in DETECTORS:
        for m in re.finditer(pattern, text):
            value, (a, b) = m[group], m.span(group)
            if value in allowed or (random and (len(value) < LEAST_LENGTH or shannon(value) < LEAST_ENTROPY)):
                continue
            if not any(a < e and s < b for _, s, e in out):
                out.append((name, a, b))
    return sorted(out, key=lambda x: (x[1], x[2]))


def may_have(text: Column) -> Column:
    return text.rlike(CUES)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, detector, start, end): a row for each finding; only texts with a cue leave the JVM."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *f) for i, t in zip(b["id"], b["text"], strict=True) for f in find(t)]
            yield pd.DataFrame(rows, columns=["id", "detector", "start", "end"])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(may_have(F.col("text")))
    return d.mapInPandas(work, f"id {d.schema['id'].dataType.simpleString()}, detector string, start int, end int")


def redact(text: str) -> str | None:
    """The text with values replaced by [REDACTED:detector]; None for a text with a private key, which is refused."""
    found = find(text)
    if any(f[0] == "private-key-block" for f in found):
        return None
    for name, a, b in reversed(found):
        text = f"{text[:a]}[REDACTED:{name}]{text[b:]}"
    return text


def guarded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): redacted texts, without those that are refused."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore")

    text = F.col(text_col)
    d = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    risky, plain = d.filter(may_have(F.col("text"))), d.filter(~F.coalesce(may_have(F.col("text")), F.lit(False)))
    return plain.unionByName(risky.withColumn("text", clean("text")).filter("text is not null"))
