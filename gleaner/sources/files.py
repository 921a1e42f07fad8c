"""File source: a recursive scan with predicates on path, size and content."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import any_of, glob_regex

MAX_BYTES = 10 << 20
#: Directories and names that a scan leaves out, and marks of generated files.
EXCLUDED_DIRS = ("node_modules", ".git", "vendor", "__pycache__", "dist", "build", ".venv", "target")
EXCLUDED_NAMES = ("*.min.js", "*.min.css", "package-lock.json", "yarn.lock", "go.sum", ".env", "*.pem", "*.key")
GENERATED = ("Code generated by", "DO NOT EDIT", "@generated", "AUTO-GENERATED", "auto-generated", "autogenerated", "This file was automatically generated")


class IgnoreRules:
    """Ordered ignore rules of one file: the last that matches decides, `!` takes back, `/` anchors, a final `/` means directories."""

    def __init__(self, lines: list[str], base: str = ""):
        self.rules: list[tuple[str, bool]] = []
        for line in lines:
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            drop = not line.startswith("!")
            pattern = line.removeprefix("!")
            only_dir, pattern = pattern.endswith("/"), pattern.rstrip("/")
            anchored = "/" in pattern
            body = glob_regex(pattern.lstrip("/"))[1:-1]
            head = re.escape(base.strip("/") + "/") if base.strip("/") else ""
            self.rules.append((f"^{head}{'' if anchored else '(?:.*/)?'}{body}{'/.*' if only_dir else '(?:/.*)?'}$", drop))

    def ignored(self, path: Column) -> Column:
        """One expression for all rules, the last rule outermost."""
        out = F.lit(False)
        for pattern, drop in self.rules:
            out = F.when(path.rlike(pattern), F.lit(drop)).otherwise(out)
        return out


def excluded(path: Column) -> Column:
    dirs = path.rlike("(^|/)(" + "|".join(map(re.escape, EXCLUDED_DIRS)) + ")/")
    return any_of(dirs, *[path.rlike(glob_regex("**/" + n)) for n in EXCLUDED_NAMES])


def is_binary(content: Column) -> Column:
    """A NUL byte among the first 512."""
    return F.hex(F.substring(content, 1, 512)).rlike("^(..)*00")


def is_generated(content: Column) -> Column:
    return F.decode(F.substring(content, 1, 1024), "UTF-8").rlike("|".join(map(re.escape, GENERATED)))


def scan(spark: SparkSession, root: str, rules: IgnoreRules | None = None, subtree: str = "", max_bytes: int = MAX_BYTES, include: list[str] | None = None) -> DataFrame:
    """path (under the root), size, modified, content, generated for each text file. Size and name predicates come before content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/{subtree}".rstrip("/")).filter(F.col("length") <= max_bytes)
    prefix = F.length(F.lit(root.rstrip("/"))) + 2
    rel = F.expr(f"substring(regexp_replace(path, '^[a-z]+:/*', '/'), {len(root.rstrip('/').split(':', 1)[-1]) + 2})") if prefix is not None else None
    files = files.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    files = files.filter(~excluded(F.col("path")))
    if rules is not None:
        files = files.filter(~rules.ignored(F.col("path")))
    if include:
        files = files.filter(any_of(*[F.col("path").rlike(glob_regex(g)) for g in include]))
    return files.filter(~is_binary(F.col("content"))).withColumn("generated", is_generated(F.col("content")))
