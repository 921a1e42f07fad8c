"""Synthetic code corpus from word pools: files that import, define, test and mention one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = ("index", "store", "cache", "router", "parser", "worker", "token", "graph", "signal", "buffer", "ledger", "planner")


def generate(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n rows (path, content): Go sources and tests, Python modules, Markdown notes and YAML settings, the same for a seed."""
    pick = lambda salt: F.element_at(F.array(*map(F.lit, WORDS)), F.pmod(F.xxhash64("id", F.lit(seed + salt)), F.lit(len(WORDS))).cast("int") + 1)
    a, b = F.initcap(pick(1)), F.initcap(pick(2))
    i = F.col("id").cast("string")
    other = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, n // 5))).cast("string")
    go = F.concat(F.lit("package "), pick(1), F.lit('\n\nimport (\n\t"fmt"\n\t"example.com/app/internal/m'), other, F.lit('"\n)\n\n// '), a, i, F.lit(" does work.\nfunc "), a, i, F.lit("() {\n\tfmt.Println("), b, F.lit(")\n}\n\ntype "), b, i, F.lit(" struct{}\n"))
    test = F.concat(F.lit("package x\n\nimport \"testing\"\n\nfunc Test"), a, i, F.lit("(t *testing.T) {}\n"))
    py = F.concat(F.lit("import os\nfrom app.m"), other, F.lit(" import thing\n\n\ndef run_"), i, F.lit("():\n    return os.name\n\n\nclass "), a, i, F.lit(":\n    pass\n"))
    md = F.concat(F.lit("# Notes "), i, F.lit("\n\nSee `internal/m"), other, F.lit(".go` and [settings](configs/c"), other, F.lit(".yaml).\n\n## More\n\nUses `"), a, other, F.lit("`.\n"))
    yaml = F.concat(F.lit("server:\n  port: 80\n  name: "), pick(3), F.lit("\nlimit: "), i, F.lit("\n"))
    kind, k = F.pmod("id", F.lit(5)), F.floor(F.col("id") / 5).cast("string")
    path = F.when(kind == 0, F.concat(F.lit("internal/m"), k, F.lit(".go"))).when(kind == 1, F.concat(F.lit("internal/m"), k, F.lit("_test.go"))).when(kind == 2, F.concat(F.lit("app/m"), k, F.lit(".py")))
    path = path.when(kind == 3, F.concat(F.lit("docs/n"), k, F.lit(".md"))).otherwise(F.concat(F.lit("configs/c"), k, F.lit(".yaml")))
    text = F.when(kind == 0, go).when(kind == 1, test).when(kind == 2, py).when(kind == 3, md).otherwise(yaml)
    return spark.range(n).select(path.alias("path"), text.alias("content"))
