"""python -m gleaner index FILES INDEX | search INDEX TEXT... | status INDEX | graph INDEX NAME..."""

from __future__ import annotations

import argparse

from gleaner import engine
from gleaner.session import build_session
from gleaner.sources import files


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gleaner", description=__doc__)
    parser.add_argument("verb", choices=["index", "search", "status", "graph"])
    parser.add_argument("place")
    parser.add_argument("rest", nargs="*")
    parser.add_argument("--limit", type=int, default=10)
    a = parser.parse_args(args)
    spark = build_session()
    if a.verb == "index":
        found = files.scan(spark, a.place)
        text = found.selectExpr("path", "decode(content, 'UTF-8') AS content")
        engine.index_status(engine.build_index(text, a.rest[0])).show(truncate=False)
        return
    corpus = engine.Corpus.read(spark, a.place)
    if a.verb == "status":
        engine.index_status(corpus).show(truncate=False)
    elif a.verb == "search":
        q = spark.createDataFrame([(i, t) for i, t in enumerate(a.rest)], "query int, q string")
        engine.search(corpus, q, engine.Options(limit=a.limit)).orderBy("query", "rank").show(a.limit * len(a.rest), truncate=False)
    else:
        engine.graph_query(corpus, spark.createDataFrame([(t,) for t in a.rest], "subject string"), per_kind=a.limit).show(1000, truncate=False)


if __name__ == "__main__":
    main()
