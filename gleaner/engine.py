"""The engine as an API: build an index of files, change it, search it, walk its graph. Queries come as tables, answers are tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner import build_log, graph_index
from gleaner.functions.joins import bounded, top
from gleaner.functions.text import any_of, in_scope, query_class
from gleaner.operators import bm25, candidates, chunking, code, decompose, embedding_cache, expansion, graph, metadata, ranking, records, vectors
from gleaner.sources import segments

#: Results of a search at most, and by default; related nodes and bytes of an answer about the graph.
MOST, DEFAULT, RELATED_BYTES = 100, 10, 16_384
#: Tables of an index and the key by which a change removes rows.
KEYS = {"files": "path", "chunks": "path", "vectors": "chunk_id", "lists": "id"} | graph_index.KEYS
#: When a compaction is due: orphans, their share, seconds without work, seconds since the last one.
COMPACT_ORPHANS, COMPACT_SHARE, COMPACT_IDLE, COMPACT_PAUSE = 100, 0.2, 30, 3600


@dataclass(frozen=True)
class Corpus:
    """An index in one folder, as of a segment."""

    spark: SparkSession
    path: str
    segment: int

    def table(self, name: str) -> DataFrame:
        """files (path, content), chunks, vectors, nodes, edges or lists, without what later changes removed."""
        return segments.live(self.spark, f"{self.path}/{name}", KEYS[name], self.segment).drop("segment")

    files = property(lambda self: self.table("files"))
    chunks = property(lambda self: self.table("chunks"))
    vectors = property(lambda self: self.table("vectors"))
    nodes = property(lambda self: self.table("nodes"))
    edges = property(lambda self: self.table("edges"))

    @property
    def terms(self) -> str:
        return f"{self.path}/terms"

    @property
    def state(self) -> dict[str, str]:
        """Keys and values noted with the changes, the latest of each."""
        rows = self.spark.read.parquet(f"{self.path}/state/rows").filter(F.col("segment") <= self.segment)
        return {r.key: r.value for r in rows.groupBy("key").agg(F.max_by("value", "segment").alias("value")).collect()}  # a few keys

    @staticmethod
    def read(spark: SparkSession, path: str) -> Corpus:
        """The index as of the last change that was finished: its state is written last."""
        last = spark.read.parquet(f"{path}/state/rows").agg(F.max("segment")).first()[0]
        return Corpus(spark, path, last)


@dataclass(frozen=True)
class Options:
    """How to search; each filter is a predicate that Catalyst may push down."""

    limit: int = DEFAULT
    weights: tuple[float, float] = ranking.WEIGHTS["engine"]
    classify: bool = False  # weights by the kind of each query
    mode: str = "and_then_or"
    scopes: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    symbol_type: str | None = None  # chunks that define a symbol of this kind
    profile: str | None = None
    decisions: str | None = None  # current: decision records in force; history: all of them
    keyword_only: bool = False
    approximate: bool = False  # vector search reads the nearest lists only (without filters)
    add_candidates: bool = False  # exact symbols, files named by decisions, PDF passages
    provider: embedding_cache.Provider | None = None  # of the queries' vectors; if it isn't the index's model, keywords alone decide
    expand: bool = True  # further words for the keyword side; never for exact queries, nor without a vector side
    synonyms: dict[str, tuple[str, ...]] | None = None
    reranker: Callable[[Column, Column], Column] | None = None
    rerank: str = "always"  # always, never, or auto: by the kind of each query
    extra: dict = field(default_factory=dict)

    def checked(self) -> Options:
        if self.profile is not None and self.profile not in metadata.PROFILES:
            raise ValueError(f"unknown profile {self.profile!r}")
        if self.mode not in ("and_then_or", "or"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.decisions not in (None, "current", "history"):
            raise ValueError(f"unknown mode of decisions {self.decisions!r}")
        if self.rerank not in ("always", "never", "auto"):
            raise ValueError(f"unknown policy of the reranker {self.rerank!r}")
        if any(w < 0 for w in self.weights):
            raise ValueError("weights can't be negative")
        return replace(self, limit=clamp(self.limit, DEFAULT, 1, MOST))


def clamp(value: int | None, default: int, least: int, most: int) -> int:
    """A limit within its bounds; the default for none or nothing."""
    return max(least, min(most, value)) if value else default


def chunked(files: DataFrame) -> DataFrame:
    """Chunks of files by their kind: symbols of code, sections of Markdown, lines of the rest."""
    kind = code.content_type(code.language(F.col("path")))
    f = files.select("path", "content", kind.alias("k"))
    parts = [chunking.chunks(f.filter("k = 'code'"), partial(chunking.by_symbols, context=True), "code"), chunking.chunks(f.filter("k = 'markdown'"), chunking.by_sections, "markdown")]
    rest = chunking.chunks(f.filter("k NOT IN ('code', 'markdown')"), chunking.by_lines, "text")
    out = parts[0].unionByName(parts[1]).unionByName(rest)
    return out.withColumn("context", context_of(F.col("path"), F.col("title"), F.col("content")))


def context_of(path: Column, title: Column, content: Column) -> Column:
    """Sentences of context for a chunk: where it is from, what it defines, what for by its first comment, and its language."""
    said = F.regexp_extract(content, r"""(?s)(?:^|\n)\s*(?://+|#+|\"{3}|'{3}|/\*+)\s*([A-Z][^\n]*?[.!?])(?:\s|$)""", 1)
    parts = (F.concat(F.lit("From file: "), path), F.when(title != "", F.concat(F.lit("Defines: "), title)), F.when(said != "", F.concat(F.lit("Purpose: "), F.regexp_replace(said, r"[.!?]$", ""))), F.concat(F.lit("Language: "), code.language(path)))
    return F.concat(F.concat_ws(". ", *parts), F.lit("."))


def by_file(chunks: DataFrame, each: int) -> DataFrame:
    """(path, chunks): the first `each` chunks of a file as an array, in order."""
    kept = top(chunks, each, ["path"], F.col("start_line"), F.col("chunk_id"), rank="n")
    return kept.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "chunk_id", "title"))).alias("chunks"))


def static_provider(dims: int = 256) -> embedding_cache.Provider:
    """Vectors of hashed words and letters: no model to load, the last resort of a list of providers."""
    return embedding_cache.Provider("static" if dims == 256 else f"static-{dims}", lambda c: vectors.static_embedding(c, "id", "content", dims))


def _embedded(spark: SparkSession, chunks: DataFrame, place: str, providers: list[embedding_cache.Provider]) -> tuple[DataFrame, str]:
    """((chunk_id, embedding), model) of chunks: contents that an earlier run embedded are looked up, the others are embedded."""
    c = chunks.groupBy("chunk_id").agg(F.min("content").alias("content")).withColumn("key", F.sha2("content", 256))
    found, model = embedding_cache.Cache(spark, place).embedded(c.select("content"), providers)
    return c.select("chunk_id", "key").join(found, "key").select("chunk_id", "embedding"), model


def _providers_of(corpus: Corpus, providers: tuple[embedding_cache.Provider, ...]) -> list[embedding_cache.Provider]:
    """Those whose vectors may join the ones that an index has."""
    fitting = [p for p in [*providers, static_provider()] if p.model == corpus.state["model"]]
    if not fitting:
        raise ValueError(f"the index holds vectors of {corpus.state['model']!r}: its provider is needed")
    return fitting


def _buckets(chunks: int) -> int:
    """Buckets of terms for so many chunks: a query reads one for each term, so they grow with the index, to a bound of folders."""
    return max(2, min(1024, chunks // 2000))


def _note(spark: SparkSession, path: str, segment: int, values: dict[str, str], name: str = "state") -> None:
    segments.put(f"{path}/{name}", segment, spark.createDataFrame(sorted(values.items()), "key string, value string"))


def build_index(files: DataFrame, path: str, project: str = "project", cache: str | None = None, providers: tuple[embedding_cache.Provider, ...] = ()) -> Corpus:
    """Write files, chunks, inverted index, vectors, nodes and edges under `path` as segment 0; what was there is replaced.

    A build of the same files that stopped goes on with the stage that it stopped in. cache: a folder of vectors that outlives
    the index, by default one within it; providers: models to try in order, before the static one.
    """
    spark, now = files.sparkSession, Corpus(files.sparkSession, path, 0)
    files = files.select("path", "content")
    stages = build_log.Stages(spark, path, 0, build_log.digest_of(files))
    put = lambda name, rows: build_log.counted(rows, lambda df: segments.put(f"{path}/{name}", 0, df, rows.select(KEYS[name]).limit(0)))

    def embed() -> str:
        rows, model = _embedded(spark, now.chunks, cache or f"{path}/cache", [*providers, static_provider()])
        put("vectors", rows)
        dimensions = now.vectors.select(F.size("embedding")).first()
        _note(spark, path, 0, {"model": model, "cache": cache or f"{path}/cache", "dimensions": str(dimensions[0] if dimensions else 0)}, "vectors/state")
        return model

    stages.run("files", lambda: put("files", files))
    stages.run("chunks", lambda: put("chunks", chunked(now.files)))
    stages.run("vectors", embed)
    stages.run("terms", lambda: bm25.build(now.chunks.dropDuplicates(["chunk_id"]), "chunk_id", "content", now.terms, _buckets(now.chunks.count())))
    stages.run("lists", lambda: vectors.build_lists(now.vectors, f"{path}/lists", id_col="chunk_id"))
    stages.run("graph", lambda: graph_index.build(path, now.files, project, code.chunk_graph(now.chunks, project)) and None)
    _log_edges(stages, now)
    told = {r.key: r.value for r in spark.read.parquet(f"{path}/vectors/state/rows").collect()}  # three rows
    _note(spark, path, 0, {"project": project, "chunk_tokens": str(chunking.MAX_TOKENS)} | told)
    stages.finish()
    return now


def _log_edges(stages: build_log.Stages, corpus: Corpus) -> None:
    """Note the edges that each extractor gave in this segment."""
    rows = corpus.spark.read.parquet(f"{corpus.path}/edges/rows/segment={corpus.segment}").groupBy("kind").agg(F.count("*").alias("n"))
    for r in rows.collect():  # a few kinds
        stages.run(f"edges of {r.kind}", lambda n=r.n: n)


def update_index(corpus: Corpus, changed: DataFrame, removed: DataFrame, providers: tuple[embedding_cache.Provider, ...] = ()) -> Corpus:
    """The index after a change of files (path, content) and removed paths (path), as a further segment.

    Chunks, postings, vectors, nodes and edges of changed and removed files go, those of changed files come; edges of other
    files into what is no longer there go stale, and stale ones into what is there again do not stay so. Only changed files
    are chunked, tokenised, embedded and searched for edges; references of other files are resolved again where a file
    that they could mean came or went, so that live edges are those of a build. What a change writes counts when its state
    is written, last; a change that stopped before is made anew and replaces its tables.
    """
    spark, path, n = corpus.spark, corpus.path, corpus.segment + 1
    now, project = Corpus(spark, path, n), corpus.state["project"]
    gone = changed.select("path").union(removed.select("path")).distinct()
    stages = build_log.Stages(spark, path, n)
    began = build_log.counted(changed.select("path", "content"), lambda df: segments.put(f"{path}/files", n, df, gone))
    stages.run("files", lambda: began)
    new = spark.read.parquet(f"{path}/files/rows/segment={n}")
    lost = corpus.chunks.join(bounded(gone), "path", "left_semi").select("chunk_id").distinct()
    segments.put(f"{path}/chunks", n, chunked(new), gone)
    added = spark.read.parquet(f"{path}/chunks/rows/segment={n}")
    bm25.change(spark, now.terms, n, lost.select(F.col("chunk_id").alias("id")), added.dropDuplicates(["chunk_id"]), "chunk_id", "content")
    segments.put(f"{path}/vectors", n, _embedded(spark, added, corpus.state["cache"], _providers_of(corpus, providers))[0], lost)
    vectors.add_to_lists(spark, f"{path}/lists", n, spark.read.parquet(f"{path}/vectors/rows/segment={n}"), lost.select(F.col("chunk_id").alias("id")), id_col="chunk_id")
    graph_index.change(graph_index.GraphIndex(spark, path, corpus.segment, project), new, removed, code.chunk_graph(added, project))
    _log_edges(stages, now)
    _note(spark, path, n, {"project": project, "changed_in": str(n)})
    stages.finish()
    return now


def reconcile(corpus: Corpus, files: DataFrame) -> tuple[Corpus, DataFrame]:
    """The index brought up to what the files (path, content) are now, and what was found: (change, n) for added, modified, removed."""
    old = corpus.files.select("path", F.sha2("content", 256).alias("was"))
    both = files.select("path", F.sha2("content", 256).alias("is")).join(old, "path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "modified")
    found = both.select("path", change.alias("change")).filter("change IS NOT NULL")
    if not found.limit(1).count():
        return corpus, found.groupBy("change").agg(F.count("*").alias("n"))
    changed = files.join(found.filter("change <> 'removed'").select("path"), "path", "left_semi")
    return update_index(corpus, changed, found.filter("change = 'removed'").select("path")), found.groupBy("change").agg(F.count("*").alias("n"))


def problems(corpus: Corpus) -> DataFrame:
    """(problem, chunk_id): chunks that lack a vector or postings, vectors and postings that lack a chunk."""
    c, v = corpus.chunks.select("chunk_id").distinct(), corpus.vectors.select("chunk_id")
    p = segments.live(corpus.spark, f"{corpus.terms}/postings", "id", corpus.segment).select(F.col("id").alias("chunk_id")).distinct()
    worded = corpus.chunks.filter(F.size(bm25.terms_of(F.col("content"))) > 0).select("chunk_id").distinct()
    named = lambda df, what: df.select(F.lit(what).alias("problem"), "chunk_id")
    return named(c.join(v, "chunk_id", "left_anti"), "no_vector").unionByName(named(worded.join(p, "chunk_id", "left_anti"), "no_postings")).unionByName(named(v.join(c, "chunk_id", "left_anti"), "orphan_vector")).unionByName(named(p.join(c, "chunk_id", "left_anti"), "orphan_postings"))


def repair(corpus: Corpus, providers: tuple[embedding_cache.Provider, ...] = ()) -> Corpus:
    """Orphans removed, what lacks made again: a further segment with just that."""
    spark, path, n = corpus.spark, corpus.path, corpus.segment + 1
    found = problems(corpus)
    lacking = lambda *kinds: corpus.chunks.join(found.filter(F.col("problem").isin(*kinds)).select("chunk_id").distinct(), "chunk_id", "left_semi")
    orphans = lambda kind: found.filter(F.col("problem") == kind).select("chunk_id")
    for name in ("files", "chunks"):
        segments.put(f"{path}/{name}", n, corpus.table(name).limit(0), corpus.table(name).select(KEYS[name]).limit(0))
    graph_index.unchanged(graph_index.GraphIndex(spark, path, corpus.segment, corpus.state["project"]))
    segments.put(f"{path}/vectors", n, _embedded(spark, lacking("no_vector"), corpus.state["cache"], _providers_of(corpus, providers))[0], orphans("orphan_vector"))
    bm25.change(spark, corpus.terms, n, orphans("orphan_postings").select(F.col("chunk_id").alias("id")), lacking("no_postings").dropDuplicates(["chunk_id"]), "chunk_id", "content")
    vectors.add_to_lists(spark, f"{path}/lists", n, spark.read.parquet(f"{path}/vectors/rows/segment={n}"), orphans("orphan_vector").select(F.col("chunk_id").alias("id")), id_col="chunk_id")
    _note(spark, path, n, {"repaired_in": str(n), "project": corpus.state["project"]})
    return Corpus(spark, path, n)


def compaction_due(orphans: Column, share: Column, idle: Column, since_last: Column) -> Column:
    """Whether a table should be compacted: enough orphans, by number and share, and nothing else to do for a while."""
    return (orphans >= COMPACT_ORPHANS) & (share >= COMPACT_SHARE) & (idle >= COMPACT_IDLE) & (since_last >= COMPACT_PAUSE)


def compact(corpus: Corpus, path: str) -> Corpus:
    """The index written anew under another path, as one segment, from stored rows: nothing is chunked or embedded again."""
    spark = corpus.spark
    for name in ("files", "chunks", "vectors"):
        rows = corpus.table(name)
        segments.put(f"{path}/{name}", 0, rows, rows.select(KEYS[name]).limit(0))
    graph_index.copied(graph_index.GraphIndex(spark, corpus.path, corpus.segment), path)
    now = Corpus(spark, path, 0)
    bm25.build(now.chunks.dropDuplicates(["chunk_id"]), "chunk_id", "content", now.terms, _buckets(now.chunks.count()))
    vectors.build_lists(now.vectors, f"{path}/lists", id_col="chunk_id")
    _note(spark, path, 0, corpus.state)
    return now


def search(corpus: Corpus, queries: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """(query, chunk_id, path, title, start_line, end_line, score, in_both, rank) for a table of queries (query, q)."""
    o = options.checked()
    chunks = _eligible(corpus.chunks, o)
    merged = _retrieved(corpus, chunks, queries, o)
    if o.add_candidates:
        merged = merged.select("query", "id", "rrf", "in_both")
        more = _candidates(corpus, chunks, queries, merged.select("query", "id", F.col("rrf").alias("score")))
        merged = merged.unionByName(more.select("query", "id", F.col("score").alias("rrf"), F.lit(False).alias("in_both")))
    shown = merged.join(chunks.select(F.col("chunk_id").alias("id"), "path", "title", "start_line", "end_line", "content", metadata.priority(F.col("meta")).alias("priority")), "id").join(bounded(queries.select("query", "q")), "query")
    asked = candidates.needle(F.col("q"))
    symbol, kind = F.array(symbol_of(F.col("title"))), symbol_kind(F.col("content"), F.col("title"))
    exact = ranking.exact_factor(F.col("path"), F.col("content"), symbol, asked["text"], asked["quoted"], kind, candidates.declared_kinds(F.col("q")))
    scored = shown.withColumn("score", F.round(F.col("rrf") * F.coalesce(exact, F.lit(1.0)) * ranking.path_factor(F.col("path")) * candidates.pdf_factor(F.col("q"), F.col("path")), 6))
    if o.reranker is not None:
        worth = records.reranker_policy(query_class(F.col("q"))["kind"], o.rerank)["apply"]
        scored = scored.withColumn("score", F.when(worth, o.reranker(F.col("q"), F.col("content"))).otherwise(F.col("score")))
    key = F.round(ranking.authority_key(F.col("score"), F.col("priority")), 6)
    best = top(scored.drop("rank").withColumn("key", key), o.limit, ["query"], F.col("key").desc(), F.col("id"))
    return best.select("query", F.col("id").alias("chunk_id"), "path", "title", "start_line", "end_line", "score", "in_both", "rank")


def symbol_of(title: Column) -> Column:
    """The symbol that a chunk's title names: the last part, without the number of a split."""
    return F.substring_index(F.regexp_replace(title, r"_(?:part\d+|rest)$", ""), ".", -1)


def symbol_kind(content: Column, title: Column) -> Column:
    """function, method, class, interface or type of the symbol that a chunk's title names, by its declaration; else null."""
    name = symbol_of(title)
    word = lambda before, after="": F.contains(content, F.concat(F.lit(before), name, F.lit(after)))
    return (
        F.when(word("type ", " interface") | word("interface "), "interface").when(word("class "), "class").when(word("type ") | word("struct "), "type")
        .when(word("func (", "") | content.rlike(r"(?m)^\s*func\s*\("), "method").when(word("func ") | word("def ") | word("function "), "function")
    )


def _eligible(chunks: DataFrame, o: Options) -> DataFrame:
    if o.scopes:
        chunks = chunks.filter(in_scope(F.col("path"), list(o.scopes)))
    if o.kinds:
        chunks = chunks.filter(F.col("kind").isin(*o.kinds))
    if o.globs:
        chunks = chunks.filter(any_of(*[F.col("path").rlike(metadata.glob_regex(g)) for g in o.globs]))
    if o.symbol_type:
        chunks = chunks.filter(symbol_kind(F.col("content"), F.col("title")) == o.symbol_type)
    chunks = chunks.withColumn("meta", metadata.source_metadata(F.col("path")))
    if o.profile:
        chunks = chunks.filter(metadata.eligible(F.col("path"), F.col("meta"), o.profile))
    if o.decisions:
        chunks = chunks.filter(metadata.decision_mode(F.col("meta"), F.col("content"), o.decisions))
    return chunks


def _filtered(o: Options) -> bool:
    return bool(o.scopes or o.kinds or o.globs or o.profile or o.symbol_type or o.decisions)


def _retrieved(corpus: Corpus, chunks: DataFrame, queries: DataFrame, o: Options) -> DataFrame:
    """Keyword and vector rankings of each query, fused."""
    spark = corpus.spark
    depth = max(50, 10 * o.limit)
    depths = bounded(queries.select("query", ranking.candidate_depth(F.col("q"), o.limit, _filtered(o)).alias("depth")))
    deep = lambda ranked: ranked.join(depths, "query").filter(F.col("rank") <= F.col("depth")).drop("depth")
    asked = expansion.expanded(queries, "query", "q", o.synonyms) if o.expand and not o.keyword_only else queries
    scored = bm25.scores_built(spark, corpus.terms, asked, "query", "q", corpus.segment)
    if _filtered(o):  # statistics are those of the whole index; what the filters leave is ranked
        scored = scored.join(chunks.select(F.col("chunk_id").alias("id")), "id", "left_semi")
    kw = bm25.best(scored, depth, o.mode)
    provider = o.provider or static_provider()
    if o.keyword_only or provider.model != corpus.state["model"]:
        vs = kw.limit(0)
    else:
        q = queries.select(F.xxhash64(F.col("query").cast("string")).alias("row"), "query", "q")
        qv = provider.embed(q.select(F.col("row").alias("id"), F.col("q").alias("content"))).join(q.select(F.col("row").alias("id"), "query"), "id").select(F.col("query").alias("chunk_id"), "embedding")
        if o.approximate and not _filtered(o):
            vs = vectors.nearest_built(spark, f"{corpus.path}/lists", qv, depth, id_col="chunk_id", segment=corpus.segment).filter("score > 0.5")
        else:
            own = corpus.vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi") if _filtered(o) else corpus.vectors
            vs = vectors.nearest(own, qv, depth, "cosine", "chunk_id", "embedding").filter("score > 0.5")
    return _fused(deep(kw), deep(vs), queries, o)


def _candidates(corpus: Corpus, chunks: DataFrame, queries: DataFrame, results: DataFrame) -> DataFrame:
    """What the results lack: holders of an exact symbol, files that a decision names, PDF passages; the best score of each."""
    c = chunks.select(F.col("chunk_id").alias("id"), "path", "title", "start_line", "content", "meta")
    symbols = c.filter("title <> ''").select("id", symbol_of(F.col("title")).alias("name"), F.lit(0).alias("kind_rank"), F.col("start_line").alias("line"))
    named = candidates.decision_paths(queries, corpus.files.filter(metadata.source_metadata(F.col("path"))["source_class"] == "adr"))
    found = candidates.exact_symbols(queries, symbols).withColumn("factor", F.lit(1.0))
    found = found.unionByName(candidates.chunks_of_paths(named, c, candidates.ADR_CHUNKS).withColumn("factor", F.lit(1.0))).unionByName(candidates.pdf_passages(queries, c))
    return candidates.append(results, queries, found)


def search_decomposed(corpus: Corpus, queries: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """(query, chunk_id, path, score, hits, rank): each query's sub-queries in one search, fused; paths that sub-queries name are added."""
    o = options.checked()
    subs = decompose.sub_queries(queries)
    hinted, plain = subs.filter("hint <> ''"), subs.filter("hint = ''")

    def run(part: DataFrame, own: Options) -> Callable[[DataFrame, int], DataFrame]:
        return lambda q, depth: search(corpus, q, replace(own, limit=min(MOST, depth))).select("query", F.col("chunk_id").alias("id"), "rank")

    keyed = lambda part, own: decompose.found_by(part, run(part, own), o.limit)
    code_only = o if o.kinds else replace(o, kinds=("code",))
    fused = ranking.fuse_many(keyed(plain, o).unionByName(keyed(hinted, code_only))).filter(F.col("rank") <= o.limit)
    c = _eligible(corpus.chunks, o).select(F.col("chunk_id").alias("id"), "path", "start_line")
    more = candidates.append(fused.select("query", "id", F.col("rrf").alias("score")), queries, candidates.chunks_of_paths(candidates.hinted_paths(subs), c, candidates.HINT_CHUNKS))
    both = fused.select("query", "id", F.col("rrf").alias("score"), "hits").unionByName(more.withColumn("hits", F.lit(0).cast("long")))
    best = top(both, o.limit, ["query"], F.col("score").desc(), F.col("hits").desc(), F.col("id"))
    return best.join(c.select("id", "path").dropDuplicates(["id"]), "id").select("query", F.col("id").alias("chunk_id"), "path", "score", "hits", "rank")


def _fused(kw: DataFrame, vs: DataFrame, queries: DataFrame, o: Options) -> DataFrame:
    if not o.classify:
        return ranking.fuse(kw, vs, o.weights)
    # each query's own weights: fuse with both pairs of weights as columns
    w = bounded(queries.select("query", query_class(F.col("q")).alias("c")))
    both = ranking.fuse(kw, vs, (1.0, 0.0)).select("query", "id", "keyword_rank", "vector_rank", "in_both").join(w, "query")
    per = Window.partitionBy("query")
    missing = F.greatest(F.count("keyword_rank").over(per), F.count("vector_rank").over(per)) + 1
    raw = F.col("c.keyword_weight") / (ranking.K + F.coalesce("keyword_rank", missing)) + F.col("c.semantic_weight") / (ranking.K + F.coalesce("vector_rank", missing))
    s = both.withColumn("raw", raw).withColumn("rrf", F.round(F.col("raw") / F.max("raw").over(per), 6))
    return s.withColumn("rank", F.row_number().over(per.orderBy(F.col("rrf").desc(), "id")).cast("long")).drop("raw", "c")


def expand_context(corpus: Corpus, hits: DataFrame, k: int = 1) -> DataFrame:
    """(chunk_id, other, gap): the k chunks of the same file before and after each hit, by position: one shuffle on the path."""
    w = Window.partitionBy("path").orderBy("start_line", "end_line", "chunk_id")
    near = F.array(*[F.struct(F.lag("chunk_id", i).over(w).alias("other"), F.lit(-i).alias("gap")) for i in range(1, k + 1)], *[F.struct(F.lead("chunk_id", i).over(w).alias("other"), F.lit(i).alias("gap")) for i in range(1, k + 1)])
    c = corpus.chunks.select("chunk_id", "path", "start_line", "end_line").withColumn("near", near)
    return c.join(hits.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", F.explode("near").alias("n")).select("chunk_id", "n.*").filter("other is not null")


def graph_query(corpus: Corpus, subjects: DataFrame, directions: tuple[str, ...] = ("out", "in"), per_kind: int = 10, budget: int = RELATED_BYTES) -> DataFrame:
    """(subject, other, kind, role, direction, confidence, path, suppressed, other_kinds, rank) of subjects (subject[, type]).

    Subjects are resolved by their type (auto without one), a file stands for all nodes of its path, edges of one
    relationship are merged, each target is answered once by its surest edge, capped for each kind and by bytes.
    """
    typed = subjects if "type" in subjects.columns else subjects.withColumn("type", F.lit("auto"))
    nodes = corpus.nodes
    seeds = graph.seed_scope(graph.resolve_typed(nodes, typed), nodes)
    merged = graph.best_edges(corpus.edges.filter(~F.col("stale")))
    hit = graph.related(merged, seeds.select("seed").distinct(), directions).join(bounded(seeds, subjects), "seed")
    ends = nodes.select(F.col("id").alias("other"), "path").dropDuplicates(["other"])
    rows = hit.join(ends, "other")
    rows = rows.withColumns({"text": F.concat_ws(" ", "seed", "kind", "other"), "method": F.concat_ws(":", "direction", "role"), "heuristic": F.lit(False)})
    best = graph.best_targets(rows).withColumns({"direction": F.substring_index("method", ":", 1), "role": F.substring_index("method", ":", -1)})
    few = top(best, per_kind, ["subject", "kind", "direction"], F.col("confidence").desc(), F.col("path"), F.col("other"))
    kept = graph.within_budget(few.drop("rank"), budget, "subject", F.col("text"), F.col("confidence").desc(), F.col("path"), F.col("other"))
    return kept.select("subject", "other", "kind", "role", "direction", "confidence", "path", "suppressed", "other_kinds", "rank")


def graph_notes(corpus: Corpus, subjects: DataFrame) -> DataFrame:
    """(subject, state, hints, warning): how each subject resolved, near names if it didn't, and a language that no extractor reads."""
    typed = subjects if "type" in subjects.columns else subjects.withColumn("type", F.lit("auto"))
    found = graph.resolve_typed(corpus.nodes, typed).groupBy("subject").agg(F.max("state").alias("state"))
    near = graph.nearest_names(corpus.nodes, typed).groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("h"))  # a few a subject
    rows = typed.select("subject").distinct().join(found, "subject", "left").join(near, "subject", "left")
    hints = F.when(F.col("state").isNull(), F.transform("h", lambda x: x["name"]))
    return rows.select("subject", F.coalesce("state", F.lit("not_found")).alias("state"), hints.alias("hints"), graph.language_warning(F.col("subject")).alias("warning"))


def warnings(corpus: Corpus) -> DataFrame:
    """(warning, n): files without a chunk, files in a language that no extractor reads, stale edges; those that there are."""
    bare = corpus.files.select("path").join(corpus.chunks.select("path").distinct(), "path", "left_anti").agg(F.count("*").alias("n"))
    unread = corpus.files.filter(graph.language_warning(F.col("path")).isNotNull()).agg(F.count("*").alias("n"))
    stale = corpus.edges.filter("stale").agg(F.count("*").alias("n"))
    named = lambda df, what: df.select(F.lit(what).alias("warning"), "n")
    return named(bare, "file_without_chunk").unionByName(named(unread, "language_not_read")).unionByName(named(stale, "stale_edge")).filter("n > 0")


def index_status(corpus: Corpus) -> DataFrame:
    """One row: chunks, files, vectors, chunks that lack a vector, edges and stale edges."""
    c = corpus.chunks.agg(F.count("*").alias("chunks"), F.count_distinct("path").alias("files"))
    lacking = corpus.chunks.select("chunk_id").distinct().join(corpus.vectors, "chunk_id", "left_anti").agg(F.count("*").alias("without_vector"))
    e = corpus.edges.agg(F.count("*").alias("edges"), F.count_if("stale").alias("stale_edges"))
    return c.crossJoin(corpus.vectors.agg(F.count("*").alias("vectors"))).crossJoin(lacking).crossJoin(e)  # one row each


def index_information(corpus: Corpus, model: str = "static", dimensions: int = 256) -> DataFrame:
    """One row: the state of the index, rows and orphans of its vectors, its size in terms, and whether a model of these dimensions fits it."""
    state = corpus.state
    fits = state.get("model", model) == model and state.get("dimensions", str(dimensions)) == str(dimensions)
    orphans = segments.counts(corpus.spark, f"{corpus.path}/vectors", "chunk_id", corpus.segment).select(F.col("rows").alias("vectors"), "orphans")
    terms = bm25.statistics(corpus.spark, corpus.terms, corpus.segment)
    return terms.crossJoin(orphans).select(F.lit(corpus.segment).alias("segment"), F.lit(state.get("model", "")).alias("model"), F.lit(fits).alias("compatible"), "docs", "terms", "avgdl", "vectors", "orphans")
