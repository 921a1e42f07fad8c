"""BM25 search for a table of queries over a table of documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.best import Best
from gleaner.functions.joins import bounded, top
from gleaner.functions.text import STOP_WORDS, tokens, without_stop_words
from gleaner.sources import segments

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Terms of queries, weights of terms by queries, and best rows up to which tasks score all queries at once; cells of a step.
QUERY_TERMS, WEIGHTS, KEPT, CELLS = 200_000, 1 << 22, 1 << 20, 1 << 20
#: Bytes of whole texts that are counted, and postings that are handed on, at once; postings that a task sorts by document on average.
BYTES, HANDED, SORTED = 1 << 23, 1 << 16, 1 << 22
#: Kinds of bytes (0: neither letter nor digit), and bytes in lower case.
_LOWER, _UPPER, _DIGIT = 1, 2, 3
_KINDS, _LOWERED = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
for _kind, _first, _last in ((_LOWER, "a", "z"), (_UPPER, "A", "Z"), (_DIGIT, "0", "9")):
    _KINDS[ord(_first) : ord(_last) + 1] = _kind
_LOWERED[_KINDS == _UPPER] += 32


def terms_of(text: Column) -> Column:
    return without_stop_words(tokens(text))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, dl): an index row for each term of a document."""
    d = docs.select(F.col(id_col).alias("id"), terms_of(F.col(text_col)).alias("t"))
    return _exploded(d).groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


def counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `postings`, counted document by document within a task; only where an identifier stands twice are they shuffled."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    p = d.mapInArrow(_counted, f"id {d.schema['id'].dataType.simpleString()}, term string, dl long, tf long")
    if d.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        return p.groupBy("id", "term", "dl").agg(F.sum("tf").alias("tf"))
    return p


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some whole texts at once, as bytes: other scripts' bytes are no letters. Rows of a term stand side by side, which is smaller when written."""
    for batch in batches:
        ids, texts = batch.column(0), pa.concat_arrays([batch.column(1).cast(pa.large_string()).fill_null("")])
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BYTES, side="right")) - 1)
            if ends[hi] > ends[lo]:
                own = np.frombuffer(data, np.uint8, int(ends[hi] - ends[lo]), int(ends[lo]))
                terms, names, doc = _terms(own, ends[lo : hi + 1] - ends[lo])
                dl = np.bincount(doc, minlength=hi - lo)
                key, tf = np.unique(terms * (hi - lo) + doc, return_counts=True)
                for at in range(0, len(key), HANDED):
                    term, d = np.divmod(key[at : at + HANDED], hi - lo)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + d)), names.take(pa.array(term)), pa.array(dl[d]), pa.array(tf[at : at + HANDED])], ["id", "term", "dl", "tf"])
            lo = hi


def _terms(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The terms (as numbers), their names, and the number of each one's document, in the order in which `terms_of` finds them."""
    kind = _KINDS[text]
    edges = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(text))]
    before, after = np.concatenate([[0], kind[:-1]]), np.concatenate([kind[1:], [0]])
    before[edges], after[edges - 1] = 0, 0
    upper = kind == _UPPER
    begins = (kind > 0) & ((before == 0) | upper & ((before == _LOWER) | (after == _LOWER)))
    letters = kind > 0
    found, starts = _LOWERED[text[letters]], np.flatnonzero(begins[letters])
    tokens = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(found))), pa.py_buffer(found)).dictionary_encode()
    numbers, names = tokens.indices.to_numpy(), tokens.dictionary.cast(pa.string())
    term = pc.and_(pc.greater_equal(pc.binary_length(names), 2), pc.invert(pc.is_in(names, pa.array(STOP_WORDS)))).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(np.searchsorted(np.flatnonzero(begins), ends)))
    stays = term[numbers]
    return numbers[stays].astype(np.int64), names, doc[stays]


def _exploded(d: DataFrame) -> DataFrame:
    """(id, dl, term) of (id, t). A plain explode would have a filter on the size of t pushed into the scan, which tokenises every text a second time."""
    return d.select("id", F.size("t").cast("long").alias("dl"), F.explode_outer("t").alias("term")).filter("term IS NOT NULL")


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, term, qtf, n): n is the number of distinct terms of the query."""
    q = queries.select(F.col(id_col).alias("query"), terms_of(F.col(text_col)).alias("t"))
    q = q.select("query", F.size(F.array_distinct("t")).cast("long").alias("n"), F.explode("t").alias("term"))
    return q.groupBy("query", "n", "term").agg(F.count("*").alias("qtf"))


def _weighted(tf: DataFrame, df: DataFrame, stats: DataFrame, q: DataFrame) -> DataFrame:
    """(query, id, n, score, matched) from term counts, document frequencies and one row of corpus statistics."""
    raw = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.crossJoin(F.broadcast(stats)).select("term", "avgdl", F.when(raw > 0, raw).otherwise(LEAST_IDF).alias("idf"))
    weighted = tf.join(bounded(idf.join(q, "term"), q), "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return weighted.groupBy("query", "id", "n").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("matched"))


def scores(docs: DataFrame, queries: DataFrame, doc_id: str, doc_text: str, query_id: str, query_text: str) -> DataFrame:
    """Scores without an index: only terms that some query has leave the scan, so the shuffle carries hits alone."""
    q = query_terms(queries, query_id, query_text)
    wanted = bounded(q.select("term").distinct())
    d = docs.select(F.col(doc_id).alias("id"), terms_of(F.col(doc_text)).alias("t"))
    stats = d.agg(F.count("*").alias("docs"), F.avg(F.size("t")).alias("avgdl"))
    hits = _exploded(d).join(wanted, "term")
    tf = hits.groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return _weighted(tf, df, stats, q)


def put_segment(docs: DataFrame, doc_id: str, doc_text: str, path: str, segment: int, buckets: int, gone: DataFrame | None = None) -> None:
    """Append documents to an inverted index, and remove those whose ids (a column id) are gone: postings in buckets of terms, and
    what the change adds to or takes from document frequencies and corpus statistics. Nothing written before is rewritten."""
    spark = docs.sparkSession
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    p = counted(docs, doc_id, doc_text).withColumn("bucket", bucket)
    p = p.hint("rebalance", F.col("bucket"))  # large buckets are dealt out to several tasks, so that none sorts more than fits
    ids = docs.select(F.col(doc_id).alias("id")) if gone is None else gone.select("id").distinct()
    lost = segments.live(spark, f"{path}/postings", "id", segment - 1).join(ids, "id", "left_semi") if gone is not None else None
    segments.put(f"{path}/postings", segment, p, ids if gone is not None else ids.limit(0), ("bucket",))
    new = spark.read.schema(p.schema).parquet(f"{path}/postings/rows/segment={segment}")  # there may be no row
    df = new.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("docs")).crossJoin(new.agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("total")))  # one row each; lengths add up to the counts of terms
    if lost is not None:
        df = df.unionByName(lost.groupBy("bucket", "term").agg((-F.count("*")).alias("df"))).groupBy("bucket", "term").agg(F.sum("df").alias("df")).filter("df <> 0")
        less = lost.select("id", "dl").distinct().agg((-F.coalesce(F.sum("dl"), F.lit(0))).cast("long").alias("total"))
        total = total.unionByName(less.crossJoin(ids.agg((-F.count("*")).alias("docs"))).select("docs", "total")).agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"))  # one row each
    segments.put(f"{path}/terms", segment, df, None, ("bucket",))
    segments.put(f"{path}/stats", segment, total.withColumn("buckets", F.lit(buckets)))


def build(docs: DataFrame, doc_id: str, doc_text: str, path: str, buckets: int = 64) -> None:
    """Write an inverted index as its first segment; a query reads the buckets of its terms only."""
    put_segment(docs, doc_id, doc_text, path, 0, buckets)


def change(spark, path: str, segment: int, gone: DataFrame, added: DataFrame, doc_id: str, doc_text: str) -> None:
    """Remove documents (a column id) from a written index and add others: cost follows the change, not the index."""
    buckets = spark.read.parquet(f"{path}/stats/rows").agg(F.max("buckets")).first()[0]
    put_segment(added, doc_id, doc_text, path, segment, buckets, gone)


def all_ids(spark, path: str, segment: int = 0) -> DataFrame:
    """Identifiers in a written index, in order."""
    return segments.live(spark, f"{path}/postings", "id", segment).select("id").distinct().orderBy("id")


def statistics(spark, path: str, segment: int = 0) -> DataFrame:
    """One row: docs, terms (distinct) and avgdl of a written index."""
    upto = F.col("segment") <= segment
    stats = spark.read.parquet(f"{path}/stats/rows").filter(upto).agg(F.sum("docs").alias("docs"), (F.sum("total") / F.sum("docs")).alias("avgdl"))
    terms = spark.read.parquet(f"{path}/terms/rows").filter(upto).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0").agg(F.count("*").alias("terms"))
    return stats.crossJoin(terms)  # one row each


def scores_built(spark, path: str, queries: DataFrame, query_id: str, query_text: str, segment: int = 0) -> DataFrame:
    """Scores from a written index as of a segment. The broadcast join on bucket and term prunes partitions while the query runs."""
    stats = spark.read.parquet(f"{path}/stats/rows").filter(F.col("segment") <= segment)
    buckets = stats.agg(F.max("buckets")).first()[0]
    stats = stats.agg(F.sum("docs").alias("docs"), (F.sum("total") / F.sum("docs")).alias("avgdl"))
    q = query_terms(queries, query_id, query_text).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    wanted = bounded(q.select("bucket", "term").distinct())
    tf = segments.live(spark, f"{path}/postings", "id", segment).join(wanted, ["bucket", "term"]).select("id", "term", "dl", "tf")
    df = spark.read.parquet(f"{path}/terms/rows").filter(F.col("segment") <= segment).join(wanted, ["bucket", "term"]).groupBy("term").agg(F.sum("df").alias("df"))
    return _weighted(tf, df, stats, q.drop("bucket"))


def best(scored: DataFrame, k: int, mode: str = "and_then_or") -> DataFrame:
    """(query, id, score, rank): documents with all terms of a query, or, where there is none, with any.

    Both kinds are cut to k rows a query first, so the choice between them is made over 2 k rows and scores are computed once.
    """
    order = (F.col("score").desc(), F.col("id"))
    if mode == "and_then_or":
        ranked = top(scored.withColumn("full", F.col("matched") == F.col("n")), k, ["query", "full"], *order)
        ranked = ranked.withColumn("any", F.max("full").over(Window.partitionBy("query"))).filter(F.col("full") | ~F.col("any"))
    else:
        ranked = top(scored, k, ["query"], *order)
    return ranked.select("query", "id", "score", "rank")


def best_built(spark, path: str, queries: DataFrame, query_id: str, query_text: str, k: int, mode: str = "and_then_or", segment: int = 0) -> DataFrame:
    """The rows of best(scores_built(...)) without a row for each pair of query and document.

    Postings of the queries' terms are dealt out by document; a task multiplies those of some documents with the weights of all
    queries and keeps k rows a query, of those with all terms and of others. Queries beyond the bounds are scored pair by pair.
    """
    rows = query_terms(queries, query_id, query_text).limit(QUERY_TERMS + 1).collect()  # a bounded number
    place = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
    asked = {x: i for i, x in enumerate(dict.fromkeys((r.query, r.n) for r in rows))}
    if len(rows) > QUERY_TERMS or len(place) * len(asked) > WEIGHTS or len(asked) * 2 * k > KEPT:
        return best(scores_built(spark, path, queries, query_id, query_text, segment), k, mode)
    stats = spark.read.parquet(f"{path}/stats/rows").filter(F.col("segment") <= segment)
    docs, total, buckets = stats.agg(F.sum("docs"), F.sum("total"), F.max("buckets")).first()
    numbers = spark.createDataFrame(list(place.items()), "term string, t int")
    wanted = F.broadcast(numbers.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")))
    df = spark.read.parquet(f"{path}/terms/rows").filter(F.col("segment") <= segment).join(wanted, ["bucket", "term"]).groupBy("t").agg(F.sum("df").alias("df"))
    n_docs = np.zeros(len(place))
    for r in df.collect():  # a row a term of the queries
        n_docs[r.t] = r.df
    raw = np.log((docs - n_docs + 0.5) / (n_docs + 0.5))
    cells = [(place[r.term], asked[r.query, r.n], r.qtf) for r in rows]
    work = spark.sparkContext.broadcast((cells, np.where(raw > 0, raw, LEAST_IDF), (total or 0) / docs if docs else 0.0, [n for _, n in asked], k, mode))
    tf = segments.live(spark, f"{path}/postings", "id", segment).join(wanted, ["bucket", "term"]).select("id", "t", "dl", "tf")
    tasks = math.ceil(n_docs.sum() / SORTED)  # an index that outgrows the configured partitions gets more of them: a sort stays within memory
    dealt = tf.repartition(tasks, "id") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else tf.repartition("id")
    of_task = dealt.sortWithinPartitions("id").mapInArrow(_scored(work), f"id {tf.schema['id'].dataType.simpleString()}, q int, score double, matched long")
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(asked)], f"q int, query {queries.schema[query_id].dataType.simpleString()}")
    return best(of_task.join(F.broadcast(names), "q").withColumn("n", F.lit(1).cast("long")), k, mode)


def _scored(work):
    """The best rows (id, q, score, matched: 1 if all terms are there) of postings (id, t, dl, tf) sorted by id."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, idf, avgdl, sizes, k, mode = work.value
        weight, there = np.zeros((len(idf), len(sizes))), np.zeros((len(idf), len(sizes)), np.float32)
        for t, q, qtf in cells:
            weight[t, q], there[t, q] = qtf * idf[t], 1
        kept, rest = Best(2 * len(sizes), k, 6, falling=True), None
        add = lambda rows: _add(kept, rows, weight, there, np.array(sizes, np.float32), avgdl, mode)
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rows = rows if rest is None else pa.concat_tables([rest, rows])
                codes, _ = _documents(rows)
                cut = int(np.searchsorted(codes, codes[-1]))  # the last document may go on
                if cut:
                    add(rows.slice(0, cut))
                rest = rows.slice(cut)
        if rest is not None:
            add(rest)
        if len(kept.group):
            full = kept.group >= len(sizes)
            yield pa.RecordBatch.from_arrays([kept.ids, pa.array((kept.group % len(sizes)).astype(np.int32)), pa.array(kept.value), pa.array(full.astype(np.int64))], ["id", "q", "score", "matched"])

    return scored


def _documents(rows: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """A number for each row's document, rising with the rows, and the ids."""
    coded = rows.column("id").combine_chunks().dictionary_encode("encode")
    return coded.indices.to_numpy(), coded.dictionary


def _add(kept: Best, rows: pa.Table, weight: np.ndarray, there: np.ndarray, sizes: np.ndarray, avgdl: float, mode: str) -> None:
    codes, ids = _documents(rows)
    t, dl, tf = (rows.column(c).to_numpy() for c in ("t", "dl", "tf"))
    share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
    step = max(1, CELLS // max(weight.shape))
    for lo in range(0, len(ids), step):
        a, b = np.searchsorted(codes, [lo, lo + step])
        own, used = np.unique(t[a:b], return_inverse=True)
        shape = (min(step, len(ids) - lo), len(own))
        at = (codes[a:b] - lo).astype(np.int64) * len(own) + used
        made = lambda w=None: np.bincount(at, w, shape[0] * shape[1]).reshape(shape)  # noqa: B023, E731
        matched = made().astype(np.float32) @ there[own]
        doc, query = np.nonzero(matched)
        full = (matched[doc, query] == sizes[query]) & (mode == "and_then_or")
        kept.add(query + len(sizes) * full, (made(share[a:b]) @ weight[own])[doc, query], ids, lo + doc)


def search(docs: DataFrame, queries: DataFrame, doc_id: str, doc_text: str, query_id: str, query_text: str, k: int, mode: str = "and_then_or") -> DataFrame:
    return best(scores(docs, queries, doc_id, doc_text, query_id, query_text), k, mode)
