"""Exact deduplication with a log-structured merge index of text digests.

Tasks put (digest, rows, best row) into a memtable; a full memtable is flushed as a run sorted by digest, a file of its
own. Compaction merges runs, and an older level if there is one, into one sorted level and keeps, for each digest, the
row with the most code points and then the smallest identifier. The level's filter is a bitmap of bounded size of the
digests that hold several rows. A document is looked up through the filter: one that it lets pass is looked for in the
level, all others stay, without a join. Each hit, that is, each row of a digest with several rows, is compared byte for
byte with the row that stays, and digests for which a comparison fails are grouped again by the whole normalised text.

Hot groups: a memtable leaves one entry a digest and flush, whatever the number of rows; digests that hold over a
thousandth of the rows (a thousand at most) are looked up by broadcast; their texts are dealt over one task for each
SALT rows before the byte comparison.

Defined cases: null text counts as empty and empty texts are equal; null identifiers come last, identifiers are of any
ordered type; of rows that are equal in text and identifier one is kept; very long texts are hashed and compared whole;
an empty table gives an empty result; extra columns stay out of `decide` and pass through `keep_one`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleaner.llm.shared import bounded, drop, fresh, look_up, parted, sift, stored

#: Entries of a memtable (about 15 MB with its run); rows of a group that one task compares.
MEMTABLE, SALT = 50_000, 256
SLICE = 1000  # rows of a batch that are Python objects at a time


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")


def flush(keyed: DataFrame) -> DataFrame:
    """Sorted runs of (digest, rows, chars, id) from a table of (id, n_chars, digest)."""
    id_type = keyed.schema["id"].dataType
    arrow = to_arrow_type(id_type)

    def rank(chars: int, key):  # smaller is better; keys are compared only if neither is null
        return (-chars, key is None, *(() if key is None else (key,)))

    def run(table: dict) -> pa.RecordBatch:
        keys = sorted(table)
        columns = [keys, *([table[k][i] for k in keys] for i in range(3))]
        kinds = (pa.binary(), pa.int64(), pa.int64(), arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["digest", "rows", "chars", "id"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list] = {}
        for batch in batches:
            for key, chars, digest in (row for at in range(0, batch.num_rows, SLICE) for row in zip(*(batch.column(i).slice(at, SLICE).to_pylist() for i in range(3)), strict=True)):
                old = table.get(digest)
                if old is None:
                    if len(table) >= MEMTABLE:
                        yield run(table)
                        table = {}
                    table[digest] = [1, chars, key]
                else:
                    old[0] += 1
                    if rank(chars, key) < rank(old[1], old[2]):
                        old[1], old[2] = chars, key
        if table:
            yield run(table)

    runs = keyed.select("id", "n_chars", "digest").mapInArrow(work, f"digest binary, rows long, chars long, id {id_type.simpleString()}")
    return stored(runs, "lsm-runs", maxRecordsPerFile=str(MEMTABLE))  # a task's runs are full but for the last: a file each


def compact(runs: DataFrame, older: DataFrame | None = None) -> DataFrame:
    """One sorted level of (digest, group_size, keep_chars, keep_id) from runs and, if there is one, an older level."""
    if older is not None:
        runs = runs.unionByName(older.select("digest", F.col("group_size").alias("rows"), F.col("keep_chars").alias("chars"), F.col("keep_id").alias("id")))
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("n"), F.col("id").alias("id")))
    merged = runs.groupBy("digest").agg(F.sum("rows").alias("group_size"), best.alias("best"))
    level = merged.select("digest", "group_size", (-F.col("best.c")).alias("keep_chars"), F.col("best.id").alias("keep_id"))
    return stored(level.sortWithinPartitions("digest"), "lsm-level")


def _several(level: DataFrame) -> DataFrame:
    return level.filter(F.col("group_size") > 1)


def look_up_all(keyed: DataFrame, level: DataFrame, rows: int) -> DataFrame:
    """`keyed` with group_size, keep_chars and keep_id: from the level for rows that pass its filter, for all others their own."""
    maybe, alone = parted(keyed, _several(level).select("digest"), "digest")
    return look_up(maybe, level, "digest", "group_size", rows).unionByName(alone.withColumns({"group_size": F.lit(1).cast("long"), "keep_chars": F.col("n_chars"), "keep_id": F.col("id")}))


def _failing(texts: DataFrame, level: DataFrame, rows: int) -> DataFrame:
    """Digests under which some row's bytes differ from those of the row that stays.

    Hot digests (a thousand at most) are known by broadcast before the join, so that their texts are dealt over salts.
    """
    several = _several(level).withColumn("salts", F.ceil(F.col("group_size") / SALT).cast("int"))
    is_hot = F.col("group_size") > max(1000, rows // 1000)
    hot = F.broadcast(several.filter(is_hot).select("digest", F.col("salts").alias("deal")))
    dealt = sift(texts, several, "digest").join(hot, "digest", "left").withColumn("at", F.when(F.col("deal").isNotNull(), F.pmod(F.xxhash64("id"), F.col("deal"))).otherwise(0).cast("int"))
    spread = several.withColumn("at", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.lit(0)))))
    hits = stored(dealt.join(spread, ["digest", "at"]).drop("at", "deal"), "lsm-hits")
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    kept = hits.filter(stays).groupBy("digest").agg(F.max("salts").alias("salts"), F.min("norm").alias("kept_norm"))
    kept = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("digest", "salt", "kept_norm")
    copies = hits.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("salts")).cast("int")).select("digest", "salt", "norm")
    failing = stored(copies.join(kept, ["digest", "salt"]).filter(F.col("norm") != F.col("kept_norm")).select("digest").distinct(), "lsm-failing")
    drop(hits)
    return failing


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """id, keep_id, group_size, kept, sha (binary), n_chars: a row for each row. digest_bytes: of the index's key (tests make it collide)."""
    sha = F.coalesce(F.unhex(F.sha2(F.col("norm"), 256)), F.lit(b""))  # never null, which spares a test that would compute it twice
    texts = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"), normalised(F.col(text_col)).alias("norm"))
    texts = texts.withColumn("sha", sha).withColumn("digest", F.substring("sha", 1, digest_bytes))
    keyed = stored(texts.select("id", "n_chars", "digest", "sha"), "lsm-digests")
    runs = flush(keyed)
    level = compact(runs)
    drop(runs)
    rows = keyed.count()
    failing = _failing(texts, level, rows)
    n = failing.count()
    found = look_up_all(keyed, level, rows)
    if n:  # digests that stand for several texts: group their rows by the text itself
        found = found.join(bounded(failing, n), "digest", "left_anti")
        clash = texts.join(bounded(failing, n), "digest", "left_semi")
        best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("id").isNull().alias("n"), F.col("id").alias("id")))
        groups = clash.groupBy("norm").agg(F.count("*").alias("group_size"), best.alias("b"))
        groups = groups.select("norm", "group_size", (-F.col("b.c")).alias("keep_chars"), F.col("b.id").alias("keep_id"))
        found = found.unionByName(clash.join(groups, "norm").select(*found.columns))
    first = F.row_number().over(Window.partitionBy("sha", "id").orderBy(F.col("n_chars").desc())) == 1
    kept = first & F.col("id").eqNullSafe(F.col("keep_id"))
    return found.withColumn("kept", kept).select("id", "keep_id", "group_size", "kept", "sha", "n_chars")


def add(docs: DataFrame, level: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The level after a batch of documents: runs of the batch are merged with the older level, whose documents aren't read again."""
    sha = F.coalesce(F.unhex(F.sha2(normalised(F.col(text_col)), 256)), F.lit(b""))
    runs = flush(docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"), sha.alias("digest")))
    merged = compact(runs, level)
    drop(runs)
    return merged


def report(decided: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return decided.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their columns. Only rows whose identifier may be that of a dropped one are hashed and shuffled."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    key, chars, sha, number = fresh(docs, "__key", "__chars", "__sha", "__number")
    names = [F.col("id").alias("id"), F.col("sha").alias("sha"), F.col("n_chars").alias("chars")]
    dropped, kept = decided.filter(~F.col("kept")).select(*names), decided.filter("kept").select(*names)
    both = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("id", "sha", "chars")]
    twins = kept.alias("a").join(dropped.alias("b"), both, "left_semi").limit(1).count()
    maybe, rest = parted(docs.withColumn(key, F.xxhash64(id_col)), dropped.select(F.xxhash64("id").alias(key)), key)
    maybe = maybe.withColumns({chars: F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"), sha: F.coalesce(F.unhex(F.sha2(normalised(F.col(text_col)), 256)), F.lit(b""))})
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("k.id")) & (F.col(f"d.{sha}") == F.col("k.sha")) & (F.col(f"d.{chars}") == F.col("k.chars"))
    if twins:  # rows equal in id and text: number them, and keep the first
        maybe = maybe.withColumn(number, F.row_number().over(Window.partitionBy(id_col, sha, chars).orderBy(F.lit(1)))).filter(F.col(number) == 1)
        stays = maybe.alias("d").join(kept.alias("k"), same, "left_semi")
    else:
        stays = maybe.alias("d").join(dropped.alias("k"), same, "left_anti")
    return stays.select(*own).unionByName(rest.select(*own))


ORACLE = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       row_number() OVER g = 1 AS kept, sha AS text_sha256
FROM n WINDOW g AS (PARTITION BY sha ORDER BY chars DESC, doc_id NULLS LAST)
"""
