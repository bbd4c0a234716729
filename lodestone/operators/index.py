"""The inverted index as DataFrames: documents, postings, lengths, and snapshots of these."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.runtime import cut

KEY = ["kb_id", "doc_id"]


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """docs with rows that a scan wrote twice as one; columns: besides the key, the columns wanted (all of them if none is named).

    Which keys repeat is settled on the keys alone. Rows of other keys pass without a shuffle of their
    texts; of the repeated ones the largest row in the order of the columns is kept, so the result doesn't
    depend on how rows arrive. Tables with null keys keep one row of these too."""
    rest = [c for c in (columns or docs.columns) if c not in KEY]
    rows = docs.select(*KEY, *rest)
    if getattr(docs, "_distinct", False):  # a snapshot
        return rows
    again = docs.groupBy(KEY).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    same = lambda a, b: a.kb_id.eqNullSafe(b.kb_id) & a.doc_id.eqNullSafe(b.doc_id)
    single = rows.join(again, same(rows, again), "left_anti")
    double = rows.join(again, same(rows, again), "left_semi").groupBy(KEY)
    if not rest:
        return single.unionByName(double.agg(F.count("*").alias("n")).drop("n"))
    return single.unionByName(double.agg(F.max(F.struct(*rest)).alias("x")).select(*KEY, "x.*"))


def snapshot(docs: DataFrame) -> DataFrame:
    """documents(docs), written once to the shared folder; for plans that use texts in several parts."""
    out = cut(documents(docs), "snapshot")
    out._distinct = True
    return out


def listed(docs: DataFrame, status: str | None = None, limit: int = 300) -> DataFrame:
    """(kb_id, rank, total, and the columns of a listing): the newest documents of each knowledge base, of one status or all.

    limit is 1 to 2000; total is the number before the limit. Null sizes, times and counts are 0."""
    names = ["rel", "name", "folder", "ext", "size", "mtime", "nwords", "status", "reason"]
    rows = documents(docs, *names)
    rows = rows if status is None else rows.where(F.col("status") == status)
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "mtime", "nwords")}
    rows = rows.select(*KEY, *[zero.get(c, F.col(c)) for c in names])
    total = rows.groupBy("kb_id").agg(F.count("*").alias("total"))
    rank = F.row_number().over(Window.partitionBy("kb_id").orderBy(F.desc("mtime"), "rel", "doc_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= max(1, min(limit, 2000))).join(total, "kb_id")


def lookup(docs: DataFrame, kb_id: str, doc_id: str, most: int | None = 400_000) -> DataFrame:
    """One document with its text, and text_cut, which says whether the text goes on after `most` characters; none for no limit."""
    row = documents(docs.where((F.col("kb_id") == kb_id) & (F.col("doc_id") == doc_id)))
    cut_ = F.coalesce(F.length("text") > most, F.lit(False)) if most else F.lit(False)
    return row.withColumn("text_cut", cut_).withColumn("text", F.substring("text", 1, most) if most else F.col("text"))


def terms(rows: DataFrame, text: str, keep: list[str], keep_stopwords: bool = False) -> DataFrame:
    """keep + term: a row for each word of a text column, stemmed."""
    out = rows.select(*keep, F.explode(T.words(F.col(text))).alias("word"))
    if not keep_stopwords:
        out = out.where(~T.is_stopword(F.col("word")))
    return out.select(*keep, T.stem(F.col("word")).alias("term"))


def postings(docs: DataFrame) -> DataFrame:
    """(kb_id, term, doc_id, tf): a word of the text counts 1, one of the file's path 2.

    Words of both are counted in one aggregation, so there is one shuffle, with counts combined before it."""
    both = terms(docs, "text", KEY).withColumn("w", F.lit(1)).unionByName(terms(docs, "rel", KEY).withColumn("w", F.lit(2)))
    return both.groupBy("kb_id", "term", "doc_id").agg(F.sum("w").cast("int").alias("tf"))


def lengths(posted: DataFrame) -> DataFrame:
    """(kb_id, doc_id, ntok): the sum of a document's term counts."""
    return posted.groupBy(KEY).agg(F.sum("tf").cast("int").alias("ntok"))


def term_statistics(posted: DataFrame) -> DataFrame:
    """(kb_id, term, df, cf): in how many documents of its knowledge base a term occurs, and how often."""
    return posted.groupBy("kb_id", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def clean_postings(posted: DataFrame) -> DataFrame:
    """Postings without null or blank terms, rows written twice once."""
    return posted.where("trim(term) <> ''").select("kb_id", "term", "doc_id", "tf").distinct()


def upsert(old: DataFrame, new: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The next snapshot of a table: rows of new in place of those of old with the same key."""
    key = key or KEY
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def keep_only(docs: DataFrame, seen: DataFrame, complete: bool = True) -> DataFrame:
    """docs that a scan saw (kb_id, rel); after a scan that was stopped early nothing is dropped, nor
    in a knowledge base the scan didn't reach."""
    if not complete:
        return docs
    scanned = seen.select("kb_id").distinct()
    known = docs.join(scanned, "kb_id", "left_anti")
    return docs.join(seen.select("kb_id", "rel").distinct(), ["kb_id", "rel"], "left_semi").select(docs.columns).unionByName(known.select(docs.columns))


def drop_kb(table: DataFrame, kb_id: str) -> DataFrame:
    return table.where(F.col("kb_id") != kb_id)


def changed(known: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed files (kb_id, rel, size, mtime) that have to be read: new ones and ones whose size or time differs."""
    same = ["kb_id", "rel", "size", "mtime"]
    return listed.join(known.select(*same).distinct(), same, "left_anti")


def newest(rows: DataFrame, key: list[str], by: list) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where("__n = 1").drop("__n")
