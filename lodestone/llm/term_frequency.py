"""Frequency of every distinct term, by heavy-light aggregation (problem 1).

Defined cases: rows with a null or blank term or a null document are left out; a (term, document)
pair that occurs in several rows counts once, with its largest tf; a null tf counts 0; an empty
table gives an empty result; extra columns are ignored. Terms are compared exactly as stored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import cut

#: Most heavy terms, their least share of the rows of some task, and their bytes together.
HEAVY_TERMS, HEAVY_SHARE, HEAVY_BYTES = 1024, 1 / 2000, 8 << 20
#: Bits of the filter of documents with repeated rows, for each of these, and at most.
BITS_EACH, MOST_BITS = 16, 1 << 27
SALTS = 64


def valid_rows(postings: DataFrame) -> DataFrame:
    """Rows with a document and a term that is neither null nor blank."""
    return postings.where(F.col("doc_id").isNotNull() & F.col("term").rlike(r"(?U)\S"))


def heavy_terms(rows: DataFrame, limit: int = HEAVY_TERMS, share: float = HEAVY_SHARE) -> list[str]:
    """At most `limit` terms that make up at least `share` of the rows of some task.

    Each task keeps at most 8 / share counters (Misra-Gries), so every such term is seen; only how
    much work is saved depends on the list, never a count. A term that isn't listed has less than
    the larger of 1 / limit and `share` of all rows, so no light term is a hot key. The list is
    broadcast; it ends before 8 MB.
    """
    room = int(8 / share)

    def run(batches):
        counts: Counter = Counter()
        total = 0
        for batch in batches:
            total += batch.num_rows
            for x in pc.value_counts(batch.column(0)).to_pylist():
                counts[x["values"]] += x["counts"]
            if len(counts) > room:
                least = sorted(counts.values(), reverse=True)[room // 2]
                counts = Counter({k: v - least for k, v in counts.items() if v > least})
        top = [(k, v) for k, v in counts.most_common(limit) if v >= share * total / 2]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([v for _, v in top], pa.int64())], ["term", "n"])

    seen = rows.select("term").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"), F.octet_length("term").alias("bytes"))
    out, used = [], 0
    for x in seen.orderBy(F.desc("n"), "term").limit(limit).collect():
        used += x.bytes
        if used > HEAVY_BYTES:
            break
        out.append(x.term)
    return out


def _filter_of(dirty: DataFrame, n: int) -> np.ndarray:
    """A filter of the documents given: two bits for each of n documents in a field of 16 n bits, 16 MB at most."""
    bits = min(MOST_BITS, 1 << max(16, (BITS_EACH * n - 1).bit_length()))
    out = np.zeros(bits // 64, np.uint64)
    if n:
        words = dirty.select(F.explode(F.array(*_places(bits))).alias("at")).groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
        got = words.toPandas()
        out[got.word.to_numpy(int)] = got.bits.to_numpy(np.int64).view(np.uint64)
    return out


def _places(bits: int) -> list:
    return [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(bits)) for i in (1, 2)]


def term_counts(postings: DataFrame, heavy: list[str] | None = None) -> tuple[DataFrame, int]:
    """(term, occurrences, n_docs) of every term, and the number of documents.

    Heavy terms are counted where they are read, in one array of counters a task, and only the
    arrays are shuffled. That is exact for documents that hold each heavy term in one row. Which do
    is told by the data alone, however the input is split: a document's rows of heavy terms are
    counted, and the terms noted in a bitmap, both combined before a shuffle of one short row a
    document; where there are more rows than terms, rows repeat. Such documents are in a filter,
    and take the way of the light terms, as does a clean document the filter mistakes for one of
    these. Light terms are shuffled once, by term.
    """
    spark = postings.sparkSession
    rows = valid_rows(postings)
    heavy = heavy_terms(rows) if heavy is None else heavy
    rows = rows.select("term", "doc_id", F.coalesce("tf", F.lit(0)).cast("long").alias("tf"))
    listed = F.broadcast(spark.createDataFrame([*enumerate(heavy)], "code int, term string"))
    coded = rows.join(listed, "term", "left").withColumn("bit", F.expr("shiftleft(1L, code % 64)"))
    words = [F.bit_or(F.when(F.col("code").between(64 * i, 64 * i + 63), F.col("bit")).otherwise(0)).alias(f"w{i}") for i in range((len(heavy) + 63) // 64)]
    per = coded.groupBy("doc_id").agg(F.count("code").alias("n"), *words)
    terms = sum((F.bit_count(f"w{i}") for i in range(len(words))), F.lit(0))
    docs = cut(per.select("doc_id", (F.col("n") > terms).alias("repeats")), "documents")
    found = docs.agg(F.count("*").alias("n"), F.count_if("repeats").alias("dirty")).first()
    bits = _filter_of(docs.where("repeats"), found.dirty)
    spread, size, n_heavy = spark.sparkContext.broadcast(bits), len(bits) * 64, len(heavy)

    def count_here(batches):
        total, n = np.zeros(n_heavy, np.int64), np.zeros(n_heavy, np.int64)
        f = spread.value
        for batch in batches:
            code, doc, tf, one, two = batch.columns
            a, b = one.to_numpy(), two.to_numpy()
            dirty = ((f[a >> 6] >> (a & 63).astype(np.uint64)) & (f[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            if dirty.any():
                take = pa.array(dirty)
                yield pa.RecordBatch.from_arrays([code.filter(take), doc.filter(take), tf.filter(take), pa.nulls(int(dirty.sum()), pa.int64())], ["code", "doc_id", "tf", "n"])
            c = code.to_numpy()[~dirty]
            n += np.bincount(c, minlength=n_heavy)
            np.add.at(total, c, tf.to_numpy()[~dirty])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.nulls(len(some), pa.string()), pa.array(total[some]), pa.array(n[some])], ["code", "doc_id", "tf", "n"])

    counted = rows.join(listed, "term").select("code", "doc_id", "tf", *_places(size)).mapInArrow(count_here, "code int, doc_id string, tf long, n long")
    salt = F.when(F.col("doc_id").isNull(), -1 - F.spark_partition_id()).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    counters = counted.join(listed, "code").select("term", "doc_id", "tf", "n", salt.alias("salt"))
    light = rows.join(listed, "term", "left_anti").select("term", "doc_id", "tf", F.lit(None).cast("long").alias("n"), F.lit(0).alias("salt"))
    parts = light.unionByName(counters).repartition("term", "salt")
    pairs = parts.groupBy("term", "salt", "doc_id").agg(F.max("tf").alias("tf"), F.max("n").alias("n"))
    sums = pairs.groupBy("term", "salt").agg(F.sum("tf").alias("tf"), F.sum(F.coalesce("n", F.lit(1))).alias("n"))
    return sums.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.sum("n").alias("n_docs")), found.n


def mark_terms(postings: DataFrame, rare_below: int = 3, common_above: float = 0.25) -> DataFrame:
    """(term, occurrences, n_docs, mark): mark is rare (fewer than `rare_below` documents), common (in
    more than the share `common_above` of the documents with a valid term), or null. A term that is
    both, which takes fewer than a dozen documents, is rare."""
    counts, n_docs = term_counts(postings)
    mark = F.when(F.col("n_docs") < rare_below, "rare").when(F.col("n_docs") > common_above * n_docs, "common")
    return counts.withColumn("mark", mark)
