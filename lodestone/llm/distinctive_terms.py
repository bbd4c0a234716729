"""How distinctive a term is of a record: correspondence-analysis residuals (problem 3).

Defined cases: rows with a null or blank term or a null document are left out; a (term, document)
pair that occurs in several rows counts once, with its largest tf; a null tf counts 0; a document
that docs lacks, or has with a null ntok or one below 1, has the sum of its tf as length; an empty
table gives an empty result; extra columns of either table are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.term_frequency import valid_rows
from lodestone.runtime import cut

#: Most terms whose margins are broadcast: those in most documents.
BROADCAST_TERMS = 4096


def residuals(postings: DataFrame, docs: DataFrame, min_weight: float | None = None, min_docs: int = 1) -> DataFrame:
    """One row per (doc_id, term) of the contingency table of documents and terms:

    tf, ntok, n_docs; expected = row total x column total / grand total; residual =
    (tf - expected) / sqrt(expected), adjusted = residual / sqrt((1 - row share)(1 - column share)),
    and weight = tf / ntok x ln(N / n_docs), N being all distinct documents of postings.

    With min_weight only rows of at least that weight in terms of at least min_docs documents are
    made; as n_docs >= min_docs bounds the weight, most rows fall before they meet their term's
    margin. Rows written twice are folded before the first shuffle, whose key is the pair, so neither a
    hot document nor a hot term gathers in one task; margins of the terms in most documents are
    broadcast, at most 4096, so no hot term is a key of a join, and the partition of a hot document is
    split by AQE's skew join, the other side being one row.
    """
    rows = valid_rows(postings).select("doc_id", "term", F.coalesce("tf", F.lit(0)).cast("long").alias("tf"))
    table = cut(rows.groupBy("doc_id", "term").agg(F.max("tf").alias("tf")), "table")
    terms = cut(table.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("term_total")), "terms")
    grand = terms.agg(F.sum("term_total")).first()[0] or 0
    n_all = postings.agg(F.count_distinct("doc_id")).first()[0]
    lengths = docs.where("doc_id is not null and ntok > 0").groupBy("doc_id").agg(F.max("ntok").alias("ntok"))
    sums = table.groupBy("doc_id").agg(F.sum("tf").alias("doc_total"))
    margins = sums.join(lengths, "doc_id", "left").select("doc_id", "doc_total", F.coalesce("ntok", "doc_total").alias("ntok"))
    cells = table.join(margins, "doc_id").where("ntok > 0")
    if min_weight is not None and min_weight > 0:
        most = math.log(max(n_all, 1) / max(min_docs, 1))
        cells = cells.where(F.lit(most) * F.col("tf") / F.col("ntok") >= min_weight * (1 - 1e-9))
    hot = cut(terms.orderBy(F.desc("n_docs"), "term").limit(BROADCAST_TERMS), "hot")
    near = cells.join(F.broadcast(hot), "term")
    far = cells.join(F.broadcast(hot.select("term")), "term", "left_anti").join(terms, "term")
    expected = F.col("doc_total") * F.col("term_total") / F.lit(float(grand or 1))
    spread = (1 - F.col("doc_total") / F.lit(float(grand or 1))) * (1 - F.col("term_total") / F.lit(float(grand or 1)))
    out = near.unionByName(far).withColumns({"expected": expected, "weight": F.col("tf") / F.col("ntok") * F.log(F.lit(float(n_all or 1)) / F.col("n_docs"))})
    out = out.withColumn("residual", F.when(F.col("expected") > 0, (F.col("tf") - F.col("expected")) / F.sqrt("expected")))
    out = out.withColumn("adjusted", F.when(spread > 0, F.col("residual") / F.sqrt(spread)))
    if min_weight is not None:
        out = out.where((F.col("weight") >= min_weight) & (F.col("n_docs") >= min_docs))
    return out.select("doc_id", "term", "tf", "ntok", "n_docs", "expected", "residual", "adjusted", "weight")
