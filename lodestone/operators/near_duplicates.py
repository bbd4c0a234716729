"""Near-duplicate documents within a knowledge base, by the Jaccard similarity of five-word runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.components import components
from lodestone.operators.index import documents
from lodestone.runtime import cut

THRESHOLD, LEAST_WORDS, LEAST_RUNS = 0.55, 30, 8


def runs_of(docs: DataFrame, apart: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kb_id, doc_id, runs): readable documents of enough words, one of each set of copies; (kb_id, a, b): its other copies b.

    Copies have the same words in the same order, by their digest, and so the same runs. apart (kb_id, doc_id):
    documents that are left out, such as those in groups of exact copies."""
    rows = documents(docs, "status", "nwords", "text").where(f"status = 'ok' and nwords >= {LEAST_WORDS}")
    if apart is not None:
        rows = rows.join(apart.select("kb_id", "doc_id"), ["kb_id", "doc_id"], "left_anti")
    split = cut(rows.select("kb_id", "doc_id", T.words(F.coalesce("text", F.lit("")), T.PLAIN_WORD).alias("words")), "words")
    key = split.where(F.size("words") > 0).select("kb_id", "doc_id", F.sha2(F.array_join("words", " "), 256).alias("key"))
    first = key.groupBy("kb_id", "key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    copies = cut(key.join(first, ["kb_id", "key"]).where("doc_id > a").select("kb_id", "a", F.col("doc_id").alias("b")), "copies")
    split = split.join(copies.select("kb_id", F.col("b").alias("doc_id")), ["kb_id", "doc_id"], "left_anti")
    sets = cut(split.select("kb_id", "doc_id", T.shingles(F.col("words")).alias("runs")).where(F.size("runs") >= LEAST_RUNS), "runs")
    return sets, copies.join(sets.select("kb_id", F.col("doc_id").alias("a")), ["kb_id", "a"], "left_semi")


def _verified(met: DataFrame, sets: DataFrame, copies: DataFrame) -> DataFrame:
    """(kb_id, a, b, similarity): the pairs of met (kb_id, a, b, t) that reach t, and the links of the copies."""
    side = lambda x: sets.select("kb_id", F.col("doc_id").alias(x), F.col("runs").alias(f"{x}_runs"))
    both = F.size(F.array_intersect("a_runs", "b_runs"))
    out = met.join(side("a"), ["kb_id", "a"]).join(side("b"), ["kb_id", "b"]).withColumn("similarity", both / (F.size("a_runs") + F.size("b_runs") - both))
    out = out.where("similarity >= t").select("kb_id", "a", "b", F.round("similarity", 4).alias("similarity"))
    return out.unionByName(copies.withColumn("similarity", F.lit(1.0)))


def pairs(docs: DataFrame, thresholds: DataFrame | None = None, default: float = THRESHOLD, apart: DataFrame | None = None) -> DataFrame:
    """(kb_id, a, b, similarity): pairs of documents of a knowledge base at or above its threshold, a before b.
    Documents with the same words are searched for as one, the first of them, and each is linked to it.

    thresholds has kb_id and near_threshold; null or missing means the default. Of two similar documents
    the rarest n - ceil(t n) + 1 runs of either share one, so only those are joined; runs that one document
    alone holds join nothing and are left out, and runs that many share come last in the order and are
    rarely among them. Similarities are then computed in full."""
    sets, copies = runs_of(docs, apart)
    if thresholds is not None:
        limits = thresholds.groupBy("kb_id").agg(F.max("near_threshold").alias("t"))
        sets = sets.join(limits, "kb_id", "left")
    else:
        sets = sets.withColumn("t", F.lit(None).cast("double"))
    sets = sets.withColumn("t", F.coalesce("t", F.lit(default)))
    each = sets.select("kb_id", "doc_id", "t", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    held = each.groupBy("kb_id", "run").agg(F.count("*").alias("held"))
    shared = held.where("held > 1")
    # of a record's runs that others hold too, those within its prefix: unshared runs come before all of them
    known = each.join(shared, ["kb_id", "run"]).groupBy("kb_id", "doc_id").agg(F.first("t").alias("t"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("held", "run"))).alias("known"))
    room = F.col("n") - F.ceil(F.col("t") * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("known"))
    rare = known.where(room > 0).select("kb_id", "doc_id", "n", "t", F.explode(F.slice("known", F.lit(1), room.cast("int"))).alias("x")).select("kb_id", "doc_id", "n", "t", F.col("x.run").alias("run"))
    other = rare.select("kb_id", "run", F.col("doc_id").alias("b"), F.col("n").alias("m"))
    met = rare.withColumnRenamed("doc_id", "a").join(other, ["kb_id", "run"]).where("a < b").where(F.least("n", "m") >= F.col("t") * F.greatest("n", "m") - 1e-9).select("kb_id", "a", "b", "t").distinct()
    return _verified(met, sets, copies)


def groups(docs: DataFrame, thresholds: DataFrame | None = None, default: float = THRESHOLD, apart: DataFrame | None = None) -> DataFrame:
    """(kb_id, group_id, doc_id, similarity): the connected documents, the group's smallest id and its largest similarity."""
    found = cut(pairs(docs, thresholds, default, apart), "pairs")
    key = lambda c: F.concat_ws("\x01", "kb_id", c)
    roots = components(found.select(key("a").alias("a"), key("b").alias("b")))
    part = lambda c, i: F.element_at(F.split(c, "\x01"), i)
    member = roots.select(part("node", 1).alias("kb_id"), part("node", 2).alias("doc_id"), part("root", 2).alias("group_id"))
    best = found.join(member, [member.kb_id == found.kb_id, member.doc_id == found.a]).groupBy(member.kb_id, "group_id").agg(F.max("similarity").alias("similarity"))
    return member.join(best, ["kb_id", "group_id"]).select("kb_id", "group_id", "doc_id", "similarity")


def candidate_pairs_lsh(docs: DataFrame, bands: int = 20, rows: int = 3, threshold: float = THRESHOLD) -> DataFrame:
    """(kb_id, a, b): pairs that share a MinHash band and reach the threshold, for corpora where missing some pairs near
    it is fine: one at 0.55 is met with a probability of 1 - (1 - 0.55^3)^20 = 0.974.

    The signature is a fold of built-in hashes. All pairs of a band's bucket are verified; copies are
    linked to the first of them, so that they never fill a bucket."""
    sets, copies = runs_of(docs)
    seeds = F.sequence(F.lit(1), F.lit(bands * rows))
    minima = F.transform(seeds, lambda s: F.array_min(F.transform("runs", lambda r: F.xxhash64(r, s))))
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("m", i * rows + 1, rows)))
    banded = cut(sets.select("kb_id", "doc_id", minima.alias("m")), "minima").select("kb_id", "doc_id", F.explode(keys).alias("band"))
    shared = banded.groupBy("kb_id", "band").agg(F.count("*").alias("n")).where("n > 1").select("kb_id", "band")
    held = cut(banded.join(shared, ["kb_id", "band"], "left_semi"), "bands")
    met = held.withColumnRenamed("doc_id", "a").join(held.withColumnRenamed("doc_id", "b"), ["kb_id", "band"]).where("a < b").select("kb_id", "a", "b").distinct()
    return _verified(met.withColumn("t", F.lit(threshold)), sets, copies).select("kb_id", "a", "b")
