"""Mixing sources to target shares of tokens (problem 9).

Every document of a listed source gets a hash-random key; the documents of all sources are
range-sorted by (source, key), prefix sums of token counts are made over the sorted partitions, and
each source is cut at its budget: whole epochs of all its documents first, then the documents of
the prefix that fills the rest.

Defined cases: documents of unlisted or null sources stay out; null and empty texts have 0 tokens
and the uses of their source's whole epochs; a target with a null source, share or cap, or a share
or cap below 0, counts as share or cap 0, and a source listed twice as its first share in order of
size, largest first; a listed source without tokens reaches share 0. Repeated rows are documents
of their own. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.tokenize import TOKENIZERS, count_tokens
from lodestone.runtime import cut, map_arrow


@dataclass
class Budget:
    target_share: float
    max_repeats: int
    size: int  # tokens of the source's documents taken once
    tokens: float = 0.0  # tokens to take

    @property
    def most(self) -> int:
        return self.size * self.max_repeats


def budgets(targets: list[tuple[str, float | None, int | None]], sizes: dict[str, int], fill: bool = False) -> dict[str, Budget]:
    """How many tokens to take of each source: its share of all sources' tokens taken once, or as much as its cap allows.

    With fill, what capped sources leave over is shared out to the others in proportion to their
    shares, so that the total is kept and not each single share.
    """
    out: dict[str, Budget] = {}
    for source, share, cap in sorted((x for x in targets if x[0] is not None), key=lambda x: (x[0], -(x[1] or 0))):
        out.setdefault(source, Budget(max(share or 0, 0), max(cap or 0, 0), sizes.get(source, 0)))
    total = sum(b.size for b in out.values())
    for b in out.values():
        b.tokens = min(b.target_share * total, b.most)
    while fill:
        open_, left = [b for b in out.values() if 0 < b.tokens < b.most], total - sum(b.tokens for b in out.values())
        if left < 0.5 or not open_:
            break
        shares = sum(b.target_share for b in open_)
        for b in open_:
            b.tokens = min(b.tokens + left * b.target_share / shares, b.most)
    return out


@dataclass
class Mixture:
    documents: DataFrame  # doc_id, source, n_tokens, uses
    shares: DataFrame  # source, target_share, max_repeats, size, tokens, share_of_target_total, share


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0, fill: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, size_col: str | None = None) -> Mixture:
    """How often to use each document of the listed sources, and the shares reached.

    size_col: a column to take sizes from (null or negative: 0) instead of counting tokens.

    The table of targets is read to the driver: it lists the sources of a mixture by hand.
    """
    spark = docs.sparkSession
    wanted = [(x.source, x.target_share, x.max_repeats) for x in targets.select("source", "target_share", "max_repeats").collect()]
    names = [x[0] for x in wanted if x[0] is not None]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(size_col or text_col).alias("text")).where(F.col("source").isin(names))
    given = rows.select("doc_id", "source", F.greatest(F.coalesce("text", F.lit(0)), F.lit(0)).cast("long").alias("n_tokens")) if size_col else None
    counted = cut(count_tokens(rows, ["doc_id", "source"], "text", tokenizer, folder) if given is None else given, "counted")
    sizes = {x.source: x.n for x in counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    plan = budgets(wanted, sizes, fill)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["source", "key", "doc_id"]
    # the key is a digest that SQL has as well, so that a mixture can be made again elsewhere
    ranked = counted.withColumn("key", F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), 1, 16))
    ranked = ranked.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("piece"), *order, "n_tokens")
    id_type = ranked.schema["doc_id"].dataType.simpleString()

    def make():
        state: list = [None, 0]  # source at the end of the batch before, and its sum within the partition

        def f(batch: pa.RecordBatch) -> dict:
            n = batch.column(4).to_numpy()
            code = batch.column(1).dictionary_encode()
            found, code = code.dictionary.to_pylist(), code.indices.to_numpy()
            sums = np.cumsum(n)
            edge = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            base = np.append(0, sums[edge[1:] - 1])
            base[0] -= state[1] if state[0] == found[code[0]] else 0
            sums = sums - np.repeat(base, np.diff(np.append(edge, len(n))))
            state[:] = [found[code[-1]], int(sums[-1])]
            return {"piece": batch.column(0), "source": batch.column(1), "doc_id": batch.column(3), "n_tokens": batch.column(4), "upto": sums}

        return f

    # sums are made in the task that sorts a partition; a row for each partition and source in it then puts them together
    local = cut(map_arrow(ranked, make, f"piece int, source string, doc_id {id_type}, n_tokens long, upto long"), "ranked")
    pieces = local.groupBy("source", "piece").agg(F.max("upto").alias("size"))
    before = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("source", "piece", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    epochs = {s: (min(int(b.tokens // b.size), b.max_repeats) if b.size else 0) for s, b in plan.items()}
    rest = {s: b.tokens - epochs[s] * b.size if epochs[s] < b.max_repeats else 0.0 for s, b in plan.items()}
    cuts = spark.createDataFrame([(s, epochs[s], float(rest[s])) for s in sorted(plan)], "source string, epochs long, rest double")
    # the document over the edge is used if more than half of it fits
    fits = (F.col("before") + F.col("upto") - F.col("n_tokens") / 2 < F.col("rest")) & (F.col("n_tokens") > 0)
    used = local.join(F.broadcast(offsets), ["source", "piece"]).join(F.broadcast(cuts), "source")
    used = used.select("doc_id", "source", "n_tokens", (F.col("epochs") + fits.cast("long")).alias("uses"))
    taken = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
    total = sum(b.size for b in plan.values())
    given = spark.createDataFrame([(s, float(b.target_share), b.max_repeats, b.size) for s, b in sorted(plan.items())], "source string, target_share double, max_repeats int, size long")
    shares = given.join(F.broadcast(taken), "source", "left").na.fill(0, ["tokens", "most_uses"])
    shares = shares.crossJoin(F.broadcast(taken.agg(F.sum("tokens").alias("all_tokens")))).select(
        "source", "target_share", "max_repeats", "size", "tokens", "most_uses", (F.col("tokens") / F.lit(float(max(total, 1)))).alias("share_of_size"), F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).alias("share")
    )
    return Mixture(used, shares)
