"""Duplicates hidden by formatting differences (problem 4).

Records with the same letters and digits, or with the same named fields in another order, are
one content. Canonical records are range-partitioned and sorted by a digest of their full key, adjacent
rows compared, and the full keys of the records that meet compared again.

Defined cases: null ids, null or empty texts and texts without a letter or digit belong to no
group; repeated rows of one id count once; an empty table gives an empty result; extra columns are
ignored. Texts are used whole, however long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.canon import letters, record_form
from lodestone.operators.components import components
from lodestone.runtime import cut, map_arrow

LETTERS, FIELDS = 0, 1


def _forms(text: str) -> list[tuple[int, str]]:
    """The canonical keys of a text in full: its letters and digits, and its fields in sorted order if it is made of such."""
    full = letters(text)
    fields = record_form(text) if full else None
    return [(LETTERS, full)] * bool(full) + [(FIELDS, fields)] * bool(fields)


def _digest(kind: int, full: str) -> bytes:
    return hashlib.sha256(b"%d" % kind + full.encode("utf-8", "surrogatepass")).digest()


def canonical_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """(id, kind, key): the canonical keys of a record, each as the 256-bit digest of the full key; full: with the column full.

    Every text with a letter or digit has a key of its letters and digits (kind 0); one made of
    named fields also has a key of its fields in sorted order (kind 1).
    """

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            found = [(i, k, x) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, x in _forms(text)]
            out = {"id": [x[0] for x in found], "kind": [x[1] for x in found], "key": [_digest(k, x) for _, k, x in found]}
            return out | ({"full": [x.encode("utf-8", "surrogatepass") for *_, x in found]} if full else {})

        return f

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null and text <> ''")
    return map_arrow(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, kind int, key binary" + ", full binary" * full)


def adjacent_copies(keys: DataFrame) -> DataFrame:
    """(kind, first_id, id): every row that isn't the smallest id of its run of equal (kind, key).

    Rows are range-partitioned and sorted by (kind, key, id); the id in the order splits the run of a
    hot key over as many partitions as its size asks for. The task that has sorted a partition scans
    it, comparing the keys of adjacent rows. Only a partition's first run may have begun in the one
    before: its rows keep their key, the last run of each batch leaves a row with its key and
    smallest id, and the first runs take the smallest id found under their key.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type = keys.schema["id"].dataType.simpleString()
    keys = cut(keys.distinct(), "keys")  # the range bounds are sampled from it
    ordered = keys.repartitionByRange(n, "kind", "key", "id").sortWithinPartitions("kind", "key", "id").select("kind", "key", "id")

    def make():
        state: list = [None, None, True]  # key and smallest id of the run at the end of the batch before; whether it is the partition's first

        def f(batch: pa.RecordBatch) -> dict:
            m, (kind, key, ids) = batch.num_rows, batch.columns
            full = np.empty((m, 5), np.int64)
            full[:, 0] = kind.to_numpy()
            full[:, 1:] = np.frombuffer(key.cast(pa.binary(32)).buffers()[1], np.int64)[key.offset * 4 :][: m * 4].reshape(m, 4)
            start = np.ones(m, bool)
            start[1:] = (full[1:] != full[:-1]).any(1)
            start[0] = state[0] is not None and bool((full[0] != state[0]).any())
            first = np.maximum.accumulate(np.where(start, np.arange(m), 0))
            names = np.array(ids.to_pylist(), object)
            firsts = names[first]
            ahead = np.flatnonzero(start)
            end = int(ahead[0]) if len(ahead) else m
            if state[0] is not None:
                firsts[:end] = state[1]
            inherited = np.zeros(m, bool)
            inherited[:end] = state[2]
            state[:] = [full[-1].copy(), firsts[-1], state[2] and not len(ahead)]
            keep = np.flatnonzero(inherited | (names != firsts))
            at = pa.array(np.append(keep, m - 1))
            keyed = np.append(inherited[keep], True)
            return {"kind": kind.take(at), "key": pa.array([k if x else None for k, x in zip(key.take(at).to_pylist(), keyed)], pa.binary()), "first_id": [*firsts[keep].tolist(), firsts[-1]], "id": [*names[keep].tolist(), firsts[-1]]}

        return f

    found = cut(map_arrow(ordered, make, f"kind int, key binary, first_id {id_type}, id {id_type}"), "runs")
    keyed = found.where("key is not null")
    smallest = keyed.groupBy("kind", "key").agg(F.min("first_id").alias("smallest"))
    moved = keyed.select("kind", "key", "id").join(smallest, ["kind", "key"]).select("kind", F.col("smallest").alias("first_id"), "id")
    return found.where("key is null").select("kind", "first_id", "id").unionByName(moved).where("id <> first_id").distinct()


def verified(copies: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """copies (kind, first_id, id) whose full keys are equal, not their digests alone.

    Full keys are made again for the records in a run only, and each is compared with its run's first.
    Were two keys to share a digest, the records that differ would be grouped by their full keys."""
    ends = copies.select("kind", F.col("first_id").alias("id"), "first_id").unionByName(copies.select("kind", "id", "first_id")).distinct()
    some = docs.join(ends.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")
    keys = canonical_keys(some, id_col, text_col, full=True).select("id", "kind", "full").join(ends, ["id", "kind"])
    keys = cut(keys.dropDuplicates(["id", "kind", "first_id"]), "full")
    firsts = keys.where("id = first_id").select("kind", "first_id", F.col("full").alias("first_full"))
    both = keys.where("id <> first_id").join(firsts, ["kind", "first_id"])
    same = both.where("full = first_full").select("kind", "first_id", "id")
    other = both.where("full <> first_full").select("kind", "full", "id")
    regrouped = other.join(other.groupBy("kind", "full").agg(F.min("id").alias("first_id")), ["kind", "full"]).where("id <> first_id")
    return same.unionByName(regrouped.select("kind", "first_id", "id"))


def layout_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(first_id, doc_id): each group's smallest id with each other id of the group.

    The runs of letters keys are groups already. Where the records of one run of fields keys lie in
    several of these, the groups are joined; the graph for that has only the groups concerned.
    """
    met = adjacent_copies(canonical_keys(docs, id_col, text_col))
    found = cut(verified(cut(met, "copies"), docs, id_col, text_col), "verified")
    same = found.where(f"kind = {LETTERS}").select("first_id", "id")
    fields = found.where(f"kind = {FIELDS}").select(F.col("first_id").alias("p"), F.col("id").alias("q"))
    label = lambda side: same.select(F.col("id").alias(side), F.col("first_id").alias(f"{side}_label"))
    edges = fields.join(label("p"), "p", "left").join(label("q"), "q", "left").select(F.coalesce("p_label", "p").alias("a"), F.coalesce("q_label", "q").alias("b"))
    joined = components(edges.where("a <> b")).where("node <> root")
    moved = same.join(joined.withColumnRenamed("node", "first_id"), "first_id", "left").select(F.coalesce("root", "first_id").alias("first_id"), F.col("id").alias("doc_id"))
    return moved.unionByName(joined.select(F.col("root").alias("first_id"), F.col("node").alias("doc_id")))


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, copies): one representative per content, the smallest id, with its number of records.

    Records without a letter or digit are each a content of their own.
    """
    groups = cut(layout_groups(docs, id_col, text_col), "groups")
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id")).distinct()
    sizes = groups.groupBy(F.col("first_id").alias("doc_id")).agg(F.count("*").alias("more"))
    return ids.join(groups.select("doc_id"), "doc_id", "left_anti").join(sizes, "doc_id", "left").select("doc_id", (F.coalesce("more", F.lit(0)) + 1).alias("copies"))
