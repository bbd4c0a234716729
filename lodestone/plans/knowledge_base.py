"""Knowledge bases on disk: settings, and snapshots of documents and postings that a rescan replaces."""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import runtime
from lodestone.operators import index
from lodestone.plans.report import WEIGHTS
from lodestone.runtime import cut
from lodestone.sources import files


@dataclass
class Settings:
    """One knowledge base. Values that can't be used are refused, so reports never see them."""

    kb_id: str
    name: str = ""
    folder: str = ""
    notes: str = ""
    near_threshold: float | None = None
    weights: dict[str, float] = field(default_factory=dict)
    is_partial: bool = False
    last_scan: int | None = None
    updated: int = 0
    version: int = 0

    def __post_init__(self):
        if self.near_threshold is not None and not 0.05 <= self.near_threshold <= 1:
            raise ValueError("near_threshold is 0.05 to 1, or None for the default")
        self.weights = {k: float(v) for k, v in self.weights.items() if k in WEIGHTS}
        if any(not math.isfinite(v) or v < 0 for v in self.weights.values()):
            raise ValueError("weights are finite and not negative")


class Conflict(Exception):
    """Somebody else has saved these settings since they were read."""


class SettingsStore:
    """Settings as small JSON files, one for each version of a knowledge base's settings, under any file system Spark knows.

    A version is written whole and then given its name, which can be given once; so of two that change the same version
    one succeeds, and a reader never sees half of one. Old versions are deleted."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _versions(self) -> dict[str, int]:
        found: dict[str, int] = {}
        for x in runtime.names_in(self.spark, self.folder):
            if m := re.fullmatch(r"(\w+)\.(\d+)\.json", x):
                found[m[1]] = max(found.get(m[1], 0), int(m[2]))
        return found

    def _path(self, kb_id: str, version: int) -> str:
        if not kb_id.isalnum():
            raise ValueError("ids are letters and digits")
        return f"{self.folder}/{kb_id}.{version}.json"

    def get(self, kb_id: str) -> Settings | None:
        self._path(kb_id, 0)
        version = self._versions().get(kb_id)
        return Settings(**json.loads(runtime.read_text(self.spark, self._path(kb_id, version)))) if version else None

    def save(self, settings: Settings) -> Settings:
        """Save what was read at settings.version (0: new) as the next version; Conflict if that isn't the last one."""
        now = self._versions().get(settings.kb_id, 0)
        new = replace(settings, version=settings.version + 1, updated=time.time_ns() // 1_000_000)
        if settings.version != now or not runtime.write_text(self.spark, self._path(settings.kb_id, new.version), json.dumps(asdict(new))):
            raise Conflict(f"{settings.kb_id} is at version {now}, not {settings.version}")
        for v in range(max(1, new.version - 5), new.version):
            runtime.delete(self.spark, self._path(settings.kb_id, v))
        return new

    def patch(self, kb_id: str, **values) -> Settings:
        """Change some values of the last version; the id can't be changed. Tried again if somebody else is faster."""
        for _ in range(20):
            old = self.get(kb_id) or Settings(kb_id)
            try:
                return self.save(Settings(**(asdict(old) | values | {"kb_id": kb_id, "version": old.version})))
            except Conflict:
                continue
        raise Conflict(f"{kb_id} changes too often")

    def delete(self, kb_id: str) -> bool:
        found = [x for x in runtime.names_in(self.spark, self.folder) if x.startswith(f"{kb_id}.")]
        return any([runtime.delete(self.spark, f"{self.folder}/{x}") for x in found])

    def clear(self) -> int:
        return sum(self.delete(x) for x in self._versions())

    def all(self, limit: int | None = None) -> list[Settings]:
        """Last changed first."""
        found = [self.get(x) for x in self._versions()]
        return sorted((x for x in found if x), key=lambda x: (-x.updated, x.kb_id))[:limit]


@dataclass
class Summary:
    """What a rescan did: documents by status, files read, folders that couldn't be opened, and whether it was stopped early."""

    counts: dict[str, int]
    read: int
    problems: list[tuple[str, str]]
    partial: bool


class Library:
    """Documents and postings as snapshots: folders of Parquet files by kb_id that are never changed, and a small file for each
    that names it; the last one is the current snapshot. Under any file system Spark knows.

    A rescan reads changed files only, replaces their rows and postings, and drops those of files that are gone
    (after a complete scan). Each knowledge base has its own snapshots, so others aren't touched."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _current(self, kb_id: str) -> tuple[int, str] | None:
        marks = [int(m[1]) for x in runtime.names_in(self.spark, f"{self.folder}/{kb_id}") if (m := re.fullmatch(r"current-(\d+)", x))]
        return (max(marks), f"{self.folder}/{kb_id}/{runtime.read_text(self.spark, f'{self.folder}/{kb_id}/current-{max(marks)}')}") if marks else None

    def kbs(self) -> list[str]:
        return [x for x in runtime.names_in(self.spark, self.folder) if self._current(x)]

    def read(self, what: str, kb_id: str | None = None) -> DataFrame | None:
        """docs or postings of one knowledge base or all."""
        paths = [f"{p[1]}/{what}" for k in ([kb_id] if kb_id else self.kbs()) if (p := self._current(k))]
        return self.spark.read.parquet(*paths) if paths else None

    def rescan(self, root: str, kb_id: str, portions: int = 1, on_progress: Callable[[int, int], None] | None = None, stop: Callable[[], bool] | None = None, settings: SettingsStore | None = None) -> Summary:
        """Bring a knowledge base up to its folder.

        New and changed files are read in portions; after each, on_progress gets how many portions are done, and of how many,
        and stop is asked whether to end early. A scan that ended early drops nothing and is marked partial in the settings,
        as is one that met folders it couldn't open."""
        at = self._current(kb_id)
        old_docs, old_postings = self.read("docs", kb_id), self.read("postings", kb_id)
        found = files.look(self.spark, root, kb_id, old_docs)
        parts, stopped = [], False
        for k in range(portions):
            some = found.only(F.pmod(F.xxhash64("rel"), F.lit(portions)) == k) if portions > 1 else found
            parts.append(cut(some.records.drop("ntok"), "read"))
            if on_progress:
                on_progress(k + 1, portions)
            if k + 1 < portions and stop and stop():
                stopped = True
                break
        new = reduce(lambda a, b: a.unionByName(b), parts)
        made = index.postings(new)
        problems = [(x.path, x.reason) for x in found.problems.orderBy("path").limit(1000).collect()]
        if old_docs is None:
            docs, posted = new, made
        else:
            docs = index.keep_only(index.upsert(old_docs.drop("ntok"), new), found.seen, complete=not stopped and not problems)
            posted = old_postings.join(new.select(*index.KEY), index.KEY, "left_anti").unionByName(made).join(docs.select(*index.KEY), index.KEY, "left_semi")
        version = uuid.uuid4().hex
        path = f"{self.folder}/{kb_id}/{version}"
        # terms sorted in files, so that a search's filter on terms skips row groups; the document in the order splits a hot term
        posted.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/postings")
        length = index.lengths(self.spark.read.parquet(f"{path}/postings"))
        docs.join(length, index.KEY, "left").write.parquet(f"{path}/docs")
        number = at[0] + 1 if at else 1
        if not runtime.write_text(self.spark, f"{self.folder}/{kb_id}/current-{number}", version):
            raise Conflict(f"{kb_id} was scanned by somebody else meanwhile")
        read = new.count()
        for x in parts:
            runtime.drop(x)
        counts = {x.status: x["count"] for x in self.read("docs", kb_id).groupBy("status").count().collect()}
        partial = stopped or bool(problems)
        if settings:
            settings.patch(kb_id, folder=root, is_partial=partial, last_scan=time.time_ns() // 1_000_000)
        if at:  # the snapshot before the last stays for those who read it
            self._forget(kb_id, keep={version, at[1].rsplit("/", 1)[-1]}, marks={number, at[0]})
        return Summary(counts, read, problems, partial)

    def _forget(self, kb_id: str, keep: set[str], marks: set[int]) -> None:
        for x in runtime.names_in(self.spark, f"{self.folder}/{kb_id}"):
            if x not in keep and x not in {f"current-{n}" for n in marks}:
                runtime.delete(self.spark, f"{self.folder}/{kb_id}/{x}")

    def drop(self, kb_id: str) -> None:
        """Forget a knowledge base; its source folder is never touched."""
        runtime.delete(self.spark, f"{self.folder}/{kb_id}")
