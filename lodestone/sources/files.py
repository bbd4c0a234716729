"""Folders of files as document records. Source folders are only read."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.runtime import cut
from lodestone.sources.extract import LARGEST, READ, extract

# Folders and files that are left out (fixed values).
IGNORED_FOLDERS = ".git .hg .svn .bzr node_modules __pycache__ .pytest_cache .mypy_cache .venv venv env .tox .gradle .idea .vscode $recycle.bin .trash .trashes .obsidian dist build .next .cache .dropbox.cache .tmp.driveupload .tmp.drivedownload .onedrive.tmp .sync .synctemp .seafile-data $tf".split() + ["system volume information"]
IGNORED_FILES = r"(?i)^(?:~\$.*|\..*\.sw[a-p]|.*\.(?:tmp|temp|part|crdownload|partial|lock)|\.ds_store|thumbs\.db|desktop\.ini|icon\r|\.gitignore)$"
RECORD = "kb_id string, doc_id string, rel string, path string, name string, folder string, ext string, size long, mtime long, status string, reason string, author string, chash string, nwords int, text string"


def ignored(rel) -> object:
    folders = "|".join(map(re.escape, IGNORED_FOLDERS))
    return F.lower(rel).rlike(rf"(?:^|/)(?:{folders}|~\$[^/]*)/") | F.regexp_substr(rel, F.lit(r"[^/]*$")).rlike(IGNORED_FILES)


def listing(files: DataFrame, root: str, kb_id: str) -> DataFrame:
    """(kb_id, rel, path, name, folder, ext, size, mtime, content) of rows of the binaryFile source under root.
    Columns other than content come from the listing; a plan that doesn't use content never opens a file."""
    path = F.regexp_replace(F.col("path"), r"^file:/*(?=/)", "")
    rel = F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.lit(1_000_000))
    out = files.select(F.lit(kb_id).alias("kb_id"), rel.alias("rel"), path.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), "content")
    out = out.where(~ignored(F.col("rel")))
    name = F.regexp_substr("rel", F.lit(r"[^/]*$"))
    ext = F.lower(F.coalesce(F.regexp_substr(name, F.lit(r"(?<=.)\.[^.]*$")), F.lit("")))
    return out.select("kb_id", "rel", "path", name.alias("name"), F.regexp_replace("rel", r"/?[^/]*$", "").alias("folder"), ext.alias("ext"), "size", "mtime", "content")


#: Bytes of files that are handed to Python at once, and that one task reads, at most (or one file).
BATCH_BYTES, TASK_BYTES = 64 << 20, 128 << 20


def _lister():
    """A function that lists one folder: local paths by the system, others by pyarrow, if it knows the scheme."""

    def list_one(path: str) -> list[tuple[str, bool, int, int, str]]:
        """(path, whether a folder, size, milliseconds, problem) of what a folder holds; links are left out."""
        import os

        local = re.sub(r"^file:/*(?=/)", "", path)
        try:
            if "://" not in local:
                out = []
                for x in sorted(os.scandir(local), key=lambda x: x.name):
                    if not x.is_symlink():
                        about = x.stat()
                        out.append((x.path, x.is_dir(), about.st_size, about.st_mtime_ns // 1_000_000, ""))
                return out
            from pyarrow import fs

            system, at = fs.FileSystem.from_uri(path)
            scheme = path.split("://", 1)[0]
            return [(f"{scheme}://{x.path}", x.type == fs.FileType.Directory, x.size or 0, (x.mtime_ns or 0) // 1_000_000, "") for x in system.get_file_info(fs.FileSelector(at))]
        except OSError as error:
            return [(path, True, 0, 0, error.strerror or str(error) or "cannot be opened")]

    return list_one


def walk(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files, problems): (path, length, ms) of all files under root, and (path, reason) of folders that can't be opened.

    Folders are listed by the executors, one level of the tree a round, so neither the driver nor one task goes through
    all files; ignored folders aren't looked into. Links aren't followed, so each file comes once."""
    list_one = _lister()
    schema = "path string, is_dir boolean, length long, ms long, problem string"

    def run(batches):
        for pdf_ in batches:
            got = [x for p in pdf_.path for x in list_one(p)]
            yield pd.DataFrame(got, columns=["path", "is_dir", "length", "ms", "problem"]).astype({"is_dir": bool, "length": "int64", "ms": "int64"})

    folders = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    levels, n = [], 1
    while n:
        level = cut(folders.repartition(max(1, min(n, 4096))).mapInPandas(run, schema), "listing")
        levels.append(level)
        name = F.lower(F.regexp_substr("path", F.lit(r"[^/]*$")))
        folders = level.where((F.col("problem") == "") & F.col("is_dir") & ~name.isin(IGNORED_FOLDERS) & ~name.startswith("~$")).select("path")
        n = folders.count()
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    return every.where("problem = '' and not is_dir").select("path", "length", "ms"), every.where("problem <> ''").select("path", F.col("problem").alias("reason"))


def _opened(paths: DataFrame) -> DataFrame:
    """paths (path, ext, size) with content: files that aren't read, being of another kind or too large, aren't opened. Files are
    spread over tasks by their size, and handed on in batches of bounded size."""
    wanted = F.col("ext").isin(sorted(READ)) & (F.col("size") <= LARGEST)
    total = paths.agg(F.sum(F.when(wanted, F.col("size")).otherwise(0)), F.count("*")).first()
    n = max(1, min(100_000, int((total[0] or 0) / TASK_BYTES) + int((total[1] or 0) / 5_000) + 1))
    rows = paths.withColumn("wanted", wanted).repartition(max(n, min(total[1] or 1, paths.sparkSession.sparkContext.defaultParallelism)))
    names = [*paths.columns]

    def run(batches):
        def read(path: str) -> bytes | None:
            local = re.sub(r"^file:/*(?=/)", "", path)
            try:
                if "://" not in local:
                    with open(local, "rb") as file:
                        return file.read()
                from pyarrow import fs

                system, at = fs.FileSystem.from_uri(path)
                with system.open_input_stream(at) as file:
                    return file.read()
            except OSError:
                return None

        for frame in batches:
            part, size = [], 0
            for x in frame.itertuples(index=False):
                part.append((*x[:-1], read(x.path) if x.wanted else None, bool(x.wanted)))
                size += x.size if x.wanted else 0
                if size > BATCH_BYTES or len(part) >= 2000:
                    yield _records_of(pd.DataFrame(part, columns=[*names, "content", "opened"]))
                    part, size = [], 0
            if part:
                yield _records_of(pd.DataFrame(part, columns=[*names, "content", "opened"]))

    return rows.mapInPandas(run, RECORD)


def _records_of(frame: pd.DataFrame) -> pd.DataFrame:
    """The records of listed files with their contents; a file that can't be opened is unreadable."""
    got = []
    for content, opened, ext, size in zip(frame.pop("content"), frame.pop("opened"), frame.ext, frame["size"]):
        if size > LARGEST and ext in READ:
            got.append(("unreadable", "", f"larger than {LARGEST >> 20} MB", None))
        elif opened and content is None:
            got.append(("unreadable", "", "the file could not be opened", None))
        else:
            got.append(extract(bytes(content or b""), ext))
    status, text, reason, author = zip(*got) if got else ((), (), (), ())
    ok = [x == "ok" for x in status]
    norm = [re.sub("[^a-z0-9]+", " ", t.casefold()).strip() for t in text]
    return frame.assign(
        doc_id=[hashlib.sha1(r.encode("utf-8", "surrogatepass")).hexdigest()[:16] for r in frame.rel], status=status, reason=reason, author=author, text=text,
        chash=[hashlib.sha1(n.encode()).hexdigest() if k else None for n, k in zip(norm, ok)], nwords=pd.array([len(t.split()) for t in text], "int32"),
    )[[c.split()[0] for c in RECORD.split(", ")]]


def records(listed: DataFrame) -> DataFrame:
    """One record for every listed file with its content, read or not: the status says ok, unreadable or skipped, and the reason why.
    For the binaryFile source of a stream, whose files come with their contents."""
    wanted = F.col("ext").isin(sorted(READ)) & (F.col("size") <= LARGEST)
    rows = listed.withColumn("content", F.when(wanted, F.col("content")))

    def run(batches):
        for frame in batches:
            for at in range(0, len(frame), 50):
                part = frame.iloc[at : at + 50].reset_index(drop=True)
                yield _records_of(part.assign(opened=part.content.notna()))

    return rows.mapInPandas(run, RECORD)


@dataclass
class Scan:
    """What a scan of a folder found: new and changed files, of which it makes records, (kb_id, rel) of all files, and folders that can't be opened."""

    new: DataFrame
    seen: DataFrame
    problems: DataFrame

    @property
    def records(self) -> DataFrame:
        return _opened(self.new).withColumn("ntok", F.lit(None).cast("int"))

    def only(self, which: Column) -> Scan:
        """The same with some of the new files."""
        return Scan(self.new.where(which), self.seen, self.problems)


def look(spark: SparkSession, root: str, kb_id: str, known: DataFrame | None = None) -> Scan:
    """A folder's files; with known (kb_id, rel, size, mtime), records of new and changed ones only.

    Which files are new is settled on the listing, before any is opened."""
    found, problems = walk(spark, root)
    files = found.select("path", F.timestamp_millis("ms").alias("modificationTime"), "length", F.lit(None).cast("binary").alias("content"))
    listed = listing(files, root, kb_id).drop("content")
    new = listed
    if known is not None:
        new = listed.join(known.select("kb_id", "rel", "size", "mtime").distinct(), ["kb_id", "rel", "size", "mtime"], "left_anti")
    return Scan(new, listed.select("kb_id", "rel"), problems)


def scan(spark: SparkSession, root: str, kb_id: str, known: DataFrame | None = None) -> DataFrame:
    """Records of a folder's files; see look."""
    return look(spark, root, kb_id, known).records


def seen(spark: SparkSession, root: str, kb_id: str) -> DataFrame:
    """(kb_id, rel) of all files of a folder, for index.keep_only."""
    return look(spark, root, kb_id).seen
