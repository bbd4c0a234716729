"""Session helpers: reading tables, and cutting lineage in a folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (tests, local mode) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not _own:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own.append(tempfile.mkdtemp(prefix="lodestone-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return _own[0]


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    The result survives the loss of executors, is columnar and compressed (smaller than
    checkpoint()'s rows) and may be scanned several times without computing df again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session may be gone already
        pass


def drop(table: DataFrame) -> None:
    """Delete a table that cut() has written, once no frame built on it is needed."""
    written = (table.sparkSession, getattr(table, "_cut_path", None))
    if written in _written:
        _written.remove(written)
        _delete(*written)


def drop_cuts() -> None:
    """Delete every table that cut() has written; frames built on them can't be read afterwards."""
    while _written:
        _delete(*_written.pop())


atexit.register(drop_cuts)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder of any file system holds; none if there is no such folder."""
    fs, p = _at(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, under its name only when complete; False if there is one of that name already."""
    fs, p = _at(spark, path)
    if fs.exists(p):
        return False
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(new)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    try:
        return bool(fs.rename(new, p))
    finally:
        fs.delete(new, False)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return bool(fs.delete(p, True))


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """mapInArrow with one worker object a task: make() -> f(batch) -> columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                got = f(batch)
                yield pa.RecordBatch.from_arrays([_array(got[x.name], x.type) for x in out], schema=out)

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)
