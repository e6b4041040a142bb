"""Shared plumbing of the training-data operators: reading, checkpoints, Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one Arrow batch, about; one longer row is a batch of its own.
ARROW_BYTES = 4 << 20
_SCRATCH: ContextVar[tuple[str, ...]] = ContextVar("larkspur_scratch", default=())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only a local session may do without one: executors
    elsewhere could not see a folder of this machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="larkspur-checkpoint-"))
    return str(sc.getCheckpointDir())


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that checkpoint() writes inside are deleted at the end, but for those that go out."""
    folder = f"{ensure_checkpoint_dir(spark)}/larkspur-{uuid.uuid4().hex}"
    token = _SCRATCH.set((*_SCRATCH.get(), folder))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        delete(spark, folder)


def checkpoint(df: DataFrame, out: bool = False) -> DataFrame:
    """Write df once as a table in the shared checkpoint folder and read it back: lineage and statistics start anew.

    Inside scratch() the table lasts as long as that; out: as long as the scratch() around it, or for good.
    (A frame from DataFrame.checkpoint() keeps size estimates of its plan. In a loop of joins these multiply, and their
    digits alone soon cost more than the data.)
    """
    stack = (ensure_checkpoint_dir(df.sparkSession), *_SCRATCH.get())
    folder = stack[max(0, len(stack) - 1 - out)]
    path = f"{folder}/larkspur-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let executors import this package where PYTHONPATH doesn't already: Spark serves it to them as an archive."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(root) in on_path or getattr(sc, "_larkspur_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="larkspur-code-"), "larkspur.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "larkspur").rglob("*.py")):
            z.write(f, str(f.relative_to(root)))
    sc.addPyFile(str(archive))
    sc._larkspur_shipped = True


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with batches of about ARROW_BYTES at most, unless the session has a bound of its own."""
    ship(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key, str(2**31 - 1))) >= 1 << 26:
        conf.set(key, str(ARROW_BYTES))
    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """One output batch for each input batch, in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return map_batches(df, run, schema)


def narrow(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, of the types that the operators expect; others (whatever their names) are left behind."""
    kinds = {"doc_id": "bigint", "text": "string"}
    return docs.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in cols])


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null becomes the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of the texts of a batch; null becomes no bytes."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]
