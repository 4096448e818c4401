"""Session helpers that the operators share: the folder all executors see, and stored tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import ExitStack
from itertools import chain
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parents[2])
DIR_KEY = "spark.checkpoint.dir"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep their Arrow batches small."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), REPO) if x)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the session's checkpoint folder. Without either, one is made in local mode
    (tests), where driver and executors are one process; on a cluster it raises, as other machines would not see it."""
    context = spark.sparkContext
    if base := context.getConf().get(DIR_KEY) or context.getCheckpointDir():
        return base.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {DIR_KEY} to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="latticeframe-"))
    return context.getCheckpointDir().rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def gathered(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """Narrow rows in tasks of about per_task rows, where a shuffle has dealt them thinner: fewer tiny files."""
    return df.coalesce(max(1, -(-rows // per_task)))


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it back. rows: a bound, for narrow tables."""
    path = new_dir(df.sparkSession, name)
    (df if rows is None else gathered(df, rows)).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def stored_by_workers(df: DataFrame, make, kinds: str, name: str) -> DataFrame:
    """Store what make(batches) yields, as stored(df.mapInArrow(make, kinds)) would, but let the Python workers write the
    Parquet files themselves: the rows do not pass through the JVM again. A file appears only when it is whole."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    files, at = file_system(path)
    files.create_dir(at, recursive=True)

    def write(batches):
        rows = iter(make(batches))
        first = next(rows, None)
        if first is None:
            return
        count = 0

        def fill(out):
            nonlocal count
            with pq.ParquetWriter(out, first.schema, compression="snappy") as w:
                for batch in chain([first], rows):
                    w.write_batch(batch)
                    count += batch.num_rows

        publish(f"{path}/part-{TaskContext.get().partitionId():07d}.parquet", fill)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([count], pa.int64())})

    total = df.mapInArrow(write, "rows long").agg({"rows": "sum"}).first()[0]
    out = spark.read.schema(kinds).parquet(path)
    out._stored_at, out._rows = path, total or 0
    return out


def kept(df: DataFrame, name: str, rows: int) -> DataFrame:
    """stored() for narrow tables of at most `rows` rows, written by the workers."""
    return stored_by_workers(gathered(df, rows), iter, df.schema, name)


def drop(*tables: DataFrame) -> None:
    """Delete what stored() wrote, when nothing reads it any more."""
    for df in tables:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder's URI, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def publish_all(uris: Sequence[str], write) -> list[int]:
    """Let write(*streams) fill private files, then move them into place: a retried task replaces whole files only. Returns their sizes."""
    with ExitStack() as opened:
        files, path = file_system(uris[0])
        folder = path.rpartition("/")[0]
        files.create_dir(folder, recursive=True)
        private = [f"{folder}/_{uuid.uuid4().hex}.part" for _ in uris]  # readers pass over names with an underscore
        write(*(opened.enter_context(files.open_output_stream(p)) for p in private))
    for p, uri in zip(private, uris, strict=True):
        files.move(p, file_system(uri)[1])
    return [files.get_file_info(file_system(uri)[1]).size for uri in uris]


def publish(uri: str, write) -> int:
    """publish_all() for one file."""
    return publish_all([uri], write)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", most: int = 500_000, native: bool = False, mark: str = "text_hash", mark_of=None) -> DataFrame:
    """docs less the rows whose id and text are in gone (the id and a column `mark`, a hash of the text; stored first).

    Rows that share an id with another text stay, and all copies of a row go together. Rows with a null id stay.
    gone is broadcast only if it has at most `most` rows. mark_of is the column that docs have as mark, by default the
    xxhash64 of the text.
    """
    named = gone.select(F.col(id_col).alias("__gone_id"), F.col(mark).alias("__gone_mark")).distinct()
    named = stored(named, "gone") if native else stored_by_workers(named, iter, named.schema, "gone")
    mark_of = F.xxhash64(docs["text"].cast("string")) if mark_of is None else mark_of
    same = (docs[id_col] == F.col("__gone_id")) & (mark_of == F.col("__gone_mark"))
    return docs.join(F.broadcast(named) if named.count() <= most else named, same, "left_anti")
