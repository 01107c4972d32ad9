"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that the contracts mean: space and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of text that a Python operator works on at once.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where they don't share the driver's path: send its source, once per context."""
    context = spark.sparkContext
    if getattr(context, "_quarry_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="quarry-source-")) / "quarry-source.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    context._quarry_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master: {master})")
        root = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/quarry-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors and is smaller than checkpoint()."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._quarry_path = path
    return written


def discard(*written: DataFrame | None) -> None:
    """Delete tables that ``materialise`` wrote, where nothing that is still to be computed reads them."""
    for df in written:
        path = getattr(df, "_quarry_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
            df._quarry_path = None


def named(columns: Iterable[str]) -> list[Column]:
    """Columns by their exact names, whatever characters these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Carried:
    """Columns that pass through a Python operator under plain names, since it takes no others, and get their own back."""

    def __init__(self, docs: DataFrame, columns: Iterable[str]):
        self.columns = list(columns)
        self.names = [f"_q_c{i}" for i in range(len(self.columns))]
        self.fields = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(self.names, self.columns, strict=True)]

    def inside(self) -> list[Column]:
        return [c.alias(n) for c, n in zip(named(self.columns), self.names, strict=True)]

    def outside(self) -> list[Column]:
        return [F.col(n).alias(c) for n, c in zip(self.names, self.columns, strict=True)]


def whole_text(column: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most ``rows`` rows and about ``most`` bytes of the given column."""
    start, held = 0, 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or held + n > most):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)
