"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids fall in fold 0 of the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def pieces(batch: pa.RecordBatch, text_index: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most about `most` bytes together, one row at least."""
    sizes = pc.binary_length(batch.column(text_index)).fill_null(0).to_pylist()
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], list]], out: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and, of each row, what make()(texts) returns for its text (bytes or None).

    make() runs once in each task; the function it returns takes a list of
    texts and gives a list of tuples as `out` (a DDL string) declares them.
    """
    from pyspark.sql.types import StructType

    schema = StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(out).fields])
    names = [f.name for f in schema.fields]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        f, arrow = make(), to_arrow_schema(schema)
        for batch in batches:
            for part in pieces(batch, n):
                rows = f(part.column(n).to_pylist())
                cols = [part.column(i) for i in range(n)]
                cols += [pa.array([r[i] for r in rows], arrow.field(n + i).type) for i in range(len(names) - n)]
                yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) if c.type != arrow.field(i).type else c for i, c in enumerate(cols)], schema=arrow)

    return df.select(*keep, F.col(text_col).cast("binary").alias("__text")).mapInArrow(run, schema)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that the session names. Only a session on one machine (tests) may do without a name."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """(docs, the column that tells its rows apart and sorts as the ids do).

    That is the id itself, unless some id is null or repeated or ids are no whole numbers: then rows are
    numbered in the order of the ids, null ones last, and of the texts, and written so that the
    numbers stay.
    """
    whole = isinstance(docs.schema[id_col].dataType, IntegralType)
    odd = docs.groupBy(id_col).agg(F.count("*").alias("__n")).where((F.col("__n") > 1) | F.col(id_col).isNull())
    if whole and odd.isEmpty():
        return docs, id_col
    return cut(docs.orderBy(F.col(id_col).asc_nulls_last(), text_col).withColumn("__row", F.monotonically_increasing_id())), "__row"


def cut(df: DataFrame) -> DataFrame:
    """Writes a result to the shared checkpoint folder and goes on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows up to which a lookup table is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 100_000


def lookup(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A checkpointed table, marked for broadcast only if it has been counted and is small."""
    return F.broadcast(df) if df.count() <= most else df
