"""Tables written to the folder that all executors share, to cut a lineage or to use costly rows twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, as in tests, one of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.gettempdir() + "/flowlens-shared"
    return folder.rstrip("/")


def computed_once(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Adds costly columns so that filters on them aren't pushed below, which would compute each again for every mention.

    The columns come out of a generator of one row, which predicates don't pass.
    Names of ``df`` and of the columns must differ.
    """
    return df.select(*df.columns, F.inline(F.array(F.struct(*columns))))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and returns them as read from there.

    A lost executor then costs no recomputation of what led to them. The table
    stays until ``discard`` or until the folder is emptied.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/flowlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._flowlens_path = path
    return out


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """``docs`` with its columns other than ``own`` as one struct _rest, so that no name of a caller meets one that an operator adds."""
    rest = [_quoted(c) for c in docs.columns if c not in own]
    return docs.select(*[c for c in docs.columns if c in own], F.struct(*rest or [F.lit(0).alias("none")]).alias("_rest"))


def unpacked(rows: DataFrame, docs: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """The columns of ``docs`` in their order, from rows that ``packed`` made."""
    return rows.select(*[F.col(c) if c in own else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def with_row_keys(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``name``, a long of each row's own that rises with doc_id, nulls last, and among equal ids with the text's hash."""
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    return materialize(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "keyed")


def discard(df: DataFrame) -> None:
    """Deletes a table of ``materialize`` that nothing needs any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._flowlens_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
