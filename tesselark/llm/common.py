"""Helpers shared by the corpus operators: the shared folder, written tables, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts name it: space and \x09 to \x0D.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: The tables that written() has made and clean_up() or temporary() have not deleted.
_MADE: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one is made and set if Spark runs on this machine alone; on
    a cluster no folder of one machine is ever used, and ValueError is raised."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tesselark-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there and any executor can read it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tesselark_path = path
    _MADE.append(out)
    return out


def stored_again(table: DataFrame) -> DataFrame:
    """A table made by written(), read once more, so that it can be joined with itself."""
    return table.sparkSession.read.schema(table.schema).parquet(table._tesselark_path)


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder within the shared one; all tables of written() lie there."""
    return f"{shared_dir(spark)}/tesselark-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete all tables of this application in the shared folder. Results of operators may read some of them until they are stored, so call it after that."""
    _MADE.clear()
    _delete(spark, scratch_dir(spark))


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that written() makes within, but for those given to the function it yields."""
    start, kept = len(_MADE), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table._tesselark_path)
        return table

    yield keep
    own = _MADE[start:]
    del _MADE[start:]
    for t in own:
        if t._tesselark_path in kept:
            _MADE.append(t)
        else:
            discard(t)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that no later result reads."""
    for t in tables:
        path = getattr(t, "_tesselark_path", None)
        if path:
            _delete(t.sparkSession, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def column(name: str) -> Column:
    """The column of exactly that name."""
    return F.col("`" + name.replace("`", "``") + "`")


def own_prefix(*tables: DataFrame) -> str:
    """A prefix that no column of the tables begins with: _tk_, with more underscores where the input has such names."""
    names, prefix = [c.lower() for t in tables for c in t.columns], "_tk_"
    while any(n.startswith(prefix) for n in names):
        prefix += "_"
    return prefix


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(column(name).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """body(v) with value computed once per row: a lambda variable is bound, not inlined into inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
