"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs  # noqa: F401 makes pa.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where that is unset and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return base


_LOCAL: dict[str, str] = {}
#: Tables written and not yet dropped, in order.
_WRITTEN: list[str] = []


@contextlib.contextmanager
def settings(spark: SparkSession, **values):
    """Session settings (dots as double underscores) that hold within the block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, and a lost executor costs no recomputation.

    The write's shuffle files go when it has ended; nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    _WRITTEN.append(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._table = path  # noqa: SLF001 our own mark
    return made


def _delete(path: str) -> None:
    try:
        system, place = pa.fs.FileSystem.from_uri(path)
        system.delete_dir(place)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):  # only Spark's readers know this path: the folder's owner clears it
        pass


def drop(*tables: DataFrame) -> None:
    """Delete tables made by cut that no plan reads any more."""
    for t in tables:
        path = getattr(t, "_table", None)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(path)


def written() -> int:
    """A mark for drop_since."""
    return len(_WRITTEN)


def drop_since(mark: int, *kept: DataFrame) -> None:
    """Delete the tables made since the mark, but for those given."""
    keep = {getattr(t, "_table", None) for t in kept}
    for path in [p for p in _WRITTEN[mark:] if p not in keep]:
        _WRITTEN.remove(path)
        _delete(path)


@atexit.register
def _clear() -> None:
    """What is left when the program ends is read by no plan."""
    for path in _WRITTEN:
        _delete(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fewer(batches, rows: int = 500):
    """Batches of at most so many rows: what a function makes of a batch is bounded by rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


#: A look-up's answer is repeated so often, so that rows of one hot key are spread over as many tasks.
SALTS = 16


def looked_up(rows: DataFrame, key: str, table: DataFrame, by: str, *salt: str) -> DataFrame:
    """rows joined with a small-rowed table on key = by; rows of a hot key are dealt by the columns `salt`."""
    spread = table.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS))))).withColumnRenamed(by, "_by")
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int"))
    return dealt.join(spread, (F.col(key) == F.col("_by")) & (F.col("_deal") == F.col("_salt"))).drop("_by", "_salt", "_deal")
