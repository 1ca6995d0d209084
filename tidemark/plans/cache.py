"""Stage results by content: a cell's key is a digest of its stage, parameters, input's identity and parents' keys."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..errors import CacheError

KEY_LENGTH = 32


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; what JSON can't hold is an error."""
    try:
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except (TypeError, ValueError) as e:
        raise CacheError(f"not a cache parameter: {e}") from e


def key(stage: str, params: dict, identity: str, parents: list[str]) -> str:
    return hashlib.sha256(canonical({"stage": stage, "params": params, "identity": identity, "parents": sorted(parents)}).encode()).hexdigest()[:KEY_LENGTH]


@dataclass
class Cell:
    """A folder <root>/<stage>/<key> with Parquet; a reader trusts it only if Spark's success mark is there."""

    spark: SparkSession
    root: str
    stage: str
    key: str
    enabled: bool = True

    @property
    def path(self) -> str:
        return f"{self.root}/{self.stage}/{self.key}"

    def _exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def hit(self) -> bool:
        return self.enabled and self._exists("_SUCCESS")

    def load(self) -> DataFrame:
        if not self.hit():
            raise CacheError(f"{self.stage} has no result {self.key}")
        return self.spark.read.parquet(self.path)

    def save(self, df: DataFrame) -> DataFrame:
        """Written by Spark's commit protocol: the success mark comes last, so a broken write is a miss."""
        df.write.mode("overwrite").parquet(self.path)
        return self.spark.read.parquet(self.path)


def fingerprint(folder: str | None = None) -> str:
    """A digest of the package's Python files, names and contents: part of the identity, so that a change of code renews all results."""
    import pathlib

    base = pathlib.Path(folder) if folder else pathlib.Path(__file__).parent.parent
    made = hashlib.sha256()
    for path in sorted(base.rglob("*.py")):
        made.update(path.relative_to(base).as_posix().encode() + b"\0" + hashlib.sha256(path.read_bytes()).digest())
    return made.hexdigest()[:KEY_LENGTH]


#: Bytes of each of the three places that a sampled identity looks at.
SAMPLE = 1 << 20


def file_identity(spark: SparkSession, path: str, mode: str = "stat") -> str:
    """A digest of what lies at a path: of names, sizes and times ('stat'), of sizes and first, middle and last SAMPLE bytes ('sample'), or of contents ('content'), made where the files are."""
    from pyspark.sql import functions as F

    if mode not in ("stat", "sample", "content"):
        raise ValueError(f"unknown identity mode {mode!r}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if mode == "stat":
        what = F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    elif mode == "sample":
        size, last = F.col("length"), F.greatest(F.col("length") - SAMPLE, F.lit(0))
        middle = F.greatest(F.floor(size / 2) - SAMPLE // 2, F.lit(0))
        chunk = lambda at: F.col("content").substr((at + 1).cast("int"), F.lit(SAMPLE))
        what = F.concat_ws("|", size.cast("string"), F.sha2(chunk(F.lit(0)), 256), F.sha2(chunk(middle), 256), F.sha2(chunk(last), 256))
    else:
        what = F.concat_ws("|", F.element_at(F.split("path", "/"), -1), F.sha2("content", 256))
    rows = files.select(F.sha2(what, 256).alias("d")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d")).first()
    return rows["d"]
