"""Helpers that the corpus operators share: text words, hashing, stored tables, batch bounds."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, every other byte unchanged.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
U64 = np.uint64


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset on a local master, a folder in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/levybook_llm"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: lineage is cut and survives lost executors.

    Shuffle files of such a step serve nobody once its table is written, so Spark is told to drop them then."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes the tables behind frames of ``stored``; for steps whose readers are stored themselves."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            if shared_folder(df.sparkSession).rstrip("/").split("://")[-1].removeprefix("file:") in path:
                folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def bits_for(keys: int, each: int, most: int) -> int:
    """A power of two: ``each`` bits a key, 2^16 at least and ``most`` at most."""
    return min(most, max(1 << 16, 1 << (keys * each - 1).bit_length()))


class Marks:
    """A bitmap of bounded size over the keys of a table: what it does not hold is surely not among them.

    It keeps rows that cannot match out of a join's shuffle. The bitmap is a table of
    cells of 64 bits: 32 bits a key, but ``most_bits`` at most, so broadcasting it is
    safe; with more keys, more rows pass that match nothing, which the join then drops.
    """

    def __init__(self, keys: DataFrame, on: list[str], most_bits: int = 1 << 26):
        self.on, self.mask = on, bits_for(keys.count(), 32, most_bits) - 1
        bit = self.place().bitwiseAND(F.lit(63)).cast("int")
        self.cells = (keys.select(F.shiftright(self.place(), 6).alias("_cell"), bit.alias("_bit")).groupBy("_cell")
                      .agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits")))

    def place(self) -> Column:
        return F.xxhash64(*self.on).bitwiseAND(F.lit(self.mask))

    def near(self, rows: DataFrame, hit: bool = True) -> DataFrame:
        """The rows whose keys may be among the keys, or the others."""
        bit = self.place().bitwiseAND(F.lit(63)).cast("int")
        held = rows.withColumn("_cell", F.shiftright(self.place(), 6)).join(F.broadcast(self.cells), "_cell", "left")
        return held.where(F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False)) == hit).drop("_cell", "_bits")

    def semi(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        return self.near(rows).join(keys, self.on, "left_semi")

    def anti(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        return self.near(rows, False).unionByName(self.near(rows).join(keys, self.on, "left_anti"))

    def left(self, rows: DataFrame, other: DataFrame) -> DataFrame:
        """A left join; rows that match nothing stay where they are."""
        return self.near(rows, False).unionByName(self.near(rows).join(other, self.on, "left"), allowMissingColumns=True)


def bounded_batches(spark: SparkSession, rows: int = 500, megabytes: int = 8) -> None:
    """Bounds what one Arrow batch brings into a Python worker; long texts make large rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def lean(run: Callable) -> Callable:
    """``run`` over a task's batches, giving back what it has freed when the task ends; Python workers outlive tasks and queries."""
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()
    return task


def give_back() -> None:
    """Hands freed memory of this process back to the machine, where its C library can."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    from pandas.util import hash_array
    cells = np.empty(len(ws), object)
    cells[:] = ws
    return hash_array(cells, categorize=False) if ws else np.zeros(0, np.uint64)
