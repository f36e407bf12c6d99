"""What the operators of this subpackage share: shared scratch folders, digests and Arrow batches."""

from __future__ import annotations

import atexit
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.sources.shared import shared_folder

#: The bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
#: Java and RE2 pattern of one run of them.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

_SCRATCH: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder of this application inside spark.checkpoint.dir, which every executor can read.

    Only where that setting is missing and the master is local (tests, a laptop) a temporary folder
    takes its place; a cluster without it is an error. The folder is deleted through Hadoop's file
    system when the driver's Python ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = shared_folder(spark, f"chatlake-{app}")
        atexit.register(_drop, spark, _SCRATCH[app])
    return _SCRATCH[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone already; the folder's owner cleans up
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Where each table written here lies, by the frame that reads it.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes Parquet to the shared folder and reads it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def reopened(df: DataFrame, spark: SparkSession) -> DataFrame:
    """What ``materialise`` wrote, read in another session of the same application."""
    return spark.read.schema(df.schema).parquet(_WRITTEN[df])


def delete(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` wrote and that nothing reads any more; others are left alone."""
    for table in tables:
        if path := _WRITTEN.pop(table, None):
            _drop(spark, path)


def gathered(df: DataFrame, rows: int | None = None) -> DataFrame:
    """In tasks of some 100,000 rows; or, for a table of one row a group, in as many as there are cores.

    However many partitions the session shuffles into: the driver keeps an account of every task, and a step of
    several shuffles of a few rows would add thousands.
    """
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism) if rows is None else rows // 100_000 + 1)


def joined(rows: DataFrame, side: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Left join of rows with a side of one row a key, whichever keys are hot."""
    most = max(rows.count() // share, share)
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key)
    return joined_apart(rows, side, side.join(hot, key, "left_semi"), key)


def joined_apart(rows: DataFrame, side: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """Left join in which the side's ``hot`` rows are broadcast.

    They must be few by their making: keys with more than a given part of all rows, say. Rows that
    are served so, and rows with a null key, are dealt out by their content.
    """
    kept = [c for c in side.columns if c != key]
    ready = F.broadcast(hot.select(F.col(key).alias("_joined_key"), F.struct(*kept).alias("_hot")))
    apart = F.when(F.col(key).isNull() | F.col("_hot").isNotNull(), F.xxhash64(*rows.columns)).otherwise(F.lit(0))
    dealt = rows.join(ready, F.col(key) == F.col("_joined_key"), "left").drop("_joined_key").withColumn("_apart", apart)
    # always 0, but no literal: the optimizer would drop a literal from the join's keys
    rest = side.select(key, F.pmod(F.xxhash64(key), F.lit(1).cast("bigint")).alias("_apart"), F.struct(*kept).alias("_cold"))
    return dealt.join(rest, [key, "_apart"], "left").withColumn("_side", F.coalesce("_hot", "_cold")).select(*rows.columns, *(F.col(f"_side.{c}").alias(c) for c in kept))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, null as empty, without making Python strings."""
    col = batch.column(batch.schema.get_field_index(name))
    for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist():
        yield x or b""


class Held(dict):
    """A bounded cache of key -> packed ids in two generations; keys over ``longest`` aren't held."""

    most, longest = 120_000, 80

    def __init__(self):
        self.old: dict = {}

    def fill(self, keys: set, make) -> dict:
        """The values of keys; ``make`` turns the list of unknown ones into theirs."""
        out, unknown = {}, []
        for key in keys:
            value = self.get(key)
            if value is None:
                value = self.old.get(key)
            if value is None:
                unknown.append(key)
            else:
                out[key] = value
        made = dict(zip(unknown, make(unknown), strict=True)) if unknown else {}
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        self.update((k, v) for k, v in made.items() if len(k) <= self.longest)
        return out | made


def slices(batch: pa.RecordBatch, name: str, rows: int = 2048, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of rows and, longer single rows aside, bytes in a column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and (i - at >= rows or held + n > most):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value to a name inside one expression, so that it is computed once a row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null, empty and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def n_words(text: Column) -> Column:
    """How many words a text has: its separators' runs plus one."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(bare) == 0, F.lit(0)).otherwise(F.regexp_count(bare, F.lit(SPACE_RUN)) + 1).cast("bigint")
