"""Shared helpers: tables, the shared folder, and small column idioms."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as used by every word rule here.
SPACE = " \t\n\x0b\x0c\r"
WORD_SPLIT = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of this machine in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, if any, and let Spark remove the shuffle files of finished jobs."""
    for df in tables:
        spark, path = df.sparkSession, df.staged_at
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    time.sleep(1.2)  # until the JVM has heard of the dropped plans: another thread tells it once a second
    spark = SparkSession.getActiveSession()
    spark.range(1).collect()  # the last plan run is held until another runs
    spark._jvm.System.gc()


#: Bits (2 to this power) that tell which keys occur; as rows of 64 bits, half a million at most.
KEY_BITS = 25


def with_key_in(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """The rows of df whose key may occur in other: all that do, and few others while other has well under 2^KEY_BITS keys.

    Before a join that shuffles wide rows this leaves most rows without a partner where they are. What is broadcast
    has a fixed bound, whatever the size of other.
    """
    cell = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << KEY_BITS) - 1))
    kind = df.schema[key].dataType
    assert not {"_cell", "_word", "_bits"} & set(df.columns)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_cell").bitwiseAND(F.lit(63)).cast("int"))
    words = other.select(cell(F.col(other_key).cast(kind)).alias("_cell")).groupBy(F.shiftright("_cell", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    found = df.withColumn("_cell", cell(F.col(key))).join(F.broadcast(words), F.shiftright("_cell", 6) == F.col("_word"))
    return found.filter(F.col("_bits").bitwiseAND(bit) != 0).drop("_cell", "_word", "_bits")


def unused(columns: list[str], name: str) -> str:
    """A column name that none of ``columns`` has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row; kinds that Spark does not hash (maps, variants) go by their JSON."""
    plain = lambda c: F.to_json(F.struct(c)) if any(k in df.schema[c].dataType.simpleString() for k in ("map<", "variant")) else F.col(f"`{c}`")
    return F.xxhash64(*map(plain, df.columns))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression, so that lambdas in the body don't compute it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_column(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def by_group(df: DataFrame, keys: list[str], order: list[str], each: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Call ``each`` with the rows (tuples of df's columns) of every group, in order; nulls are a key of their own.

    Groups are streamed from sorted partitions, many to a batch, so only one group is held at a time:
    callers see to it that groups are bounded.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    at = [df.columns.index(k) for k in keys]
    target = to_arrow_schema(_parse_datatype_string(schema))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    def run(batches):
        last, group, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = [row[i] for i in at]
                if group and key != last:
                    out += each(group)
                    group = []
                    if len(out) > 2000:
                        yield batch_of(out)
                        out = []
                last = key
                group.append(row)
        if group:
            out += each(group)
        if out:
            yield batch_of(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
