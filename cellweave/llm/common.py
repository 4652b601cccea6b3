"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a group's part holds on average where a group is dealt in parts, and the most parts it is dealt in.
PART_ROWS, MOST_PARTS = 250, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 8 * 2**20


def byte_bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands rows to Python workers in batches bounded by bytes, not by rows alone."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name).removesuffix("b")) > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def whole_text(c: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where none is set, a local session gets a temporary one; a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="cellweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_PATH: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, what: str, most: int = 0) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors. ``most``: rows a file,
    for rows so large that neither a writer nor a reader may hold many of them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", most).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _PATH[made] = path
    return made


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave and no later plan reads."""
    for t in tables:
        path = _PATH.pop(t, None)
        if path:
            spark = t.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def sha_hex(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def unique_integer(df: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether ``id_col`` is an integer, never null and never repeated."""
    if dict(df.dtypes)[id_col] not in ("bigint", "int", "smallint", "tinyint"):
        return False
    return df.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).isEmpty()


def keyed(df: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, bool]:
    """``df`` with the unique 64-bit column ``key``, and whether it is ``id_col``.

    It is where that is a unique integer; otherwise the rows are numbered and written, so that the numbers stay.
    """
    if unique_integer(df, id_col):
        return df.withColumn("key", F.col(id_col).cast("long")), True
    return written(df.withColumn("key", F.monotonically_increasing_id()), "keyed"), False


def parts_for(n: int) -> int:
    """In how many parts the rows of one group are dealt, for a table of ``n`` rows."""
    return max(1, min(MOST_PARTS, n // PART_ROWS))


def dealt(rows: DataFrame, by: list[str], spread: str, parts: int | Column) -> DataFrame:
    """``rows`` with ``_part``, moved so that each group of ``by`` lies in ``parts`` parts, by the column ``spread``; a column
    of parts may differ from group to group.

    What joins or groups the result by ``by`` and ``_part`` moves it no more, and a group of any size fills no one task.
    """
    part = F.coalesce(F.pmod(F.xxhash64(F.lit(11), spread), F.lit(parts)).cast("int"), F.lit(0))
    return rows.withColumn("_part", part).repartition(*by, "_part")


def with_totals(rows: DataFrame, by: list[str], partial: list[Column], total: list[Column], keep: Column | None = None) -> DataFrame:
    """``dealt`` rows with aggregates of their whole group: ``partial`` of each part, ``total`` of those.

    Rows of groups for which ``keep`` does not hold, or with a null in ``by``, are left out. No task gathers a group: the
    totals are made of at most one row a part and go back to the parts.
    """
    rows, some = _in_parts(rows, by, partial)
    whole = some.groupBy(*by).agg(*total)
    whole = whole if keep is None else whole.where(keep)
    return rows.join(some.select(*by, "_part").join(whole, by), [*by, "_part"])


def with_found(rows: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """``dealt`` rows left-joined to ``found``, which has one row for each value of ``by``; rows with a null there are left
    out."""
    rows, some = _in_parts(rows, by, [])
    return rows.join(some.select(*by, "_part").join(found, by), [*by, "_part"], "left")


def _in_parts(rows: DataFrame, by: list[str], partial: list[Column]) -> tuple[DataFrame, DataFrame]:
    """``rows`` and their aggregates by part. The aggregates use every column and both have one filter, so that all that
    is made of them reads one exchange: the rows are computed and moved once."""
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    every = F.max(F.xxhash64(*rows.columns)).alias("_every")
    return rows, rows.groupBy(*by, "_part").agg(*partial, every).where("_every IS NOT NULL")


Query = Callable[[SparkSession, str], DataFrame]
