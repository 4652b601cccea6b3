"""Nested per-entity payloads and tables: readers to canonical long tables, writers, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.expr import finite

# Names a signal may have in a payload, the first that is present and not empty counts.
ALIASES = {
    "step": ["cycle_index", "cycle"],
    "kind": ["step_type", "step"],
    "time": ["test_time", "time", "t"],
    "voltage": ["voltage", "V"],
    "current": ["current", "I"],
    "charge_capacity": ["charge_capacity", "Qc"],
    "discharge_capacity": ["discharge_capacity", "Qd"],
    "charge_energy": ["charge_energy"],
    "discharge_energy": ["discharge_energy"],
    "internal_resistance": ["internal_resistance", "dc_internal_resistance", "IR"],
    "temperature": ["temperature", "temperature_average", "T"],
}


def read_payloads(spark: SparkSession, path: str, glob: str = "*.json*") -> DataFrame:
    """(entity, path, payload): one JSON document a file, gzipped or not, as a variant; broken ones have a null payload."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path).withColumn("path", F.col("_metadata.file_path"))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(_structure)?(\.json)?(\.gz)?$", "")
    return files.select(name.alias("entity"), "path", F.try_parse_json("value").alias("payload"))


def exploded(payloads: DataFrame, section: str, signals: list[str] | None = None, with_kind: bool = True) -> DataFrame:
    """(entity, signals): a section's parallel arrays as rows, each signal by its first alias that is not empty, cut to the
    shortest array; a missing step is the zero-based place, a missing signal null; kinds in lower case."""
    names = signals or [k for k in ALIASES if k not in ("step", "kind")]

    def array(name: str, kind: str):
        found = F.array(*[F.try_variant_get("payload", f"$.{section}.{a}", f"array<{kind}>") for a in ALIASES.get(name, [name])])
        return F.get(F.filter(found, lambda x: x.isNotNull() & (F.size(x) > 0)), F.lit(0))

    cols = {"step": array("step", "double"), **({"kind": array("kind", "string")} if with_kind else {}), **{n: array(n, "double") for n in names}}
    held = payloads.select("entity", *[c.alias(n) for n, c in cols.items()])
    size = F.array_min(F.filter(F.array(*[F.when(F.col(n).isNotNull(), F.size(n)) for n in cols]), lambda s: s.isNotNull()))
    rows = held.withColumn("_n", size).where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda n: F.get(F.col(n), F.col("_i"))
    step = F.coalesce(finite(at("step")), F.col("_i").cast("double")).alias("step")
    kind = [F.coalesce(F.lower(F.trim(at("kind"))), F.lit("")).alias("kind")] if with_kind else []
    return rows.select("entity", step, *kind, *[finite(at(n)).alias(n) for n in names])


def kind_of_current(current: str = "current"):
    return F.when(F.col(current) < 0, "discharge").when(F.col(current) > 0, "charge").otherwise("")


def padded(array: str, size):
    """An array as long as ``size``: cut, or filled up with nulls; a single value is repeated."""
    x = F.col(array)
    return F.when(F.size(x) == 1, F.array_repeat(F.get(x, F.lit(0)), size)).otherwise(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get(x, i)))


def read_table(spark: SparkSession, path: str, schema: str, headless: bool = False) -> DataFrame:
    """A CSV table in one pass: columns by the names of its header, null where it lacks one or a value is none of the type;
    without a header by place."""
    wanted = StructType.fromDDL(schema)
    if headless:
        return spark.read.schema(wanted).csv(path)
    made = spark.read.option("header", True).csv(path)
    return made.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in made.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def write_json(df: DataFrame, path: str, compress: bool = False) -> None:
    df.write.mode("overwrite").json(path, compression="gzip" if compress else "none")


def append_events(df: DataFrame, path: str) -> None:
    """An append-only trace: one JSON line an event."""
    df.write.mode("append").json(path)


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last written row of each key."""
    return events.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_k = 1").drop("_k")
