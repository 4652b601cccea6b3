"""Ragged per-entity records: steps as maps or lists of arrays of unequal length, padded to rows; summaries cut to the
shortest array; directories of raw files; processed tables; small generated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import finite

# Names of a step's signals; the first that is present counts.
STEP_NAMES = {
    "voltage": ["V", "voltage", "Voltage"], "current": ["I", "current", "Current"], "test_time": ["t", "time", "test_time"],
    "charge_capacity": ["Qc", "QCharge", "charge_capacity"], "discharge_capacity": ["Qd", "Qdlin", "QDischarge", "discharge_capacity"],
    "charge_energy": ["Ec", "charge_energy"], "discharge_energy": ["Ed", "discharge_energy"], "internal_resistance": ["IR", "internal_resistance"], "temperature": ["T", "Tdlin", "temperature"],
}
SUMMARY_NAMES = {
    "cycle_index": ["cycle", "cycle_index", "cycles"], "discharge_capacity": ["QDischarge", "discharge_capacity"], "charge_capacity": ["QCharge", "charge_capacity"],
    "internal_resistance": ["IR", "internal_resistance"], "temperature": ["Tavg", "temperature_average", "temperature"],
}


#: Lists within lists that a value may have.
MOST_DEPTH = 64


def _items(x: Column) -> Column:
    return F.try_variant_get(x, "$", "array<variant>")


def _kind(x: Column) -> Column:
    """The kind of a leaf: the first word of its schema."""
    return F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0)


def leaves(c: Column) -> Column:
    """All leaves of a nested list (a variant) in order, depth first, objects and nulls among them; a single value is one
    leaf. A level is opened at a time, until no list is left."""

    def step(held: Column, _: Column) -> Column:
        opened = F.flatten(F.transform(held["items"], lambda x: F.coalesce(_items(x), F.array(x))))
        return F.when(held["more"], F.struct(opened.alias("items"), F.exists(held["items"], lambda x: _items(x).isNotNull()).alias("more"))).otherwise(held)

    start = F.struct(F.array(c).alias("items"), F.lit(True).alias("more"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(MOST_DEPTH)), start, step, lambda held: F.when(held["more"], F.raise_error(F.lit("lists are nested too deeply")).cast("array<variant>")).otherwise(held["items"]))
    return F.when(c.isNotNull(), done)


def numeric_leaves(c: Column) -> Column:
    """The numbers of a value (a variant) as doubles; empty for an object or a null.

    A plain list keeps its places: texts that are numbers count, all else is null, truth values are 1 and 0 in a list
    without texts. Of a list with lists or objects in it, in order and depth first, the numbers and truth values are left;
    texts, nulls and objects have no place there.
    """
    nested = F.exists(_items(c), lambda x: F.coalesce(_kind(x).isin("ARRAY", "OBJECT"), F.lit(False)))
    texts = F.exists(F.coalesce(_items(c), F.array(c)), lambda x: F.coalesce(_kind(x) == "STRING", F.lit(False)))
    number = lambda x: finite(F.try_variant_get(x, "$", "double"))
    truth = lambda x: F.try_variant_get(x, "$", "boolean").cast("double")
    bare = F.filter(leaves(c), lambda x: F.coalesce(~_kind(x).isin("STRING", "OBJECT", "VOID"), F.lit(False)))
    ragged = F.transform(bare, lambda x: F.when(_kind(x) == "BOOLEAN", truth(x)).otherwise(number(x)))
    text = lambda x: finite(F.trim(F.try_variant_get(x, "$", "string")).try_cast("double"))
    plain = F.transform(F.coalesce(_items(c), F.array(c)), lambda x: F.when(_kind(x) == "BOOLEAN", F.when(~texts, truth(x))).when(_kind(x) == "STRING", text(x)).when(_kind(x) != "OBJECT", number(x)))
    empty = F.array().cast("array<double>")
    return F.when(_kind(c).isin("OBJECT", "VOID"), empty).when(nested, ragged).otherwise(F.when(c.isNotNull(), plain))


def string_leaves(c: Column) -> Column:
    """All leaves of a value (a variant) in order as texts, trimmed and in lower case, without nulls and objects."""
    kept = F.filter(leaves(c), lambda x: F.coalesce(~_kind(x).isin("OBJECT", "VOID"), F.lit(False)))
    return F.transform(kept, lambda x: F.lower(F.trim(F.try_variant_get(x, "$", "string"))))


def first_number(c: Column) -> Column:
    """The first number of an array, null where it is none or there is none."""
    return finite(F.get(c, F.lit(0)))


def fitted(array: Column, size: Column, empty: Column | None = None) -> Column:
    """An array made ``size`` long: a single value repeated, longer ones cut, shorter ones filled up with nulls or
    ``empty``."""
    at = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get(array, i) if empty is None else F.coalesce(F.get(array, i), empty))
    return F.when(size <= 0, F.slice(array, 1, 0)).when(F.size(array) == 1, F.array_repeat(F.get(array, F.lit(0)), size)).otherwise(at)


def kind_of(current: Column) -> Column:
    """The kind of a sample by the sign of its current."""
    return F.when(current < 0, "discharge").when(current > 0, "charge").otherwise("")


def struct_rows(holder: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """A struct of lists as rows: lists of the most common length go place by place, all else is repeated on each row."""
    sizes = F.filter(F.array(*[F.when(F.size(f) > 0, F.size(f)) for f in fields]), lambda n: n.isNotNull())
    n = F.array_max(F.transform(F.array_distinct(sizes), lambda s: F.struct(F.size(F.filter(sizes, lambda x: x == s)).alias("k"), (-F.array_position(sizes, s)).alias("first"), s.alias("n"))))["n"]
    rows = holder.withColumn("_n", n).where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    one = lambda f: F.when(F.size(f) == F.col("_n"), F.get(F.col(f), F.col("_i"))).otherwise(F.get(F.col(f), F.lit(0)))
    return rows.select(*keys, F.col("_i").alias("place"), *[one(f).alias(f) for f in fields])


def step_records(payloads: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, place, record): the steps of a variant that is a list of records, or an object of them by name.

    Objects go by the names' order as texts; what is no record is left out, and places count records only.
    """
    listed = F.try_variant_get(column, "$", "array<variant>")
    mapped = F.try_variant_get(column, "$", "map<string,variant>")
    ordered = F.transform(F.array_sort(F.map_keys(mapped)), lambda k: F.element_at(mapped, k))
    each = payloads.select(*keys, F.posexplode(F.coalesce(listed, ordered)).alias("_p", "record"))
    held = each.where(F.schema_of_variant("record").startswith("OBJECT"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_p")) - 1
    return held.select(*keys, place.alias("place"), "record")


def padded_samples(records: DataFrame, keys: list[str], upto: int | None = None) -> DataFrame:
    """(keys, cycle_index, step_type, signals) rows of step records: each record's arrays are padded to the longest one,
    single values repeated; records without a known signal are left out, and those at or beyond ``upto``.

    The kind is the record's own, else by the sign of the current, else by which capacity there is.
    """
    rows = records if upto is None else records.where(F.col("place") < upto)
    raw = lambda names: F.coalesce(*[F.variant_get("record", f"$.{n}", "variant") for n in names])
    held = rows.select(*keys, "place", "record", *[numeric_leaves(raw(names)).alias(s) for s, names in STEP_NAMES.items()], string_leaves(raw(["step_type", "step"])).alias("_kind"), numeric_leaves(raw(["cycle_index"])).alias("_step"))
    size = F.array_max(F.array(*[F.coalesce(F.size(s), F.lit(0)) for s in STEP_NAMES]))
    held = held.withColumn("_n", size).where("_n > 0")
    has = lambda s: F.coalesce(F.size(s) > 0, F.lit(False))
    signs = F.transform(fitted(F.col("current"), F.col("_n")), kind_of)
    by_capacity = F.when(has("discharge_capacity") & ~has("charge_capacity"), "discharge").when(has("charge_capacity") & ~has("discharge_capacity"), "charge").otherwise("")
    kind = F.when(has("_kind"), fitted(F.col("_kind"), F.col("_n"), F.lit(""))).when(has("current"), signs).otherwise(F.array_repeat(by_capacity, F.col("_n")))
    zipped = F.arrays_zip(kind.alias("step_type"), *[F.when(has(s), fitted(F.col(s), F.col("_n"))).otherwise(F.array_repeat(F.lit(None).cast("double"), F.col("_n"))).alias(s) for s in STEP_NAMES])
    out = held.select(*keys, F.coalesce(first_number(F.col("_step")), F.col("place").cast("double")).alias("cycle_index"), F.explode(zipped).alias("x"))
    return out.select(*keys, "cycle_index", "x.step_type", *[f"x.{s}" for s in STEP_NAMES])


def summary_rows(payloads: DataFrame, keys: list[str], column: str, upto: int | None = None) -> DataFrame:
    """(keys, cycle_index, signals) of a variant of per-step arrays: cut to the shortest known one, by step, the first
    ``upto`` of them; a missing step is the zero-based place. Unknown and empty arrays are left out."""
    raw = lambda names: F.coalesce(*[F.variant_get(column, f"$.{n}", "variant") for n in names])
    held = payloads.select(*keys, *[numeric_leaves(raw(names)).alias(s) for s, names in SUMMARY_NAMES.items()])
    n = F.array_min(F.filter(F.array(*[F.size(s) for s in SUMMARY_NAMES]), lambda x: x > 0))
    rows = held.withColumn("_n", n).where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda s: F.get(F.col(s), F.col("_i"))
    rows = rows.select(*keys, "_i", F.when(F.size("cycle_index") > 0, at("cycle_index")).otherwise(F.col("_i").cast("double")).alias("cycle_index"), *[at(s).alias(s) for s in SUMMARY_NAMES if s != "cycle_index"])
    if upto is not None:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("cycle_index").asc_nulls_last(), "_i"))
        rows = rows.withColumn("_k", place).where(F.col("_k") <= upto).drop("_k")
    return rows.drop("_i")


def step_rows(summary: DataFrame, upto: int) -> DataFrame:
    """Summary rows of whole steps from 1 to ``upto``; entities without any are for the caller to exclude."""
    return summary.withColumn("cycle_index", F.floor("cycle_index").cast("int")).where(F.col("cycle_index").between(1, upto))


def batch_date(name: str | Column) -> Column:
    """The date that a batch's name starts with, as text; null without one."""
    x = F.col(name) if isinstance(name, str) else name
    return F.nullif(F.regexp_extract(x, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def source_batch(path: str | Column) -> Column:
    """The batch that a file's name tells: its stem up to ``_batchdata``."""
    x = F.col(path) if isinstance(path, str) else path
    return F.substring_index(F.regexp_replace(F.element_at(F.split(x, "[/\\\\]"), -1), r"\.[^.]*$", ""), "_batchdata", 1)


def listing(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, size) of the files under a folder whose names fit a pattern, from their metadata alone; in order of path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size")).orderBy("path")


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """The structure files of a batch's folder; without any, all its JSON and HDF5 files."""
    found = listing(spark, path, "*_structure.json")
    return found if not found.isEmpty() else listing(spark, path, "*.{json,h5,hdf5}")


def excluded_ids(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id): the lines of a text that are not empty and no comment."""
    return spark.read.text(path).select(F.trim("value").alias("cell_id")).where("cell_id <> '' AND NOT cell_id LIKE '#%'").distinct()


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def processed_tables(spark: SparkSession, path: str, required: bool = False, seed: int = 0, upto: int = 120) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """Metadata, steps, finite labels and where they come from: a folder's CSV tables, else generated ones unless
    ``required``. Labels stand in their own table or in the metadata's ``cycle_life``."""
    read = lambda n: spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/{n}.csv")
    names = [n for n in ("cell_metadata", "metadata") if exists(spark, f"{path}/{n}.csv")]
    if names and exists(spark, f"{path}/cycle_summary.csv"):
        meta = read(names[0])
        if exists(spark, f"{path}/labels.csv"):
            labels = read("labels")
        elif "cycle_life" in meta.columns:
            labels = meta.select("row_id", F.col("cycle_life").alias("y"))
        else:
            raise FileNotFoundError(f"no labels under {path}")
        from ..operators.evaluation import finite_labels

        return meta, read("cycle_summary"), finite_labels(labels), "processed"
    if required:
        raise FileNotFoundError(f"no processed tables under {path}")
    return (*generated(spark, seed=seed, upto=upto), "synthetic")


def generated(spark: SparkSession, cells: int = 80, upto: int = 120, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metadata, steps and labels of made-up cells whose capacity fades in a line with noise; life falls with the fade.

    The noise is a function of seed, cell and step, alike in every run and partitioning.
    """
    u = lambda *c: (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = lambda tag, *c: F.sqrt(-2 * F.log(u(F.lit(f"{tag}a"), *c))) * F.cos(2 * 3.141592653589793 * u(F.lit(f"{tag}b"), *c))
    cell = spark.range(cells).select(F.col("id").alias("row_id"))
    cell = cell.withColumn("q0", 1.08 + 0.015 * normal("q", "row_id")).withColumn("fade", 0.00005 + 0.0004 * u(F.lit("f"), "row_id"))
    currents = F.array(*[F.lit(x) for x in (3.6, 4.0, 4.8, 5.6)])
    meta = cell.select("row_id", F.format_string("synthetic_%d", "row_id").alias("cell_id"), F.format_string("b%d", F.col("row_id") % 4).alias("batch_id"), F.get(currents, F.floor(4 * u(F.lit("c"), "row_id")).cast("int")).alias("cc1"), F.lit("synthetic").alias("label_source"))
    steps = cell.withColumn("cycle_index", F.explode(F.sequence(F.lit(1), F.lit(upto))))
    steps = steps.select("row_id", "cycle_index", (F.col("q0") - F.col("fade") * F.col("cycle_index") + 0.001 * normal("s", "row_id", "cycle_index")).alias("discharge_capacity"), F.lit(None).cast("double").alias("charge_capacity"))
    life = 350 + 1200 * (0.0005 - F.col("fade")) / 0.00045 + 35 * normal("l", "row_id")
    return meta, steps, cell.select("row_id", F.greatest(F.lit(100.0), life).alias("y"))


def merged_batches(batches: list[DataFrame], key: str) -> DataFrame:
    """All rows of the batches by name; of rows with one key, the last batch's counts."""
    out = None
    for i, b in enumerate(batches):
        one = b.withColumn("_b", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_b").desc()))
    return out.withColumn("_k", last).where("_k = 1").drop("_k", "_b")
