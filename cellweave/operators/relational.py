"""Filters with reasons, matching joins, ordered deduplication, upserts, profiles and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import finite
from .order_stats import medians


def with_reasons(rows: DataFrame, checks: dict[str, Column], out: str = "reasons") -> DataFrame:
    """``rows`` with the names of the checks that hold, joined by a semicolon; empty where none does. A null check holds
    not."""
    return rows.withColumn(out, F.concat_ws(";", *[F.when(c, F.lit(n)) for n, c in checks.items()]))


def split_by_reasons(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that pass all checks, and the others with their reasons."""
    marked = with_reasons(rows, checks)
    return marked.where("reasons = ''").drop("reasons"), marked.where("reasons <> ''")


def reason_counts(excluded: DataFrame) -> DataFrame:
    return excluded.select(F.explode(F.split("reasons", ";")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def identity(c: str | Column) -> Column:
    """A name made comparable: base name, without extensions and a structure suffix, channels written CHnn."""
    x = F.col(c) if isinstance(c, str) else c
    x = F.element_at(F.split(x, "[/\\\\]"), -1)
    x = F.regexp_replace(x, r"(\.json|\.gz|\.csv|\.h5|\.hdf5|\.mat)+$", "")
    x = F.regexp_replace(F.lower(x), r"_structure$", "")
    number = F.regexp_extract(x, r"channel[_ ]?(\d+)", 1)
    return F.when(number != "", F.regexp_replace(x, r"channel[_ ]?\d+", F.concat(F.lit("ch"), F.lpad(number, 2, "0")))).otherwise(x)


def matched(left: DataFrame, right: DataFrame, left_name: str, right_name: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """``left`` joined to ``right`` by identity, and the rows of ``left`` that have no match."""
    a = left.withColumn("identity", identity(left_name))
    b = right.select(identity(right_name).alias("identity"), *keep, F.lit(True).alias("found"))
    both = a.join(b, "identity", "left")
    return both.where("found").drop("found"), both.where("found IS NULL").select("identity", *left.columns)


def resolved_path(candidates: dict[str, str | Column], listing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, path, how, tried): each row's first candidate, by priority, that the listing (path) holds."""
    tries = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("how"), (F.col(c) if isinstance(c, str) else c).alias("path")) for i, (n, c) in enumerate(candidates.items())])
    each = rows.select(key, F.explode(tries).alias("t")).select(key, "t.rank", "t.how", "t.path").where("path IS NOT NULL")
    hit = each.join(listing.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    best = F.min_by(F.struct("path", "how"), F.when(F.col("there"), F.col("rank")))
    found = hit.groupBy(key).agg(best.alias("b"), F.count("*").alias("tried"))
    return found.select(key, "b.path", F.coalesce("b.how", F.lit("unresolved")).alias("how"), "tried")


def anonymised(rows: DataFrame, key: str, out: str = "anon", prefix: str = "anon_cell_") -> DataFrame:
    """(key, out) of the distinct ids that are not null, numbered in the order of their texts.

    Numbers run over ranges of the sorted ids, so no task sorts all of them.
    """
    ids = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), key).distinct()
    return ranked(ids, ["k"], "i").select(key, F.format_string(f"{prefix}%05d", F.col("i")).alias(out))


#: Rows that a range holds on average, and the most ranges.
RANGE_ROWS, MOST_RANGES = 200_000, 1024


def ranked(rows: DataFrame, order: list[str], out: str, start: int = 0) -> DataFrame:
    """``rows`` numbered by ``order``, which must be unique: ranges by a sample, numbers within them, offsets of the counts.

    The number of ranges follows from the rows; a few rows are one range and need no sample.
    """
    first = order[0]
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    cuts = []
    if ranges > 1:
        cuts = [r[0] for r in rows.select(first).where(F.col(first).isNotNull()).sample(min(1.0, 100 * ranges / n), seed=1).orderBy(first).collect()]
        cuts = sorted({cuts[i * len(cuts) // ranges] for i in range(1, ranges)}) if cuts else []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(first))) if cuts else F.lit(0)
    ranged = rows.withColumn("_range", part)
    sizes = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}  # at most ``ranges`` rows
    offsets, at = [], start
    for k in range(len(cuts) + 1):
        offsets.append(at)
        at += sizes.get(k, 0)
    offset = F.get(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_range"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(out, offset + within - 1).drop("_range")


def missing_and_extra(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """(key, what): ids that lack, that are too many, and that come more than once."""
    lack = expected.select(key).distinct().join(got, key, "left_anti").withColumn("what", F.lit("missing"))
    more = got.select(key).distinct().join(expected, key, "left_anti").withColumn("what", F.lit("extra"))
    twice = got.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate").alias("what"))
    return lack.unionByName(more).unionByName(twice)


def best_per(rows: DataFrame, keys: list[str], metric: str, *ties: str) -> DataFrame:
    """The row of each key with the least metric, the earliest by ``ties`` among equals; nulls of the metric come last."""
    order = Window.partitionBy(*keys).orderBy(F.col(metric).asc_nulls_last(), *ties)
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows whose key is not in the new ones, and the new ones; missing columns are null."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def stacked(first: DataFrame, second: DataFrame, row_id: str) -> DataFrame:
    """Both tables by name; the second's row ids follow the first's largest."""
    offset = first.agg((F.coalesce(F.max(row_id), F.lit(-1)) + 1).alias("_o"))
    moved = second.crossJoin(F.broadcast(offset)).withColumn(row_id, F.col(row_id) + F.col("_o")).drop("_o")
    return first.unionByName(moved, allowMissingColumns=True)


def dataset_profile(rows: DataFrame) -> DataFrame:
    """(column, rows, nulls, distinct values, least, largest); numbers as text.

    One pass for all but the distinct values, which each column counts for itself: counted at once, each row would be
    moved once a column.
    """
    cols = rows.columns
    one = rows.agg(*[x for c in cols for x in (F.count_if(F.col(c).isNull()).alias(f"{c}|n"), F.min(c).cast("string").alias(f"{c}|lo"), F.max(c).cast("string").alias(f"{c}|hi"))], F.count("*").alias("|rows"))
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col("|rows").alias("rows"), F.col(f"{c}|n").alias("nulls"), F.col(f"{c}|lo").alias("least"), F.col(f"{c}|hi").alias("largest")) for c in cols])
    stats = one.select(F.explode(each).alias("p")).select("p.*")
    distinct = None
    for c in cols:
        n = rows.select(F.col(c).alias("_v")).where("_v IS NOT NULL").groupBy("_v").agg(F.lit(1).alias("_one")).agg(F.lit(c).alias("column"), F.count("*").alias("distinct"))
        distinct = n if distinct is None else distinct.unionByName(n)
    return stats.join(F.broadcast(distinct), "column")  # a row a column


def classified(text: str | Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule whose pattern is in the text."""
    x = F.col(text) if isinstance(text, str) else text
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(x.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def batch_statistics(rows: DataFrame, batch: str, value: str) -> DataFrame:
    """Count, extremes, mean, median and sample deviation per batch and over all (batch null, overall true)."""
    v = finite(value)
    stats = [F.count(v).alias("n"), F.max(v).alias("max"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")]
    middle = medians(rows, [batch], {"median": v}).withColumnRenamed(batch, "_batch")
    each = rows.groupBy(batch).agg(*stats).withColumn("overall", F.lit(False)).join(middle, F.col(batch).eqNullSafe(F.col("_batch"))).drop("_batch")
    every = rows.agg(*stats).withColumn(batch, F.lit(None).cast(dict(rows.dtypes)[batch])).withColumn("overall", F.lit(True))
    return each.unionByName(every.crossJoin(F.broadcast(medians(rows, [], {"median": v}))))  # one row


def availability(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Whether each column has any value."""
    one = rows.agg(*[(F.count(c) > 0).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("available")) for c in columns])).alias("f")).select("f.*")


def rebased(path: str | Column, marker: str, root: str) -> Column:
    """A path whose part behind ``marker`` is put under ``root``; null without the marker or anything behind it."""
    x = F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/"))
    rest = F.regexp_replace(F.substring(x, F.locate(marker, x) + len(marker), F.length(x)), r"^/+|/+$", "")
    return F.when((F.locate(marker, x) > 0) & (rest != ""), F.concat(F.lit(root.rstrip("/") + "/"), rest))


def file_names(batch: str | Column, cell: str | Column) -> Column:
    """The JSON file names that a cell of a batch may have, most likely first, without repeats."""
    b, c = (F.col(x) if isinstance(x, str) else x for x in (batch, cell))
    stem = F.regexp_replace(F.trim(c), r"\.json$", "")
    other = F.when(F.endswith(stem, F.lit("_structure")), F.regexp_replace(stem, "_structure$", "")).otherwise(F.concat(stem, F.lit("_structure")))
    in_batch = F.when(F.startswith(stem, F.lit("CH")), F.concat(b, F.lit("_"), stem))
    stems = F.array(stem, other, in_batch, F.concat(in_batch, F.lit("_structure")))
    return F.transform(F.array_distinct(F.filter(stems, lambda s: s.isNotNull() & (s != ""))), lambda s: F.concat(s, F.lit(".json")))


def reconstructed_paths(rows: DataFrame, key: str, root: str, batch: str, cells: list[str]) -> DataFrame:
    """(key, rank, path): where a row's file may lie by its batch and any of its cell names, in order."""
    base = root.rstrip("/") if root.rstrip("/").endswith("/data") else root.rstrip("/") + "/data"
    names = F.flatten(F.array(*[F.coalesce(F.when(F.trim(F.col(c)) != "", file_names(batch, c)), F.array().cast("array<string>")) for c in cells]))
    each = rows.where(F.trim(F.col(batch)) != "").select(key, batch, F.posexplode(names).alias("rank", "name"))
    return each.select(key, "rank", F.concat_ws("/", F.lit(base), batch, "name").alias("path"))


def resolved_sources(rows: DataFrame, key: str, columns: list[str], root: str, marker: str, batch: str, cells: list[str], files: DataFrame) -> DataFrame:
    """(key, path, how, source_column, source_path, attempted): each row's raw file, the first of: a path column as it is,
    rebased by the marker, taken as relative; then one made of batch and cell names. ``attempted``: all tried, in order."""
    tries = []
    for i, c in enumerate(columns):
        x = F.nullif(F.trim(F.col(c)), F.lit(""))
        relative = F.when(~F.startswith(x, F.lit("/")), F.concat(F.lit(root.rstrip("/") + "/"), x))
        for j, (how, p) in enumerate((("direct", x), ("rebased", rebased(x, marker, root)), ("rebased", relative))):
            tries.append(F.struct(F.lit(3 * i + j).alias("rank"), F.lit(how).alias("how"), F.lit(c).alias("source_column"), p.alias("path")))
    each = rows.select(key, F.explode(F.array(*tries)).alias("t")).select(key, "t.*").where("path IS NOT NULL")
    made = reconstructed_paths(rows, key, root, batch, cells).select(key, (F.col("rank") + 3 * len(columns)).alias("rank"), F.lit("reconstructed").alias("how"), F.lit(None).cast("string").alias("source_column"), "path")
    hit = each.unionByName(made).join(files.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    best = F.min_by(F.struct("path", "how", "source_column"), F.when(F.col("_there"), F.col("rank")))
    upto = F.min(F.when(F.col("_there"), F.col("rank")))
    tried = F.sort_array(F.collect_list(F.struct("rank", "path")))
    found = hit.groupBy(key).agg(best.alias("b"), upto.alias("_upto"), tried.alias("_tried"))
    kept = F.transform(F.filter("_tried", lambda t: F.col("_upto").isNull() | (t["rank"] <= F.col("_upto"))), lambda t: t["path"])
    first = F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.struct(F.lit(c).alias("c"), F.trim(F.col(c)).alias("p"))) for c in columns])
    out = rows.select(key, first.alias("_first")).join(found, key, "left")
    return out.select(key, "b.path", F.coalesce("b.how", F.lit("unresolved")).alias("how"), F.coalesce("b.source_column", "_first.c").alias("source_column"), F.col("_first.p").alias("source_path"), F.array_join(F.array_distinct(F.coalesce(kept, F.array().cast("array<string>"))), ";").alias("attempted"))


def within(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the ids (a semi join)."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def table_problems(rows: DataFrame, required: list[str], unique: str | None = None, lower: str | None = None) -> list[str]:
    """What is wrong with a table: missing columns, numbers that are infinite, repeated names, texts not in lower case."""
    found = [f"missing column: {c}" for c in required if c not in rows.columns]
    numbers = [c for c, t in rows.dtypes if t in ("float", "double")]
    checks = {f"infinite numbers: {c}": F.count_if(F.abs(F.col(c)) == float("inf")) for c in numbers}
    if lower and lower in rows.columns:
        checks[f"not in lower case: {lower}"] = F.count_if(F.col(lower) != F.lower(lower))
    if checks:
        seen = rows.agg(*[c.alias(str(i)) for i, c in enumerate(checks.values())]).first()
        found += [name for i, name in enumerate(checks) if seen[str(i)]]
    if unique and unique in rows.columns and not rows.groupBy(unique).count().where("count > 1").isEmpty():
        found.append(f"repeated: {unique}")
    return found
