"""One digest for settings that mean the same, however they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Objects and lists within each other that settings may have.
MOST_DEPTH = 64


def _list(x: Column) -> Column:
    return F.try_variant_get(x, "$", "array<variant>")


def _object(x: Column) -> Column:
    return F.try_variant_get(x, "$", "map<string,variant>")


def _parts(x: Column) -> Column:
    """The (name, value) parts of an object or a list, null for a single value."""
    in_list = F.transform(_list(x), lambda v, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("key"), v.alias("value")))
    name = lambda k: F.concat(F.lit("."), F.to_json(F.struct(k.alias("k"))))
    in_object = F.transform(F.map_entries(_object(x)), lambda e: F.struct(name(e["key"]).alias("key"), e["value"].alias("value")))
    return F.coalesce(in_list, in_object)


def _single(x: Column) -> Column:
    """A single value, an empty list or an empty object as text: numbers have one form, texts are told from all else."""
    kind = F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0)
    number = F.try_variant_get(x, "$", "double")
    whole = F.try_variant_get(x, "$", "decimal(38,0)")
    form = F.when(F.abs(number) < 2.0**53, (number + 0.0).cast("string")).when(whole.cast("double") == number, whole.cast("string")).otherwise(number.cast("string"))
    return (
        F.when(kind == "VOID", "null").when(kind == "ARRAY", "[]").when(kind == "OBJECT", "{}").when(kind == "STRING", F.to_json(F.struct(F.try_variant_get(x, "$", "string").alias("t"))))
        .when(kind == "BOOLEAN", F.try_variant_get(x, "$", "string")).otherwise(form)
    )


def canonical_lines(settings: Column) -> Column:
    """The sorted ``path=value`` lines of a nested value (a variant): names in one order, 1, 1.0 and 1e0 alike. Lists keep
    their order. Values are opened from the top, a level at a time."""

    def step(held: Column, _: Column) -> Column:
        opened = F.flatten(F.transform(
            held["items"],
            lambda p: F.when(F.size(_parts(p["value"])) > 0, F.transform(_parts(p["value"]), lambda q: F.struct(F.concat(p["key"], q["key"]).alias("key"), q["value"].alias("value")))).otherwise(F.array(p)),
        ))
        more = F.exists(held["items"], lambda p: F.coalesce(F.size(_parts(p["value"])) > 0, F.lit(False)))
        return F.when(held["more"], F.struct(opened.alias("items"), more.alias("more"))).otherwise(held)

    start = F.struct(F.array(F.struct(F.lit("$").alias("key"), settings.alias("value"))).alias("items"), F.lit(True).alias("more"))
    items = F.aggregate(F.sequence(F.lit(0), F.lit(MOST_DEPTH)), start, step, lambda held: F.when(held["more"], F.raise_error(F.lit("settings are nested too deeply")).cast("array<struct<key:string,value:variant>>")).otherwise(held["items"]))
    return F.when(settings.isNotNull(), F.array_sort(F.transform(items, lambda p: F.concat(p["key"], F.lit("="), _single(p["value"])))))


def settings_digest(settings: Column) -> Column:
    """The digest of settings (a variant); null without any."""
    return F.sha2(F.array_join(canonical_lines(settings), "\n"), 256)


def columns_digest(columns: list[str]) -> Column:
    """The digest of a row's columns as settings; nulls are settings, too."""
    return settings_digest(F.parse_json(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})))


def by_digest(rows: DataFrame, text: str, partial: list[Column], total: list[Column]) -> DataFrame:
    """(digest, totals) of rows with settings as JSON texts: ``partial`` aggregates of each text, ``total`` of those. Equal
    texts have one digest, so it is worked out once a text and not once a row."""
    each = rows.groupBy(text).agg(*partial).repartition(text)
    return each.withColumn("digest", settings_digest(F.parse_json(F.col(text)))).groupBy("digest").agg(*total)
