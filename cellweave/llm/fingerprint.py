"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

A text's words are its lower-cased runs without white space; its shingles are five words in a row (all words, if there
are fewer). Each shingle is hashed once. The top bits of the hash are its bin, the least hash of a bin represents it.
An empty bin copies the bin that its own random probes hit first (optimal densification), and the low eight bits of
every bin are stored. The likeness of two fingerprints is the share of equal bins, corrected for chance agreement.

Edge cases: a null text is empty; a text without words has the fingerprint '', like another of the kind (1.0) and unlike
any other (0.0); very long texts are fingerprinted whole; in ``op4``, documents that share an id go by a 128-bit hash of id
and text, documents without one come last by the same hash, and rows that repeat both count once as neighbours; a single
document is its own next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import sha_hex, table, unique_integer, whole_text, written

WORDS = 5
BIN_BITS = 7
BITS = 8
PROBES = 8
#: Documents that a range of the order by id holds on average, and the most ranges.
RANGE_ROWS, MOST_RANGES = 20_000, 4096


def words(text: Column) -> Column:
    return F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+", -1)


def shingle_hashes(w: Column, k: int = WORDS) -> Column:
    """64-bit hashes of the k-word shingles of a word array, one of all words where there are fewer."""
    return F.when(
        F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    ).otherwise(F.array(F.xxhash64(w)))


def _literal(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def bin_minima(hashes: Column, bits: int = BIN_BITS) -> Column:
    """Per bin in order its least hash, or the bin's largest number where it is empty.

    The largest numbers are sorted in among the hashes, so every bin has a first element.
    """
    low = 64 - bits
    n = 1 << bits
    ends = _literal([((j - n // 2 + 1) << low) - 1 for j in range(n)], "bigint")
    return F.sort_array(F.concat(hashes, ends))


def first_of_bins(ordered: Column, bits: int = BIN_BITS) -> Column:
    low = 64 - bits
    return F.filter(ordered, lambda x, i: (i == 0) | (F.shiftright(x, low) != F.shiftright(F.get(ordered, i - 1), low)))


def densified(minima: Column, bits: int = BIN_BITS, keep: int = BITS, seed: int = 1) -> Column:
    """The low ``keep`` bits per bin; an empty bin takes those of the first non-empty bin among its probes.

    After the fixed probes the non-empty bin of the least random rank is taken, so every bin is filled.
    """
    n, mask, full = 1 << bits, (1 << keep) - 1, (1 << (64 - bits)) - 1
    rng = random.Random(seed)
    probes = _literal([rng.randrange(n) for _ in range(n * PROBES)], "int")
    value = lambda x: F.when(x.bitwiseAND(F.lit(full)) != full, x.bitwiseAND(F.lit(mask)) - (1 << keep - 1))

    def one(x: Column, j: Column) -> Column:
        hit = [value(F.get(minima, F.get(probes, j * PROBES + t))) for t in range(PROBES)]
        ranked = F.array_min(
            F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.when(value(F.get(minima, b)).isNotNull(), F.struct(F.xxhash64(j, b), value(F.get(minima, b)).alias("v"))))
        )["v"]
        return F.coalesce(value(x), *hit, ranked).cast("tinyint")

    return F.transform(minima, one)


def with_fingerprint(df: DataFrame, text_col: str, out: str, k: int = WORDS) -> DataFrame:
    """``df`` with ``out``: an array of one byte per bin, empty where the text has no words."""
    w, h, m = f"{out}_w", f"{out}_h", f"{out}_m"
    has = F.trim(F.get(F.col(w), F.lit(0))) != ""
    return (
        df.withColumn(w, words(whole_text(text_col)))
        .withColumn(h, F.when(has, bin_minima(shingle_hashes(F.col(w), k))).otherwise(F.array().cast("array<bigint>")))
        .drop(w)
        .withColumn(m, first_of_bins(F.col(h)))
        .drop(h)
        .withColumn(out, densified(F.col(m)))
        .drop(m)
    )


def packed(fp: Column) -> Column:
    """The fingerprint as lowercase hexadecimal text."""
    digits = _literal([f"{v:02x}" for v in range(1 << BITS)], "string")
    return F.array_join(F.transform(fp, lambda v: F.get(digits, v.cast("int") + (1 << BITS - 1))), "")


def likeness(a: Column, b: Column, keep: int = BITS) -> Column:
    """The estimated share of common shingles, 0 to 1."""
    chance = 2.0**-keep
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    guess = (same / F.greatest(F.size(a), F.lit(1)) - chance) / (1 - chance)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), guess)))


def next_rows(rows: DataFrame, n: int) -> DataFrame:
    """(key, doc_id, n_chars, next) of about ``n`` distinct ``rows`` (key, doc_id, n_chars): the next key by descending
    doc_id and key, the first after the last.

    The rows are cut into ranges of that order, written so that the ranges stay, followed up within each, and one row a
    range links the ranges. An id that many rows share is cut like any other.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("key").desc()]
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    ranged = written(rows.repartitionByRange(ranges, *order).withColumn("bucket", F.spark_partition_id()), "ranges")
    within = ranged.withColumn("next", F.lead("key").over(Window.partitionBy("bucket").orderBy(*order)))
    one = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "key")
    heads = ranged.groupBy("bucket").agg(F.max(one)["key"].alias("head"))
    around = Window.orderBy("bucket")  # a row a range
    links = heads.select("bucket", F.lead("head").over(around).alias("after"), F.first("head").over(around).alias("first"))
    return within.join(F.broadcast(links), "bucket").select("key", "doc_id", "n_chars", F.coalesce("next", "after", "first").alias("next"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    unique = unique_integer(docs)
    rows = docs.withColumn("key", F.col("doc_id") if unique else F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")))
    slim = rows.select("key", "doc_id", F.length("text").alias("n_chars"))
    pairs = next_rows(slim if unique else slim.distinct(), docs.count())
    base = rows.select("key", "text")  # moved once: both joins below read one exchange
    other = base.select(F.col("key").alias("next"), F.col("text").alias("next_text"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    lent = with_fingerprint(pairs.join(other, "next"), "next_text", "next_fp").select(
        "key", "doc_id", "n_chars", F.substring("next_text", F.lit(1), third).alias("lent"), "next_fp"
    )
    lent = lent if unique else lent.dropDuplicates(["key"])
    edited = base.join(lent, "key").withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - third), "lent"))
    both = with_fingerprint(with_fingerprint(edited.select("doc_id", "n_chars", "text", "edited", "next_fp"), "text", "fp"), "edited", "edited_fp")
    return both.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        sha_hex(F.col("edited")).alias("edited_sha256"),
        packed(F.col("fp")).alias("fingerprint"),
        packed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


QUERIES = {"op4_fingerprint": op4_fingerprint}
