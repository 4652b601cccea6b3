"""Secret scans by an incremental blob ledger, with DataFrame functions only.

Every version of a file is a row. A version's text is content-addressed (SHA-256); a rule has a kind and a version.
Only (blob, rule, rule version) triples that the ledger lacks are scanned, each blob once however many paths hold it,
and the findings are joined back to all paths, in parts, so that a blob with very many paths fills no one task.

Edge cases: a null text is the empty blob; repeated rows are paths of one blob and each gets its findings; very long texts
are scanned whole; an empty table gives an empty result; columns beside those asked for are ignored, or kept by
``redact``, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dealt, parts_for, sha_hex, shared_dir, table, whole_text, with_found


@dataclass(frozen=True)
class Rule:
    """``pattern``: leftmost non-overlapping matches. ``group``: whose length must be at least ``least``."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)

FINDING = "array<struct<start:int,rank:int,end:int,kind:string>>"


def addressed(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """``versions`` with the column ``blob``, the SHA-256 of the text."""
    return versions.withColumn("blob", sha_hex(whole_text(text_col)))


def hit(text: Column, rule: Rule) -> Column:
    """Whether a text can have a match of the rule: never false where it has one."""
    if rule.kind == "hex" and rule.group == 0:
        return text.rlike(f"{rule.pattern[:-1]}{{{rule.least},}}")
    return text.rlike(rule.pattern)


def matches(text: Column, rule: Rule) -> Column:
    """Per match in order: the code points before it and after the match before, its length and its group's length."""
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    return F.transform(
        F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), inner.alias("inner")),
        lambda m: F.struct(
            F.length(m["gap"]).alias("gap"),
            F.coalesce(F.length(m["whole"]), F.lit(0)).alias("len"),
            F.coalesce(F.length(m["inner"]) >= rule.least, F.lit(False)).alias("ok"),
        ),
    )


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """(blob, findings) of the blobs that have any; ``blobs``: distinct ``blob`` with ``text``.

    The offsets are running sums over the matches of one blob, so no step grows faster than a text's matches.
    """
    found = F.array(*[
        F.struct(
            F.lit(i).alias("rank"),
            F.lit(r.kind).alias("kind"),
            F.when(hit(F.col("text"), r), matches(F.col("text"), r)).alias("at"),
        )
        for i, r in enumerate(rules)
    ])
    any_hit = F.lit(False)
    for r in rules:
        any_hit = any_hit | hit(F.col("text"), r)
    by = Window.partitionBy("blob", "rank").orderBy("i")
    return (
        blobs.where(any_hit)
        .select("blob", F.explode(found).alias("f"))
        .where(F.col("f.at").isNotNull())
        .select("blob", "f.rank", "f.kind", F.posexplode("f.at").alias("i", "m"))
        .withColumn("end", F.sum(F.col("m.gap") + F.col("m.len")).over(by).cast("int"))
        .where("m.ok")
        .groupBy("blob")
        .agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("m.len")).alias("start"), "rank", "end", "kind"))).cast(FINDING).alias("findings"))
    )


def unseen(versions: DataFrame, rules: tuple[Rule, ...], scanned: DataFrame | None) -> dict[tuple[Rule, ...], DataFrame]:
    """The blobs to scan, once each, by the set of rules that the ledger lacks for them.

    ``versions``: blob and text. ``scanned``: the ledger's (blob, kind, version) triples, or None for an empty ledger.
    Equal blobs meet after each task has kept one row of each, so a blob that many paths hold is moved once a task.
    """
    once = versions.select("blob", "text").dropDuplicates(["blob"])
    if scanned is None:
        return {rules: once}
    names = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    seen = scanned.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("seen"))
    lacks = F.array_join(F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))), ",")
    ids = versions.select("blob").distinct().join(seen, "blob", "left").select(lacks.alias("lacks")).where("lacks <> ''")
    sets = [row.lacks for row in ids.distinct().collect()]  # at most 2 ** len(rules)
    lacking = once.join(seen, "blob", "left").withColumn("lacks", lacks)
    return {
        tuple(r for r in rules if f"{r.kind}:{r.version}" in x.split(",")): lacking.where(F.col("lacks") == x).select("blob", "text")
        for x in sorted(sets)
    }


class Ledger:
    """A ledger kept as Parquet under ``path``: ``scanned`` (blob, kind, version) and ``findings`` by blob.

    ``update`` scans what is new in ``versions`` and appends; an update that is lost half way only means that its
    blobs are scanned again, since ``scanned`` is written last and ``findings`` are read as a set.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if fs.exists(path) else None

    def scanned(self) -> DataFrame | None:
        """The (blob, kind, version) triples that need no scan; None before the first update."""
        found = self._read("scanned", "blob string, kind string, version int")
        return None if found is None else found.distinct()

    def findings(self, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
        """(blob, findings) of the current rule versions."""
        live = F.lit(False)
        for r in rules:
            live = live | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
        schema = "blob string, kind string, version int, start int, end int"
        found = self._read("findings", schema)
        rows = (self.spark.createDataFrame([], schema) if found is None else found).where(live).distinct()
        order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
        one = F.struct("start", order[F.col("kind")].alias("rank"), "end", "kind")
        return rows.groupBy("blob").agg(F.sort_array(F.collect_list(one)).cast(FINDING).alias("findings"))

    def update(self, versions: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, text_col: str = "text") -> int:
        """Scan the unseen pairs of blob and rule version; the number of scanned pairs."""
        new = versions.select(whole_text(text_col).alias("text"))
        new = addressed(new)
        n = 0
        for some, blobs in unseen(new, rules, self.scanned()).items():
            version = F.create_map(*[x for r in some for x in (F.lit(r.kind), F.lit(r.version))])
            rows = scan(blobs, some).select("blob", F.explode("findings").alias("f"))
            rows.select("blob", "f.kind", version[F.col("f.kind")].alias("version"), "f.start", "f.end").write.mode("append").parquet(f"{self.path}/findings")
            names = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in some])
            pairs = blobs.select("blob", F.explode(names).alias("r")).select("blob", "r.kind", "r.version")
            n += pairs.count()
            pairs.write.mode("append").parquet(f"{self.path}/scanned")
        return n


def join_back(versions: DataFrame, findings: DataFrame) -> DataFrame:
    """``versions`` (with ``blob``) and each path's findings, an empty array where there are none."""
    rows = versions.withColumn("_path", F.xxhash64(*[c for c in versions.columns if c != "blob"]))
    spread = dealt(rows, ["blob"], "_path", parts_for(versions.count()))
    return with_found(spread, findings, ["blob"]).withColumn("findings", F.coalesce("findings", F.array().cast(FINDING))).drop("_path", "_part")


def digest(findings: Column, rules: tuple[Rule, ...] = BASE_RULES) -> list[Column]:
    of = lambda kind: F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("long")
    n = [of(r.kind).alias(f"n_{r.kind}") for r in rules]
    spans = F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    return [*n, sha_hex(spans).alias("base_sha256"), spans.alias("spans")]


def new_ledger(spark: SparkSession) -> Ledger:
    """An empty ledger in the shared folder."""
    return Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    ledger = new_ledger(spark)
    ledger.update(docs)
    return join_back(addressed(docs).select("doc_id", "blob"), ledger.findings()).select("doc_id", *digest(F.col("findings")))


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES, mark: str = "[SECRET]", ledger: Ledger | None = None) -> DataFrame:
    """``docs`` with every finding replaced by ``mark``; overlapping findings are replaced together.

    A text without findings is left as it is, a null one too. All columns are kept. What ``ledger`` knows already is not
    scanned again; without one an empty ledger is used.
    """
    ledger = ledger or new_ledger(docs.sparkSession)
    ledger.update(docs, rules, text_col)
    versions = addressed(docs.select(F.struct(*docs.columns).alias("row"), whole_text(text_col).alias("text")))
    joined = join_back(versions.select("row", "blob"), ledger.findings(rules))
    upto = lambda s: F.greatest(s["upto"], F.lit(0))
    text = F.col("row")[text_col]
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("upto"))
    pieces = F.aggregate(
        "findings",
        start,
        lambda s, f: F.when(
            f["start"] < s["upto"], F.struct(s["parts"].alias("parts"), F.greatest(s["upto"], f["end"]).alias("upto"))
        ).otherwise(
            F.struct(
                F.concat(s["parts"], F.array(F.substring(text, upto(s) + 1, f["start"] - upto(s)), F.lit(mark))).alias("parts"),
                f["end"].alias("upto"),
            )
        ),
        lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["upto"] + 1, F.length(text))),
    )
    masked = F.when(F.size("findings") > 0, pieces).otherwise(text)
    return joined.select(F.col("row").withField(text_col, masked).alias("row")).select("row.*")


_ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

ORACLE_SQL = {
    "op1_secret_scan": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
r(rank, kind, pat, least) AS (VALUES (0, 'assign', '{_ASSIGN}', 8), (1, 'access', 'AKIA[A-Z0-9]+', 16), (2, 'hex', '[0-9a-f]+', 32)),
m AS (
  SELECT doc_id, 0 AS rank, 'assign' AS kind, regexp_split_to_array(text, '{_ASSIGN}') AS gaps, regexp_extract_all(text, '{_ASSIGN}', 0) AS w, regexp_extract_all(text, '{_ASSIGN}', 2) AS g, 8 AS least FROM d WHERE regexp_matches(text, '{_ASSIGN}')
  UNION ALL SELECT doc_id, 1, 'access', regexp_split_to_array(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), 16 FROM d WHERE regexp_matches(text, 'AKIA[A-Z0-9]{{12}}')
  UNION ALL SELECT doc_id, 2, 'hex', regexp_split_to_array(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+', 0), regexp_extract_all(text, '[0-9a-f]+', 0), 32 FROM d WHERE regexp_matches(text, '[0-9a-f]{{32}}')),
e AS (SELECT doc_id, rank, kind, least, unnest(range(1, len(w) + 1)) AS i, gaps, w, g FROM m),
x AS (SELECT doc_id, rank, kind, i, length(w[i]) AS n, length(g[i]) >= least AS ok,
        sum(length(gaps[i]) + length(w[i])) OVER (PARTITION BY doc_id, rank ORDER BY i) AS fin FROM e),
f AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
        string_agg(kind || ':' || CAST(fin - n AS BIGINT) || ':' || CAST(fin AS BIGINT), ',' ORDER BY fin - n, rank) AS spans
      FROM x WHERE ok GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (doc_id)"""
}

QUERIES = {"op1_secret_scan": op1_secret_scan}
