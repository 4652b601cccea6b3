"""Fill-in-middle transformation over the tokens of the tokenizers library's Split pre-tokenizer.

The pre-tokenizer isolates every match of the unit pattern and gives its offsets in code points; nothing is trained. The
length of the array of ends is the number of units, and two ranks drawn from a digest of the row's id pick the places in
it at which the text is sliced into prefix, middle and suffix. ``restored`` rebuilds the text from the output alone.

Edge cases: a null text is empty and stays plain, as does a text that holds a marker; a null id is drawn as an id without
digits; repeated rows with one id get one form; an empty slice is written as such; very long texts are split a window
at a time, cut between units; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_bounded, sha_hex, table, whole_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Code points of a text that are split at once.
WINDOW = 250_000

_LETTERS = re.compile("[A-Za-z]*")


@lru_cache(2)
def splitter(unit: str):
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(unit), behavior="isolated")


def unit_ends(text: str, window: int = WINDOW) -> np.ndarray:
    """Where each unit of the text ends, in code points."""
    split, found, at = splitter(UNIT).pre_tokenize_str, [], 0
    while at < len(text):
        stop = at + window
        if stop < len(text) and _LETTERS.match(text[stop - 1]).end():
            stop = _LETTERS.match(text, stop).end()
        units = split(text[at:stop])
        found.append(np.fromiter((end for _, (_, end) in units), np.int64, len(units)) + at)
        at = stop
    return np.concatenate(found) if found else np.empty(0, np.int64)


def draws(id_col: str, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hex digest of the seed and the id, as integers."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), "UTF-8"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row.

    Of a hundred draws, those from ``plain_from`` on leave the text plain; of the others, those below ``spm_below`` put the
    suffix first.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, h1, h2, h3, h4 in zip(b["t"], b["h1"], b["h2"], b["h3"], b["h4"]):
                ends = unit_ends(text)
                n = len(ends)
                if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= plain_from:
                    out.append((n, "plain", None, None, text))
                    continue
                a, z = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                head, mid, tail = PREFIX + text[:a], MIDDLE + text[a:z], SUFFIX + text[z:]
                spm = h4 % 100 < spm_below
                out.append((n, "spm" if spm else "psm", a, z - a, tail + head + mid if spm else head + tail + mid))
            made = pd.DataFrame(out, columns=["n", "form", "prefix_chars", "middle_chars", "output"]).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
            made.insert(0, "id", b["id"].to_numpy())
            yield made

    h = [c.alias(f"h{k + 1}") for k, c in enumerate(draws(id_col, seed))]
    rows = byte_bounded(docs).select(F.col(id_col).alias("id"), whole_text(text_col).alias("t"), *h)
    return rows.mapInPandas(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output of a form was made from. No slice holds a marker and markers cannot overlap, so the first
    place of each is the one that was written."""
    out = F.col(output)

    def between(start: Column, end: Column) -> Column:
        return F.substring(out, start, end - start)

    p, s, m, end = F.instr(out, PREFIX), F.instr(out, SUFFIX), F.instr(out, MIDDLE), F.length(out) + 1
    head = F.when(F.col(form) == "psm", between(p + len(PREFIX), s)).otherwise(between(p + len(PREFIX), m))
    tail = F.when(F.col(form) == "psm", between(s + len(SUFFIX), m)).otherwise(between(s + len(SUFFIX), p))
    return F.when(F.col(form) == "plain", out).otherwise(F.concat(head, between(m + len(MIDDLE), end), tail))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha_hex(F.col("output")).alias("output_sha256"), sha_hex(restored()).alias("restored_sha256"))


ORACLE_SQL = {
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
    WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, length(array_to_string(u[:least(a, b)], '')) AS x, length(array_to_string(u[:greatest(a, b)], '')) AS z FROM r),
s AS (SELECT *, '<P>' || substr(t, 1, x) AS head, '<S>' || substr(t, z + 1) AS tail, '<M>' || substr(t, x + 1, z - x) AS mid FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN x END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN z - x END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN head || tail || mid ELSE tail || head || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM s"""
}

QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
