"""Lines that several documents hold: kept in the first one only.

Every line becomes its key's digest with the document and the position it stands
at.  Digests are dealt out by range and sorted by document and position within
each; one pass over a digest's rows then meets its first document first, and all
rows of later documents are to go.  A digest may hold a third of all rows, so the
pass is made twice: first by digest and block of documents, which ranges can split,
and then over what the first document of each block holds.  Text does not travel
with the digests.  What comes back is per document a bitmap of kept lines,
compressed as runs.

Defined results: a null text is one empty line, like an empty one.  Rows that share
a doc_id are one document: no row of it loses what another one holds.  Rows without
doc_id are together one document, after all others.  Rows equal in doc_id and text
share a bitmap.  Lines with equal keys within one document stay together or go
together.  A very long text is one row here as it is in the input, and its lines are
spread like all others.  An empty table has no bitmaps.  Only doc_id and text are
read, other columns stay as they are; the bitmaps' names for rows, doc and row, do
not meet them.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtally.llm.common import scratch, stored, unused

#: Code points that a key has at least to be looked at.
LEAST = 10
#: Groups of documents that the rows of one digest are split into.
BLOCKS = 1024
#: White space that is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
NAMELESS = 2**63 - 1


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z made small.

    lower() does that for text of one byte a character, and faster.
    """
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def occurrences(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """digest, block, doc, row, place of each line whose key is long enough."""
    rows = docs.select(
        doc_key().alias("doc"),
        F.xxhash64("text").alias("row"),
        F.posexplode(lines_of(F.col("text"))).alias("place", "line"),
    ).withColumn("bare", F.btrim("line", F.lit(BLANKS)))
    rows = rows.where(F.char_length("bare") >= least)
    return rows.select(
        F.unhex(F.md5(line_key(F.col("line")))).alias("digest"),
        F.pmod(F.xxhash64("doc"), F.lit(BLOCKS)).cast("int").alias("block"),
        "doc",
        "row",
        "place",
    )


def with_first(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with first, the least doc of their keys: ranges of keys, sorted by doc and place."""
    sorted_rows = Window.partitionBy(*keys).orderBy("doc", "place")
    so_far = sorted_rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.repartitionByRange(*keys).withColumn("first", F.first("doc").over(so_far))


def kept_runs(gone: Column) -> Column:
    """The runs of kept lines before the last of the sorted places that are gone."""

    def before(place: Column, i: Column, places: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(places, i - 1) + 1)
        return F.struct(start.alias("at"), (place - start).alias("n"))

    runs = F.transform(
        F.array(gone), lambda places: F.transform(places, lambda p, i: before(p, i, places))
    )[0]
    return F.filter(runs, lambda run: run["n"] > 0)


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc, row, keep, rest of the documents that lose lines; all others keep theirs.

    doc is the doc_id and row the text's hash.  keep has runs of kept lines, first
    place and number; from place rest on all lines are kept.
    """
    with scratch(docs.sparkSession):
        found = stored(occurrences(docs, least), "line-places")
        near = stored(with_first(found, "digest", "block"), "line-blocks")
        heads = near.where("doc = first").drop("first")
        far = with_first(heads, "digest")
        gone = near.unionByName(far).where("doc <> first")
        places = F.sort_array(F.collect_set("place")).alias("gone")
        bitmaps = gone.groupBy("doc", "row").agg(places).select(
            "doc",
            "row",
            kept_runs(F.col("gone")).alias("keep"),
            (F.element_at("gone", -1) + 1).alias("rest"),
        )
        return stored(bitmaps, "line-bitmaps", outlive=True)


def kept_lines(lines: Column, keep: Column, rest: Column) -> Column:
    """The lines that a bitmap keeps; without one all."""
    held = F.transform(
        F.array(lines),
        lambda x: F.concat(
            F.flatten(F.transform(keep, lambda run: F.slice(x, run["at"] + 1, run["n"]))),
            F.slice(x, rest + 1, F.size(x)),
        ),
    )[0]
    return F.when(rest.isNull(), lines).otherwise(held)


def with_bitmaps(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, str, str]:
    """docs with their bitmaps beside them, and the names of the columns keep and rest."""
    keep, rest, doc, row = (unused(docs, n) for n in ("keep", "rest", "doc", "row"))
    bitmaps = keep_bitmaps(docs, least).toDF(doc, row, keep, rest)
    keyed = docs.withColumns({doc: doc_key(), row: F.xxhash64("text")})
    return keyed.join(bitmaps, [doc, row], "left").drop(doc, row), keep, rest


def drop_repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs whose texts lack the lines that an earlier document holds."""
    joined, keep, rest = with_bitmaps(docs, least)
    kept = kept_lines(lines_of(F.col("text")), F.col(keep), F.col(rest))
    text = F.when(F.col(rest).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text).select(*docs.columns)


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    joined, keep, rest = with_bitmaps(docs.select("doc_id", "text"), least)
    shown = joined.withColumn("lines", lines_of(F.col("text")))
    shown = shown.withColumn("kept", kept_lines(F.col("lines"), F.col(keep), F.col(rest)))
    n_lines = F.size("lines").cast("long")
    return shown.select(
        "doc_id",
        n_lines.alias("n_lines"),
        (n_lines - F.size("kept")).alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


#: The same from all lines at once.
REPORT_SQL = f"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, coalesce(doc_id, {NAMELESS}) AS doc, string_split(text, chr(10)) AS lines FROM numbered),
placed AS (SELECT r, doc, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{ascii_uppercase}', '{ascii_lowercase}') AS key FROM placed),
firsts AS (SELECT key, min(doc) AS doc FROM keyed WHERE length(key) >= {LEAST}
           GROUP BY key HAVING count(DISTINCT doc) > 1),
judged AS (SELECT k.*, f.doc IS NOT NULL AND f.doc <> k.doc AS gone
           FROM keyed k LEFT JOIN firsts f USING (key)),
kept AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text
  FROM judged GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept.text) AS kept_sha256
FROM kept JOIN numbered USING (r)"""
