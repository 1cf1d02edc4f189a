"""Collocations: phrases whose words meet far more often than their parts would by chance.

Texts become vertical positional lists: for each word the positions where it occurs.
A phrase of k + 1 words is a phrase of k words at a position and one at the next, so
lists of longer phrases come from merge-joining the lists of frequent ones, and a
list's length is the phrase's exact frequency.  The adjacent word's postings are
joined where they begin a frequent phrase of k words themselves, for else the longer
phrase cannot be frequent.  Positions skip one at the end of a piece, so no phrase
crosses it.

Lists are cut by chunks of text, and a chunk's lists stay together: neighbours are
always found within a chunk.  Between two lengths only lengths of lists travel, a row
per chunk and phrase; a phrase that is frequent over all chunks takes the number of
its first row as its id, and each chunk is told the ids of its own phrases.  A word
that is a third of the corpus is one row per chunk.  Ids are exact, not hashes.

Then each candidate has the frequencies of its beginnings and endings from its two
parts of one word less, and everything else is one join by id: a candidate whose words
lie in a longer one of the same frequency lies in one that is longer by one word and
has that frequency too.

Defined results: a null text is empty; a null lang is UND, like that name itself.
Repeated rows count each.  Texts longer than a chunk are cut between pieces, so a chunk
is as long as its longest piece at most.  Ties in the score are ordered by frequency
and phrase.  An empty table has no phrases.  Only text and lang are read, whatever
other columns are called.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtally.llm.common import discard, release_memory, scratch, shuffles_cleaned, stored, text_slices

LEAST, LONGEST, MOST = 100, 5, 2000
UND = "und"
#: Bytes of text whose lists are kept together, about.
CHUNK_BYTES = 16 << 20
#: How lists are written: they are read once.
SMALLER = {"compression": "zstd"}
#: Rows that a task hands on at once.
ROWS = 1 << 16
#: Bits of an id: the task, the chunk of the task, the phrase of the chunk.
CHUNK_BITS, PHRASE_BITS = 16, 27
WORD, BLANK, BREAK = 0, 1, 2
BREAKS = b".,;:!?\n\x0b\x0c\r"
CUT = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte its kind, and the byte with A-Z made small."""
    kinds = np.full(256, WORD, np.uint8)
    kinds[list(b" \t")] = BLANK
    kinds[list(BREAKS)] = BREAK
    small = np.arange(256, dtype=np.uint8)
    small[65:91] += 32
    return kinds, small


KINDS, SMALL = _tables()


def packed(values: np.ndarray) -> bytes:
    """Numbers as differences, first all their lowest bytes: what is small packs well."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return steps.view(np.uint8).reshape(-1, steps.itemsize).T.tobytes()


def unpacked(data: bytes, kind=np.int32) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel().cumsum(dtype=kind)


def word_lists(text: bytes) -> tuple[int, pa.Array, np.ndarray, np.ndarray]:
    """Number of words, distinct words, lengths of their lists, the lists one after another."""
    data = np.frombuffer(text, np.uint8)
    kinds = KINDS[data]
    inside = kinds == WORD
    edges = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    pieces = np.searchsorted(np.flatnonzero(kinds == BREAK), starts)
    positions, n = (np.arange(len(starts)) + pieces).astype(np.int32), len(starts)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    del edges, starts, ends, pieces, kinds
    letters = SMALL[data[inside]]
    words = pa.Array.from_buffers(
        pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
    ).dictionary_encode()
    which = words.indices.to_numpy()
    lengths = np.bincount(which, minlength=len(words.dictionary)).astype(np.int32)
    return n, words.dictionary, lengths, positions[np.argsort(which, kind="stable")]


def cut_texts(text: bytes, most: int):
    """text in parts of about most bytes that end where a piece ends."""
    start = 0
    while start < len(text):
        end = CUT.search(text, start + most)
        stop = end.end() if end else len(text)
        yield text[start:stop]
        start = stop


def first_lists(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """chunk, lang, n_words, words, lengths, places: the lists of words, a row per chunk and lang."""

    def index(batches):
        task, chunks = TaskContext.get().partitionId(), 0
        held: dict[str, list[bytes]] = {}
        size = 0

        def flush():
            nonlocal chunks, size
            for lang, texts in held.items():
                n, words, lengths, places = word_lists(b"\n".join(texts))
                texts.clear()
                if n:
                    if chunks >> CHUNK_BITS or len(words) >> PHRASE_BITS:
                        raise ValueError("more chunks in a task, or words in a chunk, than ids")
                    number = ((task << CHUNK_BITS) + chunks) << PHRASE_BITS
                    yield pa.RecordBatch.from_pydict(
                        {
                            "chunk": [number],
                            "lang": [lang],
                            "n_words": [n],
                            "words": pa.array([words.to_pylist()], pa.list_(pa.string())),
                            "lengths": [packed(lengths)],
                            "places": [packed(places)],
                        }
                    )
                    chunks += 1
            held.clear()
            size = 0

        for batch in text_slices(batches):
            for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True):
                for part in cut_texts(text.encode(), chunk_bytes):
                    held.setdefault(lang, []).append(part)
                    size += len(part)
                    if size >= chunk_bytes:
                        yield from flush()
        yield from flush()
        release_memory()

    read = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UND)).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    form = "chunk long, lang string, n_words long, words array<string>, lengths binary, places binary"
    return read.mapInArrow(index, form)


def in_rows(columns: dict):
    """Arrow batches of some rows each."""
    columns = {k: pa.array(v) for k, v in columns.items()}
    for a in range(0, len(next(iter(columns.values()))), ROWS):
        yield pa.RecordBatch.from_pydict({k: v.slice(a, ROWS) for k, v in columns.items()})


def word_counts(lists: DataFrame) -> DataFrame:
    """phrase (a number of its own), lang, word, n of each chunk's words."""

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, lang = (batch.column(c)[i].as_py() for c in ("chunk", "lang"))
                words = batch.column("words")[i].values
                phrase = chunk + np.arange(len(words))
                n = unpacked(batch.column("lengths")[i].as_py()).astype(np.int64)
                yield from in_rows({"phrase": phrase, "lang": pa.repeat(lang, len(n)), "word": words, "n": n})
        release_memory()

    needed = lists.select("chunk", "lang", "words", "lengths")
    return needed.mapInArrow(rows, "phrase long, lang string, word string, n long")


def phrase_counts(lists: DataFrame) -> DataFrame:
    """phrase, first, second, n of each chunk's phrases."""

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda c, i=i, batch=batch: batch.column(c)[i].as_py()
                first, second = (unpacked(cell(c), np.int64) for c in ("firsts", "seconds"))
                phrase = cell("chunk") + np.arange(len(first))
                n = unpacked(cell("lengths")).astype(np.int64)
                yield from in_rows({"phrase": phrase, "first": first, "second": second, "n": n})
        release_memory()

    needed = lists.select("chunk", "firsts", "seconds", "lengths")
    return needed.mapInArrow(rows, "phrase long, first long, second long, n long")


def frequent(counts: DataFrame, keys: list[str], least: int) -> DataFrame:
    """phrase, id, a and keys of each chunk's phrases that all chunks together have least times.

    Where phrase is id the row stands for the phrase itself.
    """
    same = Window.partitionBy(*keys)
    summed = counts.withColumns({"a": F.sum("n").over(same), "id": F.min("phrase").over(same)})
    return summed.where(F.col("a") >= least).select("phrase", "id", "a", *keys)


def extended(lists: DataFrame, found: DataFrame) -> DataFrame:
    """chunk, firsts, seconds, lengths, places: lists of phrases that are a word longer.

    firsts and seconds are the ids of their two parts of one word less.
    """

    def extend(held: pa.Table, told: pa.Table) -> pa.Table:
        columns = {"chunk": [], "firsts": [], "seconds": [], "lengths": [], "places": []}
        if held.num_rows and told.num_rows:
            chunk = held.column("chunk")[0].as_py()
            lengths = unpacked(held.column("lengths")[0].as_py())
            told = told.sort_by("id")
            known = np.full(len(lengths), -1, np.int32)
            known[told.column("phrase").to_numpy() - chunk] = np.arange(told.num_rows)
            ids = told.column("id").to_numpy()
            which = np.repeat(known, lengths)
            places = unpacked(held.column("places")[0].as_py())[which >= 0]
            order = np.argsort(places)
            places, which = places[order], which[which >= 0][order].astype(np.int64)
            meet = np.flatnonzero(places[1:] == places[:-1] + 1)
            pair = which[meet] * told.num_rows + which[meet + 1]
            order = np.argsort(pair, kind="stable")
            pair, places = pair[order], places[meet[order]]
            starts = np.flatnonzero(np.diff(pair, prepend=-1))
            lengths = np.diff(starts, append=len(pair)).astype(np.int32)
            first, second = ids[pair[starts] // told.num_rows], ids[pair[starts] % told.num_rows]
            for name, value in zip(
                columns,
                (chunk, *map(packed, (first, second, lengths, places))),
                strict=True,
            ):
                columns[name].append(value)
        release_memory()
        kinds = [pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array(v, t) for v, t in zip(columns.values(), kinds, strict=True)], list(columns))

    chunk = F.shiftleft(F.shiftright("phrase", PHRASE_BITS), PHRASE_BITS).alias("chunk")
    told = found.select(chunk, "phrase", "id").groupBy("chunk")
    needed = lists.select("chunk", "lengths", "places").groupBy("chunk")
    form = "chunk long, firsts binary, seconds binary, lengths binary, places binary"
    return needed.cogroup(told).applyInArrow(extend, form)


def candidates(docs: DataFrame, least: int = LEAST, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id, lang, phrase, words, a, n, heads, tails, first, second of phrases of 2 to LONGEST words.

    heads and tails are the frequencies of the first and of the last 1, 2, ... words.
    Frequent words are among the rows, as phrases of one word.  An id is one among the
    phrases of as many words.
    """
    lists = stored(first_lists(docs, chunk_bytes), "phrase-words", **SMALLER)
    sizes = lists.groupBy("lang").agg(F.sum("n_words").alias("n"))
    found = stored(frequent(word_counts(lists), ["lang", "word"], least), "phrase-frequent-1")
    none = F.array().cast("array<long>")
    level = found.where("phrase = id").join(sizes, "lang").select(
        "id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", "n",
        none.alias("heads"), none.alias("tails"), F.lit(None).cast("long").alias("first"),
        F.lit(None).cast("long").alias("second"),
    )
    levels = [stored(level, "phrase-level-1")]
    for k in range(2, LONGEST + 1):
        longer = stored(extended(lists, found), f"phrase-lists-{k}", **SMALLER)
        discard(lists, found)
        lists = longer
        found = stored(frequent(phrase_counts(lists), ["first", "second"], least), f"phrase-frequent-{k}")
        p, s = levels[-1].alias("p"), levels[-1].alias("s")
        own = found.where("phrase = id").select("id", "a", "first", "second").alias("f")
        joined = own.join(p, F.col("f.first") == F.col("p.id")).join(s, F.col("f.second") == F.col("s.id"))
        level = joined.select(
            "f.id", "p.lang", F.concat_ws(" ", "p.phrase", "s.last").alias("phrase"), "s.last", "f.a", "p.n",
            F.concat("p.heads", F.array("p.a")).alias("heads"),
            F.concat("s.tails", F.array("s.a")).alias("tails"), "f.first", "f.second",
        )
        levels.append(stored(level, f"phrase-level-{k}"))
    return reduce(
        DataFrame.unionByName, (x.withColumn("words", F.lit(k)) for k, x in enumerate(levels, 1))
    ).drop("last")


def lowest_cut(a: Column, n: Column, heads: Column, tails: Column) -> Column:
    """score, k, l, r of the cut with the lowest score, the first of those."""
    wide = lambda x: x.cast("decimal(19,0)")

    def cut(k: Column) -> Column:
        left, right = F.element_at(heads, k), F.element_at(tails, F.size(heads) + 1 - k)
        top = wide(a) * wide(n) * F.lit(1000).cast("decimal(4,0)")
        score = F.call_function("div", top, wide(left) * wide(right))
        return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(heads)), cut))


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's best phrases that no longer one replaces."""
    with scratch(docs.sparkSession), shuffles_cleaned(docs.sparkSession):
        found = candidates(docs, least, chunk_bytes)
        several = found.where("words > 1")
        part = F.explode(F.array("first", "second")).alias("id")
        parts = several.select((F.col("words") - 1).alias("words"), part, "a")
        within = parts.groupBy("words", "id").agg(F.max("a").alias("longer"))
        whole = several.join(within, ["words", "id"], "left").where("longer IS NULL OR longer < a")
        best = lowest_cut(*(F.col(c) for c in ("a", "n", "heads", "tails"))).alias("best")
        scored = whole.select("lang", "phrase", "a", "n", best).select("*", "best.score", "best.l", "best.r")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        shown = ranked.select(
            "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
        )
        return stored(shown, "phrases", outlive=True)


#: The same by counting all runs of words.
PHRASES_SQL = rf"""
WITH texts AS (
  SELECT coalesce(lang, '{UND}') AS lang, regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]') AS pieces
  FROM documents),
pieces AS (SELECT lang, unnest(pieces) AS piece FROM texts),
worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang),
runs AS (
  SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: w[i:i + k - 1])) AS p
  FROM worded, (SELECT unnest(range(1, {LONGEST + 1})) AS k)),
counted AS MATERIALIZED (
  SELECT lang, k, p, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT c.lang, c.k, c.p, c.a, x.a AS l, y.a AS r, s.n::BIGINT AS n, j,
         ((1000 * c.a::HUGEINT * s.n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT))::BIGINT AS score
  FROM counted c JOIN sizes s USING (lang), unnest(range(1, c.k)) AS t(j)
  JOIN counted x ON x.lang = c.lang AND x.p = c.p[1:j]
  JOIN counted y ON y.lang = c.lang AND y.p = c.p[j + 1:]
  WHERE c.k > 1),
lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
inner_runs AS (
  SELECT lang, a, unnest([p[1:k - 1], p[2:]]) AS p FROM counted WHERE k > 2),
longer AS (SELECT lang, p, max(a) AS a FROM inner_runs GROUP BY ALL),
kept AS (
  SELECT w.* FROM lowest w LEFT JOIN longer g ON g.lang = w.lang AND g.p = w.p
  WHERE g.a IS NULL OR g.a < w.a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC,
         array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM kept)
SELECT * FROM ranked WHERE rank <= {MOST}"""
