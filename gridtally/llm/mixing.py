"""Mixing sources to target weights, with DataFrame operations only.

1. Words of each source are packed, document after document, into blocks of
   block_words words; only the last block of a source is shorter.
2. Each source gets the slots its target weight asks for, and every output
   shard draws how many of its slots each source fills: a multinomial draw
   without replacement from what is left of all slots, so every shard's counts
   are random and every source ends within half a block of its target, which
   independent draws would miss by their sampling error, past the limit of
   repeats too.  The draw deals all slots by a pseudorandom permutation and
   counts them by shard and source.
3. A source's slots, shard after shard as drawn, run through its blocks in
   epochs, each with a pseudorandom permutation of the block indexes of its own;
   blocks join slots by index.

The permutation is a swap-or-not shuffle: in each round an index may trade
places with its mirror image about a keyed pivot.  It is a bijection on any
range, is computed for each row by itself, and needs no sort.

Defined results: a null text has no words; documents without words are never
taken; a null source is a source of its own that sorts last; equal rows are
documents each, and their order among each other is no matter; an empty table
gives an empty mix.  A text of any length is one row that reaches into as many
blocks as its words fill.  Columns of the input other than doc_id, source and text
are ignored by the report and kept by the documents.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtally.llm.common import row_hash, stored, unused

BLOCK_WORDS = 32
SHARD_SLOTS = 4096
REPEATS = 3
SEED = 20240
ROUNDS = 16
PRIME = 2_147_483_647
#: Rows of a source that one window task orders at most, on average.
BUCKET_ROWS = 20_000
#: Slots that one row stands for before they are written out, and that one task writes out.
CHUNK_SLOTS = 4096
TASK_SLOTS = 50_000
#: Shards whose drawn counts one window task orders.
GROUP_SHARDS = 1024


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    draw = random.Random(seed)
    return [(draw.randrange(1, PRIME), draw.randrange(PRIME)) for _ in range(rounds)]


def permutation(size: Column, key: Column, seed: int) -> Column:
    """The rounds of the permutation of 0..size-1 named by key: an array of pivot, a, b."""
    prime = F.lit(PRIME).cast("long")

    def one(a: int, b: int) -> Column:
        mixed = ((key % prime) * a + b) % prime
        return F.struct(
            ((mixed * prime + (mixed * a + b) % prime) % size).alias("pivot"),
            F.lit(a).cast("long").alias("a"),
            (((key % prime) * a + b) % prime).alias("b"),
        )

    return F.array(*(one(a, b) for a, b in round_keys(seed)))


def permuted(index: Column, size: Column, rounds: Column) -> Column:
    """The place that index takes.

    The rounds run in one higher-order expression: as a chain of projections
    they would double in size each time the optimizer inlines one.
    """
    prime = F.lit(PRIME).cast("long")

    def traded(place: Column, k: Column) -> Column:
        def either(mirror: Column) -> Column:
            pair = F.greatest(place, mirror) % prime
            return F.when((pair * k["a"] + k["b"]) % prime % 2 == 1, mirror).otherwise(place)

        return F.get(F.transform(F.array(F.pmod(k["pivot"] - place, size)), either), F.lit(0))

    return F.aggregate(rounds, index, traded)


def sized(docs: DataFrame) -> DataFrame:
    """source, source_key, row_key, text_key, spread, size: one small row per document.

    source_key sorts as the sources do: by code point, null last.  row_key and
    text_key are hashes, equal for equal doc_id, source and text; spread is
    one that other engines compute as well.
    """
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("source_key"),
        *row_keys(),
        F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 8), 16, 10)
        .cast("long")
        .alias("spread"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
        .cast("long")
        .alias("size"),
    )


def row_keys() -> list[Column]:
    return [
        F.xxhash64("doc_id", "source", F.col("doc_id").isNull(), F.col("source").isNull()).alias("row_key"),
        F.xxhash64("text").alias("text_key"),
    ]


def source_targets(sizes: DataFrame, block_words: int, repeats: int = REPEATS) -> DataFrame:
    """One row per source: its size, target, number of blocks and of slots.

    Weights 1, 2, 3 repeat along the sorted sources.  A source's target stops at
    repeats times its size; what it leaves is shared by weight among the rest,
    again until none is above.  That end point is least(cap, level * weight)
    for one common level, which a pass over the sources sorted by cap / weight
    finds.  The windows here run over one row per source, never over documents.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy("source_key")
    by_fill = Window.orderBy("fill", "source_key")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(0, Window.unboundedFollowing)
    slots_before = by_name.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(everything).cast("double")
        - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    return (
        sizes.groupBy("source_key")
        .agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
        .withColumn("source_no", (F.row_number().over(by_name) - 1).cast("long"))
        .withColumn("weight", F.col("source_no") % 3 + 1)
        .withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn(
            "level",
            F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "source_key", "level")))
            .over(everything)
            .getField("level"),
        )
        .withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
        .withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long"))
        .withColumn(
            "n_slots",
            F.when(
                F.col("source_size") > 0,
                F.least(
                    F.floor(F.col("target") * F.col("n_blocks") / F.col("source_size") + 0.5),
                    F.lit(repeats) * F.col("n_blocks"),
                ),
            )
            .otherwise(0)
            .cast("long"),
        )
        .withColumn(
            "first_slot", F.coalesce(F.sum("n_slots").over(slots_before), F.lit(0)).cast("long")
        )
        .withColumn("all_slots", F.sum("n_slots").over(everything))
        .drop("cap", "fill", "level", "weight")
    )


def hashed_bucket(buckets: int) -> Column:
    known = F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long"), F.lit(PRIME))
    return (known + F.col("spread")) % PRIME * 48271 % PRIME % buckets


def placed(sizes: DataFrame, rows: int) -> DataFrame:
    """sizes with first_word: where the document starts among its source's words.

    A running sum in two levels: within hashed buckets of a source, and over the
    buckets' totals, so that a source with a third of all rows is many tasks.
    """
    buckets = max(64, -(-rows // BUCKET_ROWS))
    spread = sizes.withColumn("bucket", hashed_bucket(buckets))
    totals = spread.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = (
        Window.partitionBy("source_key")
        .orderBy("bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = totals.select(
        "source_key",
        "bucket",
        F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("bucket_start"),
    )
    inside = (
        Window.partitionBy("source_key", "bucket")
        .orderBy("doc_id", "size", "spread", "text_key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        spread.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, ["source_key", "bucket"])
        .withColumn("first_word", F.col("bucket_start") + F.col("ahead"))
        .drop("bucket", "ahead", "bucket_start")
    )


def draw_counts(
    sources: DataFrame, seed: int = SEED, shard_slots: int = SHARD_SLOTS
) -> DataFrame:
    """source_key, shard, n: the slots of each shard that each source fills, as drawn.

    A row per source is cut into chunks of slots, which are dealt to enough
    tasks before they are written out as rows.
    """
    zero = F.lit(0).cast("long")
    total = sources.agg(F.coalesce(F.sum("n_slots"), zero)).first()[0]
    last = F.floor((F.col("n_slots") - 1) / F.lit(CHUNK_SLOTS)).cast("long")
    chunk_end = F.least((F.col("chunk") + 1) * CHUNK_SLOTS, F.col("n_slots")) - 1
    slots = (
        sources.where("n_slots > 0")
        .withColumn("chunk", F.explode(F.sequence(zero, last)))
        .repartition(max(1, -(-total // TASK_SLOTS)), "source_key", "chunk")
        .withColumn("deal", permutation(F.col("all_slots"), zero, seed))
        .withColumn("turn", F.explode(F.sequence(F.col("chunk") * CHUNK_SLOTS, chunk_end)))
    )
    place = permuted(F.col("first_slot") + F.col("turn"), F.col("all_slots"), F.col("deal"))
    return (
        slots.select(
            "source_key", F.floor(place / F.lit(shard_slots)).cast("long").alias("shard")
        )
        .groupBy("source_key", "shard")
        .agg(F.count("*").alias("n"))
    )


def filled_slots(counts: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """shard, source_key, epoch, block: the block in each slot that the counts gave its source.

    The slots of a source are numbered shard after shard by a running sum in two
    levels, and a number is a turn through the source's blocks.
    """
    zero = F.lit(0).cast("long")
    total = sources.agg(F.coalesce(F.sum("n_slots"), zero)).first()[0]
    grouped = counts.withColumn("part", F.floor(F.col("shard") / GROUP_SHARDS))
    ahead = Window.partitionBy("source_key").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    inside = Window.partitionBy("source_key", "part").orderBy("shard").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        grouped.groupBy("source_key", "part")
        .agg(F.sum("n").alias("part_n"))
        .select("source_key", "part", F.coalesce(F.sum("part_n").over(ahead), zero).alias("start"))
    )
    first, end = F.col("first"), F.col("first") + F.col("n")
    runs = (
        grouped.withColumn("before", F.coalesce(F.sum("n").over(inside), zero))
        .join(starts, ["source_key", "part"])
        .withColumn("first", F.col("start") + F.col("before"))
        .join(sources.select("source_key", "source_no", "n_blocks"), "source_key")
    )
    epochs = F.sequence(
        F.floor(first / F.col("n_blocks")), F.floor((end - 1) / F.col("n_blocks"))
    )
    epoch_start = F.col("epoch") * F.col("n_blocks")
    turns = F.sequence(
        F.greatest(first, epoch_start) - epoch_start,
        F.least(end, epoch_start + F.col("n_blocks")) - 1 - epoch_start,
    )
    key = F.col("source_no") * REPEATS + F.col("epoch") + 1
    slots = (
        runs.repartition(max(1, -(-total // TASK_SLOTS)), "source_key", "shard")
        .withColumn("epoch", F.explode(epochs))
        .withColumn("rounds", permutation(F.col("n_blocks"), key, seed + 1))
        .withColumn("turn", F.explode(turns))
    )
    block = permuted(F.col("turn"), F.col("n_blocks"), F.col("rounds"))
    return slots.select("shard", "source_key", "epoch", block.alias("block"))


def doc_blocks(docs: DataFrame, block_words: int) -> DataFrame:
    """One row per document and block that it reaches into, with the words it has there."""
    reach = F.sequence(
        F.floor(F.col("first_word") / F.lit(block_words)),
        F.floor((F.col("first_word") + F.col("size") - 1) / F.lit(block_words)),
    )
    start = F.greatest(F.col("block") * block_words, F.col("first_word"))
    end = F.least((F.col("block") + 1) * block_words, F.col("first_word") + F.col("size"))
    return (
        docs.where("size > 0")
        .withColumn("block", F.explode(reach))
        .withColumn("n_words", end - start)
        .withColumn("from_word", start - F.col("first_word"))
    )


class Mix:
    """The mix of one table of documents: small intermediate tables, written once."""

    def __init__(
        self,
        docs: DataFrame,
        block_words: int = BLOCK_WORDS,
        seed: int = SEED,
        shard_slots: int = SHARD_SLOTS,
    ):
        self.sizes = stored(sized(docs), "mix-sizes")
        self.sources = stored(source_targets(self.sizes, block_words), "mix-sources")
        self.docs = placed(self.sizes, self.sizes.count())
        self.counts = stored(draw_counts(self.sources, seed, shard_slots), "mix-counts")
        self.slots = filled_slots(self.counts, self.sources, seed)
        self.blocks = doc_blocks(self.docs, block_words)

    def shards(self) -> DataFrame:
        """The mix itself: shard, epoch and block of each slot, and a document's words in it."""
        pieces = self.blocks.select(
            "source_key", "block", "doc_id", "first_word", "size", "row_key", "text_key",
            "from_word", "n_words",
        )
        # Spark's size estimate ignores how many slots a row explodes to, so it must not
        # choose to broadcast here.
        return self.slots.hint("merge").join(pieces, ["source_key", "block"])

    def documents(self) -> DataFrame:
        """doc_id, source_key, size, taken, first_shard of each document.

        taken are the words of it in all shards, repeats counted; first_shard is
        the first shard that holds some, null if none does.
        """
        own = ["source_key", "first_word"]
        taken = self.shards().groupBy(*own).agg(
            F.sum("n_words").alias("taken"), F.min("shard").alias("first_shard")
        )
        worded = self.docs.where("size > 0").join(taken.hint("merge"), own, "left")
        columns = ["doc_id", "source_key", "size", "taken", "first_shard"]
        empty = self.sizes.where("size = 0").withColumns(
            {"taken": F.lit(0).cast("long"), "first_shard": F.lit(None).cast("long")}
        )
        both = worded.select(*columns).unionByName(empty.select(*columns))
        return both.withColumn("taken", F.coalesce("taken", F.lit(0)))


def mix_report(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_shard for every document."""
    mix = Mix(docs, block_words, seed)
    goals = mix.sources.select("source_key", "source_size", "target")
    return mix.documents().join(goals, "source_key").select(
        "doc_id", "size", "source_size", "target", "taken", "first_shard"
    )


def mixed_documents(docs: DataFrame, block_words: int, seed: int = SEED) -> DataFrame:
    """The mix as documents: the input's columns, a row for each epoch a document is in a shard.

    An epoch that takes the whole document keeps its text as it is; else the text
    is the words taken in that epoch, joined by spaces.  n_chars, where there is
    one, follows the text.
    """
    mix = Mix(docs, block_words, seed)
    part = F.struct("epoch", "from_word", "n_words")
    names = ("_row_key", "_text_key", "_side", "_order", "_copy", "_take", "_epoch")
    row_key, text_key, side, order, copy, take, epoch = (unused(docs, n) for n in names)
    taken = (
        mix.shards()
        .groupBy("source_key", "first_word")
        .agg(
            F.first("row_key").alias(row_key),
            F.first("text_key").alias(text_key),
            F.first("size").alias("size"),
            F.sort_array(F.collect_list(part)).alias("parts"),
        )
        .select(
            row_key,
            text_key,
            F.lit(0).alias(side),
            F.col("first_word").alias(order),
            F.struct("size", "parts").alias(take),
        )
    )
    keyed = docs.withColumns(
        {**dict(zip((row_key, text_key), row_keys())), side: F.lit(1), order: row_hash(docs)}
    )
    # Documents and what is taken of them meet in one shuffle.  Equal rows are numbered on
    # both sides, and each meets what has its number, one before the other in a window, so
    # that very many equal rows are never an array.
    met = keyed.unionByName(taken, allowMissingColumns=True).repartition(row_key, text_key)
    numbers = Window.partitionBy(row_key, text_key, side).orderBy(order)
    both = Window.partitionBy(row_key, text_key, copy).orderBy(side)
    met = met.withColumn(copy, F.row_number().over(numbers))
    met = met.withColumn(take, F.lag(take).over(both)).where((F.col(side) == 1) & F.col(take).isNotNull())
    turns = F.array_distinct(F.transform(F.col(f"{take}.parts"), lambda p: p["epoch"]))
    chosen = F.filter(F.col(f"{take}.parts"), lambda p: p["epoch"] == F.col(epoch))
    joined = met.withColumn(epoch, F.explode(turns))
    size = F.col(f"{take}.size")
    whole = F.aggregate(chosen, F.lit(0).cast("long"), lambda n, p: n + p["n_words"]) == size

    def cut(words: Column) -> Column:
        return F.array_join(
            F.transform(
                chosen,
                lambda p: F.array_join(
                    F.slice(words, (p["from_word"] + 1).cast("int"), p["n_words"].cast("int")), " "
                ),
            ),
            " ",
        )

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # One element, so that the words are found once per row and not once per part.
    some = F.get(F.transform(F.array(words), cut), F.lit(0))
    mixed = joined.withColumn("text", F.when(whole, F.col("text")).otherwise(some))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(*docs.columns)


def permuted_sql(base: str, first: str, size: str, key: str, index: str, seed: int) -> str:
    """Common table expressions {base}0 to {base}16 that permute the column index as permuted()."""
    steps = [first]
    for i, (a, b) in enumerate(round_keys(seed)):
        mixed = f"(({key} % {PRIME} * {a} + {b}) % {PRIME})"
        pivot = f"(({mixed} * {PRIME} + ({mixed} * {a} + {b}) % {PRIME}) % {size})"
        mirror = f"((({pivot} - {index}) % {size} + {size}) % {size})"
        bit = f"(greatest({index}, {mirror}) % {PRIME} * {a} + {mixed}) % {PRIME} % 2"
        steps.append(
            f"{base}{i + 1} AS (SELECT * REPLACE (CASE WHEN {bit} = 1 THEN {mirror}"
            f" ELSE {index} END AS {index}) FROM {base}{i})"
        )
    return ",\n".join(steps)


def report_sql(
    block_words: int = BLOCK_WORDS, seed: int = SEED, shard_slots: int = SHARD_SLOTS
) -> str:
    """mix_report(documents) for DuckDB, the draw and the permutations included."""
    deal = permuted_sql(
        "d",
        """d0 AS (
  SELECT source_key, source_no, n_blocks, all_slots, first_slot + unnest(range(n_slots)) AS place
  FROM sources WHERE n_slots > 0)""",
        "all_slots", "0::BIGINT", "place", seed,
    )
    turned = permuted_sql(
        "r",
        f"""r0 AS (
  SELECT source_key, shard, n_blocks, turn % n_blocks AS block,
         (source_no * {REPEATS} + turn // n_blocks + 1) % {PRIME} AS key FROM drawn)""",
        "n_blocks", "key", "block", seed + 1,
    )
    return rf"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS source_key,
         ('0x' || md5(coalesce(text, ''))[:8])::BIGINT AS spread,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
named AS (
  SELECT source_key, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source_key) - 1 AS source_no
  FROM sized GROUP BY source_key),
filled AS (
  SELECT *, source_no % 3 + 1 AS weight, {float(REPEATS)}::DOUBLE * source_size AS cap,
         {float(REPEATS)}::DOUBLE * source_size / (source_no % 3 + 1) AS fill FROM named),
leveled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (
           ORDER BY fill, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER (ORDER BY fill, source_key
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM filled),
aimed AS (
  SELECT source_key, source_no, source_size,
         least(cap, weight * (SELECT arg_min(level, (fill, source_key)) FROM leveled
                              WHERE level <= fill)) AS target,
         CAST(ceil(source_size / {block_words}::DOUBLE) AS BIGINT) AS n_blocks FROM leveled),
slotted AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(
           target * n_blocks / source_size + 0.5) AS BIGINT), {REPEATS} * n_blocks)
         ELSE 0 END AS n_slots FROM aimed),
sources AS (
  SELECT *, (sum(n_slots) OVER ())::BIGINT AS all_slots, coalesce(sum(n_slots) OVER (
           ORDER BY source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_slot
  FROM slotted),
{deal},
drawn AS (
  SELECT source_key, source_no, n_blocks, place // {shard_slots} AS shard,
         row_number() OVER (PARTITION BY source_key ORDER BY place) - 1 AS turn FROM d{ROUNDS}),
{turned},
spreaded AS (
  SELECT *, (((coalesce(doc_id, 0) % {PRIME} + {PRIME}) % {PRIME}) + spread) % {PRIME} * 48271 % {PRIME}
         % greatest(64, (SELECT (count(*) + {BUCKET_ROWS - 1}) // {BUCKET_ROWS} FROM sized))
         AS bucket FROM sized),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source_key ORDER BY bucket, doc_id, size, spread
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_word
  FROM spreaded),
reached AS (
  SELECT *, unnest(range(first_word // {block_words},
           (first_word + size - 1) // {block_words} + 1)) AS block FROM placed WHERE size > 0),
taken AS (
  SELECT source_key, first_word, min(shard) AS first_shard,
         sum(least((block + 1) * {block_words}, first_word + size)
             - greatest(block * {block_words}, first_word)) AS taken
  FROM reached JOIN r{ROUNDS} USING (source_key, block) GROUP BY source_key, first_word),
every AS (
  SELECT source_key, doc_id, size, coalesce(taken, 0)::BIGINT AS taken, first_shard
  FROM placed LEFT JOIN taken USING (source_key, first_word) WHERE size > 0
  UNION ALL SELECT source_key, doc_id, size, 0, NULL FROM sized WHERE size = 0)
SELECT doc_id, size, source_size, target, taken, first_shard
FROM every JOIN sources USING (source_key)"""
