"""Near-duplicate classes by BagMinHash signatures of word-shingle multisets.

A document is the multiset of its five-word shingles.  Each shingle drives
Poisson processes in time, one for each interval of a doubling division of the
weight axis: (0,1], (1,2], (2,4], ...  A point of a process hits a random
component of the signature and carries a weight; it counts for a document that
holds the shingle more often than that weight.  A component keeps its earliest
point, so two documents agree in it with probability equal to their weighted
Jaccard similarity.  A process stops as soon as its next point is later than
all components of the document, so most shingles draw one point only.

Signatures are cut into bands; documents with an equal band share a bucket.
Equal texts are one node from the start.  In each bucket the member that sits in
the largest buckets elsewhere is the hub, and every other member is compared
with it: pairs grow with the members, not with their square.  Compared means
verified: the weighted Jaccard similarity of the two shingle multisets must
reach the threshold.

Documents in buckets that then still span several components mostly share a
passage and little else.  They are signed again with longer bands, in which such
documents part and near-duplicates still meet, and compared through hubs again.
Where a bucket of long bands still spans components, its members are compared
across components: all their pairs that share a long band and pass an exact
prefix filter on shingles, which enumerates them without pairing a crowd with
itself.  So every two documents that share a bucket of both kinds are compared or
of one class.  Classes are the connected components of the verified links.

Defined results: words are runs between white space; a text of fewer than five
words is one shingle; null counts as empty, and texts without words are copies
of each other only if they are equal.  Rows of one doc_id are one document: each
of its texts is compared, and it links what they link.  A null doc_id has no
class.  A class is named by its least doc_id, so ties need no order.  Texts of
any length are signed whole, in slices of bounded memory or alone.  Input columns
other than doc_id and text are ignored, whatever their names.  An empty table has
no classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.llm.common import scratch, stored, text_slices

SHINGLE = 5
THRESHOLD = 0.8
#: Bands and rows of the first signature, and of the second, of documents in open buckets.
BANDS, ROWS = 20, 4
LONG_BANDS, LONG_ROWS = 60, 8
#: Ratio of neighbouring size classes in the comparison across components.
STEP = 1.05
#: Bytes of text whose signatures are computed side by side.
SLICE_BYTES = 2 << 20
SEED = 5
ODD, MASK = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and number of every distinct shingle of every text."""
    place: dict[str, int] = {}
    ids, sizes = [], []
    for text in texts:
        words = text.split() if text else []
        ids += [place.setdefault(w, len(place)) for w in words]
        sizes.append(len(words))
    hashes = np.fromiter(
        (xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in place), np.uint64
    )
    sizes = np.array(sizes, np.int64)
    if not len(ids):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    words = hashes[np.array(ids, np.int64)]
    padded = np.append(words, np.zeros(SHINGLE, np.uint64))
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(words)) - first[owner]  # the place of each word in its text
    short = sizes[owner] < SHINGLE
    keep = np.where(short, at == 0, at <= sizes[owner] - SHINGLE)
    value = np.zeros(len(words), np.uint64)
    for k in range(SHINGLE):
        inside = ~short | (at + k < sizes[owner])
        value = (value + np.where(inside, padded[k : k + len(words)], 0)) * ODD
        value = value ^ (value >> np.uint64(29))
    value, owner = mixed(value[keep]), owner[keep]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))
    start = np.flatnonzero(fresh)
    return owner[start], value[start], np.diff(np.append(start, len(value)))


def signatures(
    texts: int,
    owner: np.ndarray,
    value: np.ndarray,
    count: np.ndarray,
    size: int = BANDS * ROWS,
    salt: int = SEED,
) -> np.ndarray:
    """BagMinHash signatures (texts, size) of weighted shingles; unused rows are infinite."""
    earliest = np.full((texts, size), np.inf)
    doubling = [(owner, value, count, 0)]
    level = 1
    while (more := np.flatnonzero(count > (1 << (level - 1)))).size:
        doubling.append((owner[more], value[more], count[more], level))
        level += 1
    doc = np.concatenate([d for d, _, _, _ in doubling])
    held = np.concatenate([c for _, _, c, _ in doubling]).astype(np.float64)
    low = np.concatenate([np.full(len(d), (1 << (k - 1)) if k else 0) for d, _, _, k in doubling])
    width = np.maximum(low, 1).astype(np.float64)
    seeds = [np.uint64((k * 2 + salt) * int(ODD) & MASK) for *_, k in doubling]
    state = np.concatenate([mixed(v + seed) for (_, v, _, _), seed in zip(doubling, seeds)])
    time = np.zeros(len(doc))
    flat = earliest.ravel()
    while len(doc):
        state = state + ODD
        draw = mixed(state)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / width
        more = mixed(draw ^ ODD)
        part = doc * size + (more % np.uint64(size)).astype(np.int64)
        weight = low + width * ((more >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        counts = np.floor(weight) < held  # weights are whole numbers: a cell counts or not
        np.minimum.at(flat, part[counts], time[counts])
        alive = time < earliest.max(1)[doc]
        doc, held, low, width = doc[alive], held[alive], low[alive], width[alive]
        state, time = state[alive], time[alive]
    return earliest


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets, as sorted hashes and counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    every = a[1].sum() + b[1].sum() - both
    return float(both / every) if every else 1.0


def banded(texts: DataFrame, bands: int, rows: int, salt: int = SEED) -> DataFrame:
    """texts with bands (array of long) in place of text; none for a text without words."""
    kept = [c for c in texts.columns if c != "text"]

    def run(batches):
        for batch in text_slices(batches, most_bytes=SLICE_BYTES):
            words = [x.as_py() for x in batch.column("text")]
            found = signatures(len(words), *shingle_counts(words), bands * rows, salt)
            bits = found.view(np.uint64)
            keys = np.zeros((len(words), bands), np.uint64)
            for k in range(rows):
                keys = mixed((keys + bits[:, k::rows]) * ODD)
            keys = mixed(keys + np.arange(bands, dtype=np.uint64) * ODD).view(np.int64)
            known = np.isfinite(found[:, 0])  # texts without words are in no bucket
            ends = np.append(0, np.cumsum(np.where(known, bands, 0))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[known].ravel()))
            own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, lists], names=[*kept, "bands"])

    fields = [texts.schema[c] for c in kept]
    fields.append(T.StructField("bands", T.ArrayType(T.LongType())))
    return texts.mapInArrow(run, T.StructType(fields))


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, digest and text of each document."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text.alias("text"),
    )


def bucket_members(nodes: DataFrame) -> DataFrame:
    """bucket, node, size for nodes (node, bands): the buckets of more than one node."""
    places = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = places.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return stored(places.join(apart(sizes), "bucket"), "bag-members")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough."""

    def run(batches):
        last, known = None, None
        for batch in batches:
            ones, others = batch.column("text_a"), batch.column("text_b")
            hubs = batch.column("b").to_pylist()
            good = []
            for i, hub in enumerate(hubs):
                if hub != last:
                    last, known = hub, shingle_counts([others[i].as_py()])[1:]
                own = shingle_counts([ones[i].as_py()])[1:]
                good.append(similarity(own, known) >= threshold)
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"]
            )

    # Rows arrive sorted by b, so a hub's shingles are made once for its run of partners.
    return (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(run, "a long, b long")
    )


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component of edges (a, b).

    Alternating large and small stars: each round hangs every node's larger
    (smaller) neighbours on its least one; the number of rounds grows with the
    logarithm of the longest chain.  Rows never exceed the edges'.
    """

    def star(edges: DataFrame, larger: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if larger else edges.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
        least = near.groupBy("a").agg(F.min("b").alias("least"))
        least = apart(least.select("a", F.least("a", "least").alias("least")))
        hung = near.join(least, "a")
        if larger:
            hung = hung.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            hung = hung.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
                least.select("a", F.col("least").alias("b"))
            )
        return stored(hung.where("a <> b").distinct(), "cc")

    with scratch(edges.sparkSession):
        now = stored(edges.where("a <> b").select("a", "b").distinct(), "cc")
        seen = None
        while True:
            mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if mark == seen:
                found = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
                return stored(found, "labels", outlive=True)
            seen = mark
            now = star(star(now, True), False)


def apart(totals: DataFrame) -> DataFrame:
    """Totals by key, written before they are joined back to the rows of their key.

    Joined at once they would lend the join their partitioning, and a key with a
    third of all rows would be one task; with an exchange on both sides Spark
    splits such a partition.
    """
    return stored(totals, "totals")


def with_hubs(members: DataFrame) -> DataFrame:
    """bucket, node, hub: each member (bucket, node, size) beside its bucket's hub, hubs left out.

    A bucket's hub is its best connected member, by the sizes of the buckets it
    is in: among edited copies that is the original or one close to it, which
    the others resemble more than they do each other.
    """
    weight = apart(members.groupBy("node").agg(F.sum("size").alias("weight")))
    weighed = members.join(weight, "node").select("bucket", "node", "weight")
    hubs = weighed.groupBy("bucket").agg(
        F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("hub")
    )
    hubs = apart(hubs.select("bucket", (-F.col("hub.node")).alias("hub")))
    rest = members.join(hubs, "bucket").where("node <> hub").select("bucket", "node", "hub")
    return stored(rest, "hubs")


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, node, label of the members (bucket, node) of buckets that span components."""
    labelled = members.select("bucket", "node").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    labelled = apart(labelled)
    split = (
        labelled.groupBy("bucket")
        .agg(F.min("label").alias("least"), F.max("label").alias("most"))
        .where("least <> most")
        .select("bucket")
    )
    return labelled.join(apart(split), "bucket")


def shingle_rows(texts: DataFrame) -> DataFrame:
    """node, label, n, token: a row for every shingle of a multiset, copies told apart."""

    def run(batches):
        for batch in text_slices(batches):
            owner, value, count = shingle_counts([x.as_py() for x in batch.column("text")])
            copy = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            token = mixed(np.repeat(value, count) + copy.astype(np.uint64) * ODD)
            at = np.repeat(owner, count)
            n = np.bincount(at, minlength=batch.num_rows)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node").take(take),
                    batch.column("label").take(take),
                    pa.array(n[at], pa.int64()),
                    pa.array(token.view(np.int64)),
                ],
                names=["node", "label", "n", "token"],
            )

    return texts.select("node", "label", "text").mapInArrow(
        run, "node long, label long, n long, token long"
    )


def prefix_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different label whose multisets may reach the threshold: none is missed.

    Two multisets of sizes m and n that reach the threshold share at least
    threshold / (1 + threshold) * (m + n) members, so in any common order of
    shingles the first that they share is near the front of both.  Here rare
    shingles come first.  A document that differs from a crowd's centre by too
    much differs in so many rare shingles that the common ones are out of reach,
    and it meets only documents with the same changes, not the crowd.  Sizes are
    classed in steps of STEP, and the reach is taken per pair of classes.
    """
    part = threshold / (1 + threshold)
    span = math.ceil(math.log(1 / threshold) / math.log(STEP))
    tokens = stored(shingle_rows(texts), "open-shingles")
    held = apart(
        tokens.groupBy("token").agg(
            F.count("*").alias("holders"), F.min("label").alias("low"), F.max("label").alias("high")
        )
    )
    by_rarity = Window.partitionBy("node").orderBy("holders", "token")
    least = F.ceil(F.pow(F.lit(STEP), F.col("partner")) - 1e-9)
    reach = F.col("n") - F.ceil(F.lit(part) * (F.col("n") + least) - 1e-9)
    rows = (
        tokens.join(held, "token")
        .withColumn("place", F.row_number().over(by_rarity) - 1)
        .where("low <> high")  # a shingle of one component leads nowhere
        .withColumn("own", F.floor(F.log("n") / math.log(STEP) + 1e-9))
        .withColumn(
            "partner", F.explode(F.sequence(F.col("own") - span, F.col("own") + span))
        )
        .where(F.col("place") <= reach)
        .select("node", "label", "n", "token", "place", "own", "partner")
    )
    rows = stored(rows, "open-prefixes")
    per_label = rows.groupBy("token", "own", "partner", "label").agg(F.count("*").alias("n"))
    crowd = per_label.groupBy("token", "own", "partner").agg(
        F.max(F.struct("n", "label")).getField("label").alias("crowd")
    )
    x = rows.join(apart(crowd), ["token", "own", "partner"]).alias("x")
    y = rows.alias("y")
    needed = F.ceil(F.lit(part) * (F.col("x.n") + F.col("y.n")) - 1e-9)
    # Of two crowds the greater label's rows look for the other; within one key only rows
    # outside its crowd look for partners, so a crowd is never held against itself.
    return (
        x.join(
            y,
            (F.col("x.token") == F.col("y.token"))
            & (F.col("x.own") == F.col("y.partner"))
            & (F.col("x.partner") == F.col("y.own"))
            & (F.col("x.label") != F.col("y.label"))
            & ((F.col("x.own") != F.col("y.own")) | (F.col("x.label") != F.col("crowd")))
            & ((F.col("x.own") == F.col("y.own")) | (F.col("x.own") > F.col("y.own")))
            & (F.col("x.place") <= F.col("x.n") - needed)
            & (F.col("y.place") <= F.col("y.n") - needed),
        )
        .select(
            F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")
        )
        .distinct()
    )


def pairs_of(hubs: DataFrame) -> DataFrame:
    """The pairs (a > b) of members with their hubs."""
    return hubs.select(
        F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")
    ).distinct()


def across_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends have different labels; a node without one is its own."""
    for end in "ab":
        own = labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
        pairs = pairs.join(own, end, "left")
    far = F.coalesce("label_a", "a") != F.coalesce("label_b", "b")
    return pairs.where(far).select("a", "b")


def open_nodes(members: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label of the members of buckets that span components."""
    still = open_members(members, labels).groupBy("node").agg(F.min("label").alias("label"))
    return stored(still, "bag-open")


def sharing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes (node, bands) that have a band in common."""
    one = nodes.select(F.col("node").alias("a"), F.col("bands").alias("bands_a"))
    other = nodes.select(F.col("node").alias("b"), F.col("bands").alias("bands_b"))
    met = pairs.join(one, "a").join(other, "b").where(F.arrays_overlap("bands_a", "bands_b"))
    return met.select("a", "b")


def linked(texts: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """a, b: verified links that join all near texts that share buckets."""
    hubs = with_hubs(members)
    done = stored(pairs_of(hubs), "bag-pairs")
    links = stored(verified(done, texts, threshold), "bag-links")

    # Hubs have met all of their buckets.  Where the others still span components, they are
    # signed again: documents that share a passage only part in longer bands.
    labels = components(links)
    still = open_nodes(hubs, labels)
    own = texts.join(still.select("node"), "node").select("node", "text")
    nodes = stored(banded(own, LONG_BANDS, LONG_ROWS, SEED + 1), "bag-signatures")
    hubs = with_hubs(bucket_members(nodes))
    fresh = pairs_of(hubs).join(done, ["a", "b"], "left_anti")
    fresh = stored(across_labels(fresh, labels), "bag-pairs")
    done = done.unionByName(fresh)
    links = links.unionByName(stored(verified(fresh, texts, threshold), "bag-links"))

    # Buckets of long bands that still span components: compare across them.
    still = open_nodes(hubs, components(links))
    across = prefix_pairs(texts.join(still, "node"), threshold)
    across = sharing(across.join(done, ["a", "b"], "left_anti"), nodes)
    more = verified(stored(across, "bag-pairs"), texts, threshold)
    return stored(links.unionByName(more), "bag-links", outlive=True)


def copies(marks: DataFrame) -> DataFrame:
    """Nodes of marks (doc_id, digest, row): digest, node (its least row), least doc_id, copies."""
    same = marks.groupBy("digest").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("copies")
    )
    return stored(same, "copies")


def twins(marks: DataFrame, same: DataFrame) -> DataFrame:
    """Links a, b between the nodes of one doc_id, seldom any."""
    named = marks.where("doc_id IS NOT NULL").select("doc_id", "digest")
    several = named.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y"))
    several = several.where("x <> y").select("doc_id", F.col("x").alias("digest"))
    ends = several.join(same, "digest").select("doc_id", F.col("node").alias("b"))
    met = named.join(apart(ends), "doc_id").join(same, "digest")
    return met.select(F.col("node").alias("a"), "b")


def classes_of(marks: DataFrame, same: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, class_id, copies of marks, given the components' labels of nodes."""
    labelled = same.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = stored(labelled, "labelled")
    names = labelled.groupBy("label").agg(F.min("least").alias("class_id"))
    classes = labelled.join(apart(names), "label").select("digest", "class_id", "copies")
    kept = [c for c in marks.columns if c not in ("digest", "row")]
    class_id = F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")
    return marks.drop("row").join(apart(classes), "digest").select(*kept, class_id, "copies")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, copies: the class of each document, named by its least doc_id.

    copies is the number of rows with the very same text.
    """
    rows = digested(docs).withColumn("row", F.monotonically_increasing_id())
    marks = stored(banded(rows, BANDS, ROWS), "bag-signatures")
    same = copies(marks)
    firsts = same.where("least IS NOT NULL").select(F.col("node").alias("row"), "node")
    with scratch(docs.sparkSession):
        members = bucket_members(marks.select("row", "bands").join(firsts, "row"))
        wanted = members.select("node").distinct().join(same, "node")
        texts = stored(
            digested(docs)
            .withColumnRenamed("doc_id", "least")
            .join(wanted.select("node", "least", "digest"), ["least", "digest"])
            .select("node", "text")
            .dropDuplicates(["node"]),
            "bag-texts",
        )
        links = linked(texts, members, threshold)
    labels = components(links.unionByName(twins(marks, same)))
    return classes_of(marks.drop("bands"), same, labels)
