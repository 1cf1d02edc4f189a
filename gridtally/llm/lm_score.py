"""Language-model scores by deleted interpolation of n-gram estimates.

The probability of a word after another mixes three estimates: its share among
the words seen after that one, its share among all words, and the smoothed base
share (c + 1) / (N + V + 1), which gives an unseen word its place.  The mixture
weights depend on how often the context was seen (a bucket per doubling).  They
are learned by expectation-maximisation on held-out counts: estimates from one
part of the training documents, mixed so as to fit the other part.

The corpus is never gathered.  Documents are read in chunks; a chunk numbers its
own distinct words and word pairs and keeps its texts as those numbers.  Pairs
and words travel to their owner by hash, in blobs, a blob per chunk and owner;
the owner adds up and answers each chunk with the totals of what it asked.
The owner of a number of keys sees each key once per chunk however frequent it
is in the texts, so a word that is a third of the corpus is no hot spot.  What
reaches the driver is a table of counts by bucket and estimate class, of fixed
size, for the weights.

Words are runs of bytes other than white space (\\x20, \\x09-\\x0D) with A-Z made
small; each text ends in one end token, which is counted.  The first word's
context is the beginning of a text.  Keys are 64-bit hashes of words and pairs.

Defined results: null texts count as empty, whose only token is the end; without
training documents all estimates but the base are empty and the base is 1 over
V + 1; repeated rows are scored alike and counted each; a very long text is read
whole; an empty table has no scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import stored

#: Bytes of text in a chunk, and tokens per owner of keys, about.
CHUNK_BYTES = 6 << 20
OWNER_TOKENS = 2_000_000
#: Context-frequency buckets, one per doubling; classes of estimates, two per doubling.
BUCKETS = 32
CLASSES = 96
STEPS = 80
END, BEGIN = np.uint64(1), np.uint64(2)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Folds of a document: scored only, training, and training whose counts are held out.
SCORED, KEPT, DELETED = 0, 1, 2
SIDES = ("left", "right")


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(mixed(context * ODD) + word)


class Chunk:
    """Some documents as numbers: distinct words, and the text as places among them."""

    def __init__(self, words: np.ndarray, places: np.ndarray, sizes: np.ndarray, fold: np.ndarray):
        self.words, self.places, self.sizes, self.fold = words, places, sizes, fold

    @classmethod
    def of_texts(cls, texts: list[bytes], fold: np.ndarray) -> Chunk:
        place: dict[bytes, int] = {}
        ids, sizes = [], []
        for text in texts:
            words = text.translate(SMALL).split()
            ids += [place.setdefault(w, len(place) + 1) for w in words]
            ids.append(0)
            sizes.append(len(words) + 1)
        hashes = [int(END), *map(xxhash.xxh3_64_intdigest, place)]
        return cls(
            np.array(hashes, np.uint64), np.array(ids, np.int32), np.array(sizes, np.int64), fold
        )

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pair keys, and each token's place among them."""
        word = self.words[self.places]
        context = np.append(BEGIN, word[:-1])
        context[np.cumsum(self.sizes)[:-1]] = BEGIN
        keys, at = np.unique(pair_keys(context, word), return_inverse=True)
        return keys, at

    def token_fold(self) -> np.ndarray:
        return np.repeat(self.fold, self.sizes)


SMALL = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def narrow(x: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.min_scalar_type(top))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as compressed bytes."""
    parts = []
    for x in arrays:
        parts += [np.array([ord(x.dtype.char), len(x)], np.int64).tobytes(), x.tobytes()]
    data = b"".join(parts)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    data = pa.decompress(blob[8:], size, codec="zstd", asbytes=True)
    found, a = [], 0
    while a < size:
        char, n = np.frombuffer(data[a : a + 16], np.int64)
        kind = np.dtype(chr(char))
        end = a + 16 + int(n) * kind.itemsize
        found.append(np.frombuffer(data[a + 16 : end], kind))
        a = end
    return found


CHUNK_FORM = (
    "chunk long, is_deleted boolean, n_tokens long, kept_tokens long, deleted_tokens long,"
    " doc_ids array<long>, body binary"
)


def chunked(docs: DataFrame) -> DataFrame:
    """doc_id, text, fold as chunks: CHUNK_FORM.  Held-out training documents have their own."""

    def flush(held: list[tuple], number: int) -> pa.RecordBatch:
        folds = np.array([f for _, _, f in held], np.uint8)
        made = Chunk.of_texts([t for _, t, _ in held], folds)
        body = packed(made.words, narrow(made.places), narrow(made.sizes), folds)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([bool(folds[0] == DELETED)]),
                pa.array([int(made.sizes.sum())], pa.int64()),
                pa.array([int(made.sizes[folds == KEPT].sum())], pa.int64()),
                pa.array([int(made.sizes[folds == DELETED].sum())], pa.int64()),
                pa.array([[d for d, _, _ in held]], pa.list_(pa.int64())),
                pa.array([body], pa.binary()),
            ],
            names=CHUNK_FORM.replace(",", "").split()[::2],
        )

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            rows = zip(batch.column("doc_id").to_pylist(), texts, batch.column("fold").to_pylist())
            for doc_id, text, fold in rows:
                own, text = fold == DELETED, text.as_py() or b""
                held[own].append((doc_id, text, fold))
                size[own] += len(text) + 64
                if size[own] >= CHUNK_BYTES:
                    yield flush(held[own], number)
                    number, held[own], size[own] = number + 1, [], 0
        for own in (False, True):
            if held[own]:
                yield flush(held[own], number)
                number += 1

    return docs.mapInArrow(run, CHUNK_FORM)


def opened(body: bytes) -> Chunk:
    words, places, sizes, fold = unpacked(body)
    return Chunk(words, places.astype(np.int64), sizes.astype(np.int64), fold)


def owners_of(keys: np.ndarray, owners: int) -> np.ndarray:
    return (mixed(keys) % np.uint64(owners)).astype(np.int64)


def dealt(keys: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys by owner, then key; and the owners in that order."""
    own = owners_of(keys, owners)
    order = np.lexsort((keys, own))
    return order, own[order]


def asked(chunks: DataFrame, owners: int) -> DataFrame:
    """owner, chunk, body: each chunk's distinct words and pairs with their training counts."""

    def run(batches):
        for batch in batches:
            for number, body in zip(batch.column("chunk").to_pylist(), batch.column("body")):
                own = opened(body.as_py())
                fold = own.token_fold()
                pairs, at = own.pairs()
                columns = []
                for keys, where in ((own.words, own.places), (pairs, at)):
                    kept = np.bincount(where[fold == KEPT], minlength=len(keys))
                    deleted = np.bincount(where[fold == DELETED], minlength=len(keys))
                    order, who = dealt(keys, owners)
                    columns.append((who, keys[order], kept[order], deleted[order]))
                # Owners without a key of this chunk get no row: rows never exceed keys.
                asks = np.union1d(columns[0][0], columns[1][0])
                cuts = [
                    [slice(a, b) for a, b in zip(*(np.searchsorted(who, asks, s) for s in SIDES))]
                    for who, *_ in columns
                ]
                bodies = [
                    packed(
                        *(
                            x
                            for (_, keys, kept, deleted), cut in zip(columns, own_cuts)
                            for x in (
                                np.diff(keys[cut], prepend=np.uint64(0)),
                                narrow(kept[cut]),
                                narrow(deleted[cut]),
                            )
                        )
                    )
                    for own_cuts in zip(*cuts)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(asks, pa.int64()),
                        pa.array([number] * len(asks), pa.int64()),
                        pa.array(bodies, pa.binary()),
                    ],
                    names=["owner", "chunk", "body"],
                )

    return chunks.select("chunk", "body").mapInArrow(run, "owner long, chunk long, body binary")


def answered(questions: DataFrame) -> DataFrame:
    """chunk, owner, known_words, body: the totals of what each chunk asked, in its order.

    known_words, on one row of each owner, counts its distinct training words.
    """

    def run(group: pa.Table) -> pa.Table:
        bodies = [unpacked(x) for x in group.column("body").to_pylist()]
        answers = [[] for _ in bodies]
        known = 0
        for k in (0, 3):
            keys = [np.cumsum(b[k], dtype=np.uint64) for b in bodies]
            every, at = np.unique(np.concatenate(keys), return_inverse=True)
            cut = np.cumsum([len(x) for x in keys])[:-1]
            sums = [
                np.bincount(
                    at, np.concatenate([b[k + j] for b in bodies]), minlength=len(every)
                ).astype(np.int64)
                for j in (1, 2)
            ]
            if k == 0:
                known = int(((sums[0] + sums[1]) > 0).sum())
            for answer, own in zip(answers, np.split(at, cut)):
                answer += [narrow(x[own]) for x in sums]
        return pa.table(
            {
                "chunk": group.column("chunk"),
                "owner": group.column("owner"),
                "known_words": pa.array([known] + [0] * (len(bodies) - 1), pa.int64()),
                "body": pa.array([packed(*a) for a in answers], pa.binary()),
            }
        )

    return questions.groupBy("owner").applyInArrow(
        run, "chunk long, owner long, known_words long, body binary"
    )


class Totals:
    """A chunk's tokens with the corpus counts of words, contexts and pairs."""

    def __init__(self, chunk: pa.Table, answers: pa.Table, owners: int):
        self.chunk = opened(chunk.column("body")[0].as_py())
        self.doc_ids = chunk.column("doc_ids")[0].as_py()
        bodies = dict(zip(answers.column("owner").to_pylist(), answers.column("body").to_pylist()))
        parts = [unpacked(bodies[o]) for o in sorted(bodies)]
        pairs, self.at = self.chunk.pairs()
        self.words = self._ordered(self.chunk.words, parts, 0, owners)
        self.pairs = self._ordered(pairs, parts, 2, owners)

    @staticmethod
    def _ordered(keys, parts, k: int, owners: int) -> list[np.ndarray]:
        """Kept and deleted counts in the order of keys."""
        order, _ = dealt(keys, owners)
        found = []
        for j in (k, k + 1):
            counts = np.empty(len(keys), np.int64)
            counts[order] = np.concatenate([p[j] for p in parts])
            found.append(counts)
        return found

    def counts(self, begins: int, deleted: bool):
        """Per token: counts of the word, its context, and the pair."""
        word, pair = self.words[0], self.pairs[0]
        if deleted:
            word, pair = word + self.words[1], pair + self.pairs[1]
        own = word[self.chunk.places]
        context = np.append(0, own[:-1])
        context[np.cumsum(self.chunk.sizes) - self.chunk.sizes] = begins
        return own, context, pair[self.at]


def buckets_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket per doubling."""
    doubling = np.log2(np.maximum(context, 1)).astype(np.int64) + 1
    return np.where(context > 0, np.minimum(doubling, BUCKETS - 1), 0)


def estimates(own, context, pair, n: int, v: int):
    """The pair, word and base estimates of each token."""
    second = pair / np.maximum(context, 1)
    return second, own / max(n, 1), (own + 1) / (n + v + 1)


def mixture_weights(cells: np.ndarray, number: np.ndarray, n: int, v: int) -> np.ndarray:
    """Weights (BUCKETS, 3) by expectation-maximisation on counts of held-out cells.

    A bucket without held-out tokens takes the weights of all, an unseen context
    never trusts pairs.
    """
    bucket, rest = np.divmod(cells, CLASSES * CLASSES)
    pair_class, word_class = np.divmod(rest, CLASSES)
    pair = np.where(pair_class > 0, 2.0 ** (-(pair_class - 0.5) / 2), 0.0)
    own = np.where(word_class > 0, 2.0 ** ((word_class - 0.5) / 2), 0.0)
    p = np.stack([np.minimum(pair, 1), own / max(n, 1), (own + 1) / (n + v + 1)], 1)
    number = number.astype(np.float64)

    def fitted(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        w = start
        for _ in range(STEPS):
            share = p[rows] * w
            share *= (number[rows] / share.sum(1))[:, None]
            total = share.sum(0) + start * 1e-3
            w = total / total.sum()
        return w

    start = np.array([0.3, 0.3, 0.4])
    common = fitted(np.arange(len(cells)), start) if len(cells) else np.array([0.0, 0.0, 1.0])
    found = np.tile(common, (BUCKETS, 1))
    for b in range(BUCKETS):
        rows = np.flatnonzero(bucket == b)
        if len(rows):
            found[b] = fitted(rows, start)
    found[0, 0] = 0.0
    found[0] /= found[0].sum()
    return found


def scores(docs: DataFrame, held_out: Column, deleted: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document.

    Training leaves out held_out; of the rest, deleted is the part whose counts
    are held out while the mixture weights are learned, and count in the end.
    """
    fold = F.when(F.coalesce(held_out, F.lit(False)), SCORED).when(
        F.coalesce(deleted, F.lit(False)), DELETED
    ).otherwise(KEPT)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", fold.alias("fold"))
    chunks = stored(chunked(texts), "lm-chunks")
    owners = max(1, -(-(chunks.agg(F.sum("n_tokens")).first()[0] or 0) // OWNER_TOKENS))
    # Groups are not split, so tasks follow the number of owners and chunks, which grow with the
    # bytes, and not a setting.
    parts = 2 * owners
    answers = stored(answered(asked(chunks, owners).repartition(parts, "owner")), "lm-answers")
    pieces = 2 * max(1, chunks.count())
    sizes = texts.groupBy("fold").agg(F.count("*").alias("n")).collect()
    begins = {r["fold"]: r["n"] for r in sizes}
    kept_docs, all_docs = begins.get(KEPT, 0), begins.get(KEPT, 0) + begins.get(DELETED, 0)
    v = answers.agg(F.sum("known_words")).first()[0] or 0

    tokens = chunks.groupBy().agg(
        F.coalesce(F.sum("kept_tokens"), F.lit(0)), F.coalesce(F.sum("deleted_tokens"), F.lit(0))
    )
    n_kept, n_deleted = tokens.first()
    n = n_kept + n_deleted

    def cells(chunk: pa.Table, own_answers: pa.Table) -> pa.Table:
        if not chunk.num_rows:  # an answer to another kind of chunk
            return pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        own, context, pair = Totals(chunk, own_answers, owners).counts(kept_docs, False)
        second, _, _ = estimates(own, context, pair, n_kept, v)
        low = 2.0 ** -((CLASSES - 2) / 2)
        pair_class = np.where(
            second > 0, 1 + np.floor(-2 * np.log2(np.maximum(second, low))).astype(np.int64), 0
        )
        word_class = np.where(
            own > 0, 1 + np.floor(2 * np.log2(np.maximum(own, 1))).astype(np.int64), 0
        )
        key = (buckets_of(context) * CLASSES + pair_class) * CLASSES + word_class
        found, number = np.unique(key, return_counts=True)
        return pa.table({"cell": found, "n": number.astype(np.int64)})

    held = (
        chunks.where("is_deleted").repartition(pieces, "chunk").groupBy("chunk")
        .cogroup(answers.repartition(pieces, "chunk").groupBy("chunk"))
        .applyInArrow(cells, "cell long, n long")
        .groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect()
    )
    weights = mixture_weights(
        np.array([r["cell"] for r in held], np.int64), np.array([r["n"] for r in held]), n_kept, v
    )

    def scored(chunk: pa.Table, own_answers: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return pa.table({f: pa.array([], t) for f, t in RESULT})
        totals = Totals(chunk, own_answers, owners)
        own, context, pair = totals.counts(all_docs, True)
        second, first, base = estimates(own, context, pair, n, v)
        w = weights[buckets_of(context)]
        mix = w[:, 0] * second + w[:, 1] * first + w[:, 2] * base
        sizes = totals.chunk.sizes
        begin = np.cumsum(sizes) - sizes
        columns = [
            totals.doc_ids,
            totals.chunk.fold == SCORED,
            sizes,
            np.add.reduceat((own > 0).astype(np.int64), begin),
            np.add.reduceat(np.log10(base), begin),
            np.add.reduceat(np.log10(mix), begin),
        ]
        return pa.table({f: pa.array(c, t) for (f, t), c in zip(RESULT, columns)})

    return (
        chunks.repartition(pieces, "chunk")
        .groupBy("chunk")
        .cogroup(answers.repartition(pieces, "chunk").groupBy("chunk"))
        .applyInArrow(
            scored,
            "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double,"
            " score double",
        )
        .withColumn("train_tokens", F.lit(n).cast("long"))
    )


RESULT = [
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
    ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
]
