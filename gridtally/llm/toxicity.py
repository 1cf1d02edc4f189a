"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is read in overlapping windows of words.  A word enters as a learned
vector of its own, if training saw it often enough, and as the mean of learned
vectors of its hashed character trigrams.  Two gated recurrent networks read
the window in both directions; attention pools their states; a logistic unit
scores the pool.  A document scores as its worst window does, after a
calibration that is fitted on whole training documents.

The network is trained in numpy on a bounded sample of labelled rows (SAMPLE of
each class; the bound is a parameter).  Labels are known for documents only, so
training alternates: the network picks the windows that speak most for label 1,
and learns from those.  Scoring is one pass over all documents in Arrow batches
with every window of every text.

Null texts count as empty.  A text without words has one window of padding, so
it gets a score too.  Without labels of both kinds every score is the share of
label 1.  Equal texts get equal scores, so ties need no order.  Of several texts of
one labelled doc_id the greatest is learned from.  An empty table has no scores.
A very long text is scored in all of its windows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.llm.common import text_slices

WINDOW, STRIDE = 24, 12
HIDDEN = 8
WORD_SIZE, CHAR_SIZE = 8, 4
VOCABULARY, SEEN_IN = 20_000, 3
CHAR_BUCKETS = 2048
#: Labelled rows of each class that training may use at most.
SAMPLE = 2000
ROUNDS, EPOCHS, BATCH = 3, 3, 256
THRESHOLD = 0.7
SEED = 11
#: Characters of text whose windows are scored side by side.
SLICE_CHARS = 1 << 20
PAD, UNKNOWN = 0, 1
KEEP = 30.0  # an update gate of sigmoid(KEEP) leaves the state as it was

words_of = re.compile(r"\w+").findall


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character trigrams of words laid end to end, each one's word, and their numbers."""
    raw = [f"<{w or ' '}>".encode("utf-32-le") for w in words]
    points = np.frombuffer(b"".join(raw), np.uint32).astype(np.int64)
    sizes = np.array([len(r) // 4 for r in raw])
    ends = np.cumsum(sizes)
    padded = np.append(points, [0, 0])
    codes = (points * 961 + padded[1:-1] * 31 + padded[2:]) * 2_654_435_761
    inside = np.ones(len(points), bool)
    inside[ends - 1] = inside[ends - 2] = False
    owner = np.repeat(np.arange(len(words)), sizes)[inside]
    return (codes[inside] >> 12) % CHAR_BUCKETS, owner, sizes - 2


def trigram_means(words: list[str], table: np.ndarray) -> np.ndarray:
    """Mean of the table's rows over each word's trigrams."""
    codes, _, sizes = trigrams(words)
    sums = np.add.reduceat(table[codes], np.cumsum(sizes) - sizes, axis=0)
    return sums / sizes[:, None].astype(np.float32)


def windows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first word and number of words of every window, texts laid end to end."""
    n = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(sizes)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(sizes) - sizes)[owner] + place * STRIDE
    return owner, first, np.minimum(WINDOW, sizes[owner] - place * STRIDE)


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters, forward and backward passes of the recurrent network."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        size = WORD_SIZE + CHAR_SIZE
        small = lambda *shape: (draw.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {"word": small(2, WORD_SIZE), "char": small(CHAR_BUCKETS, CHAR_SIZE)}
        for way in "fb":
            self.p["W" + way] = small(size, 3 * HIDDEN)
            self.p["U" + way] = small(HIDDEN, 3 * HIDDEN)
            self.p["c" + way] = np.zeros(3 * HIDDEN, np.float32)
        self.p["attend"] = small(2 * HIDDEN)
        self.p["out"] = small(2 * HIDDEN)
        self.p["bias"] = np.zeros(1, np.float32)

    def driven(self, inputs: np.ndarray, way: str) -> np.ndarray:
        return inputs @ self.p["W" + way] + self.p["c" + way]

    def read(self, x: np.ndarray, way: str, trace: list | None = None) -> np.ndarray:
        """States (T, B, H) for driven inputs x (T, B, 3H); way "b" reads from the end."""
        U, H = self.p["U" + way], HIDDEN
        h = np.zeros((x.shape[1], H), np.float32)
        states = np.empty((*x.shape[:2], H), np.float32)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            hu = h @ U
            gates = sigmoid(x[t, :, : 2 * H] + hu[:, : 2 * H])
            r, z = gates[:, :H], gates[:, H:]
            n = np.tanh(x[t, :, 2 * H :] + r * hu[:, 2 * H :])
            if trace is not None:
                trace.append((t, h, hu, r, z, n))
            h = n + z * (h - n)
            states[t] = h
        return states

    def pooled(self, states: np.ndarray, mask: np.ndarray):
        """Attention weights and logits of states (T, B, 2H)."""
        score = states @ self.p["attend"]
        score = np.where(mask, score, -1e9)
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pool = np.einsum("tb,tbh->bh", weight, states)
        return weight, pool, pool @ self.p["out"] + self.p["bias"]

    def logits(self, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self.read(forward, "f"), self.read(backward, "b")], 2)
        return self.pooled(states, mask)[2]

    def slopes(self, inputs, pad, mask, labels, share):
        """Gradients of the weighted log loss; inputs (T, B, D), pad and mask (T, B)."""
        H, p = HIDDEN, self.p
        x, traces, states = {}, {}, []
        for way in "fb":
            x[way] = self.driven(inputs, way)
            x[way][pad, H : 2 * H] = KEEP
            traces[way] = []
            states.append(self.read(x[way], way, traces[way]))
        states = np.concatenate(states, 2)
        weight, pool, logit = self.pooled(states, mask)
        gap = (sigmoid(logit) - labels) * share
        slope = {"out": pool.T @ gap, "bias": gap.sum(keepdims=True)}
        d_pool = gap[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pool
        d_weight = np.einsum("tbh,bh->tb", states, d_pool)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        slope["attend"] = np.einsum("tb,tbh->h", d_score, states)
        d_states = d_states + d_score[:, :, None] * p["attend"]
        d_inputs = np.zeros_like(inputs)
        for k, way in enumerate("fb"):
            U = p["U" + way]
            d_own, d_h = d_states[:, :, k * H : (k + 1) * H], 0.0
            d_x, d_U = np.zeros_like(x[way]), np.zeros_like(U)
            for t, h, hu, r, z, n in reversed(traces[way]):
                d = d_own[t] + d_h
                d_n = d * (1 - z) * (1 - n * n)
                d_z = d * (h - n) * z * (1 - z)
                d_r = d_n * hu[:, 2 * H :] * r * (1 - r)
                d_x[t] = np.concatenate([d_r, d_z, d_n], 1)
                d_hu = np.concatenate([d_r, d_z, d_n * r], 1)
                d_U += h.T @ d_hu
                d_h = d * z + d_hu @ U.T
            d_x[pad] = 0
            flat = d_x.reshape(-1, 3 * H)
            slope["U" + way] = d_U
            slope["c" + way] = flat.sum(0)
            slope["W" + way] = inputs.reshape(-1, inputs.shape[2]).T @ flat
            d_inputs += d_x @ p["W" + way].T
        return slope, d_inputs


class Adam:
    def __init__(self, rate: float):
        self.rate, self.step, self.moments = rate, 0, {}

    def update(self, p: dict, slope: dict) -> None:
        self.step += 1
        for name, g in slope.items():
            m, v = self.moments.setdefault(name, (np.zeros_like(p[name]), np.zeros_like(p[name])))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            fix = np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
            p[name] -= (self.rate * fix * m / (np.sqrt(v) + 1e-7)).astype(np.float32)


class Model:
    """The network with its vocabulary and the calibration of documents."""

    def __init__(self, seed: int = SEED):
        self.net = Network(seed)
        self.vocabulary: dict[str, int] = {}
        self.scale, self.offset, self.constant = 1.0, 0.0, None

    # -- reading -----------------------------------------------------------------

    def indexed(self, texts: list[str | None]):
        """Distinct words, each text's words as places among them, and their number."""
        place: dict[str, int] = {"": 0}
        ids, sizes = [], []
        for text in texts:
            words = words_of(text.lower()) if text else []
            ids += [place.setdefault(w, len(place)) for w in words]
            sizes.append(len(words))
        return list(place), np.array(ids, np.int32), np.array(sizes, np.int64)

    def inputs(self, words: list[str]) -> np.ndarray:
        known = np.array([self.vocabulary.get(w, UNKNOWN) for w in words])
        known[0] = PAD
        return np.concatenate(
            [self.net.p["word"][known], trigram_means(words, self.net.p["char"])], 1
        )

    def window_ids(self, ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Places of the words of windows, (WINDOW, windows); 0 is padding."""
        step = np.arange(WINDOW)[:, None]
        at = np.minimum(first + step, max(len(ids) - 1, 0))
        found = ids[at] if len(ids) else np.zeros(at.shape, np.int32)
        return np.where(step < count, found, 0)

    def window_logits(self, words: list[str], ids: np.ndarray, first, count) -> np.ndarray:
        inputs = self.inputs(words)
        driven = {way: self.net.driven(inputs, way) for way in "fb"}
        for way in "fb":
            driven[way][0, HIDDEN : 2 * HIDDEN] = KEEP
        found = np.empty(len(first), np.float32)
        for a in range(0, len(first), 4096):
            own = self.window_ids(ids, first[a : a + 4096], count[a : a + 4096])
            mask = own > 0
            mask[0] |= ~mask.any(0)
            found[a : a + 4096] = self.net.logits(driven["f"][own], driven["b"][own], mask)
        return found

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """The largest window logit of each text."""
        words, ids, sizes = self.indexed(texts)
        owner, first, count = windows_of(sizes)
        logit = self.window_logits(words, ids, first, count)
        return np.maximum.reduceat(logit, np.searchsorted(owner, np.arange(len(texts))))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        found, a = [], 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size < SLICE_CHARS):
                size, b = size + len(texts[b] or ""), b + 1
            logit = self.worst(texts[a:b]).astype(np.float64)
            found.append(sigmoid(np.clip(self.scale * logit + self.offset, -30, 30)))
            a = b
        return np.concatenate(found) if found else np.empty(0)

    # -- training ----------------------------------------------------------------

    def fit(self, texts: list[str | None], labels: np.ndarray, share: np.ndarray) -> Model:
        """Learn from whole texts; share weighs each document in the calibration."""
        labels = np.asarray(labels, np.float32)
        if not len(labels) or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.0
            return self
        draw = np.random.default_rng(SEED)
        words, ids, sizes = self.indexed(texts)
        lean = self._vocabulary(words, ids, sizes, labels, draw)
        owner, first, count = windows_of(sizes)
        # The first pick of windows: those whose three most leaning words lean most.
        value = np.append(lean, -9)[np.where((w := self.window_ids(ids, first, count)) > 0, w, -1)]
        logit = np.sort(value, 0)[-3:].clip(0).sum(0)
        adam = Adam(0.02)
        for _ in range(ROUNDS):
            picked, goal = self._picked(owner, logit, labels, draw)
            self._train(words, ids, first[picked], count[picked], goal, adam, draw)
            logit = self.window_logits(words, ids, first, count)
        worst = np.maximum.reduceat(logit, np.searchsorted(owner, np.arange(len(texts))))
        self._calibrate(worst.astype(np.float64), labels, np.asarray(share, np.float64))
        return self

    def _vocabulary(self, words, ids, sizes, labels, draw) -> np.ndarray:
        """Choose the vocabulary; a word's first input starts as its lean to label 1."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        pair = np.unique(doc.astype(np.int64) * len(words) + ids)
        at, label = pair % len(words), labels[pair // len(words)]
        seen = np.bincount(at, minlength=len(words))
        ones = np.bincount(at, label, minlength=len(words))
        n, n_ones = len(labels), float(labels.sum())
        lean = np.log((ones + 0.5) / (n_ones + 1)) - np.log((seen - ones + 0.5) / (n - n_ones + 1))
        lean[seen < SEEN_IN] = 0
        often = np.flatnonzero(seen >= SEEN_IN)
        often = often[np.argsort(-seen[often], kind="stable")][:VOCABULARY]
        self.vocabulary = {words[i]: k + 2 for k, i in enumerate(often.tolist())}
        table = (draw.standard_normal((len(often) + 2, WORD_SIZE)) * 0.1).astype(np.float32)
        table[2:, 0] = lean[often]
        table[:2, 0] = 0
        self.net.p["word"] = table
        return lean

    def _picked(self, owner, logit, labels, draw):
        """Of each text the window with the largest logit; of label 0 the next and any one too."""
        order = np.lexsort((-logit, owner))
        start = np.searchsorted(owner[order], np.arange(len(labels)))
        size = np.diff(np.append(start, len(owner)))
        top = order[start]
        zero = np.flatnonzero(labels == 0)
        more = zero[size[zero] > 1]
        second = order[start[more] + 1]
        some = order[start[more] + draw.integers(0, size[more])]
        picked = np.concatenate([top, second, some])
        return picked, labels[owner[picked]]

    def _train(self, words, ids, first, count, goal, adam, draw) -> None:
        known = np.array([self.vocabulary.get(w, UNKNOWN) for w in words])
        known[0] = PAD
        p = self.net.p
        ones = goal.sum()
        weight = np.where(goal == 1, len(goal) / (2 * ones), len(goal) / (2 * (len(goal) - ones)))
        windows = self.window_ids(ids, first, count)
        for _ in range(EPOCHS):
            order = draw.permutation(len(goal))
            for a in range(0, len(order), BATCH):
                own = order[a : a + BATCH]
                places, at = np.unique(windows[:, own], return_inverse=True)
                at = at.reshape(WINDOW, len(own))
                some = [words[i] for i in places.tolist()]
                inputs = np.concatenate(
                    [p["word"][known[places]], trigram_means(some, p["char"])], 1
                )
                pad = windows[:, own] == 0
                mask = ~pad
                mask[0] |= ~mask.any(0)
                share = (weight[own] / len(own)).astype(np.float32)
                slope, d_inputs = self.net.slopes(inputs[at], pad, mask, goal[own], share)
                d_words = np.zeros_like(inputs)
                np.add.at(d_words, at.ravel(), d_inputs.reshape(-1, inputs.shape[1]))
                slope["word"] = np.zeros_like(p["word"])
                np.add.at(slope["word"], known[places], d_words[:, :WORD_SIZE])
                slope["word"][PAD] = 0
                slope["word"] += 1e-4 * p["word"]
                slope["char"] = self._char_slope(some, d_words[:, WORD_SIZE:])
                adam.update(p, slope)

    def _char_slope(self, words: list[str], d_means: np.ndarray) -> np.ndarray:
        """The gradient of trigram_means by its table."""
        codes, owner, sizes = trigrams(words)
        slope = np.zeros_like(self.net.p["char"])
        np.add.at(slope, codes, (d_means / sizes[:, None].astype(np.float32))[owner])
        return slope

    def _calibrate(self, worst: np.ndarray, labels: np.ndarray, share: np.ndarray) -> None:
        """Platt's scaling by Newton steps, with a little pull to slope one."""
        x = np.stack([worst, np.ones_like(worst)], 1)
        w = np.array([1.0, 0.0])
        for _ in range(50):
            q = sigmoid(np.clip(x @ w, -30, 30))
            g = x.T @ (share * (q - labels)) + 0.5 * (w - [1.0, 0.0])
            h = (x * (share * q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(2)
            step = np.linalg.solve(h, g)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        self.scale, self.offset = float(max(w[0], 1e-3)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labels (doc_id, toxic) of docs: at most sample rows of each class.

    Which rows is settled by a hash of doc_id, so reruns agree.  Rows without a
    label, and labels of no document, are left out.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")
    )
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    counted = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    ids = []
    for kind in (0, 1):
        own = known.where(F.col("toxic") == kind)
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids += [(r["doc_id"], kind) for r in own.collect()]
    if not ids:
        return Model().fit([], np.empty(0), np.empty(0))
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int")
    # One row of each doc_id reaches the driver, however often it is repeated.
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.max("text").alias("text"))
    )
    rows = sorted(rows.collect(), key=lambda r: r["doc_id"])
    found = np.array([r["toxic"] for r in rows], np.float32)
    share = np.array([counted[int(k)] / max((found == k).sum(), 1) for k in found])
    return Model().fit([r["text"] for r in rows], found, share / share.mean())


def toxicity_scores(df: DataFrame, model: Model, out_col: str = "toxicity") -> DataFrame:
    """df with out_col, the score of each whole text; a clashing column is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY words
    kept = [c for c in df.columns if c.lower() != out_col.lower()]

    def run(batches):
        for batch in text_slices(batches):
            scores = shared.value.scores([x.as_py() for x in batch.column("text")])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(batch.schema.get_field_index(c)) for c in kept),
                    pa.array(scores, pa.float64()),
                ],
                names=[*kept, out_col],
            )

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out_col, T.DoubleType())])
    return df.mapInArrow(run, schema)
