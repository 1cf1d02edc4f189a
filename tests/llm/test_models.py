"""URL filter, toxicity and language model against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtally.llm import lm_score, registry, toxicity, url_filter


# -- urls ------------------------------------------------------------------------------

URLS = [
    ("https://www.Example.com/en/5?q=1", "www.example.com", "/en/5", "www.example.com/en/", "allow"),
    ("http://a.example.com/en/x#y", "a.example.com", "/en/x", "example.com/en/", "block"),
    ("http://example.com/de/", "example.com", "/de/", "com/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("ftp://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("http://x.com", "x.com", "", None, None),
    ("http://ÉX.org?://b.com/en/", "Éx.org", "", None, None),
    ("a?u=b://c.net/es/2", "c.net", "/es/2", "net/es/", "block"),
    ("http:///es/", "", "/es/", None, None),
    ("no scheme", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
]


def slow_grams(host, path):
    found = set()
    if not host:
        return found
    for mark, text in (("h", f"^{host}$"), ("p", path)):
        for n in url_filter.GRAMS:
            found |= {(mark, text[i : i + n]) for i in range(len(text) - n + 1)}
    return found


def test_rules_and_parts(spark):
    df = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    rows = url_filter.judge(df, [0.0] * url_filter.FEATURES, -1.0).orderBy("page_id").collect()
    for row, (_, host, path, rule, verdict) in zip(rows, URLS):
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule), row["url"]
        assert row["verdict"] == (verdict or "allow")
    assert url_filter.judge(df.limit(0), [0.0] * url_filter.FEATURES, 0.0).count() == 0


def test_fit_equals_plain_descent(spark):
    weights, bias = url_filter.fit(url_filter.labelled_table(spark))
    hashes = {}
    pairs = sorted({g for u, _ in url_filter.LABELLED for g in slow_grams(*parts(u))})
    df = spark.createDataFrame(pairs, "m string, g string")
    for r in df.select("m", "g", F.pmod(F.xxhash64("m", "g"), F.lit(url_filter.FEATURES)).alias("f")).collect():
        hashes[r["m"], r["g"]] = r["f"]
    n = len(url_filter.LABELLED)
    x, y = np.zeros((n, url_filter.FEATURES)), np.array([label for _, label in url_filter.LABELLED], float)
    for i, (u, _) in enumerate(url_filter.LABELLED):
        features = {hashes[g] for g in slow_grams(*parts(u))}
        x[i, list(features)] = 1 / math.sqrt(len(features))
    share = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum()))) / n
    w = v = np.zeros(url_filter.FEATURES)
    b = c = 0.0
    for step in range(url_filter.STEPS):
        push = step / (step + 3)
        a, d = w + push * (w - v), b + push * (b - c)
        gap = (1 / (1 + np.exp(-(x @ a + d))) - y) * share
        v, c = w, b
        w, b = a - 8 * (x.T @ gap + url_filter.RIDGE / n * a), d - 2 * gap.sum()
    assert np.allclose(weights, w, atol=1e-5) and abs(bias - b) < 1e-5


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    return (m[1].lower(), m[2]) if m else ("", "")


def test_held_out_urls(spark):
    rows = url_filter.labelled_table(spark).withColumn("k", F.crc32("url") % 4)
    weights, bias = url_filter.fit(rows.where("k <> 0"))
    judged = url_filter.judge(rows.where("k = 0"), weights, bias, rules=[])
    right = F.avg(((F.col("verdict") == "block") == (F.col("label") == 1)).cast("double"))
    assert judged.agg(right).first()[0] >= 0.7


def test_fit_without_both_classes(spark):
    one = spark.createDataFrame([("http://a.b/", 1), (None, 0), ("http://c.d/", None)], "url string, label int")
    weights, bias = url_filter.fit(one)
    assert not any(weights) and bias > 0


# -- toxicity ----------------------------------------------------------------------------


def test_gradients():
    net = toxicity.Network(1)
    draw = np.random.default_rng(0)
    for name in net.p:
        net.p[name] = net.p[name].astype(np.float64)
    inputs = draw.standard_normal((5, 3, toxicity.WORD_SIZE + toxicity.CHAR_SIZE))
    pad = np.zeros((5, 3), bool)
    pad[3:, 1] = True
    goal, share = np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 2.0])

    def loss():
        x = {}
        for way in "fb":
            x[way] = net.driven(inputs, way)
            x[way][pad, toxicity.HIDDEN : 2 * toxicity.HIDDEN] = toxicity.KEEP
        z = net.logits(x["f"], x["b"], ~pad).astype(np.float64)
        return float((share * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - goal * z)).sum())

    slope, d_inputs = net.slopes(inputs, pad, ~pad, goal, share)
    for name, place in [("Uf", (2, 5)), ("Ub", (1, 20)), ("Wf", (3, 9)), ("cb", (17,)), ("attend", (4,)), ("out", (9,)), ("bias", (0,))]:
        step = 1e-2
        old = net.p[name][place]
        net.p[name][place] = old + step
        up = loss()
        net.p[name][place] = old - step
        down = loss()
        net.p[name][place] = old
        assert slope[name][place] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-3), name
    old = inputs[1, 0, 2]
    inputs[1, 0, 2] = old + 1e-2
    up = loss()
    inputs[1, 0, 2] = old - 1e-2
    assert d_inputs[1, 0, 2] == pytest.approx((up - loss()) / 2e-2, rel=0.05, abs=2e-3)


def test_windows_cover_every_word():
    sizes = np.array([0, 1, 24, 25, 100, 36])
    owner, first, count = toxicity.windows_of(sizes)
    start = np.cumsum(sizes) - sizes
    for i, n in enumerate(sizes):
        own = owner == i
        seen = {k for f, c in zip(first[own], count[own]) for k in range(f - start[i], f - start[i] + c)}
        assert seen == set(range(n)) and own.sum() >= 1


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")]


def test_held_out_toxicity(tables):
    docs, labels = tables
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = toxicity.train(docs, labels.where(fold != 1))
    scored = toxicity.toxicity_scores(docs.select("doc_id", "text"), model, "score")
    rows = scored.join(labels.where(fold == 1), "doc_id").toPandas()
    right = ((rows.score >= toxicity.THRESHOLD) == (rows.toxic == 1)).mean()
    assert right >= 0.9 and right > (rows.toxic == 0).mean()
    again = toxicity.train(docs.repartition(5), labels.where(fold != 1))
    assert again.scores(["some text here"])[0] == pytest.approx(model.scores(["some text here"])[0], abs=1e-6)


def slow_toxicity(model, text):
    """The score of one text, window by window and word by word."""
    p, size = {k: v.astype(float) for k, v in model.net.p.items()}, toxicity.HIDDEN
    words = re.findall(r"\w+", (text or "").lower())

    def vector(word):
        marked = f"<{word}>"
        codes = [(ord(a) * 961 + ord(b) * 31 + ord(c)) * 2_654_435_761 for a, b, c in zip(marked, marked[1:], marked[2:])]
        chars = np.mean([p["char"][(c >> 12) % toxicity.CHAR_BUCKETS] for c in codes], 0)
        return np.append(p["word"][model.vocabulary.get(word, toxicity.UNKNOWN)], chars)

    def states(vectors, way):
        h, found = np.zeros(size), []
        for x in vectors:
            x, u = x @ p["W" + way] + p["c" + way], h @ p["U" + way]
            reset, update = (1 / (1 + np.exp(-(x + u)[k * size : (k + 1) * size])) for k in (0, 1))
            fresh = np.tanh(x[2 * size :] + reset * u[2 * size :])
            h = update * h + (1 - update) * fresh
            found.append(h)
        return found

    worst, first = -math.inf, 0
    while True:
        vectors = [vector(w) for w in words[first : first + toxicity.WINDOW]]
        ahead, back = states(vectors, "f"), states(vectors[::-1], "b")[::-1]
        both = [np.append(a, b) for a, b in zip(ahead, back)] or [np.zeros(2 * size)]
        share = np.array([math.exp(s @ p["attend"]) for s in both])
        pool = sum(w * s for w, s in zip(share / share.sum(), both))
        worst = max(worst, float(pool @ p["out"] + p["bias"][0]))
        first += toxicity.STRIDE
        if first + toxicity.WINDOW - toxicity.STRIDE >= len(words):
            return 1 / (1 + math.exp(-(model.scale * worst + model.offset)))


def test_scores_equal_a_slow_reader(tables):
    docs, labels = tables
    model = toxicity.train(docs, labels, sample=150)
    texts = [r["text"] for r in docs.orderBy(F.xxhash64("doc_id")).limit(25).collect()]
    texts += [None, "", "!!", "one", "ÀÉ 漢字 🙂 x", " ".join(f"w{i}" for i in range(24)), " ".join(f"w{i}" for i in range(37))]
    assert model.scores(texts) == pytest.approx([slow_toxicity(model, t) for t in texts], abs=1e-4)


def test_held_out_is_never_null(spark, tmp_path):
    rows = [(None, "a b", "x"), (1, "c", "x"), (1, "d", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, held_out string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r["held_out"] for r in registry.op8_toxicity(spark, str(tmp_path)).collect()} <= {True, False}


def test_long_text_has_a_late_window(tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    clean = docs.join(labels.where("toxic = 0"), "doc_id").where("length(text) > 2000 AND lang = 'en'").first()["text"]
    bad = docs.join(labels.where("toxic = 1"), "doc_id").where("lang = 'en'").collect()
    worst = max(bad, key=lambda r: model.scores([r["text"]])[0])["text"]
    alone, late = model.scores([clean, clean * 30 + " " + worst])
    assert late > alone and late >= model.scores([worst])[0] - 0.2


def test_toxicity_edges(spark, tables):
    docs, labels = tables
    rows = [(1, None, "x"), (2, "", "x"), (3, "!!!", "x"), (4, "w " * 30_000, "x"), (None, "n", None), (4, "w", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxicity string")
    scored = toxicity.toxicity_scores(df, toxicity.train(docs, labels)).collect()
    assert len(scored) == 6 and all(0 <= r["toxicity"] <= 1 for r in scored)
    assert scored[0]["toxicity"] == scored[1]["toxicity"] == scored[2]["toxicity"]
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.toxicity_scores(df, none).first()["toxicity"] == 0.0
    ones = toxicity.train(docs, labels.withColumn("toxic", F.lit(1)))
    assert ones.scores(["a"])[0] == 1.0


# -- language model ------------------------------------------------------------------------


def slow_scores(rows):
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i, _ in rows}

    def tokens(text):
        small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return [w for w in re.split("[\x20\x09-\x0d]+", small) if w] + ["</s>"]

    def counts(keep):
        words, pairs, contexts = Counter(), Counter(), Counter()
        for i, text in rows:
            if keep(fold[i]):
                own = tokens(text)
                before = ["<s>", *own[:-1]]
                words.update(own)
                pairs.update(zip(before, own))
                contexts.update(before)
        return words, pairs, contexts

    def bucket(c):
        return 0 if c == 0 else min(int(math.log2(c)) + 1, lm_score.BUCKETS - 1)

    words, pairs, contexts = counts(lambda f: f != 2)
    n, v = sum(words.values()), len(words)
    kept, kept_pairs, kept_contexts = counts(lambda f: f not in (2, 3))
    cells = Counter()
    for i, text in rows:
        if fold[i] == 3:
            own = tokens(text)
            for a, b in zip(["<s>", *own[:-1]], own):
                p = kept_pairs[a, b] / max(kept_contexts[a], 1)
                pair_class = 0 if p == 0 else 1 + math.floor(-2 * math.log2(p))
                word_class = 0 if kept[b] == 0 else 1 + math.floor(2 * math.log2(kept[b]))
                cells[(bucket(kept_contexts[a]) * lm_score.CLASSES + pair_class) * lm_score.CLASSES + word_class] += 1
    keys = sorted(cells)
    weights = lm_score.mixture_weights(np.array(keys, np.int64), np.array([cells[k] for k in keys]), sum(kept.values()), v)
    found = []
    for i, text in rows:
        own = tokens(text)
        base = score = 0.0
        for a, b in zip(["<s>", *own[:-1]], own):
            p0 = (words[b] + 1) / (n + v + 1)
            w = weights[bucket(contexts[a])]
            base += math.log10(p0)
            score += math.log10(w[0] * pairs[a, b] / max(contexts[a], 1) + w[1] * words[b] / max(n, 1) + w[2] * p0)
        known = sum(words[b] > 0 for b in own)
        found.append((i, fold[i] == 2, len(own), known, n, base, score))
    return found


def lm(df):
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    return lm_score.scores(df, fold == 2, fold == 3)


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_lm_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "OWNER_TOKENS", 400)
    draw = np.random.default_rng(0)
    rows = [
        (i, " ".join(f"W{int(x)}" for x in draw.zipf(1.5, draw.integers(0, 60)) % 50)) for i in range(120)
    ] + [(200, None), (201, ""), (202, "a\tB\x0bc\x85d É é"), (203, "the " * 5000), (204, "same"), (204, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fold", F.lit("clash"))
    ours = sorted(tuple(r[c] for c in COLUMNS) for r in lm(df.repartition(3)).collect())
    theirs = sorted(slow_scores(rows))
    for a, b in zip(ours, theirs, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_lm_beats_base_on_held_out(tables):
    rows = lm(tables[0]).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows["s"] > rows["b"]


def test_lm_mixture_is_a_distribution():
    cells = np.array([5 * lm_score.CLASSES**2 + 7 * lm_score.CLASSES + 9, 3])
    weights = lm_score.mixture_weights(cells, np.array([10, 5]), 1000, 50)
    assert np.allclose(weights.sum(1), 1) and (weights >= 0).all() and weights[0, 0] == 0


def test_weights_make_held_out_counts_likeliest():
    """Against plain expectation-maximisation, and against all mixtures on a grid."""
    draw, n, v, size = np.random.default_rng(3), 100_000, 5000, lm_score.CLASSES
    cells = {(int(a), int(b)): int(c) for a, b, c in zip(draw.integers(0, 14, 60), draw.integers(1, 20, 60), draw.zipf(1.6, 60) % 999)}

    def chances(pair, word):
        own = 2 ** ((word - 0.5) / 2)
        return (2 ** -((pair - 0.5) / 2) if pair else 0.0, own / n, (own + 1) / (n + v + 1))

    def likelihood(w):
        return sum(c * math.log(sum(x * p for x, p in zip(w, chances(*k)))) for k, c in cells.items())

    weights = [0.3, 0.3, 0.4]
    for _ in range(lm_score.STEPS):
        total = [0.3e-3, 0.3e-3, 0.4e-3]
        for k, c in cells.items():
            parts = [w * p for w, p in zip(weights, chances(*k))]
            total = [t + c * x / sum(parts) for t, x in zip(total, parts)]
        weights = [t / sum(total) for t in total]
    keys = sorted(cells)
    numbers = np.array([(5 * size + a) * size + b for a, b in keys], np.int64)
    found = lm_score.mixture_weights(numbers, np.array([cells[k] for k in keys]), n, v)
    assert found[5] == pytest.approx(weights, rel=1e-9)
    grid = [(a / 40, b / 40, (40 - a - b) / 40) for a in range(1, 39) for b in range(1, 40 - a)]
    assert likelihood(found[5]) >= max(map(likelihood, grid)) - 1e-3 * abs(likelihood(found[5]))


def test_lm_edges(spark):
    form = "doc_id long, text string"
    assert lm(spark.createDataFrame([], form)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm(spark.createDataFrame([(held, "a b")], form)).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
