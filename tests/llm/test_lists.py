"""Phrases, repeated lines and centroid clusters against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtally.llm import clusters, line_dedup, phrases

SHAPE = "doc_id long, text string, lang string, a int, n string, phrase string, place int, row int"
SMALL_LETTERS = {c: c + 32 for c in range(65, 91)}


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 0, "n", "p", 1, 2) for r in rows], SHAPE)


# -- phrases ---------------------------------------------------------------------------


def slow_phrases(rows, least, most):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(SMALL_LETTERS)):
            words = tuple(w for w in re.split(r"[ \t]+", piece) if w)
            sizes[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang, words[i : i + k]] += 1
    found = {k: v for k, v in counts.items() if v >= least}
    inside = defaultdict(int)
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside[lang, p[i : i + k]], a)
    by_lang = defaultdict(list)
    for (lang, p), a in found.items():
        if len(p) > 1 and 100 * inside[lang, p] < 100 * a:
            n = sizes[lang]
            cuts = [(counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
            score, k = min((1000 * a * n // (x * y), k) for k, (x, y) in enumerate(cuts))
            by_lang[lang].append((-score, -a, " ".join(p).encode(), a, *cuts[k], n, score))
    return {
        (lang, rank, row[2].decode(), *row[3:])
        for lang, own in by_lang.items()
        for rank, row in enumerate(sorted(own)[:most], 1)
    }


@pytest.fixture(scope="module")
def prose():
    draw = np.random.default_rng(5)
    words = ["the", "of", "é", "È", "New", "york", "a b", "x\x00", "w1", "w2", "日本", "ÀB"]
    rows = []
    for i in range(300):
        picked = draw.choice(words, int(draw.integers(0, 40)))
        marks = draw.choice([" ", "  ", "\t", ". ", ",", "\x0b", "\x0c", "\r", "\n", " ; "], len(picked), p=[0.7] + [0.3 / 9] * 9)
        rows.append(("".join(w + m for w, m in zip(picked, marks, strict=True)), ["en", "fr", None, "und"][i % 4]))
    rows += [("in the end of the day all is well", "en")] * 40 + [("la la la la la la la", "fr")] * 9
    rows += [(None, "en"), ("", None), (" \t.,", "en"), ("only", "zz")]
    rows += [("no break here " * 3000, "long"), ("ab. cd ab cd, " * 3000, "long")]
    return rows


@pytest.mark.parametrize("chunk_bytes", [300, 1 << 20])
def test_phrases(spark, prose, chunk_bytes):
    docs = table_of(spark, [(i, *r) for i, r in enumerate(prose)]).repartition(3)
    found = phrases.collocations(docs, 8, 30, chunk_bytes)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in found.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    ours = [tuple(r) for r in found.collect()]
    assert len(ours) == len(set(ours)) and set(ours) == slow_phrases(prose, 8, 30)


def test_products_beyond_64_bits(spark):
    rows = [(10**12, 10**13, [2 * 10**12, 10**12], [10**12 + 7, 3 * 10**12]), (7, 100, [7, 8], [9, 8])]
    df = spark.createDataFrame(rows, "a long, n long, heads array<long>, tails array<long>")
    best = df.select(phrases.lowest_cut(*(F.col(c) for c in ("a", "n", "heads", "tails"))).alias("b"))
    got = [tuple(r["b"]) for r in best.collect()]
    slow = []
    for a, n, heads, tails in rows:
        cuts = [(heads[k - 1], tails[len(heads) - k]) for k in range(1, len(heads) + 1)]
        score, k = min((1000 * a * n // (x * y), k) for k, (x, y) in enumerate(cuts, 1))
        slow.append((score, k, *cuts[k - 1]))
    assert got == slow


def test_lists_are_packed_without_loss():
    places = np.array([5, 9, 2**30, 3, 4, 0, 2**31 - 1], np.int32)
    assert (phrases.unpacked(phrases.packed(places)) == places).all()
    text = b"one. two three " * 50
    parts = list(phrases.cut_texts(text, 16))
    assert b"".join(parts) == text and all(re.search(rb"[.]$", p) for p in parts[:-1])
    assert list(phrases.cut_texts(b"", 16)) == []


def test_no_phrases(spark):
    assert phrases.collocations(table_of(spark, [])).collect() == []
    assert phrases.collocations(table_of(spark, [(1, "too few", "en")])).collect() == []


# -- lines -----------------------------------------------------------------------------


def slow_lines(rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(SMALL_LETTERS)

    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(2**63 - 1 if doc is None else doc)
    kept = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        own = 2**63 - 1 if doc is None else doc
        stay = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == own]
        kept.append((doc, text, lines, stay))
    return kept


@pytest.fixture(scope="module")
def pages():
    draw = np.random.default_rng(9)
    lines = [f"a repeated line number {i}" for i in range(30)] + ["short", "ten chars!", "nine char", "", " \t", "çédille très Ça"]
    rows = []
    for i in range(400):
        own = [f"own line {i} of its text {k}" for k in range(int(draw.integers(0, 4)))]
        body = [str(x) for x in draw.choice(lines, int(draw.integers(0, 12)))] + own
        draw.shuffle(body)
        body = [draw.choice([x, f"  {x}\t", x.upper() if x.isascii() else x, x + "\r"]) for x in body]
        rows.append((int(draw.integers(0, 350)), "\n".join(body)))
    rows += [(i, "the license line of them all\nrest %d is its own" % i) for i in range(500, 900)]
    rows += [(None, "a repeated line number 3\nnameless line here"), (None, "nameless line here\n"), (7, None), (8, "")]
    rows += [(9, "the same row twice")] * 3 + [(10, "the same row twice\n" * 3)]
    rows += [(1011, "a very long text of lines\n" * 20_000 + "its end is here"), (1012, "x" * 300_000), (1013, "X" * 300_000)]
    rows += [(1014, "a very long text of lines\nkept line by itself\na very long text of lines")]
    return rows


def test_lines(spark, pages):
    docs = table_of(spark, [(d, t, None) for d, t in pages]).repartition(5)
    slow = slow_lines(pages)
    ours = Counter(tuple(r) for r in line_dedup.report(docs).collect())
    assert ours == Counter(
        (d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
        for d, _, lines, stay in slow
    )
    texts = line_dedup.drop_repeated_lines(docs)
    assert texts.columns == docs.columns
    whole = lambda d, text, lines, stay: text if len(stay) == len(lines) else "\n".join(stay)
    assert Counter((r["doc_id"], r["text"]) for r in texts.collect()) == Counter((x[0], whole(*x)) for x in slow)


def test_bitmaps_hold_no_text(spark, pages):
    bitmaps = line_dedup.keep_bitmaps(table_of(spark, [(d, t, None) for d, t in pages]))
    assert [t for _, t in bitmaps.dtypes] == ["bigint", "bigint", "array<struct<at:int,n:int>>", "int"]
    cut = bitmaps.where("doc = 1014").first()
    assert [tuple(r) for r in cut["keep"]] == [(1, 1)] and cut["rest"] == 3
    whole = {r["doc"] for r in bitmaps.collect()}
    assert 1011 not in whole and 1012 not in whole and 1013 in whole


def test_ranges_are_sorted_without_another_exchange(spark, pages):
    rows = line_dedup.occurrences(table_of(spark, [(d, t, None) for d, t in pages[:50]]))
    df = line_dedup.with_first(rows, "digest", "block")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") and "hashpartitioning" not in plan and "Python" not in plan


def test_no_lines(spark):
    assert line_dedup.report(table_of(spark, [])).collect() == []
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in line_dedup.report(table_of(spark, [(1, None, None)])).collect()] == [(1, 1, 0, empty)]


# -- clusters --------------------------------------------------------------------------


def slow_clusters(rows, k, rounds):
    good = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in good if i is not None)[:k]
    means = [v for _, v in start]

    def assign():
        out = []
        for _, v in good:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(means)))
        return out

    for _ in range(rounds):
        groups = defaultdict(list)
        for (_, v), (_, c) in zip(good, assign(), strict=True):
            groups[c].append(v)
        for c, own in groups.items():
            means[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    last = assign()
    total = sum(d for d, _ in last)
    by = Counter()
    for d, c in last:
        by[c] += d
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return Counter((i, c, d, by[c], total, digest[c]) for (i, _), (d, c) in zip(good, last, strict=True))


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(6, 64))
    rows = [(i, (centres[i % 6] + draw.normal(0, 0.4, 64)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(i, [0.0] * 64) for i in range(200, 206)] + [(3, rows[3][1])] * 4 + [(None, rows[5][1])]
    rows += [(i, [float(x % 3 - 1) for x in range(i, i + 64)]) for i in range(300, 330)]
    rows += [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65), (404, [1.0] * 63 + [None])]
    rows += [(405, [1.0] * 63 + [float("nan")]), (406, [float("inf")] + [1.0] * 63), (407, [-900.25] * 64)]
    return rows


@pytest.mark.parametrize("k, rounds", [(8, 10), (40, 3), (1000, 2)])
def test_clusters(spark, vectors, k, rounds):
    df = spark.createDataFrame([(*r, 1, 2) for r in vectors], "vec_id long, embedding array<float>, cluster int, id int")
    found = clusters.clusters(df.repartition(4), k=k, rounds=rounds)
    assert [t for _, t in found.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert Counter(tuple(r) for r in found.collect()) == slow_clusters(vectors, k, rounds)


def test_annulus_equals_all_comparisons():
    draw = np.random.default_rng(3)
    x = draw.integers(-50, 50, (500, 4)) * 10
    centroids = np.concatenate([x[:60], x[:20], -x[:20]])  # equal ones, and others of equal norm
    number, distance = clusters.nearest(x, centroids)
    apart = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (number == apart.argmin(1)).all() and (distance == apart.min(1)).all()
    large = np.array([[clusters.LARGEST] * 64, [-clusters.LARGEST] * 64])
    assert clusters.nearest(large, large[:1])[1].tolist() == [0, 64 * (2 * clusters.LARGEST) ** 2]


def test_vectors_out_of_range_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="a component is over"):
        clusters.clusters(df)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert clusters.clusters(df).collect() == [] and clusters.clusters(df.limit(0)).collect() == []
