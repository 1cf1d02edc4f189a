"""Near-duplicates, neighbours and image copies against brute force."""

import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtally.llm import ann, media, near_dedup, registry


def slow_classes(rows):
    """Classes by comparing all texts."""
    first, sets = {}, {}
    for i, text in sorted(rows):
        first.setdefault(text or "", i)
    for text, i in first.items():
        w = text.split()
        sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(sets)
    for k, i in enumerate(nodes):
        for j in nodes[:k]:
            both = sum((sets[i] & sets[j]).values())
            every = sum((sets[i] | sets[j]).values())
            if every and both / every >= near_dedup.THRESHOLD:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(first[text or ""]) for i, text in rows}


def edited(words, n, draw):
    words = list(words)
    for at in draw.integers(0, len(words), n):
        words[at] = f"new{draw.integers(10**6)}"
    return words


@pytest.fixture(scope="module")
def corpus():
    draw = np.random.default_rng(1)
    word = lambda n: [f"w{x}" for x in draw.integers(0, 5000, n)]
    rows, i = [], 0
    for size in (150, 90, 400):  # crowds round an original, some of them too far off
        base = word(size)
        for k in range(60):
            rows.append((i := i + 1, " ".join(edited(base, min(int(draw.geometric(0.35)) - 1, 9), draw))))
    chain = word(200)  # each near the one before, the ends far apart
    for k in range(8):
        rows.append((i := i + 1, " ".join(chain)))
        chain = edited(chain, 2, draw)
    line = " ".join(word(12))
    rows += [(i := i + 1, "\n".join([line] * n)) for n in (1, 5, 6, 20, 22)]  # multisets matter
    rows += [(i := i + 1, " ".join(word(int(n)))) for n in draw.integers(1, 120, 60)]
    rows += [(i := i + 1, t) for t in ["a b", "a b", "a b c", "", None, "", "  ", "x " * 9000, "x " * 9001]]
    rows += [(i, "x " * 9001), (i := i + 1, " ".join(word(20_000)))]
    return rows


def test_classes_equal_brute_force(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").withColumn("node", F.lit("clash"))
    found = near_dedup.near_classes(df.repartition(5)).collect()
    assert len(found) == len(corpus)
    theirs = slow_classes(corpus)
    assert {r["doc_id"]: r["class_id"] for r in found} == theirs
    copies = Counter(t or "" for _, t in corpus)
    assert all(r["copies"] == copies[dict(corpus)[r["doc_id"]] or ""] for r in found)


def test_prefix_pairs_miss_nothing(spark, corpus):
    rows = [(i, t) for i, t in dict(corpus).items() if t and len(t) < 5000]
    df = spark.createDataFrame([(i, i, t) for i, t in rows], "node long, label long, text string")
    found = {tuple(r) for r in near_dedup.prefix_pairs(df, near_dedup.THRESHOLD).collect()}
    sets = {i: near_dedup.shingle_counts([t])[1:] for i, t in rows}
    for k, (i, _) in enumerate(rows):
        for j, _ in rows[:k]:
            if near_dedup.similarity(sets[i], sets[j]) >= near_dedup.THRESHOLD:
                assert (max(i, j), min(i, j)) in found


def test_rows_of_one_doc_id_keep_all_links(spark):
    draw = np.random.default_rng(8)
    a, b = ([f"w{x}" for x in draw.integers(0, 9999, 200)] for _ in "ab")
    near = [" ".join(edited(t, 2, draw)) for t in (b, a)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near[0]), (3, near[1]), (4, "apart from all of them here")]
    for order in (rows, rows[::-1]):
        found = near_dedup.near_classes(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert {(r["doc_id"], r["class_id"]) for r in found} == {(1, 1), (2, 1), (3, 1), (4, 4)} and len(found) == 5


def test_very_long_texts(spark):
    draw = np.random.default_rng(9)
    words = [f"w{x}" for x in draw.integers(0, 10**6, 300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(edited(words, 2000, draw))), (3, " ".join(words[:200_000]))]
    found = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == {1: 1, 2: 1, 3: 3}


def test_signatures_are_unbiased():
    draw = np.random.default_rng(2)
    a = {i: int(draw.integers(1, 12)) for i in range(300)}
    b = {i: a[i] if i % 3 else int(draw.integers(1, 12)) for i in range(60, 360) if i in a or i >= 300 and a.setdefault(i, 1)}
    both = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
    true = both / (sum(a.values()) + sum(b.values()) - both)

    def sign(d):
        value = near_dedup.mixed(np.array(list(d), np.uint64) * near_dedup.ODD)
        return near_dedup.signatures(1, np.zeros(len(d), int), value, np.array(list(d.values())), size=8192)

    assert (sign(a) == sign(b)).mean() == pytest.approx(true, abs=0.02)


def test_components(spark):
    edges = [(2, 1), (3, 2), (4, 3), (5, 4), (11, 10), (12, 10), (9, 8), (8, 7), (7, 9), (30, 20), (20, 25)]
    found = near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    labels = {r["node"]: r["label"] for r in found}
    assert labels == {2: 1, 3: 1, 4: 1, 5: 1, 11: 10, 12: 10, 8: 7, 9: 7, 30: 20, 25: 20}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_edges(spark):
    form = "doc_id long, text string"
    assert near_dedup.near_classes(spark.createDataFrame([], form)).count() == 0
    rows = near_dedup.near_classes(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], form)).collect()
    assert {(r["doc_id"], r["class_id"]) for r in rows} == {(None, None), (1, 1)}


# -- neighbours ----------------------------------------------------------------------------


def slow_neighbours(rows, asked, k=5):
    good = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    found = {}
    for q in filter(asked, good):
        scores = sorted((-float(unit[q] @ unit[i]), i) for i in good if i != q)
        found[q] = [(i, -s) for s, i in scores[:k]]
    return found


def searched(df, k=5):
    found = {}
    for r in ann.neighbours(df, F.col("vec_id") % 50 == 0, k).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


FORM = "vec_id long, embedding array<float>"


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 64)
    draw = np.random.default_rng(0)
    x = draw.standard_normal((1500, 32))
    x[700:1100] = x[7] + draw.standard_normal((400, 32)) * 0.02  # a crowd
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    ours, theirs = searched(spark.createDataFrame(rows, FORM).repartition(3)), slow_neighbours(rows, lambda i: i % 50 == 0)
    assert ours.keys() == theirs.keys() and all(len(v) == 5 for v in ours.values())
    hits = sum(len({i for i, _ in ours[q]} & {i for i, _ in theirs[q]}) for q in theirs)
    assert hits / (5 * len(theirs)) >= 0.9
    true = {(q, i): float(np.dot(x32(rows, q), x32(rows, i)) / np.sqrt(np.dot(x32(rows, q), x32(rows, q)) * np.dot(x32(rows, i), x32(rows, i)))) for q in ours for i, _ in ours[q]}
    assert all(s == pytest.approx(true[q, i], abs=1e-12) for q in ours for i, s in ours[q])


def x32(rows, i):
    return np.array(rows[i][1], float)


def test_recall_on_the_table(spark, monkeypatch):
    """The query's own table, in a tree of some thirty cells."""
    monkeypatch.setattr(ann, "CELL_ROWS", 64)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    ours, theirs = searched(df), slow_neighbours(rows, lambda i: i % 50 == 0)
    assert ours.keys() == theirs.keys()
    hits = sum(len({i for i, _ in ours[q]} & {i for i, _ in theirs[q]}) for q in theirs)
    assert hits / sum(len(v) for v in theirs.values()) >= 0.9


def test_neighbour_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 300, 10)]  # equal: ties to the smaller id
    rows += [(1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 1.0]), (50, [inf, 1.0, 1.0]), (6, [1.0])]
    rows += [(7, [3.0, 2.0, 1.0]), (7, [3.0, 2.0, 1.0]), (350, [-1.0, 0.5, 0.0]), (None, [1.0, 1.0, 1.0])]
    ours = searched(spark.createDataFrame(rows, FORM).withColumn("cell", F.lit(1)))
    assert [i for i, _ in ours[0]] == [10, 20, 30, 40, 50] and [i for i, _ in ours[100]] == [0, 10, 20, 30, 40]
    assert ours[0][0][1] == pytest.approx(1.0) and 350 in ours and ours[350][0][0] == 0
    few = searched(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], FORM))
    assert few == {0: [(1, 0.0)]}
    assert searched(spark.createDataFrame([], FORM)) == {} and searched(spark.createDataFrame([(0, None)], FORM)) == {}
    assert searched(spark.createDataFrame([(0, [1.0])], FORM)) == {}


def test_chi_square():
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert ann.chi_square_quantile(0.5, 2) == pytest.approx(1.386, abs=1e-3)


# -- images ------------------------------------------------------------------------------


def texture(seed, n=140):
    draw = np.random.default_rng(seed)
    grid = sum(media.resized(draw.standard_normal((1, k, k)), n, n)[0] * 60 / (k / 8) ** 0.5 for k in (8, 16, 32))
    return np.clip(128 + grid, 0, 255)


def png(grid, kind=0):
    rows = np.rint(grid).astype(np.uint8)
    body = b""
    for y, line in enumerate(rows.astype(int)):
        left = np.append(0, line[:-1])
        above = rows[y - 1].astype(int) if y else np.zeros_like(line)
        corner = np.append(0, above[:-1])
        if kind == 4:
            p = left + above - corner
            far = np.abs(np.stack([p - left, p - above, p - corner]))
            guess = np.stack([left, above, corner])[far.argmin(0), np.arange(len(line))]
        else:
            guess = [0 * line, left, above, (left + above) // 2][kind]
        body += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", grid.shape[1], grid.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png(kind):
    grid = np.rint(texture(3, 20))
    assert np.array_equal(media.decoded(png(grid, kind)), grid)


def test_broken_images():
    good = media.encoded_pgm(texture(1, 20))
    for data in (None, b"", b"P5", b"P5\n9 9\n255\nxx", good[:50], b"\x89PNG\r\n\x1a\nxxxx", b"GIF89a", png(texture(1, 20))[:60]):
        assert media.decoded(data) is None
    assert media.decoded(good).shape == (20, 20)
    assert media.decoded(b"P6\n1 1\n255\n\x00\x03\x06")[0, 0] == 3.0


def test_crops_and_edits_join(spark):
    rows, family = [], {}
    draw = np.random.default_rng(5)
    for s in range(12):
        image = texture(s)
        versions = [
            image,
            image[10:125, 15:130],  # a crop
            np.clip(image * 0.85 + 20, 0, 255),  # another tone
            np.clip(image + draw.standard_normal(image.shape) * 4, 0, 255),  # noise
            np.rot90(image),
        ]
        for v in versions:
            family[len(rows)] = s
            rows.append((len(rows), bytes(media.encoded_pgm(v))))
    rows += [(100, rows[0][1]), (101, None), (102, b"junk"), (103, b"junk"), (104, media.encoded_pgm(np.full((40, 40), 9.0)))]
    df = spark.createDataFrame(rows, "id long, image binary").withColumn("digest", F.lit("clash"))
    found = {r["id"]: r["class_id"] for r in media.image_classes(df).collect()}
    assert len(found) == len(rows) and found[100] == found[0] == 0
    assert found[102] == found[103] == 102 and found[101] == 101 and found[104] == 104
    together = [found[i] == found[5 * s] for i, s in family.items()]
    assert np.mean(together) >= 0.95
    assert len({found[5 * s] for s in range(12)}) == 12
    assert media.image_classes(df.limit(0)).count() == 0


def test_equals_comparing_all_pairs(spark):
    """Classes against a consensus of every two pictures, some of them alike in part only."""
    draw, rows = np.random.default_rng(11), []
    for s in range(8):
        image = texture(s, 100)
        image[:30, :30] = texture(99, 30)  # a mark that all of them bear
        for v in (image, image[8:90, 5:88], image * 0.85 + 20, image + draw.standard_normal(image.shape) * 4):
            rows.append((len(rows), bytes(media.encoded_pgm(v))))
    df = spark.createDataFrame(rows, "id long, image binary")
    known = [(r["places"], r["descriptors"]) for r in media.described(df, "id", "image").orderBy("doc_id").collect()]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if media.consensus(*known[i], *known[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    found = {r["id"]: r["class_id"] for r in media.image_classes(df).collect()}
    assert found == dict(enumerate(label)) and len(set(label)) == 8


def test_large_pictures(spark):
    image = np.tile(texture(4, 140), (5, 5)) * 0.6 + texture(5, 700) * 0.4  # repeats itself
    rows = [(1, media.encoded_pgm(image)), (2, media.encoded_pgm(image[60:650, 90:680])), (3, media.encoded_pgm(texture(6, 700)))]
    df = spark.createDataFrame([(i, bytes(x)) for i, x in rows], "id long, image binary")
    found = {r["id"]: r for r in media.image_classes(df).collect()}
    assert {i: r["class_id"] for i, r in found.items()} == {1: 1, 2: 1, 3: 3} and found[1]["n_corners"] > 1000


def test_crowded_buckets_lose_no_pair(spark, monkeypatch):
    """Keys so coarse that unrelated hubs sit in all buckets hide no copy."""
    rows, draw, keys = [], np.random.default_rng(6), media.table_keys
    for s in range(5):
        image = texture(s, 90)
        for v in (image, np.clip(image * 0.85 + 20, 0, 255), image + draw.standard_normal(image.shape) * 4):
            rows.append((len(rows), bytes(media.encoded_pgm(v))))
    coarse = F.array_distinct(F.transform("bands", lambda b: F.pmod(b, F.lit(5)))).alias("bands")
    monkeypatch.setattr(media, "table_keys", lambda rows: keys(rows).select("node", coarse))
    df = spark.createDataFrame(rows, "id long, image binary")
    found = {r["id"]: r["class_id"] for r in media.image_classes(df).collect()}
    assert found == {i: i - i % 3 for i in range(15)}


def test_copies_of_marked_pictures_join(spark):
    mark, rows = texture(999, 44), []
    for s in range(24):
        image = texture(s, 110)
        image[:44, :44] = mark
        rows.append((s, image))
    rows += [(100 + s, rows[s][1] * 0.85 + 20) for s in range(0, 24, 4)]
    df = spark.createDataFrame([(i, bytes(media.encoded_pgm(x))) for i, x in rows], "id long, image binary")
    found = {r["id"]: r["class_id"] for r in media.image_classes(df).collect()}
    assert found == {i: i % 100 for i, _ in rows}


def test_vectors_as_images(spark):
    rows = [(10, [1.0] * 64), (20, [float(i) for i in range(64)]), (30, None), (40, [1.0, None, 2.0, 3.0]), (50, []), (60, [0.0] * 4), (None, [1.0])]
    made = media.vector_images(spark.createDataFrame(rows, FORM), "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()
    shown = {(r["id"], r["edit"]): r["image"] for r in made}
    assert [shown[i, "none"] is None for i in (10, 20, 30, 40, 50, 60, None)] == [False, False, True, True, True, False, False]
    assert {k for k in shown if k[1] != "none"} == {(20, media.EDITS[2]), (60, media.EDITS[2])}
    assert media.decoded(shown[20, "none"]).shape == (64, 64)


def test_query_finds_its_copies(spark, small):
    rows = registry.op10_media(spark, small).collect()
    own = {r["image_id"]: r["class_id"] for r in rows}
    copies = [r for r in rows if r["edit"] != "none"]
    assert copies and np.mean([own[2 * r["vec_id"]] == r["class_id"] for r in copies]) >= 0.95
    assert all(r["edit"] == media.EDITS[r["vec_id"] // 10 % 4] for r in copies)
    table = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    unit = {r["vec_id"]: np.array(r["embedding"]) / np.linalg.norm(r["embedding"]) for r in table}
    joined = [r for r in rows if r["vec_id"] * 2 != r["class_id"]]
    assert all(unit[r["vec_id"]] @ unit[r["class_id"] // 2] > 0.8 for r in joined)  # no false ones
