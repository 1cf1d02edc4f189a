"""Copies among images by local descriptors and geometric consensus.

Corners are found on several scales (local maxima of the Harris response), given
an orientation (the centroid of their patch), and described by binary tests
between smoothed pixels along directions turned with it.  A descriptor is cut
into parts, and each part is a key of a hash table: near descriptors agree in
some part whole.  Images that share enough keys in the tables are candidates.
Each bucket's members are first compared with its best connected image, as
near-duplicate texts are.  Then all candidates that are still of different
components are enumerated by an exact prefix filter on their keys, rare keys
first, so an unrelated hub hides no pair and a key that very many images hold is
no meeting place.  A candidate is verified by consensus: matched corners must
agree, up to a few pixels, on one similarity transform (shift, turn, scale), so
crops and edits are found while images that share a texture only are not.
Matched are corners whose descriptors are each other's nearest, so matches never
exceed corners, and both steps run in blocks of bounded memory.

Images are PGM, PPM (binary, 8 bit) or PNG (8 bit, not interlaced) bytes.
Defined results: an image that is null, of another format, broken or under
LEAST_SIDE pixels a side has no corners and a class of its own with equal bytes;
so has one without corners.  Rows of one id are one image: each picture is
compared, and it links what they link.  A null id has no class, a class is named
by its least id, so ties need no order, and an empty table has no classes.  Among
equally near descriptors the first is taken.  Other input columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtally.llm.common import scratch, stored, text_slices
from gridtally.llm.near_dedup import (
    across_labels,
    apart,
    bucket_members,
    classes_of,
    components,
    copies,
    open_members,
    twins,
    with_hubs,
)

SCALES = (1.0, 1.5, 2.25)
BITS, PARTS = 128, 2
PATCH, REACH = 12, 7  # radius of tests, of the orientation
TURNS = 32
CORNER = 40.0  # least Harris response, in grey levels squared
HAMMING = 26  # most differing bits of matched corners
#: Keys that candidates share: so many, and so large a part of the smaller image's.
SHARED, SHARE = 2, 0.05
INLIERS, INLIER_SHARE, NEAR = 6, 0.4, 3.0
LEAST_SIDE = 16
#: Bytes of images decoded, and pixels searched for corners, side by side.
SLICE_BYTES, BLOCK_PIXELS = 512 << 10, 300_000
#: Corners of one picture that are described side by side.
BLOCK_CORNERS = 2048
#: Pairs of corners, or of matches, that consensus holds side by side.
BLOCK_PAIRS = 1 << 18


def decoded(data: bytes | None) -> np.ndarray | None:
    """Grey levels (rows, columns) as floats, or None."""
    try:
        if data[:2] in (b"P5", b"P6"):
            head = re.match(rb"P[56](?:\s+|#[^\n]*\n)+(\d+)\s+(\d+)\s+(\d+)\s", data)
            w, h, top = map(int, head.groups())
            depth = 1 if data[:2] == b"P5" else 3
            grid = np.frombuffer(data, np.uint8, w * h * depth, head.end()).reshape(h, w, depth)
            return grid.mean(2) * (255.0 / top) if 0 < top < 256 else None
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return decoded_png(data)
    except (TypeError, ValueError, AttributeError, KeyError, struct.error, zlib.error, IndexError):
        pass
    return None


def decoded_png(data: bytes) -> np.ndarray | None:
    at, parts, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        parts += [body] if kind == b"IDAT" else []
        at += 12 + size
    w, h, bits, colour, _, _, interlaced = head
    depth = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    if bits != 8 or interlaced:
        return None
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, w * depth + 1)
    above = np.zeros(w * depth, np.int64)
    lines = []
    for kind, line in zip(rows[:, 0].tolist(), rows[:, 1:].astype(np.int64)):
        if kind == 2:
            line = (line + above) & 255
        elif kind == 1:
            line = (line.reshape(w, depth).cumsum(0) & 255).ravel()
        elif kind:  # the other filters look left and up
            line = line.copy()
            for i in range(len(line)):
                left = line[i - depth] if i >= depth else 0
                corner = above[i - depth] if i >= depth else 0
                up = above[i]
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    d = [abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)]
                    guess = (left, up, corner)[d.index(min(d))]
                line[i] = (line[i] + guess) & 255
        lines.append(line)
        above = line
    grid = np.array(lines, np.float64).reshape(h, w, depth)
    return grid[:, :, : 3 if depth > 2 else 1].mean(2)


def encoded_pgm(grid: np.ndarray) -> bytes:
    h, w = grid.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.clip(np.rint(grid), 0, 255).astype(np.uint8).tobytes()


def resized(grids: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear resampling of images (N, rows, columns)."""

    def places(n: int, m: int):
        x = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        i = np.minimum(x.astype(int), max(n - 2, 0))
        return i, np.minimum(i + 1, n - 1), (x - i).astype(np.float32)

    a, b, f = places(grids.shape[1], h)
    grids = grids[:, a] * (1 - f)[:, None] + grids[:, b] * f[:, None]
    a, b, f = places(grids.shape[2], w)
    return grids[:, :, a] * (1 - f) + grids[:, :, b] * f


def box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of radius r, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        s = np.cumsum(np.pad(x, pad, "edge"), axis, dtype=np.float64)
        n = x.shape[axis]
        s = s[:, 2 * r + 1 :, :] - s[:, :n, :] if axis == 1 else s[:, :, 2 * r + 1 :] - s[:, :, :n]
        x = (s / (2 * r + 1)).astype(np.float32)
    return x


def test_pattern() -> np.ndarray:
    """Ends of the binary tests for each turn: (TURNS, BITS, 2 ends, y and x)."""
    draw = np.random.default_rng(3)
    ends = np.clip(draw.standard_normal((BITS, 2, 2)) * PATCH / 2.2, -PATCH * 0.7, PATCH * 0.7)
    angle = np.arange(TURNS) * 2 * np.pi / TURNS
    c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    y, x = ends[None, :, :, 0], ends[None, :, :, 1]
    return np.rint(np.stack([c * y + s * x, c * x - s * y], -1)).astype(np.int64)


PATTERN = test_pattern()


def descriptors(padded: np.ndarray, who: np.ndarray, y: np.ndarray, x: np.ndarray):
    """Angle and binary tests of corners in images that are padded by PATCH."""
    step = np.arange(-REACH, REACH + 1)
    disc = step[:, None] ** 2 + step**2 <= REACH**2
    who, y, x = who[:, None, None], y[:, None, None] + PATCH, x[:, None, None] + PATCH
    patch = padded[who, y + step[:, None], x + step]
    patch = (patch - patch.mean((1, 2), keepdims=True)) * disc
    angle = np.arctan2((patch * step[:, None]).sum((1, 2)), (patch * step).sum((1, 2)))
    turn = np.rint(angle * TURNS / (2 * np.pi)).astype(np.int64) % TURNS
    ends = PATTERN[turn]  # corners, bits, ends, 2
    values = padded[who, y + ends[..., 0], x + ends[..., 1]]
    return angle, np.packbits(values[:, :, 0] < values[:, :, 1], axis=1)


def corners(grids: np.ndarray):
    """Of images (N, rows, columns): owner, x, y, angle, scale and descriptor of each corner."""
    found = []
    for scale in SCALES:
        h, w = round(grids.shape[1] / scale), round(grids.shape[2] / scale)
        if min(h, w) < LEAST_SIDE:
            break
        level = box(grids if scale == 1 else resized(grids, h, w), 1)
        dy, dx = np.gradient(level, axis=(1, 2))
        yy, xx, xy = box(dy * dy, 2), box(dx * dx, 2), box(dx * dy, 2)
        response = (xx * yy - xy * xy) / (xx + yy + 1e-6)
        inner = np.full(response.shape, -np.inf, np.float32)
        inner[:, 3:-3, 3:-3] = response[:, 3:-3, 3:-3]
        peak = inner > CORNER
        for sy in range(-2, 3):
            for sx in range(-2, 3):
                if (sy, sx) != (0, 0):
                    other = np.roll(inner, (sy, sx), (1, 2))
                    peak &= inner >= other if (sy, sx) > (0, 0) else inner > other
        who, y, x = np.nonzero(peak)
        if not len(who):
            continue
        padded = np.pad(level, ((0, 0), (PATCH, PATCH), (PATCH, PATCH)), "edge")
        angle = np.empty(len(who))
        bits = np.empty((len(who), BITS // 8), np.uint8)
        for start in range(0, len(who), BLOCK_CORNERS):
            own = slice(start, start + BLOCK_CORNERS)
            angle[own], bits[own] = descriptors(padded, who[own], y[own], x[own])
        found.append((who, x * scale, y * scale, angle, np.full(len(who), scale), bits))
    if not found:
        empty = np.empty(0)
        return np.empty(0, np.int64), empty, empty, empty, empty, np.empty((0, BITS // 8), np.uint8)
    return tuple(np.concatenate(x) for x in zip(*found))


def packed_places(rows: np.ndarray) -> bytes:
    """x, y, angle and scale of corners (N, 4), a column after the other."""
    return rows[:, :2].T.astype(np.float32).tobytes() + rows[:, 2:].T.astype(np.float16).tobytes()


def unpacked_places(data: bytes) -> np.ndarray:
    n = len(data) // 12
    fine = np.frombuffer(data, np.float32, 2 * n).reshape(2, n)
    coarse = np.frombuffer(data, np.float16, 2 * n, 8 * n).reshape(2, n)
    return np.concatenate([fine, coarse]).T.astype(np.float64)


def described(df: DataFrame, id_col: str, image_col: str) -> DataFrame:
    """doc_id, digest, row, n_corners, places (see packed_places), descriptors (bytes)."""

    def run(batches):
        for batch in text_slices(batches, "image", SLICE_BYTES):
            images = [decoded(x.as_py()) for x in batch.column("image")]
            sizes, places, bits = [0] * len(images), [b""] * len(images), [b""] * len(images)
            shapes: dict[tuple, list[int]] = {}
            for i, grid in enumerate(images):
                if grid is not None and min(grid.shape) >= LEAST_SIDE:
                    shapes.setdefault(grid.shape, []).append(i)
            for shape, members in shapes.items():
                block = max(1, BLOCK_PIXELS // (shape[0] * shape[1]))
                for a in range(0, len(members), block):
                    own = members[a : a + block]
                    grids = np.stack([images[i] for i in own]).astype(np.float32)
                    who, *rest, words = corners(grids)
                    order = np.argsort(who, kind="stable")
                    at = np.searchsorted(who[order], np.arange(len(own) + 1))
                    rows = np.stack(rest, 1)[order]
                    words = words[order]
                    for k, i in enumerate(own):
                        sizes[i] = int(at[k + 1] - at[k])
                        places[i] = packed_places(rows[at[k] : at[k + 1]])
                        bits[i] = words[at[k] : at[k + 1]].tobytes()
            kept = [batch.column(c) for c in ("doc_id", "digest", "row")]
            made = [pa.array(sizes, pa.int64()), pa.array(places, pa.binary())]
            made.append(pa.array(bits, pa.binary()))
            names = ["doc_id", "digest", "row", "n_corners", "places", "descriptors"]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=names)

    data = F.col(image_col)
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        data.alias("image"),
        F.unhex(F.sha2(F.coalesce(data, F.lit(b"")), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    form = "doc_id long, digest binary, row long, n_corners long, places binary, descriptors binary"
    return rows.mapInArrow(run, form)


def table_keys(rows: DataFrame) -> DataFrame:
    """node, bands: the distinct table keys of the descriptors of each image."""

    def run(batches):
        for batch in text_slices(batches, "descriptors", SLICE_BYTES):
            lists = []
            for data in batch.column("descriptors"):
                parts = np.frombuffer(data.as_py(), np.uint64).reshape(-1, PARTS)
                keys = parts * np.uint64(0x9E3779B97F4A7C15) + np.arange(PARTS, dtype=np.uint64)
                lists.append(np.unique(keys.view(np.int64)))
            bands = pa.array(lists, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), bands], names=["node", "bands"])

    return rows.select("node", "descriptors").mapInArrow(run, "node long, bands array<long>")


def matches(bits_a: bytes, bits_b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The corners that are each other's nearest, at most HAMMING bits apart."""
    u = np.frombuffer(bits_a, np.uint64).reshape(-1, BITS // 64)
    v = np.frombuffer(bits_b, np.uint64).reshape(-1, BITS // 64)
    best = np.empty(len(u), np.int64)
    least = np.full(len(v), BITS + 1)
    back = np.zeros(len(v), np.int64)
    near = np.empty(len(u), np.int64)
    step = max(1, BLOCK_PAIRS // len(v))
    for k in range(0, len(u), step):
        far = np.bitwise_count(u[k : k + step, None] ^ v[None]).sum(2, dtype=np.uint8)
        best[k : k + step] = far.argmin(1)
        near[k : k + step] = far.min(1)
        low, at = far.min(0), far.argmin(0) + k
        better = low < least
        least[better], back[better] = low[better], at[better]
    i = np.flatnonzero((near <= HAMMING) & (back[best] == np.arange(len(u))))
    return i, best[i]


def consensus(places_a: bytes, bits_a: bytes, places_b: bytes, bits_b: bytes) -> int:
    """The most matched corners that agree on one similarity transform, or 0 if too few."""
    a, b = unpacked_places(places_a), unpacked_places(places_b)
    if min(len(a), len(b)) < INLIERS:
        return 0
    i, j = matches(bits_a, bits_b)
    if len(i) < INLIERS:
        return 0
    p, q = a[i], b[j]
    turn, ratio = q[:, 2] - p[:, 2], q[:, 3] / p[:, 3]
    c, s = np.cos(turn) * ratio, np.sin(turn) * ratio
    best = 0
    step = max(1, BLOCK_PAIRS // len(i))
    for k in range(0, len(i), step):  # the transforms that a block of matches proposes
        own = slice(k, k + step)
        dx = p[:, 0] - p[own, 0][:, None]
        dy = p[:, 1] - p[own, 1][:, None]
        x = q[own, 0][:, None] + c[own][:, None] * dx - s[own][:, None] * dy - q[:, 0]
        y = q[own, 1][:, None] + s[own][:, None] * dx + c[own][:, None] * dy - q[:, 1]
        good = np.hypot(x, y) <= NEAR * np.maximum(1.0, ratio[own])[:, None]
        best = max(best, int(good.sum(1).max()))
    return best if best >= max(INLIERS, INLIER_SHARE * min(len(a), len(b))) else 0


def confirmed(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that a consensus of corners joins."""

    def run(batches):
        for batch in text_slices(batches, "da", SLICE_BYTES):
            sides = [[batch.column(c).to_pylist() for c in cs] for cs in (("pa", "da"), ("pb", "db"))]
            good = [consensus(*x) > 0 for x in zip(*sides[0], *sides[1])]
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"]
            )

    one, other = (
        images.select(
            F.col("node").alias(end),
            F.col("places").alias(f"p{end}"),
            F.col("descriptors").alias(f"d{end}"),
        )
        for end in "ab"
    )
    joined = pairs.join(one, "a").join(other, "b").select("a", "b", "pa", "da", "pb", "db")
    return joined.mapInArrow(run, "a long, b long")


def shared_keys(n: Column) -> Column:
    """The keys that an image with n of them must share with a larger one."""
    return F.greatest(F.lit(SHARED), F.ceil(F.lit(SHARE) * n - 1e-9)).cast("long")


def candidates(met: DataFrame, keys: DataFrame) -> DataFrame:
    """The distinct pairs (a > b) of met (x, y) whose keys (node, bands) have enough in common."""
    pairs = met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    # Half of each key is enough to tell an image's few keys apart, and half as much to move.
    short = F.transform("bands", lambda b: (b % 2_147_483_647).cast("int"))
    for end in "ab":
        own = keys.select(F.col("node").alias(end), short.alias(f"keys_{end}"))
        pairs = pairs.join(own, end)
    needed = shared_keys(F.least(F.size("keys_a"), F.size("keys_b")))
    both = F.size(F.array_intersect("keys_a", "keys_b"))
    return pairs.where(both >= needed).select("a", "b")


def crowd_pairs(members: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs (x, y) of members (bucket, node, label) of different label: all candidates, and more.

    An image must share shared_keys(n) of its n keys with a larger one.  With
    the rarest key first, the first shared one is no later than n less that
    number, so its commonest keys are looked up by nobody.
    """
    sizes = keys.select("node", F.size("bands").cast("long").alias("n_keys"))
    held = members.groupBy("bucket").agg(F.count("*").alias("holders"))
    ranked = members.join(apart(held), "bucket").join(sizes, "node")
    last = Window.partitionBy("node").orderBy(F.desc("holders"), "bucket")
    ranked = ranked.withColumn("from_end", F.row_number().over(last))
    ranked = stored(ranked.select("bucket", "node", "label", "n_keys", "from_end"), "media-ranked")
    x = ranked.where(F.col("from_end") >= shared_keys(F.col("n_keys"))).alias("x")
    y = ranked.alias("y")
    return x.join(
        y,
        (F.col("x.bucket") == F.col("y.bucket"))
        & (F.col("x.label") != F.col("y.label"))
        & (F.struct("x.n_keys", "x.node") < F.struct("y.n_keys", "y.node")),
    ).select(F.col("x.node").alias("x"), F.col("y.node").alias("y"))


def image_classes(df: DataFrame, id_col: str = "id", image_col: str = "image") -> DataFrame:
    """id, class_id, n_corners: the class of each image, named by its least id."""
    rows = stored(described(df, id_col, image_col), "media-corners")
    same = copies(rows.select("doc_id", "digest", "row"))
    # A row is found by its number, so that a hub with many partners is a key that Spark can split.
    images = rows.where(F.col("n_corners") >= INLIERS).withColumnRenamed("row", "node")
    with scratch(df.sparkSession):
        keys = stored(table_keys(images.join(same.select("node"), "node", "left_semi")), "media-keys")
        hubs = with_hubs(bucket_members(keys))
        met = hubs.select(F.col("node").alias("x"), F.col("hub").alias("y"))
        done = stored(candidates(met, keys), "media-pairs")
        links = stored(confirmed(done, images), "media-links")
        labels = components(links)
        members = stored(open_members(hubs, labels), "media-open")
        more = candidates(crowd_pairs(members, keys), keys).join(done, ["a", "b"], "left_anti")
        more = stored(across_labels(more, labels), "media-pairs")
        links = links.unionByName(confirmed(more, images))
        links = stored(links, "media-links", outlive=True)
    marks = rows.select("doc_id", "digest", "row", "n_corners")
    labels = components(links.unionByName(twins(marks, same)))
    return classes_of(marks, same, labels).select(
        F.col("doc_id").alias("id"), "class_id", "n_corners"
    )


#: Sides of the noise grids that a drawing's texture is made of, and their strength.
OCTAVES = ((8, 1.0), (16, 0.7), (24, 0.5))
EDITS = ("crop", "tone", "noise", "turn")


def textures(n: int, side: int) -> np.ndarray:
    """One square texture for each of n components: (n, side, side)."""
    draw = np.random.default_rng(11)
    return sum(
        resized(draw.standard_normal((n, k, k)), side, side) * weight for k, weight in OCTAVES
    ).astype(np.float32)


def edited(grid: np.ndarray, edit: str, seed: int) -> np.ndarray:
    """An edited copy of a picture: cropped, toned, with noise, or turned by a right angle."""
    h, w = grid.shape
    if edit == "crop":
        return grid[round(h * 0.12) : round(h * 0.9), round(w * 0.1) : round(w * 0.88)]
    if edit == "tone":
        return grid * 0.85 + 20
    if edit == "noise":
        return grid + np.random.default_rng(seed).standard_normal(grid.shape) * 4
    return np.rot90(grid)


def vector_images(
    df: DataFrame, id_col: str, vector_col: str, copied: Column | None = None, side: int = 64
) -> DataFrame:
    """id, edit, image: vectors drawn as square grey images, for tables that hold no media.

    Each component weighs a texture of its own; equal vectors are equal images,
    near ones are like images.  A vector that is null or empty or holds null or
    non-finite components has a null image.  Where copied holds, a second row has
    an edited copy of the drawing, by one of EDITS in turn of the id.
    """

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, edits, images = [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("id", "vector", "copied")))
            for id_, vector, copied in rows:
                values = np.array([np.nan if x is None else x for x in vector or ()], np.float64)
                good = len(values) > 0 and np.isfinite(values).all()
                grid = None
                if good:
                    if len(values) not in known:
                        known[len(values)] = textures(len(values), side)
                    grid = np.tensordot(values / max(np.abs(values).max(), 1e-300), known[len(values)], 1)
                    grid = np.rint(127.5 + 127.5 * grid / max(float(np.abs(grid).max()), 1e-12))
                ids.append(id_)
                edits.append("none")
                images.append(encoded_pgm(grid) if good else None)
                if copied and good and id_ is not None:
                    edit = EDITS[id_ // 10 % len(EDITS)]
                    ids.append(id_)
                    edits.append(edit)
                    images.append(encoded_pgm(edited(grid, edit, abs(id_))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(edits, pa.string()), pa.array(images, pa.binary())],
                names=["id", "edit", "image"],
            )

    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).alias("vector"),
        (F.lit(False) if copied is None else copied).alias("copied"),
    )
    return rows.mapInArrow(run, "id long, edit string, image binary")
