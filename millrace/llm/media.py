"""Media columns: cropped and edited copies by local image descriptors.

Corners (Harris) are found on a pyramid of scales, a sixth of an octave apart: every local maximum
above a threshold, so their number grows with the area. Each is placed to a fraction of a pixel and
gets an orientation from the intensity centroid of its patch; 256 binary tests between points of
concentric rings, turned by that orientation, are its descriptor. Five 44-bit codes are cut from a
descriptor. Corners of a copy keep some of their codes; images that share two codes or more (and one for
each 200 corners of the smaller image) are compared: each corner of the image with fewer corners
matches its nearest descriptor within a Hamming distance of 48, and two images are copies if one
similarity transform (scale, turn, shift) maps at least ``least`` matched corners, and a fiftieth of all matches, onto each other.

Codes travel in packed postings. Each code pairs its images with its smallest id, and each image is first compared with the one
that shares the most codes with it, then with the best of those it is not connected with; after that,
exactly, all that share codes enough and are not yet connected, each pair once. A group of copies so
costs its size, not its square; what stays quadratic are images that share codes and are no copies.
Images of equal bytes are a class whose smallest id stands for it. Features are computed again for
the images of compared pairs only, so no descriptors are stored.

The tables here hold no images: ``render`` draws an embedding as a texture, so equal and close
vectors give equal and edited images. Other media columns come as PGM bytes.

Results for odd input: null or undecodable images, and those without corners, are copies of nothing
unless equal bytes; repeated rows share a class; of rows that repeat an id with other images each has its own
class; null ids get their class's smallest id; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import postings as P
from millrace.llm import words as W
from millrace.llm.components import components
from millrace.llm.scratch import Scratch

SIDE, LEVELS, SHRINK, RADIUS, CONSENSUS, DISTANCE = 96, 9, 2 ** (-1 / 6), 10, 5, 48
MARGIN, STRENGTH, TABLES, CODE, SHARED, CORNERS_A_CODE, BLOCK, POSTED = RADIUS + 2, 10.0, 5, 44, 2, 200, 512, 1 << 18
#: Points on each of the rings, from the inner one.
RINGS = (6, 10, 14, 16, 18)


def render(vectors: np.ndarray) -> np.ndarray:
    """Textures (n, SIDE, SIDE) of vectors (n, d): a fixed random basis, smoothed."""
    n, d = vectors.shape
    seed = np.arange(d * SIDE * SIDE, dtype=np.uint64)
    basis = (W.mix(seed * np.uint64(W.STEP)) >> np.uint64(40)).astype(np.float32).reshape(d, SIDE * SIDE) / 2**24 - 0.5
    x = (vectors.astype(np.float32) @ basis).reshape(n, SIDE, SIDE)
    for axis in (1, 2):
        x = (np.roll(x, 1, axis) + 2 * x + np.roll(x, -1, axis)) / 4
    spread = np.maximum(np.abs(x).max((1, 2), keepdims=True), 1e-12)
    return np.clip(np.rint(127.5 + 127.5 * x / spread), 0, 255).astype(np.uint8)


def to_pgm(image: np.ndarray) -> bytes:
    return f"P5 {image.shape[1]} {image.shape[0]} 255\n".encode() + image.tobytes()


def from_pgm(data: bytes | None) -> np.ndarray | None:
    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", data or b"")
    if not m:
        return None
    w, h = int(m[1]), int(m[2])
    body = data[m.end() : m.end() + w * h]
    return np.frombuffer(body, np.uint8).reshape(h, w) if len(body) == w * h and w * h else None


def gaussian(sigma: float) -> np.ndarray:
    r = int(np.ceil(2.5 * sigma))
    g = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return (g / g.sum()).astype(np.float32)


def blurred(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Images (n, h, w) smoothed along both axes, edges repeated."""
    r = len(kernel) // 2
    for axis in (1, 2):
        wide = np.pad(x, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="edge")
        n = x.shape[axis]
        x = sum(np.take(wide, np.arange(i, i + n), axis) * c if axis == 1 else wide[:, :, i : i + n] * c for i, c in enumerate(kernel))
    return x


def resized(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear."""
    ys, xs = (np.arange(h) + 0.5) * x.shape[1] / h - 0.5, (np.arange(w) + 0.5) * x.shape[2] / w - 0.5
    y0, x0 = np.clip(np.floor(ys).astype(int), 0, x.shape[1] - 2), np.clip(np.floor(xs).astype(int), 0, x.shape[2] - 2)
    fy, fx = np.clip(ys - y0, 0, 1).astype(np.float32)[:, None], np.clip(xs - x0, 0, 1).astype(np.float32)
    rows = x[:, y0] * (1 - fy) + x[:, y0 + 1] * fy
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x0 + 1] * fx


def sampled(x: np.ndarray, n: np.ndarray, y: np.ndarray, xx: np.ndarray) -> np.ndarray:
    """Bilinear values of images ``n`` at (y, xx), rows of points."""
    y0, x0 = np.floor(y).astype(np.int64), np.floor(xx).astype(np.int64)
    fy, fx, w, flat = y - y0, xx - x0, x.shape[2], x.reshape(-1)
    at = (n[:, None] * x.shape[1] + y0) * w + x0
    return (flat[at] * (1 - fx) + flat[at + 1] * fx) * (1 - fy) + (flat[at + w] * (1 - fx) + flat[at + w + 1] * fx) * fy


def tests() -> tuple[np.ndarray, np.ndarray]:
    """The rings' points (y, x), and the 256 pairs of points that are compared: at least a third of the radius apart."""
    n = np.array(RINGS)
    ring = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    r, a = RADIUS * (ring + 1) / len(n), 2 * np.pi * (k + 0.5 * (ring % 2)) / n[ring]
    points = np.stack([r * np.sin(a), r * np.cos(a)], 1)
    first, second = np.triu_indices(len(points), 1)
    far = np.hypot(*(points[first] - points[second]).T) > RADIUS / 3
    pairs = np.stack([first[far], second[far]], 1)
    order = np.argsort(W.mix(np.arange(len(pairs), dtype=np.uint64) + np.uint64(77)))[:256]
    return points.astype(np.float32), pairs[order]


def peaks(strength: np.ndarray) -> np.ndarray:
    """Maxima of their 5 x 5 neighbourhood, above the threshold and inside the margin."""
    top = strength
    for axis in (1, 2):
        before, top = top, top.copy()
        for d in (1, 2):
            low, high = [slice(None)] * 3, [slice(None)] * 3
            low[axis], high[axis] = slice(None, -d), slice(d, None)
            top[tuple(high)] = np.maximum(top[tuple(high)], before[tuple(low)])
            top[tuple(low)] = np.maximum(top[tuple(low)], before[tuple(high)])
    ok = (strength >= top) & (strength > STRENGTH)
    ok[:, :MARGIN] = ok[:, -MARGIN:] = False
    ok[:, :, :MARGIN] = ok[:, :, -MARGIN:] = False
    return ok


def beside(low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where the parabola through three values has its top, -0.5 to 0.5."""
    bend = low - 2 * mid + high
    return np.clip(np.where(bend < -1e-9, (low - high) / (2 * np.minimum(bend, -1e-9)), 0), -0.5, 0.5)


def describe(images: np.ndarray, pattern: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of ``images`` (n, h, w): corners (y, x, scale, angle) in its pixels, and descriptors (corners, 4) of 64 bits."""
    points, pairs = pattern
    height, width = images.shape[1:]
    at, corners, codes = [np.zeros(0, np.int64)], [np.zeros((0, 4), np.float32)], [np.zeros((0, 4), np.uint64)]
    x, step, window = images.astype(np.float32), np.array([0.25, 0.5, 0.25], np.float32), gaussian(1.5)
    for level in range(LEVELS):
        h, w = round(height * SHRINK**level), round(width * SHRINK**level)
        if min(h, w) < 2 * MARGIN + 3:
            break
        x = resized(blurred(x, step), h, w) if level else blurred(x, gaussian(1.3))
        gy, gx = np.zeros_like(x), np.zeros_like(x)
        gy[:, 1:-1], gx[:, :, 1:-1] = (x[:, 2:] - x[:, :-2]) / 2, (x[:, :, 2:] - x[:, :, :-2]) / 2
        a, b, c = blurred(gy * gy, window), blurred(gx * gx, window), blurred(gy * gx, window)
        strength = a * b - c * c - 0.04 * (a + b) ** 2
        n, iy, ix = np.nonzero(peaks(strength))
        mid = strength[n, iy, ix]
        y = (iy + beside(strength[n, iy - 1, ix], mid, strength[n, iy + 1, ix])).astype(np.float32)
        xx = (ix + beside(strength[n, iy, ix - 1], mid, strength[n, iy, ix + 1])).astype(np.float32)
        angle = np.zeros(len(n), np.float32)
        for _ in range(3):  # the centroid of the turned rings tells what is left to turn; the last look is the descriptor's
            cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
            value = sampled(x, n, y[:, None] + cos * points[:, 0] + sin * points[:, 1], xx[:, None] - sin * points[:, 0] + cos * points[:, 1])
            if _ < 2:
                angle = angle + np.arctan2((value * points[:, 0]).sum(1), (value * points[:, 1]).sum(1))
        bits = np.packbits(value[:, pairs[:, 0]] < value[:, pairs[:, 1]], axis=1)
        at.append(n)
        codes.append(np.ascontiguousarray(bits).view("<u8"))
        fy, fx = height / h, width / w
        corners.append(np.stack([(y + 0.5) * fy - 0.5, (xx + 0.5) * fx - 0.5, np.full(len(n), (fy * fx) ** 0.5), angle], 1).astype(np.float32))
    row = np.concatenate(at)
    order = np.argsort(row, kind="stable")
    corner, code, edge = np.concatenate(corners)[order], np.concatenate(codes)[order], np.searchsorted(row[order], np.arange(len(images) + 1))
    return [(corner[i:j], code[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)]


def described(data: list[bytes | None], pattern: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``describe`` for PGM bytes, images of one shape at a time."""
    out = [(np.zeros((0, 4), np.float32), np.zeros((0, 4), np.uint64))] * len(data)
    by_shape: dict[tuple[int, ...], list[tuple[int, np.ndarray]]] = {}
    for i, d in enumerate(data):
        image = from_pgm(d)
        if image is not None:
            by_shape.setdefault(image.shape, []).append((i, image))
    for shape, some in by_shape.items():
        size = max(1, (1 << 18) // (shape[0] * shape[1]))
        for lo in range(0, len(some), size):
            part = some[lo : lo + size]
            for (i, _), found in zip(part, describe(np.stack([x for _, x in part]), pattern), strict=True):
                out[i] = found
    return out


def matches(da: np.ndarray, db: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each corner's nearest descriptor in the other image, if within the distance; bounded memory."""
    best, place = np.full(len(da), DISTANCE + 1, np.int16), np.zeros(len(da), np.int64)
    for lo in range(0, len(da), BLOCK):
        for at in range(0, len(db), 8 * BLOCK):
            far = sum(np.bitwise_count(da[lo : lo + BLOCK, None, w] ^ db[None, at : at + 8 * BLOCK, w]).astype(np.int16) for w in range(4))
            near = far.argmin(1)
            d = far[np.arange(len(far)), near]
            closer = np.flatnonzero(d < best[lo : lo + BLOCK])
            best[lo + closer], place[lo + closer] = d[closer], near[closer] + at
    i = np.flatnonzero(best <= DISTANCE)
    return i, place[i]


def consensus(ka: np.ndarray, da: np.ndarray, kb: np.ndarray, db: np.ndarray, enough: int | None = None) -> int:
    """Most matched corners (of either image) that one similarity transform maps onto each other; with ``enough``, 0 or
    as many as it takes to tell copies."""
    if not len(ka) or not len(kb):
        return 0
    if len(kb) < len(ka):
        ka, da, kb, db = kb, db, ka, da
    i, j = matches(da, db)
    enough = max(enough, len(i) // 50) if enough else None
    a, b = ka[i].astype(float), kb[j].astype(float)
    scale, turn = b[:, 2] / a[:, 2], (b[:, 3] - a[:, 3]) % (2 * np.pi)
    cos, sin = scale * np.cos(turn), scale * np.sin(turn)
    ty, tx = b[:, 0] - (cos * a[:, 0] + sin * a[:, 1]), b[:, 1] - (-sin * a[:, 0] + cos * a[:, 1])
    best, bins = 0, np.floor(turn / (np.pi / 8)).astype(int) % 16
    for t in np.unique(bins):  # each match proposes a transform; those of about its turn vote by where it sends their corner
        voter = np.flatnonzero(np.isin(bins, [(t - 1) % 16, t, (t + 1) % 16]))
        if len(voter) <= best:
            continue
        mine, v, w = np.flatnonzero(bins == t), a[voter], b[voter]
        for lo in range(0, len(mine), BLOCK):
            m = mine[lo : lo + BLOCK, None]
            off = np.hypot(cos[m] * v[:, 0] + sin[m] * v[:, 1] + ty[m] - w[:, 0], -sin[m] * v[:, 0] + cos[m] * v[:, 1] + tx[m] - w[:, 1])
            agree = (off <= 3.0 * np.maximum(1, w[:, 2])) & (np.abs(np.log(scale[m] / scale[voter])) < 0.2)
            for row in agree[agree.sum(1) > best]:
                best = max(best, min(len(np.unique(i[voter[row]])), len(np.unique(j[voter[row]]))))
                if enough and best >= enough:
                    return best
    return 0 if enough else best


def codes_of(descriptors: np.ndarray) -> np.ndarray:
    """48 bits of a hash of each code with its table, distinct."""
    bits = np.unpackbits(np.ascontiguousarray(descriptors).view(np.uint8).reshape(-1, 32), axis=1)[:, : TABLES * CODE].reshape(-1, CODE)
    raw = np.zeros((len(bits), 8), np.uint8)
    raw[:, : -(-CODE // 8)] = np.packbits(bits, axis=1)
    return np.unique(W.mix(raw.view("<u8").reshape(-1, TABLES) + np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(W.STEP)) & P.LOW48)


FEATURES = "id long, sig long, n int, codes binary"
CORNERS = "id long, points binary, descriptors binary"


def signature(data: bytes | None) -> int | None:
    return None if not data else int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def features(batches):
    """From (id, image: PGM bytes)."""
    pattern = tests()
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            data = part.column("image").to_pylist()
            found = described(data, pattern)
            codes = [W.pack6(codes_of(d)) for _, d in found]
            yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.int64()), pa.array([signature(d) for d in data], pa.int64()), pa.array([len(k) for k, _ in found], pa.int32()), pa.array(codes, pa.binary())], ["id", "sig", "n", "codes"])


def post(batches, parts: int):
    """(id, code) postings, dealt by code; images of equal bytes of a batch once."""
    for batch in batches:
        ids, code, size, seen = [], [], 0, set()
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            for i, sig, codes in zip(*(part.column(c).to_pylist() for c in ("id", "sig", "codes")), strict=True):
                if codes and sig not in seen:
                    seen.add(sig)
                    code.append(W.unpack6(codes))
                    ids.append(np.full(len(code[-1]), i))
                    size += len(code[-1])
                    if size > POSTED:
                        yield from posted(ids, code, parts)
                        ids, code, size = [], [], 0
        if size:
            yield from posted(ids, code, parts)


def posted(ids: list[np.ndarray], code: list[np.ndarray], parts: int):
    c = np.concatenate(code)
    return P.rows(0, P.pack(P.parts_of(W.mix(c), parts), np.concatenate(ids), c))


def id_parts(ids: np.ndarray, parts: int) -> np.ndarray:
    return P.parts_of(W.mix(ids.view(np.uint64) + np.uint64(W.STEP)), parts)


def packed_pairs(a: np.ndarray, b: np.ndarray, parts: int):
    """kind 1: how many codes each pair (a < b) shares here, dealt by pair."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    pair, k = np.unique(np.stack([a, b], 1), axis=0, return_counts=True) if len(a) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    part = P.parts_of(W.mix(W.mix(pair[:, 0].view(np.uint64) + np.uint64(W.STEP)) ^ pair[:, 1].view(np.uint64)), parts) if len(pair) else np.zeros(0, np.int32)
    return P.records(1, part, np.column_stack([pair, k]))


def grouped(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, codes and where each code starts, sorted by (code, id) and distinct, of codes of two images or more."""
    ids, code = P.unpack(P.gather(batches).pop(0, []))
    order = np.lexsort((ids, code))
    ids, code = ids[order], code[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (code[1:] != code[:-1])
    ids, code = ids[new], code[new]
    first = np.ones(len(ids), bool)
    first[1:] = code[1:] != code[:-1]
    start = np.flatnonzero(first)
    many = np.repeat(np.diff(np.append(start, len(ids))) > 1, np.diff(np.append(start, len(ids))))
    return ids[many], code[many], first[many]


def meet(batches, parts: int):
    """kind 1: pairs of each code's smallest id with its other ids; kind 0: shared codes, dealt by id."""
    ids, code, first = grouped(batches)
    if len(ids):
        hub = ids[first][np.cumsum(first) - 1]
        yield from packed_pairs(hub[~first], ids[~first], parts)
        yield from P.rows(0, P.pack(id_parts(ids, parts), ids, code))


def tally(batches, least: int):
    """Pairs that share at least so many codes."""
    rows = P.unrecord(P.gather(batches).pop(1, []), 3)
    if len(rows):
        pair, at = np.unique(rows[:, :2], axis=0, return_inverse=True)
        k = np.bincount(at.ravel(), rows[:, 2]).astype(np.int64)
        keep = k >= least
        yield pa.RecordBatch.from_arrays([pa.array(pair[keep, 0]), pa.array(pair[keep, 1]), pa.array(k[keep])], ["a", "b", "k"])


def gathered(batches):
    """Each image's shared codes."""
    ids, code = P.unpack(P.gather(batches).pop(0, []))
    order = np.argsort(ids, kind="stable")
    ids, code = ids[order], code[order]
    known, at = np.unique(ids, return_index=True)
    edge = [*at.tolist(), len(ids)]
    for lo in range(0, len(known), 256):
        codes = [code[a:b].tobytes() for a, b in zip(edge[lo : lo + 256], edge[lo + 1 : lo + 257], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(known[lo : lo + 256]), pa.array(codes, pa.binary())], ["id", "codes"])


def post_rooted(batches, parts: int):
    """kind 2: (code, id, root) records, dealt by code."""
    for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
        rows = [np.zeros((0, 3), np.int64)]
        for i, root, codes in zip(*(batch.column(c).to_pylist() for c in ("id", "root", "codes")), strict=True):
            c = np.frombuffer(codes, "<i8")
            rows.append(np.column_stack([c, np.full(len(c), i), np.full(len(c), root)]))
        out = np.concatenate(rows)
        yield from P.records(2, P.parts_of(W.mix(out[:, 0].view(np.uint64)), parts), out)


def cross(batches, parts: int):
    """Pairs of images that share a code and are not connected: those outside the code's largest component meet the others."""
    rows = P.unrecord(P.gather(batches).pop(2, []), 3)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))]
    edge = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0], [True]])) if len(rows) else np.zeros(1, np.int64)
    a, b, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        ids, root = rows[lo:hi, 1], rows[lo:hi, 2]
        if root[0] == root[-1]:
            continue
        known, n = np.unique(root, return_counts=True)
        top = known[n.argmax()]
        for i in np.flatnonzero(root != top).tolist():
            other = ids[(root != root[i]) & ((root == top) | (ids > ids[i]))]
            a.append(np.full(len(other), ids[i]))
            b.append(other)
            size += len(other)
            if size > 1 << 20:
                yield from packed_pairs(np.concatenate(a), np.concatenate(b), parts)
                a, b, size = [], [], 0
    if size:
        yield from packed_pairs(np.concatenate(a), np.concatenate(b), parts)


def cornered(batches):
    """(id, points, descriptors) from (id, image)."""
    pattern = tests()
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            found = described(part.column("image").to_pylist(), pattern)
            yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.int64()), pa.array([k.tobytes() for k, _ in found], pa.binary()), pa.array([d.tobytes() for _, d in found], pa.binary())], ["id", "points", "descriptors"])


def agreeing(batches, least: int):
    for batch in batches:
        keep = []
        for ka, da, kb, db in zip(*(batch.column(c).to_pylist() for c in ("ka", "da", "kb", "db")), strict=True):
            keep.append(consensus(np.frombuffer(ka, np.float32).reshape(-1, 4), np.frombuffer(da, "<u8").reshape(-1, 4), np.frombuffer(kb, np.float32).reshape(-1, 4), np.frombuffer(db, "<u8").reshape(-1, 4), least) > 0)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def verified(pairs: DataFrame, images: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """``pairs`` (a, b) of images that are copies; features are made once for each image in a pair."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    found = scratch.save(images.join(wanted, "id", "left_semi").select("id", "image").mapInArrow(cornered, CORNERS).dropDuplicates(["id"]))
    one = found.select(F.col("id").alias("a"), F.col("points").alias("ka"), F.col("descriptors").alias("da"))
    two = found.select(F.col("id").alias("b"), F.col("points").alias("kb"), F.col("descriptors").alias("db"))
    out = scratch.save(pairs.join(one, "a").join(two, "b").select("a", "b", "ka", "da", "kb", "db").mapInArrow(lambda it: agreeing(it, least), "a long, b long"))
    scratch.drop(found)
    return out


def copies(images: DataFrame, least: int = CONSENSUS, shared: int = SHARED) -> DataFrame:
    """(id, class_id, n_corners) for each row of ``images`` (id, image)."""
    scratch, parts = Scratch(images.sparkSession, "media"), P.shuffle_parts(images)
    found = scratch.save(images.select("id", "image").mapInArrow(features, FEATURES))
    narrow = found.select("id", "sig", "n")
    classes = scratch.save(narrow.where("sig is not null and id is not null").groupBy("sig").agg(F.min("id").alias("rep")))
    named = scratch.save(narrow.where("n > 0 and id is not null").join(classes, "sig").groupBy("id", "rep").agg(F.max("n").alias("n")))

    def of_classes(pairs: DataFrame) -> DataFrame:
        """Pairs of images as pairs of their classes' smallest ids."""
        a, b = (named.select(F.col("id").alias(x), F.col("rep").alias("r" + x), F.col("n").alias("n" + x)) for x in "ab")
        return pairs.join(a, "a").join(b, "b").where("ra <> rb").where(F.col("k") * CORNERS_A_CODE >= F.least("na", "nb")).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()

    posted = found.where("n > 0 and id is not null").select("id", "sig", "codes").mapInArrow(lambda it: post(it, parts), P.SCHEMA)
    met = scratch.save(P.dealt(posted, parts).mapInArrow(lambda it: meet(it, parts), P.SCHEMA))
    scratch.sweep()
    sharing = scratch.save(P.dealt(met.where("kind = 0"), parts).mapInArrow(gathered, "id long, codes binary"))

    def tallied(posts: DataFrame) -> DataFrame:
        return P.dealt(posts, parts).mapInArrow(lambda it: tally(it, shared), "a long, b long, k long")

    def best(pairs: DataFrame) -> DataFrame:
        """For each image the one of its pairs with a smaller id that shares the most codes."""
        return pairs.groupBy("b").agg(F.max_by("a", F.struct("k", -F.col("a"))).alias("a"), F.max("k").alias("k"))

    def unconnected(links: DataFrame) -> DataFrame:
        """Pairs that share codes enough and are not in one component of ``links``."""
        roots = components(links, scratch).withColumnRenamed("node", "rep")
        rooted = sharing.join(named.drop("n"), "id").join(roots, "rep", "left").select("id", F.coalesce("root", "rep").alias("root"), "codes")
        return tallied(P.dealt(rooted.mapInArrow(lambda it: post_rooted(it, parts), P.SCHEMA), parts).mapInArrow(lambda it: cross(it, parts), P.SCHEMA))

    # each image with its best partner, twice, connects nearly all copies; then, exactly, whatever is not connected
    links = tested = None
    for turn in range(3):
        found_pairs = tallied(met.where("kind = 1")) if turn == 0 else unconnected(links)
        pairs = of_classes(found_pairs if turn == 2 else best(found_pairs))
        pairs = scratch.save(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))  # each pair is verified once
        told = verified(pairs, images, least, scratch)
        links, tested = (told, pairs) if links is None else (links.union(told), tested.union(pairs))
    linked = components(links, scratch)
    rooted = classes.join(linked.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("class_id"))
    told = scratch.save(rooted.join(smallest, "root").select("sig", "class_id"))
    out = scratch.save(narrow)
    scratch.drop(found, met, sharing, named, classes)
    return out.join(told, "sig", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.col("n").alias("n_corners"))


def rendered(vectors: DataFrame) -> DataFrame:
    """(id, image) from (id, vector)."""

    def draw(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, raw = part.column("id").to_pylist(), part.column("vector").to_pylist()
                size = [len(v) if v and all(x is not None for x in v) else 0 for v in raw]
                out: list[bytes | None] = [None] * len(ids)
                for d in sorted(set(size) - {0}):
                    at = [i for i, s in enumerate(size) if s == d]
                    for i, image in zip(at, render(np.array([raw[i] for i in at], np.float32)), strict=True):
                        out[i] = to_pgm(image)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "image"])

    return vectors.mapInArrow(draw, "id long, image binary")


def op7(embeddings: DataFrame) -> DataFrame:
    """Classes of copies among the rendered ``embeddings``."""
    vectors = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = copies(rendered(vectors))
    return out.select(F.col("id").alias("vec_id"), "class_id", "n_corners")
