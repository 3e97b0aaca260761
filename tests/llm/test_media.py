import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import media


def placed(image, scale, turn, side):
    """``image`` scaled and turned about its middle, cut to ``side`` pixels; bilinear."""
    h, w = image.shape
    y, x = np.mgrid[:side, :side] - (side - 1) / 2
    iy = np.clip((np.cos(turn) * y + np.sin(turn) * x) / scale + (h - 1) / 2, 0, h - 1.001)
    ix = np.clip((-np.sin(turn) * y + np.cos(turn) * x) / scale + (w - 1) / 2, 0, w - 1.001)
    y0, x0, f = iy.astype(int), ix.astype(int), image.astype(float)
    fy, fx = iy - y0, ix - x0
    return np.rint((f[y0, x0] * (1 - fx) + f[y0, x0 + 1] * fx) * (1 - fy) + (f[y0 + 1, x0] * (1 - fx) + f[y0 + 1, x0 + 1] * fx) * fy).clip(0, 255).astype(np.uint8)


def noisy(image, sigma):
    return np.clip(image + np.random.default_rng(int(image[0, 0])).normal(0, sigma, image.shape), 0, 255).astype(np.uint8)


#: Edits and the share of copies that must be found.
EDITS = {
    "three quarters": lambda x: x[6:89, 8:91], "half": lambda x: x[10:78, 20:88], "quarter": lambda x: x[20:68, 30:78], "turned 90": np.rot90, "turned 10": lambda x: placed(x, 1, np.pi / 18, 80), "turned 37": lambda x: placed(x, 1, 0.65, 68),
    "scaled 1.2": lambda x: placed(x, 1.2, 0, 115), "scaled 0.9": lambda x: placed(x, 0.9, 0, 86), "scaled 0.75": lambda x: placed(x, 0.75, 0, 72), "noise 4": lambda x: noisy(x, 4), "noise 10": lambda x: noisy(x, 10), "16 steps": lambda x: x // 16 * 16, "8 steps": lambda x: x // 32 * 32, "paler": lambda x: (x * 0.8 + 20).astype(np.uint8),
}


def image_rows(spark, images):
    return spark.createDataFrame([(i, bytearray(media.to_pgm(np.ascontiguousarray(x)))) for i, x in enumerate(images)], "id long, image binary")


def test_recall_of_edits(spark):
    """Each edit of 30 textures is found in nine of ten cases or more, and nothing else is linked."""
    plain = media.render(np.random.default_rng(12).normal(size=(30, 64)))
    images = [*plain, *[f(x) for f in EDITS.values() for x in plain]]
    got = {r["id"]: r["class_id"] for r in media.copies(image_rows(spark, images)).collect()}
    assert all(c % 30 == i % 30 for i, c in got.items())
    recall = {name: np.mean([got[30 * (e + 1) + i] == got[i] for i in range(30)]) for e, name in enumerate(EDITS)}
    print(recall)
    assert min(recall.values()) >= 0.9


def test_copies(spark):
    rng = np.random.default_rng(5)
    plain = media.render(rng.normal(size=(12, 64)))
    rows = [(i, media.to_pgm(x)) for i, x in enumerate(plain)]
    rows += [(100, rows[0][1]), (101, media.to_pgm(np.ascontiguousarray(plain[1][8:90, 6:94])))]
    rows += [(200, None), (201, b""), (202, b"not an image"), (203, media.to_pgm(np.zeros((96, 96), np.uint8))), (204, media.to_pgm(np.zeros((3, 3), np.uint8))), (0, rows[0][1]), (None, rows[5][1]), (None, b"alone")]
    got = {}
    for r in media.copies(spark.createDataFrame([(bytearray(b) if b is not None else None, i) for i, b in rows], "image binary, id long").withColumn("sig", F.lit("clash")).withColumn("n", F.lit(1))).collect():
        got.setdefault(r["id"], set()).add(r["class_id"])
    want = {i: {i} for i in [*range(12), 200, 201, 202, 203, 204]} | {100: {0}, 101: {1}, None: {5, None}}
    assert got == want


def test_large_image_and_its_part(spark):
    rng = np.random.default_rng(9)
    wide = media.blurred(rng.normal(size=(1, 300, 500)).astype(np.float32), media.gaussian(1.0))[0]
    wide = np.clip(128 + 40 * wide / wide.std(), 0, 255).astype(np.uint8)
    got = {r["id"]: r for r in media.copies(image_rows(spark, [wide, wide[90:190, 220:340], wide[:, ::-1]])).collect()}
    assert [got[i]["class_id"] for i in range(3)] == [0, 0, 2] and got[0]["n_corners"] > 8 * got[1]["n_corners"]


def test_many_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=64)
    rows = [(i, [float(x) for x in (v if i % 2 else v + rng.normal(0, 0.002, 64))]) for i in range(60)]
    rows += [(60, [float(x) for x in rng.normal(size=64)]), (61, None), (62, []), (63, [1.0])]
    got = {r["vec_id"]: r["class_id"] for r in media.op7(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert all(got[i] == 0 for i in range(60)) and [got[i] for i in (60, 61, 62, 63)] == [60, 61, 62, 63]
    assert media.op7(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("sigma", [6, 12])
def test_links_are_those_of_brute_force(spark, sigma):
    """Of the pairs that share codes enough, all that brute force links are found, and no other."""
    plain = media.render(np.random.default_rng(8).normal(size=(40, 64)))
    images, pattern = [*plain, *[noisy(x, sigma) for x in plain]], media.tests()
    found = [media.described([media.to_pgm(x)], pattern)[0] for x in images]
    codes = [media.codes_of(d) for _, d in found]
    linked = {(i, j) for i in range(80) for j in range(i) if media.consensus(*found[j], *found[i], media.CONSENSUS)}
    shared = {(i, j) for i, j in linked if len(np.intersect1d(codes[i], codes[j])) >= media.SHARED}
    assert len(shared) >= 0.9 * len(linked)
    got = {r["id"]: r["class_id"] for r in media.copies(image_rows(spark, images)).collect()}
    assert {(i, j) for i in range(80) for j in range(i) if got[i] == got[j]} == shared
