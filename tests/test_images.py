"""Image source (S6-S8), decoding (R1), grey masks and segmentation on PNGs
written by the test itself."""

import os

from pyspark.sql import functions as F

from terrascope.operators import raster as RA
from terrascope.plans import segmentation as SEG
from terrascope.sources import images as IM
from tests.pngs import two_half_image, write_png


def _write_set(folder, n=4, size=12):
    os.makedirs(f"{folder}/images", exist_ok=True)
    os.makedirs(f"{folder}/masks", exist_ok=True)
    for i in range(n):
        img = two_half_image(size, size)
        if i % 2:   # mirror every other image so position alone does not decide
            img = [row[::-1] for row in img]
        write_png(f"{folder}/images/satellite_{i:04d}.png", img)
        mask = [[255 if px == (34, 139, 34) else 0 for px in row] for row in img]
        write_png(f"{folder}/masks/mask_{i:04d}.png", mask, grey=True)
    with open(f"{folder}/images/satellite_9999.png", "wb") as f:
        f.write(b"not an image")


def test_decode_colour_and_grey(spark, tmpdir_run):
    write_png(f"{tmpdir_run}/pic_0001.png", [[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (10, 20, 30)]])
    write_png(f"{tmpdir_run}/grey_0002.png", [[0, 128], [255, 7]], grey=True)
    imgs = IM.read_images(spark, tmpdir_run, glob="*.png")
    px = {(r.image_id, r.y, r.x): (r.b, r.g, r.r) for r in RA.decode_image(imgs).collect()}
    assert px[(1, 0, 0)] == (0, 0, 255)          # red stored as BGR
    assert px[(1, 1, 1)] == (30, 20, 10)
    assert px[(2, 0, 1)] == (128, 128, 128)      # one channel -> b = g = r
    assert len(px) == 8
    grey = {(r.image_id, r.y, r.x): r.v for r in RA.decode_grey(imgs).collect()}
    assert grey[(2, 1, 0)] == 255 and grey[(2, 1, 1)] == 7
    assert grey[(1, 0, 0)] == round(0.299 * 255) and grey[(1, 1, 1)] == round(0.114 * 30 + 0.587 * 20 + 0.299 * 10)


def test_invalid_file_dropped_or_flagged(spark, tmpdir_run):
    _write_set(tmpdir_run, n=1)
    kept = IM.read_images(spark, f"{tmpdir_run}/images", drop_invalid=True)
    assert kept.count() == 1
    flagged = IM.read_images(spark, f"{tmpdir_run}/images", drop_invalid=False)
    assert flagged.filter(F.col("image.height") == -1).count() == 1


def test_extension_rule(spark):
    names = ["a.PNG", "b.jpeg", "c.tif", "d.gif", "noext", "x.tar.TIFF", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    out = [r.ok for r in df.select(IM.allowed_file("n").alias("ok")).collect()]
    assert out == [True, True, True, False, False, True, False]


def test_two_half_image_segmentation(spark, tmpdir_run):
    _write_set(tmpdir_run, n=4)
    images = RA.decode_image(IM.read_images(spark, f"{tmpdir_run}/images", glob="*.png"))
    masks = RA.decode_grey(IM.read_images(spark, f"{tmpdir_run}/masks"))
    model, report, _ = SEG.train_segmenter(images, masks, size=8, max_samples=64, numTrees=5, maxDepth=5)
    acc = {r["class"]: r.f1_score for r in report.collect()}["accuracy"]
    assert acc > 0.95
    out = SEG.segment(model, images, size=8)
    cov = out["coverage"].collect()
    assert len(cov) == 4
    for r in cov:
        assert abs(r.forest_percentage - 50.0) <= 10.0
        assert abs(r.forest_percentage + r.deforested_percentage - 100.0) <= 0.01
        assert r.total_pixels == 144
    assert out["overlay"].count() == 4 * 144


def test_decoders_give_every_byte(spark, tmpdir_run):
    _write_set(tmpdir_run, n=3, size=9)
    write_png(f"{tmpdir_run}/images/grey_0007.png", [[0, 128, 3], [255, 7, 9]], grey=True)
    imgs = IM.read_images(spark, f"{tmpdir_run}/images", glob="*.png")
    want, luma = set(), set()
    for r in imgs.collect():
        im = r.image
        for i in range(im.height * im.width):
            at = im.data[i * im.nChannels:(i + 1) * im.nChannels]
            b, g, red = (at[0], at[1], at[2]) if im.nChannels >= 3 else (at[0],) * 3
            place = (r.image_id, i // im.width, i % im.width, im.height, im.width)
            want.add((*place, b, g, red))
            luma.add((*place, int(0.114 * b + 0.587 * g + 0.299 * red + 0.5)))
    assert len(want) == 3 * 81 + 6
    assert {tuple(r) for r in RA.decode_image(imgs).collect()} == want
    assert {tuple(r) for r in RA.decode_grey(imgs).collect()} == luma


def test_unpaired_masks_are_an_error(spark, tmpdir_run):
    import pytest
    _write_set(tmpdir_run, n=2, size=6)
    os.remove(f"{tmpdir_run}/masks/mask_0001.png")
    images = RA.decode_image(IM.read_images(spark, f"{tmpdir_run}/images", glob="*.png"))
    masks = RA.decode_grey(IM.read_images(spark, f"{tmpdir_run}/masks"))
    with pytest.raises(ValueError, match="1 has no mask"):
        SEG.train_segmenter(images, masks, size=4, numTrees=2, maxDepth=2)


def test_noisy_two_half_image(spark, tmpdir_run):
    """The two-half test image with uniform noise -15..14 (seeded)."""
    import numpy as np
    rng = np.random.default_rng(7)
    os.makedirs(f"{tmpdir_run}/images")
    os.makedirs(f"{tmpdir_run}/masks")
    for i in range(3):
        base = np.array(two_half_image(24, 24), dtype=int)
        if i % 2:
            base = base[:, ::-1]
        noisy = np.clip(base + rng.integers(-15, 15, base.shape), 0, 255)
        write_png(f"{tmpdir_run}/images/satellite_{i:04d}.png", [[tuple(int(c) for c in px) for px in row] for row in noisy])
        mask = [[255 if tuple(px) == (34, 139, 34) else 0 for px in row] for row in base.tolist()]
        write_png(f"{tmpdir_run}/masks/mask_{i:04d}.png", mask, grey=True)
    images = RA.decode_image(IM.read_images(spark, f"{tmpdir_run}/images"))
    masks = RA.decode_grey(IM.read_images(spark, f"{tmpdir_run}/masks"))
    model, report, _ = SEG.train_segmenter(images, masks, size=12, numTrees=10, maxDepth=6)
    for r in SEG.segment(model, images, size=12)["coverage"].collect():
        assert abs(r.forest_percentage - 50.0) <= 10.0


def test_listing_without_decoding(spark, tmpdir_run):
    _write_set(tmpdir_run, n=2, size=5)
    ids = sorted(r.image_id for r in IM.list_images(spark, f"{tmpdir_run}/images", glob="satellite_*").collect())
    assert ids == [0, 1, 9999]
    plan = IM.list_images(spark, f"{tmpdir_run}/images")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_tiff_decodes_like_png(spark, tmpdir_run):
    from tests.pngs import write_tiff
    img = [[((x * 37) % 256, (y * 53) % 256, (x + y) % 256) for x in range(7)] for y in range(5)]
    write_png(f"{tmpdir_run}/pic_0001.png", img)
    write_tiff(f"{tmpdir_run}/pic_0002.tif", img)
    px = RA.decode_image(IM.read_images(spark, tmpdir_run, glob="*.{png,tif}"))
    a = sorted((r.y, r.x, r.b, r.g, r.r) for r in px.filter("image_id = 1").collect())
    b = sorted((r.y, r.x, r.b, r.g, r.r) for r in px.filter("image_id = 2").collect())
    assert len(a) == 35 and a == b
    assert a[0] == (0, 0, 0, 0, 0) and (1, 2, 3, 53, 74) in a      # BGR of RGB (74, 53, 3)


def test_training_samples_of_a_large_table_are_the_first_in_hash_order(spark, monkeypatch):
    from terrascope.operators.sampling import sample_rows
    px = spark.range(300).select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p")).select(
        "image_id", F.expr("cast(p div 4 AS int)").alias("y"), F.expr("cast(p % 4 AS int)").alias("x"), F.lit(4).alias("height"),
        F.lit(4).alias("width"), *[F.expr(f"cast(pmod(xxhash64(image_id, p, {j}), 256) AS int)").alias(c) for j, c in enumerate("bgr")])
    masks = px.select("image_id", "y", "x", "height", "width", F.col("g").alias("v"))
    written, keep = [], SEG.materialize
    monkeypatch.setattr(SEG, "materialize", lambda df, name: written.append((name, keep(df, name))) or written[-1][1])
    for some, k in ((masks, 500), (masks, 10), (masks.where("image_id % 40 = 0"), 500)):
        written.clear()
        got = SEG.bounded_samples(px, some, 8, k, 40, 42)
        want = sample_rows(SEG.training_pixels(px, some, 8, k, 42), 40, 42)
        assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 40 and got.columns == want.columns
        assert all(t.count() <= 400 for name, t in written if name == "segmenter_samples")
    # fewer samples than wanted: all of them
    few = SEG.bounded_samples(px, masks.where("image_id = 7"), 8, 30, 40, 42)
    assert few.count() == 30
