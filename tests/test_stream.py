"""Images dropped in two batches are each scored exactly once."""

import os

from pyspark.sql import functions as F

from terrascope.operators import raster as RA
from terrascope.plans import segmentation as SEG
from terrascope.sources import images as IM
from terrascope.streaming.segment_stream import start_coverage_stream
from tests.pngs import two_half_image, write_png


def test_stream_scores_each_image_once(spark, tmpdir_run):
    train_dir, inbox = f"{tmpdir_run}/train", f"{tmpdir_run}/inbox"
    os.makedirs(train_dir)
    os.makedirs(inbox)
    img = two_half_image(8, 8)
    write_png(f"{train_dir}/satellite_0001.png", img)
    px = RA.decode_image(IM.read_images(spark, train_dir))
    masks = px.select("image_id", "y", "x", "height", "width",
                      F.when(F.col("g") > F.col("r"), 255).otherwise(0).alias("v"))
    model, _, _ = SEG.train_segmenter(px, masks, size=8, max_samples=64, numTrees=3, maxDepth=4)

    out, ckpt = f"{tmpdir_run}/out", f"{tmpdir_run}/ckpt"
    for i in (1, 2):
        write_png(f"{inbox}/upload_{i:04d}.png", img)
    q = start_coverage_stream(spark, model, inbox, out, ckpt, size=8)
    q.awaitTermination(120)
    for i in (3, 4):
        write_png(f"{inbox}/upload_{i:04d}.png", img)
    q = start_coverage_stream(spark, model, inbox, out, ckpt, size=8)
    q.awaitTermination(120)
    res = spark.read.parquet(out).collect()
    assert sorted(r.file_name for r in res) == [f"upload_{i:04d}.png" for i in (1, 2, 3, 4)]
    assert all(abs(r.forest_percentage + r.deforested_percentage - 100) <= 0.01 for r in res)


def test_replayed_batch_replaces_its_output(spark, tmpdir_run):
    from terrascope.streaming.segment_stream import coverage_sink
    folder = f"{tmpdir_run}/imgs"
    os.makedirs(folder)
    img = two_half_image(8, 8)
    for i in (5, 6):
        write_png(f"{folder}/upload_{i:04d}.png", img)
    batch = IM.read_images(spark, folder)
    px = RA.decode_image(batch)
    masks = px.select("image_id", "y", "x", "height", "width",
                      F.when(F.col("g") > F.col("r"), 255).otherwise(0).alias("v"))
    model, _, _ = SEG.train_segmenter(px, masks, size=8, max_samples=64, numTrees=2, maxDepth=3)
    sink = coverage_sink(model, f"{tmpdir_run}/out", size=8)
    sink(batch, 7)
    sink(batch, 7)           # the same micro-batch again (task / driver retry)
    assert spark.read.parquet(f"{tmpdir_run}/out").count() == 2


def test_any_name_junk_and_default_checkpoint(spark, tmpdir_run):
    """Names without a number, equal numbers, files that are no images; a
    restart without an explicit checkpoint goes on where the stream ended."""
    train_dir, inbox, out = f"{tmpdir_run}/train", f"{tmpdir_run}/inbox", f"{tmpdir_run}/out"
    os.makedirs(train_dir)
    os.makedirs(inbox)
    img = two_half_image(8, 8)
    write_png(f"{train_dir}/satellite_0001.png", img)
    px = RA.decode_image(IM.read_images(spark, train_dir))
    masks = px.select("image_id", "y", "x", "height", "width",
                      F.when(F.col("g") > F.col("r"), 255).otherwise(0).alias("v"))
    model, _, _ = SEG.train_segmenter(px, masks, size=8, max_samples=64, numTrees=2, maxDepth=3)
    for name in ("forest", "a_1", "b_1"):
        write_png(f"{inbox}/{name}.png", img)
    with open(f"{inbox}/junk.png", "wb") as f:
        f.write(b"no image")
    start_coverage_stream(spark, model, inbox, out, size=8).awaitTermination(120)
    write_png(f"{inbox}/late.png", img)
    start_coverage_stream(spark, model, inbox, out, size=8).awaitTermination(120)
    res = {r.file_name: r for r in spark.read.parquet(out).collect()}
    assert sorted(res) == ["a_1.png", "b_1.png", "forest.png", "junk.png", "late.png"]
    assert len({r.image_id for r in res.values()}) == 5
    assert res["junk.png"].error and res["junk.png"].total_pixels is None
    assert all(r.error is None and r.total_pixels == 64 for n, r in res.items() if n != "junk.png")
