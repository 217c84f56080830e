"""Batch jobs: the original's runnable entry points as Spark jobs.

* ``climate_job``        CSVs -> cleaned tables, features, models, predictions,
                         metrics, model info (process + train steps)
* ``climate_reports``    stored predictions + model -> report DataFrames
* ``segmenter_job``      image / mask folders -> model, classification report
* ``scoring_job``        model + image folder -> coverage, mask and overlay
                         pixel tables per image

Every output is written under ``out_dir`` (a shared folder on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascope.functions.calendar import decade
from terrascope.operators import raster as RA
from terrascope.operators.clean import clean
from terrascope.operators.series import TARGET
from terrascope.plans import climate_model as M
from terrascope.plans import reports as R
from terrascope.plans import segmentation as SEG
from terrascope.plans.climate_features import build_features
from terrascope.session import materialize, scaled_conf
from terrascope.sources import climate_csv as CSV
from terrascope.sources import images as IM
from terrascope.sources import sinks as K


def _path(out_dir: str, *parts: str) -> str:
    return "/".join([out_dir.rstrip("/"), *parts])


def _sized(spark: SparkSession, paths, on: bool):
    """Shuffle partitions / splits sized to the inputs while a job runs (only
    keys the user has not set; see ``session.scaled_conf``)."""
    existing = [p for p in paths if on and p and CSV.read_optional(spark, p, fmt="binaryFile") is not None]
    return scaled_conf(spark, existing)


def climate_job(spark: SparkSession, global_csv: str, out_dir: str, country_csv: str | None = None,
                city_csv: str | None = None, from_year: int = 1900, params: dict | None = None,
                cv_folds: int = 5, size_shuffles: bool = True) -> dict:
    """Process + train: cleaned tables (country / city partitioned by decade),
    full feature table, every model, predictions of the best one, metrics
    table and model info.  Missing optional inputs are skipped."""
    with _sized(spark, [global_csv, country_csv, city_csv], size_shuffles):
        written = {}
        for name, path, value in (("country", country_csv, "AverageTemperature"),
                                  ("city", city_csv, "AverageTemperature")):
            if not path:
                continue
            raw = CSV.read_optional(spark, path, fmt="csv", header=True)
            if raw is None:
                continue
            reread = CSV.read_country(spark, path) if name == "country" else CSV.read_city(spark, path)
            table = clean(reread, value, from_year).withColumn("Decade", decade("Year"))
            K.write_table(table, _path(out_dir, "processed", name), partition_by=["Decade"])
            written[name] = _path(out_dir, "processed", name)

        glob = CSV.read_global(spark, global_csv)
        K.write_table(clean(glob, TARGET, from_year), _path(out_dir, "processed", "global"))
        features = build_features(glob, from_year=from_year).cache()
        K.write_table(features, _path(out_dir, "training", "full_features"))

        models, metrics, best = M.train_and_select(features, params=params, cv_folds=cv_folds)
        for kind, model in models.items():
            M.save_model(model, _path(out_dir, "models", kind))
        M.save_model(models[best], _path(out_dir, "models", "best"))
        pred = M.predictions_dataset(models[best], features)
        K.write_table(pred, _path(out_dir, "predictions"))
        K.write_metrics(metrics, _path(out_dir, "metrics"))
        split = M.time_split(features).groupBy("is_train").count().collect()
        n = {r.is_train: r["count"] for r in split}
        K.write_model_info(K.model_info(metrics, best, n.get(True, 0), n.get(False, 0)), _path(out_dir, "model_info"))
        features.unpersist()
        written.update(global_=_path(out_dir, "processed", "global"), features=_path(out_dir, "training", "full_features"),
                       predictions=_path(out_dir, "predictions"), metrics=_path(out_dir, "metrics"),
                       model=_path(out_dir, "models", "best"), best=best)
        return written


def climate_reports(spark: SparkSession, out_dir: str, years: int = 5) -> dict[str, DataFrame]:
    """Reports from the stored predictions and best model (S4 + K6 load)."""
    pred = CSV.read_predictions(spark, _path(out_dir, "predictions")).cache()
    model = M.load_model(_path(out_dir, "models", "best"))
    fc = M.forecast(model, pred, years)
    out = dict(R.global_trends(pred))
    out.update(seasonal=R.seasonal(pred), forecast=fc, summary=R.climate_summary(pred, fc))
    country = _path(out_dir, "processed", "country")
    stored = CSV.read_optional(spark, country)
    if stored is not None:
        out.update(R.country_analysis(stored))
    return out


def segmenter_job(spark: SparkSession, images_dir: str, masks_dir: str, out_dir: str, size: int = 128,
                  max_samples: int = 500, glob: str | None = None, size_shuffles: bool = True, **rf_params) -> dict:
    """Train the pixel classifier on paired images and masks; save the model
    and the classification report."""
    with _sized(spark, [images_dir, masks_dir], size_shuffles):
        # pair check on the file listings (no decoding), then train without repeating it
        SEG.require_pairs(IM.list_images(spark, images_dir, glob), IM.list_images(spark, masks_dir, glob))
        images = RA.decode_image(IM.read_images(spark, images_dir, glob=glob))
        masks = RA.decode_grey(IM.read_images(spark, masks_dir, glob=glob))
        model, report, _ = SEG.train_segmenter(images, masks, size=size, max_samples=max_samples, strict=False,
                                               **rf_params)
        model.write().overwrite().save(_path(out_dir, "segmenter"))
        report.coalesce(1).write.mode("overwrite").option("header", True).csv(_path(out_dir, "segmenter_report"))
        return {"model": _path(out_dir, "segmenter"), "report": _path(out_dir, "segmenter_report")}


def scoring_job(spark: SparkSession, model_path: str, images_dir: str, out_dir: str, size: int = 128,
                glob: str | None = None, size_shuffles: bool = True) -> dict:
    """Segment every image in a folder: coverage table plus mask and overlay
    pixel tables (K7).  Images may have any name: ``image_id`` is the hash of the
    path, which the coverage table carries with the file name.  A file that cannot
    be decoded gets a coverage row with an ``error``.  Files are decoded once and
    the model runs once; all outputs read those two tables."""
    with _sized(spark, [images_dir], size_shuffles):
        from pyspark.ml import PipelineModel
        model = PipelineModel.load(model_path)
        files = materialize(IM.read_images(spark, images_dir, glob=glob, drop_invalid=False, key="path"), "decoded_images")
        out = SEG.segment(model, RA.decode_image(files), size, keep_grid=True)
        K.write_table(SEG.with_errors(files, out["coverage"]), _path(out_dir, "coverage"))
        K.write_pixels(out["mask"].select("image_id", "y", "x", "label", "mb", "mg", "mr"), _path(out_dir, "mask"))
        K.write_pixels(out["overlay"].select("image_id", "y", "x", "ob", "og", F.col("or")), _path(out_dir, "overlay"))
        return {"coverage": _path(out_dir, "coverage"), "mask": _path(out_dir, "mask"), "overlay": _path(out_dir, "overlay")}
