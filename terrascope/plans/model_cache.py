"""Trained-model cache for the registered queries.

The original application trains once, stores the model and lets every
scoring / report request load it (a process-wide model cache).  Registered
queries do the same: a model is trained once per SparkContext and input
folder and reused by later queries; training itself is measured by the
training keys (``pixel_classifier``, ``metrics_table`` ...).
"""

from __future__ import annotations

from collections.abc import Callable

_MODELS: dict[tuple, object] = {}


def cached_model(spark, sf_dir: str, name: str, build: Callable[[], object]):
    """The model ``name`` for this context and folder, built once by ``build``;
    rewritten tables (other sizes or times in the folder's listing) build anew."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    state = tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in listed))
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), state, name)
    if key not in _MODELS:
        _MODELS[key] = build()
    return _MODELS[key]


def clear() -> None:
    """Forget every model (after a folder was rewritten, or to time a fit)."""
    _MODELS.clear()
