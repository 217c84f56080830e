"""terrascope: environmental analytics as Spark DataFrame operators.

Two families of operators:

* climate time series: cleaning, calendar / lag / moving-average features,
  annual, decade, seasonal and per-country trends, regression models and
  forecasts (``terrascope.operators.*``, ``terrascope.plans.climate_*``);
* raster segmentation: image decoding into pixel tables, resampling, focal
  (neighbourhood) operators, pixel classification and coverage reports
  (``terrascope.operators.raster``, ``terrascope.plans.segmentation``).

Every operator is a plain function ``DataFrame -> DataFrame`` built from the
DataFrame API, so Catalyst plans, prunes and pushes down as usual.
"""

__version__ = "0.1.0"
