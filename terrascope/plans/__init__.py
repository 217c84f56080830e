"""Composite plans: feature pipeline, model training, reports, segmentation."""
