"""Operators for training-data pipelines (text scoring, encoding, packing,
near-duplicate joins, decontamination, filters).  Nothing else in the package
imports this subpackage."""
