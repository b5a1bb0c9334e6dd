"""Operators of training-data pipelines: deduplication, scans, filters, classifiers, mixing, decontamination."""
