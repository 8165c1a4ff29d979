"""Readers and writers: flow CSVs, result documents, fitted detectors."""
