"""Cleaning, feature engineering, sampling, classifiers, scoring and metrics."""
