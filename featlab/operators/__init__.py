"""Scores, graphs, selectors, splits, classifiers and metrics over DataFrames."""
