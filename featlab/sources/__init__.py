"""Matrices, hyperparameter sheets and result tables."""
