"""Analyses assembled from the operators."""
