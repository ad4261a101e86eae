"""Column-level helpers: NULL rules, labels and probability functions."""
