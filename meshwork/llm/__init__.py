"""Operators for training-data pipelines over text, URLs and vectors. Nothing else in the package imports this one."""
