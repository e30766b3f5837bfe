"""Combinatorial kernels on small graphs in memory; Spark runs one for each independent group (`applyInPandas`)."""
