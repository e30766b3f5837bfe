"""Queries over the driver's tables, and the logical plans they share."""
