"""Scalar semantics of the task store as Spark columns."""
