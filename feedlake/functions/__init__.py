"""Scalar functions F1-F21 as built-in Column expressions (``text``)."""
