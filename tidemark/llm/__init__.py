"""Operators for large-scale training-data preparation (self-contained subpackage)."""
