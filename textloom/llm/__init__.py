"""Operators of a large-scale training-data pipeline; nothing else in textloom imports this subpackage."""
