"""Operators of a training-data pipeline. Nothing outside this subpackage imports it, except the entry module's guard."""
