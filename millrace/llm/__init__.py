"""Operators for preparing text and records for language models. Nothing outside this package imports it."""
