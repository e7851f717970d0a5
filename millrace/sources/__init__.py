"""Readers of tables and of JSON and configuration columns."""
