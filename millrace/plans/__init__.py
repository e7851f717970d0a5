"""Queries built from the operators, by topic, each with its SQL where SQL can express it."""
