"""Deterministic panel analytics as composable Spark DataFrame operators."""
