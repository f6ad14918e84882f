"""Strict readers and deterministic writers."""
