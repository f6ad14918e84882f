"""Column functions; those that need a sequence of steps are Arrow-batched."""
