"""DataFrame-to-DataFrame operators.  Each states its null, tie and failure rules in its docstring."""
