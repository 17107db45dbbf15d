"""Column expressions and the Arrow kernels they cannot express."""
