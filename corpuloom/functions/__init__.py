"""Column functions and batch kernels."""
