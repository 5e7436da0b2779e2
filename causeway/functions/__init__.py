"""Column helpers over bit sets and kernels for single graphs."""
