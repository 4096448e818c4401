"""Scalar functions: NumPy's ufuncs as Spark expressions."""
