"""Tensor operators over coordinate tables and block tables."""
