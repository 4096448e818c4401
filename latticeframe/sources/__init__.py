"""Constructors: tensors from arrays, tables, formulas and stored files."""
