"""Scalar functions as Column expressions; all stay inside code generation."""
