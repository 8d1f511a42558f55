"""Scalar library: every function maps Columns to a Column."""
