"""Bindings of the operators to the given tables, and whole plans made of them."""
