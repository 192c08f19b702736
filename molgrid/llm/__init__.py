"""Training-data operators: one module per operator, `registry` binds them to the tables.

Nothing outside this subpackage imports it.
"""
