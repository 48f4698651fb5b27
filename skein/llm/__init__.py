"""Operators for preparing language-model training data.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when it is present.  One module per operator, the registered queries and their
DuckDB SQL in ``queries``.
"""
