"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``registry.queries()`` and
``registry.oracle_sql()`` list what the driver's contract file adds.
"""
