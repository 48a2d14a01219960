"""Operators for building training corpora: dedup, tokenising, packing, filtering, search.

Nothing outside this subpackage imports it. ``queries`` and ``oracles`` hand its
driver queries to ``__spark_entry__``.
"""
