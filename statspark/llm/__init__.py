"""Corpus preparation operators: screening, deduplication, scoring and packing of text.

Nothing outside this subpackage imports it. Every module holds one operator
with a general interface; ``queries`` binds them to the test tables.
"""
