"""Corpus preparation for language-model training.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns DataFrames; ``queries`` binds them to table folders, ``oracles`` has their SQL.
"""
