"""Operators for preparing language-model training corpora.

Every operator takes and returns DataFrames and is usable on its own; the
`queries` module holds the thin registered queries and their SQL.
"""
