"""Operators for preparing language-model training corpora.

Nothing outside this package imports it.  Each module holds one operator with
a general interface; :mod:`veilspark.llm.entries` holds the thin ``opN_*``
queries and their SQL.
"""
