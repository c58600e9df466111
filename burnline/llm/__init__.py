"""Operators of a training-data pipeline: dedup, quality, language, tokens, HTML, chat.

Nothing outside this subpackage imports it. ``queries.QUERIES`` holds one
registered query per operator, ``queries.SQL`` the DuckDB text of those that
SQL can express.
"""
