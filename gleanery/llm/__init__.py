"""Operators for preparing large text and entity collections.

Nothing outside this subpackage imports it; see ``queries.py`` for the
registered queries and ``README.md`` for the method behind each operator.
"""
