"""Operators for preparing language-model training corpora.

Each module holds one operator with a general DataFrame interface; ``queries``
holds the thin per-table queries and ``oracles`` their SQL counterparts.
Nothing outside this subpackage imports it.
"""
