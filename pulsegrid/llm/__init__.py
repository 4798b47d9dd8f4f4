"""Operators that prepare text corpora for training.

One module per operator; ``queries`` holds the thin registered queries and
``oracles`` their SQL.  Nothing outside this subpackage imports it.
"""
