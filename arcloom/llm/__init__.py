"""Training-data operators over document collections.

Each operator is a function of DataFrames; ``queries.py`` registers the thin
``opN_<name>`` queries.  Nothing outside this subpackage imports it.
"""
