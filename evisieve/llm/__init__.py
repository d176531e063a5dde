"""Training-data operators: scans, classifiers, sharding, tokenisation, deduplication and archives.

Nothing outside this subpackage imports it; `queries.py` holds the registered queries and their SQL.
"""
