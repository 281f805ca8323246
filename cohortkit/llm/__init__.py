"""Training-data operators: scans, classifiers, extraction, deduplication, mixing.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` holds the thin queries
and their SQL.
"""
