"""Operators that prepare training data: deduplication, packing, scans, mixing, scoring.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is here.
"""
