"""Training-data operators: deduplication, joins, scans, packing, scoring, counting.

Every operator takes a DataFrame of documents and returns a DataFrame; nothing
outside this subpackage imports it.
"""
