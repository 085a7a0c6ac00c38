"""Training-data operators: search, joins, scoring, packing and archive formats.

Nothing outside this subpackage imports it.
"""
