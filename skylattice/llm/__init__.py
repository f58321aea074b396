"""Training-data operators: privacy, deduplication, filtering, packing and archive formats.

Nothing outside this subpackage imports it; ``registry`` holds the queries.
"""
