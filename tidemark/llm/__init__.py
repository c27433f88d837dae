"""Training-data operators: token stores, search, joins, packing, language
identification, line and document deduplication, token counts and formatting.

Nothing outside this subpackage imports it.
"""
