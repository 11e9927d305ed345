"""Operators that prepare training text: deduplication, mixing, packing, scoring, token counts and search.

Nothing outside this folder imports it. Each module holds one operator with its own general interface;
``queries`` registers the thin ``opN_<name>`` queries over the driver's tables.
"""
