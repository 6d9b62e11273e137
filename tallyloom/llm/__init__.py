"""Training-data operators: deduplication, tokenisation, packing, mixing, scoring and filtering of text.

Each operator module has a general function that works on any DataFrame; ``queries`` has the thin
``opN_<name>`` queries over the standard tables.  Nothing outside this subpackage imports it.
"""
