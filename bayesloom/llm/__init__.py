"""Training-data operators: token counts, chat formatting, de-duplication, scoring,
search, packing, extraction, mixing and personal-data spans.

Nothing outside this subpackage imports it.
"""
