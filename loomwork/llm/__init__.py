"""Operators for preparing training text: language, quality, toxicity, personal
data, duplicates, contamination, mixing, page extraction, media and chat format.

Nothing outside this subpackage imports it.
"""
