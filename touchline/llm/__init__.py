"""Operators for preparing training corpora: search, near duplicates, classifiers, tokenizers, mixing and secret scans.

Nothing outside this subpackage imports it. Each module is one operator; ``queries`` applies each of them to whole tables.
"""
