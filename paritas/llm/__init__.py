"""Operators for training-data pipelines: mixing, quality rules, quotation
linking, toxicity, personal data, language-model scoring, near copies, exact
vector search, piece encoding and token files.

Nothing else in the library imports this subpackage.
"""
