"""Operators of a training-data pipeline: token counts, packing, chat rendering, near-duplicates,
quality and toxicity scores, decontamination, secrets, language-model scores and quality rules.

Nothing else in the library imports this subpackage. ``catalog`` registers the queries.
"""
