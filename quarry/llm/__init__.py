"""Operators of a training-data pipeline (packing, joins, dedup, tokenising, scoring).

Nothing else in the library imports this subpackage. ``queries.py`` registers
one query per operator; ``corpus_pipeline.py`` at the repository top chains
four of them.
"""
