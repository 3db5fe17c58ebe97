"""Operators of a large-scale training-data pipeline (text corpora).

Nothing else in the library imports this subpackage; its queries are
registered in :mod:`moodgrid.llm.queries`.
"""
