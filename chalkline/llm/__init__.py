"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; the thin ``opN_*`` queries live in :mod:`chalkline.llm.queries`.
"""
