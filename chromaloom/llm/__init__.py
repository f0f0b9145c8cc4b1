"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage; deleting it leaves the
rest of the library whole.  Every operator takes and returns DataFrames, selects
the columns it needs by name (so extra columns never clash) and has a thin
``opN_*`` query in :mod:`chromaloom.llm.queries`.
"""
