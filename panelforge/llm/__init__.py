"""Operators that prepare text corpora for model training.

Nothing else in the package imports this subpackage. Each module holds one
operator with its own general interface; :mod:`panelforge.llm.queries` applies
them to the driver's tables.
"""
