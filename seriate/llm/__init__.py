"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage.  Each operator module
holds a general interface and documents its defined result for nulls, empty
and very long texts, ties, repeated rows and empty tables;
:mod:`seriate.llm.queries` holds the registered ``opN_`` queries.
"""
