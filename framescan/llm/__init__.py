"""Operators of a training-data pipeline: cleaning, de-duplication, scoring,
mixing, sharding and packing of documents.

Every operator takes and returns DataFrames.  Nothing outside this subpackage
imports it.
"""
