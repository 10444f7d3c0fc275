"""Operators of a training-data pipeline over tables of documents and pages.

Every operator takes a DataFrame and names of its columns and returns a
DataFrame; ``queries`` binds them to the provided tables.
"""
