"""Operators of a training-data pipeline over text documents.

Nothing else in the package imports this one. Each operator module takes
DataFrames, returns DataFrames, and states its results for nulls, empty
texts, ties, repeated rows and empty tables in its docstring. Operators read
only the columns they are told to, so extra columns with any name pass by.
"""
