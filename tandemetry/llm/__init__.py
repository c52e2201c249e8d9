"""Operators that prepare training data for language models.

One module an operator; ``queries`` binds them to the synthetic tables.  Nothing
else in the library imports this subpackage.
"""
