"""Training-data operators: the thirteen components of a large text pipeline.

Nothing else in the library imports this subpackage.
"""
