"""Operations of large training-data pipelines.

Self-contained: nothing else in the library imports this subpackage, and the
subpackage imports nothing from the rest of the library.
"""
