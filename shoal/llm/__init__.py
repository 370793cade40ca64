"""Operations of a large training-data pipeline, one module each.

Nothing outside this subpackage imports it; ``queries.py`` lists its registered queries.
"""
