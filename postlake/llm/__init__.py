"""Operations of a training-data pipeline over large text and vector corpora.

Nothing outside this subpackage imports it; ``queries`` holds its registered queries.
"""
