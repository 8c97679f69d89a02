"""Operations of a training-data pipeline, each an operator on DataFrames.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and ``sql`` what SQL can express of them.
"""
