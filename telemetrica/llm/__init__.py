"""Operations of a training-data pipeline: search, tokens, duplicates, quality, packing.

Nothing outside this subpackage imports it.
"""
