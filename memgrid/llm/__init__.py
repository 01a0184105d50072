"""Operations of a training-data pipeline: tokenising, filtering, deduplicating and scoring text.

Nothing else in the library imports this package; it can be removed as a whole.
"""
