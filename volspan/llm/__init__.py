"""Operations of a large training-data pipeline, as Spark jobs.

Nothing else in the library imports this subpackage.
"""
