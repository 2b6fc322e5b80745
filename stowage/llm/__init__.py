"""Operations of a training-data pipeline, expressed as Spark jobs.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is present.
"""
