"""stowage: planning, indexing, verifying and performing object-archive jobs on Spark.

A bucket listing is a DataFrame of objects; selecting, merging, ordering,
splitting and laying out an archive are lazy queries over it, and tar files are
read and written in parallel by Spark data sources.
"""
