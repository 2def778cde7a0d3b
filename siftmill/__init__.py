"""siftmill: collection curation on Spark.

functions/  column expressions (no jobs, no state)
operators/  DataFrame -> DataFrame operators
sources/    readers and writers
plans/      cascades and the storage helpers that plans need
streaming/  incremental catalog ingest
llm/        training-data operators; nothing outside it imports it
"""
