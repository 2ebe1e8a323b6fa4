"""Schemas of the knowledge store, the run history and the stage messages. Names and types are fixed values, as stored data have them."""

from pyspark.sql import types as T

SOURCES = ("enwiki", "frwiki")

#: Store of chunks; unique by (pid, source, chunk_index), kept so by the upsert. chunk_count lets a half-stored article be told.
CHUNKS = T.StructType([
    T.StructField("pid", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_count", T.IntegerType()),
    T.StructField("content", T.StringType()), T.StructField("source", T.StringType()), T.StructField("last_modified_date", T.TimestampType()), T.StructField("embedding", T.ArrayType(T.FloatType(), True)),
])

HISTORY = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("run_id", T.IntegerType()), T.StructField("service_name", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("metadata", T.StringType()), T.StructField("timestamp", T.TimestampNTZType()),
])

RAW_MESSAGE = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("content", T.StringType()), T.StructField("last_modified_date", T.TimestampType()), T.StructField("pid", T.IntegerType()),
    T.StructField("source", T.StringType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_count", T.IntegerType()),
    T.StructField("is_namespace_0", T.BooleanType()), T.StructField("is_redirect", T.BooleanType()), T.StructField("has_wikilinks", T.BooleanType()),
])

ENCODED_VECTOR = T.StructType([T.StructField("kind", T.StringType()), T.StructField("dtype", T.StringType()), T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data_b64", T.StringType())])
PROCESSED_MESSAGE = T.StructType([*RAW_MESSAGE.fields, T.StructField("embeddings", ENCODED_VECTOR)])

#: Statuses of run_history rows (fixed values).
RUN_STARTED = "Run Started"
INGESTION_STARTED = "Ingestion Started"
INGESTION_COMPLETED = "Ingestion Completed"
PROCESSING_STARTED = "Processing Started"
PROCESSING_COMPLETED = "Processing Completed"
STORING_STARTED = "Storing Started"
STORING_COMPLETED = "Storing Completed"
RUN_ENDED = "Run Completed"
DUMP_LINK_UPDATED = "New Dump Link Detected and Downloaded"
BATCH_AVERAGE_TIME = "Processing Batch Average Time"
RUN_STOPPED = "Run Manually Stopped"
RUN_CONTINUED = "Run Continued"
