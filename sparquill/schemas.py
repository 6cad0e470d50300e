"""Explicit schemas of the records that cross stage and file boundaries."""

from pyspark.sql import types as T

CHUNK = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("year_range", T.StringType()),
        T.StructField("chunk_id", T.IntegerType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("token_count", T.IntegerType()),
        T.StructField("section", T.StringType()),
    ]
)
CHUNK_COLUMNS = CHUNK.fieldNames()

PAGE_ARRAY = "array<struct<number:int,body:string>>"

# A stored collection: scalar metadata only, so that every field can be filtered on.
COLLECTION_CORE = ["id", "embedding", "document"]
SCALAR_TYPES = (
    T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType,
)
