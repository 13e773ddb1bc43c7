"""Schemas of the tables."""

from pyspark.sql import types as T

NOTE_TYPES = ("fleeting", "literature", "permanent")

NOTES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("created", T.TimestampNTZType()),
        T.StructField("updated", T.TimestampNTZType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("backlinks", T.ArrayType(T.StringType())),
        T.StructField("source", T.StringType()),
        T.StructField("filepath", T.StringType()),
    ]
)

IMPORT = T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])

COMMITS = T.StructType([T.StructField(c, T.StringType()) for c in ("hash", "subject", "author", "date", "body")])
