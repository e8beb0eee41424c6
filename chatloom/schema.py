"""Schemas shared by sources, operators and sinks."""

from pyspark.sql import types as T

ENTITY = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

RAW_MESSAGE = T.StructType(
    [
        T.StructField("from", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("text_entities", T.ArrayType(ENTITY)),
        T.StructField("sticker_emoji", T.StringType()),
    ]
)

RAW_CHAT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("messages", T.ArrayType(RAW_MESSAGE)),
    ]
)

TURN = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

TRAINING_RECORD = T.StructType([T.StructField("messages", T.ArrayType(TURN))])
