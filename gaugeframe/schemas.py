"""Explicit schemas of files the engine reads; nothing is inferred."""

from pyspark.sql import types as T

PREDICTION = T.StructType([
    T.StructField("image", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("defect", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("predicted_defective", T.BooleanType()),
])

EVALUATION = T.StructType([
    T.StructField("checkpoint_sha256", T.StringType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("images", T.LongType()),
    T.StructField("predictions", T.ArrayType(PREDICTION)),
])

RECORD = T.StructType([
    T.StructField("image", T.StringType()),
    T.StructField("mask", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("defect", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("image_sha256", T.StringType()),
    T.StructField("mask_sha256", T.StringType()),
    T.StructField("split", T.StringType()),
])

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
