"""Fixed schemas of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

URL_PARTS = ["scheme", "netloc", "path", "params", "query", "fragment"]

URL = T.StructType([T.StructField(n, T.StringType(), False) for n in URL_PARTS])
SECRET = T.StructType([T.StructField("type", T.StringType()), T.StructField("data", T.StringType())])
#: What a fetch gives: a null status is a fetch that failed.
PAGE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("content_length", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)
#: An answer with its time.
ANSWER = T.StructType([*PAGE.fields, T.StructField("answered", T.TimestampType())])
EDGE = T.StructType([T.StructField("parent", T.StringType()), T.StructField("child", T.StringType()), T.StructField("kind", T.StringType())])
ELEMENT = T.StructType([T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType())])
FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType())])
