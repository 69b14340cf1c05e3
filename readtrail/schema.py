"""Schemas of the input tables."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_LOG = T.StructType([
    T.StructField("user_pseudo_id", T.StringType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("event_date", T.StringType()),
    T.StructField("event_timestamp", T.LongType()),
    T.StructField("user_first_touch_timestamp", T.LongType()),
    T.StructField("event_params", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StructType([
            T.StructField("string_value", T.StringType()),
            T.StructField("int_value", T.LongType()),
        ])),
    ]))),
    T.StructField("geo", T.StructType([T.StructField("country", T.StringType())])),
    T.StructField("device", T.StructType([
        T.StructField("web_info", T.StructType([
            T.StructField("hostname", T.StringType()),
        ])),
    ])),
    T.StructField("app_info", T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("version", T.StringType()),
    ])),
])

LANGUAGE_MAX_LEVEL = "app_language string, max_level bigint, display_language string"
COHORTS = "cr_user_id string, cohort_name string"
