"""Schemas shared by producers of links and by the page reader."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(k, T._parse_datatype_string(v) if "<" in v else _SIMPLE[v]) for k, v in fields.items()])


_SIMPLE = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "date": T.DateType(), "strings": T.ArrayType(T.StringType()), "map": T.MapType(T.StringType(), T.StringType())}

DISCOVERED = _struct(job_id="string", url="string", method="string", lastmod="string", confidence="double", stable_id="string")
PAGE = _struct(title="string", canonical_url="string", meta_description="string", json_ld="strings", data_layer="strings", name="string", address="string", telephone="string", links="strings", social_urls="strings", image_urls="strings")
