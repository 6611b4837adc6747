"""Export and import of one collection as JSON lines: a header, then a line per point."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import invalid
from ..functions import payload as P
from .records import number_json

FORMAT_VERSION = 1
POINT = "type string, id bigint, values array<float>, payload variant, bad string"


def header(name: str, dimension: int, strict_finite: bool) -> str:
    return json.dumps({"type": "collection", "format_version": FORMAT_VERSION, "name": name, "dimension": dimension, "strict_finite": strict_finite}, separators=(",", ":"))


def point_json() -> Column:
    payload = P.to_json(F.coalesce(F.col("payload"), F.create_map().cast("map<string,struct<s:string,i:bigint,f:double,b:boolean>>")))
    return F.concat(F.lit('{"type":"point","id":'), F.col("id").cast("string"), F.lit(',"values":['), F.array_join(F.transform("values", number_json), ","), F.lit('],"payload":'), payload, F.lit("}"))


def export(points: DataFrame, path: str, name: str, dimension: int, strict_finite: bool = True) -> None:
    """Part files whose names order them: the header's first, then the points by id."""
    spark = points.sparkSession
    own = points.select(F.col("id").alias("at"), point_json().alias("value")).orderBy("at").select("value")
    spark.createDataFrame([(header(name, dimension, strict_finite),)], "value string").coalesce(1).write.text(f"{path}/0-header")
    own.write.text(f"{path}/1-points")


def read_header(spark: SparkSession, path: str) -> dict[str, object]:
    first = spark.read.option("recursiveFileLookup", "true").text(path).where(F.col("value").contains('"format_version"') & F.get_json_object("value", "$.type").isin("collection")).first()
    own = json.loads(first["value"]) if first else None
    if own is None:
        raise invalid("an export begins with its collection")
    if own.get("format_version") != FORMAT_VERSION:
        raise invalid(f"unsupported format_version {own.get('format_version')}")
    name, dimension, strict = own.get("name"), own.get("dimension"), own.get("strict_finite")
    if not isinstance(name, str) or not name or not isinstance(dimension, int) or isinstance(dimension, bool) or dimension <= 0 or not isinstance(strict, bool):
        raise invalid("header needs a name, a positive dimension and a boolean strict_finite")
    return {"name": name, "dimension": dimension, "strict_finite": strict}


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """id, values, payload and ord of the points of an export, in file order."""
    reader = spark.read.option("recursiveFileLookup", "true")
    own = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    own = own.where(F.trim("value") != "").withColumn("r", F.from_json("value", POINT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}))
    head = F.coalesce(F.col("r.type") == "collection", F.lit(False))
    good = F.col("r.bad").isNull() & (F.col("r.type") == "point") & F.col("r.id").isNotNull() & F.col("r.values").isNotNull() & ~F.exists("r.values", lambda x: x.isNull())
    # the header is let through here and dropped below: Spark may evaluate this before the filter
    checked = F.when(F.coalesce(good, F.lit(False)) | head | (F.trim("value") == ""), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("invalid point record: "), F.substring("value", 1, 100))).cast(own.schema["r"].dataType))
    own = own.withColumn("r", checked).where(~head)
    return own.select("r.id", "r.values", P.from_variant(F.col("r.payload")).alias("payload"), F.struct("file", "at", "row").alias("ord"))


