"""SQL surface: column functions and a table function for packed records."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from boxtrail.session import ship_package
from boxtrail.sources.records import SHORT_RECORD

# Plain SQL bodies, so a call in a query is inlined by the optimizer like any built-in expression.
SQL_FUNCTIONS = {
    "box_iou": (
        "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double",
        "double",
        "coalesce(try_divide(greatest(0D,least(ax2,bx2)-greatest(ax1,bx1))*greatest(0D,least(ay2,by2)-greatest(ay1,by1)),"
        "(ax2-ax1)*(ay2-ay1)+(bx2-bx1)*(by2-by1)-greatest(0D,least(ax2,bx2)-greatest(ax1,bx1))*greatest(0D,least(ay2,by2)-greatest(ay1,by1))),0D)",
    ),
    "line_side": (
        "x double, line double, hysteresis double",
        "int",
        "case when x <= line - hysteresis then -1 when x >= line + hysteresis then 1 else 0 end",
    ),
}


def register_functions(spark: SparkSession) -> None:
    """Temporary SQL functions and the ``decode_records`` table function."""
    ship_package(spark)
    for name, (args, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    spark.udtf.register("decode_records", DecodeRecords)


@udtf(returnType="grid_index int, slot int, obj int, tx int, ty int, tw int, th int")
class DecodeRecords:
    """Rows of one packed payload for LATERAL use; ``sources.records.decode_records`` is the native form."""

    def eval(self, payload: bytes):
        for at in range(0, len(payload), SHORT_RECORD):
            r = bytes(payload[at : at + SHORT_RECORD])
            codes = [b - 256 if b > 127 else b for b in r[3:8]]
            yield Row(grid_index=r[0] + 256 * r[1], slot=r[2], obj=codes[0], tx=codes[1], ty=codes[2], tw=codes[3], th=codes[4])
