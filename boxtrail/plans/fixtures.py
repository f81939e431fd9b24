"""Detection, stream, feature and packet tables derived from the driver tables.

Each view is plain SQL that runs unchanged in both engines, so an oracle can start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from boxtrail.operators.ordered import indexed

GT = """
select image_id,gt_idx,class_id,cx,cy,w,h,cx-w/2 as x1,cy-h/2 as y1,cx+w/2 as x2,cy+h/2 as y2,
  l_discount,l_tax,l_returnflag,l_partkey from (
 select l_orderkey as image_id,row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,
   l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate)-1 as gt_idx,
  cast(l_suppkey % 2 as int) as class_id,
  1e-1+8e-1*cast(l_partkey % 37 as double)/37e0 as cx,1e-1+8e-1*cast(l_partkey % 23 as double)/23e0 as cy,
  8e-2+l_quantity/4e2 as w,8e-2+l_quantity/5e2 as h,l_discount,l_tax,l_returnflag,l_partkey from lineitem) t
"""

DET = """
select image_id,gt_idx*2+dup as det_idx,class_id,
  (5e-1+4e0*l_tax+cast(l_partkey % 100 as double)/1e3)*(case when dup=1 then 9e-1 else 1e0 end) as confidence,
  x1+s as x1,y1+s/2 as y1,x2+s as x2,y2+s/2 as y2 from (
   select *,(l_discount-5e-2)*w*(case when dup=1 then 8e0 else 4e0 end) as s
   from fx_gt cross join (select 0 as dup union all select 1 as dup) d
   where l_returnflag<>'R' and (dup=0 or l_returnflag='A')) q
"""

FRAMES = """
select *,row_number() over (partition by user_id order by ts,event_id)-1 as frame_index from events
"""

STREAM = """
select user_id as source_id,frame_index,event_id,class_id,class_name,confidence,
  x-1e1 as x1,y-15e-1*1e1 as y1,x+1e1 as x2,y+15e-1*1e1 as y2 from (
  select user_id,event_id,event_type,frame_index,cast(user_id % 2 as int) as class_id,
   case when user_id % 2=0 then 'cell' else 'droplet' end as class_name,
   5e-1+cast(event_id % 50 as double)/1e2 as confidence,
   1e2+1e1*cast(frame_index % 12 as double) as x,5e1+cast(event_id % 7 as double) as y
  from fx_frames) b where event_type<>'error'
"""

# One candidate per line: measured shape and brightness columns; image = order, track = (order, part % 3).
CANDIDATES = """
select image_id as sequence_id,gt_idx as candidate_idx,cast(l_partkey % 3 as int) as track_id,
  cast(gt_idx as bigint) as frame_index,cast(image_id % 20 as int) as video_id,
  cx*96e0 as center_x_px,cy*96e0 as center_y_px,
  cast(2+l_partkey % 9 as double) as bbox_width,cast(2+l_partkey % 7 as double) as bbox_height,
  cast(3+l_partkey % 101 as double) as pixel_area,3e-1+cast(l_partkey % 67 as double)/1e2 as circularity,
  4e-1+cast(l_partkey % 59 as double)/1e2 as solidity,35e-2+cast(l_partkey % 61 as double)/1e2 as extent,
  4e0+cast(l_partkey % 13 as double) as blackhat_mean,14e0+cast(l_partkey % 47 as double) as blackhat_max,
  cast(l_partkey % 5 as double)+1e0 as blackhat_threshold,2e0+l_tax*1e2 as temporal_mean,
  3e0+cast(l_partkey % 4 as double) as temporal_threshold,cast(l_partkey % 29 as double) as local_contrast,
  cast(l_partkey % 97 as double)/96e0 as radial_distance_norm,l_discount*1e1 as proposal_score
from fx_gt
"""

# Latency-like rows: one per event; gap and size follow value.
TIMED = """
select user_id as source_id,frame_index,event_id,event_type,value,
  cast(event_id % 17 as int) as detections from fx_frames
"""

VIEWS = {
    "fx_gt": GT,
    "fx_det": DET,
    "fx_frames": FRAMES,
    "fx_stream": STREAM,
    "fx_cand": CANDIDATES,
    "fx_timed": TIMED,
}
NEEDS = {
    "fx_gt": [],
    "fx_det": ["fx_gt"],
    "fx_frames": [],
    "fx_stream": ["fx_frames"],
    "fx_cand": ["fx_gt"],
    "fx_timed": ["fx_frames"],
}


def ctes(*names: str, settled: bool = False) -> str:
    """``with`` prefix that defines the named views (and what they need) for the SQL check.

    ``settled`` views are written once before they are joined, and the prefix allows no recursion.
    """
    ordered: list[str] = []

    def visit(name):
        for need in NEEDS[name]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    how = "as materialized" if settled else "as"
    return ("with " if settled else "with recursive ") + ",\n".join(f"{n} {how} ({VIEWS[n].strip()})" for n in ordered) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wall_micros(ts):
    """Microseconds of a timestamp as it is written, whatever the session's time zone is."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def _from(spark: SparkSession, sql: str, **inputs: DataFrame) -> DataFrame:
    for name in inputs:
        sql = sql.replace(f"from {name}", f"from {{{name}}}")
    return spark.sql(sql, **inputs)


def gt(spark, sf_dir) -> DataFrame:
    # Same rows as in the shared text, but what follows from a line's own columns is worked out after the shuffle, not sent through it.
    head, tail = "row_number() over (", ")-1 as gt_idx"
    order = GT[GT.index(head) + len(head) : GT.index(tail)]
    numbered = _from(spark, f"select *,{head}{order}{tail} from lineitem", lineitem=table(spark, sf_dir, "lineitem"))
    return _from(spark, GT.replace(f"{head}{order}{tail}", "gt_idx"), lineitem=numbered)


def det(spark, sf_dir, truth: DataFrame | None = None) -> DataFrame:
    # Same rows as in the shared text, without a join: the two copies come from an explode.
    text = DET.replace(
        "cross join (select 0 as dup union all select 1 as dup) d", "lateral view explode(array(0,1)) d as dup"
    )
    return _from(spark, text, fx_gt=truth if truth is not None else gt(spark, sf_dir))


def frames(spark, sf_dir) -> DataFrame:
    numbered = indexed(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "frame_index")
    return numbered.withColumn("frame_index", F.col("frame_index") - 1)


def stream(spark, sf_dir) -> DataFrame:
    return _from(spark, STREAM, fx_frames=frames(spark, sf_dir))


def candidates(spark, sf_dir) -> DataFrame:
    return _from(spark, CANDIDATES, fx_gt=gt(spark, sf_dir))


def timed(spark, sf_dir) -> DataFrame:
    return _from(spark, TIMED, fx_frames=frames(spark, sf_dir))
