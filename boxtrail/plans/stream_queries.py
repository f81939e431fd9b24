"""Registered queries: trackers, association, consensus, load shedding and throughput over the event feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtrail.operators import association as assoc, windows as wn
from boxtrail.operators.motion import estimate_velocity
from boxtrail.plans import fixtures as fx
from boxtrail.plans.matching_queries import r6
from boxtrail.plans.registry import ORACLES, query
from boxtrail.plans.sqltext import iou
from boxtrail.streaming import kernels as k, streams as st, trackers as tr
from boxtrail.streaming.feed import as_stream, run_to_end
from boxtrail.streaming.stateful import Clock

LINE = k.LineConfig(
    roi=(90, 0, 220, 110), line_fraction=0.5, minimum_hits={"cell": 2, "droplet": 3}, max_misses=3,
    max_center_distance={"cell": 0.25, "droplet": 0.25}, hysteresis=0.03,
)
NUMBERS = ["confidence", "center_x", "center_y", "velocity_x", "velocity_y"]


def detections(spark, sf):
    return fx.stream(spark, sf).withColumn("det_idx", F.col("event_id"))


@query("st1_track_lines")
def st1(spark, sf):
    events = tr.crossing_events(tr.track_lines(detections(spark, sf), ["source_id"], LINE), ["source_id"])
    cols = ["source_id", "frame_index", "track_id", "class_id", "hits", "cumulative_count", *NUMBERS]
    return r6(events.select(*cols), *NUMBERS)


@query("st2_track_observations")
def st2(spark, sf):
    cfg = k.LineConfig(**{**LINE.__dict__, "observations": True})
    rows = tr.track_lines(detections(spark, sf), ["source_id"], cfg).filter("kind = 'observation'")
    cols = ["source_id", "frame_index", "track_id", "hits", "misses", "confirmed", "counted", "predicted", *NUMBERS]
    return r6(rows.select(*cols), *NUMBERS)


@query("st3_track_optimal")
def st3(spark, sf):
    cfg = k.OptimalConfig(model_width=130.0, line_x=155.0, minimum_hits=2, max_misses=3, max_center_distance=0.25, hysteresis=0.03)
    rows = tr.track_optimal(detections(spark, sf), ["source_id"], cfg)
    return r6(rows, "center_x", "center_y")


def crossings(spark, sf):
    """Crossing-like rows per user: clicks are upstream, purchases downstream, with a class from the event id."""
    t = fx.timed(spark, sf)
    return t.select(
        "source_id",
        "event_type",
        (F.col("event_id") % 2).cast("int").alias("class_id"),
        "event_id",
        "frame_index",
        F.lit(0.0).alias("center_x"),
        (F.col("event_id") % 23).cast("double").alias("center_y"),
        (0.5 + (F.col("event_id") % 50).cast("double") / 100).alias("confidence"),
        ((F.col("event_id") % 9).cast("double") / 2).alias("velocity_x"),
    )


SIDES = """cr as (select source_id,event_type,cast(event_id%2 as int) as class_id,event_id,frame_index,cast(event_id%23 as double) as center_y,
 5e-1+cast(event_id%50 as double)/1e2 as confidence,cast(event_id%9 as double)/2e0 as velocity_x from fx_timed),
up as (select * from cr where event_type='click'),dn as (select * from cr where event_type='purchase'),
pr as (select d.source_id,d.class_id,d.event_id as de,d.frame_index as df,u.event_id as ue,u.frame_index as uf,d.frame_index-u.frame_index as delay,abs(d.center_y-u.center_y) as cross_d,
 case when u.velocity_x>=25e-2 then 12e0/u.velocity_x else cast(d.frame_index-u.frame_index as double) end as ex from dn d join up u on d.source_id=u.source_id and d.class_id=u.class_id
 and d.frame_index-u.frame_index between 1 and 15 and abs(d.center_y-u.center_y)<=14e0),
ws as (select source_id,class_id,de,df,list(ue order by {order}) as wish from pr group by 1,2,3,4),
e as (select *,row_number() over (partition by source_id,class_id order by df,de) rk from ws),
s(source_id,class_id,rk,used,de,ue) as (
 select source_id,class_id,rk,[wish[1]],de,wish[1] from e where rk=1
 union all
 select e.source_id,e.class_id,e.rk,case when list_filter(e.wish,lambda x: not list_contains(s.used,x))[1] is null then s.used else list_append(s.used,list_filter(e.wish,lambda x: not list_contains(s.used,x))[1]) end,
  e.de,list_filter(e.wish,lambda x: not list_contains(s.used,x))[1] from s join e on s.source_id=e.source_id and s.class_id=e.class_id and e.rk=s.rk+1)
select d.source_id,d.event_id,s.ue as upstream_id,p.delay as delay_frames,p.cross_d as cross_axis_distance,s.ue is not null as verified from dn d
 left join s on s.source_id=d.source_id and s.class_id=d.class_id and s.de=d.event_id and s.ue is not null left join pr p on p.source_id=d.source_id and p.de=s.de and p.ue=s.ue"""

SCORE_ORDER = "abs(delay-ex)/greatest(ex,1e0)+cross_d/14e0,uf,ue"


def _associated(spark, sf, preserve):
    c = crossings(spark, sf)
    up, down = c.filter("event_type = 'click'").drop("event_type"), c.filter("event_type = 'purchase'").drop("event_type")
    out = assoc.associate_events(up, down, ["source_id", "class_id"], 1, 15, 14.0, 12.0, preserve)
    return out.select("source_id", "event_id", "upstream_id", "delay_frames", "cross_axis_distance", "verified")


@query("jn14_associate_events", fx.ctes("fx_timed").rstrip() + ",\n" + SIDES.replace("{order}", SCORE_ORDER))
def jn14(spark, sf):
    return _associated(spark, sf, False)


@query("jn14_associate_in_order", fx.ctes("fx_timed").rstrip() + ",\n" + SIDES.replace("{order}", "uf," + SCORE_ORDER))
def jn14o(spark, sf):
    return _associated(spark, sf, True)


def _two_sources(spark, sf):
    c = crossings(spark, sf)
    # The first source answers three frames late; arrival order follows the frame at which each side is seen.
    late = F.when(F.col("event_type") == "click", 3).otherwise(0)
    c = c.withColumn("current_frame", F.col("frame_index") + late).withColumn("arrival", F.col("current_frame") * 2 + (F.col("event_type") != "click").cast("long"))
    pick = ["source_id", "class_id", "event_id", "frame_index", "center_y", "confidence", "velocity_x", "arrival", "current_frame"]
    return c.filter("event_type = 'click'").select(*pick), c.filter("event_type = 'purchase'").select(*pick)


FUSED = """cr as (select source_id,event_type,cast(event_id%2 as int) as class_id,event_id,frame_index,cast(event_id%23 as double) as center_y,
 5e-1+cast(event_id%50 as double)/1e2 as confidence from fx_timed),
a as (select *,frame_index+3 as cur,(frame_index+3)*2 as arr from cr where event_type='click'),
b as (select *,frame_index as cur,frame_index*2+1 as arr from cr where event_type='purchase'),
p0 as (select a.source_id,a.class_id,a.event_id as ue,b.event_id as de,a.frame_index as uf,b.frame_index as df,b.frame_index-a.frame_index as delay,
 abs(b.center_y-a.center_y) as cd,greatest(a.arr,b.arr) as step,greatest(a.cur,b.cur) as now_f,a.arr as ua,b.arr as da,a.confidence as ca,b.confidence as cb
 from a join b on a.source_id=b.source_id and a.class_id=b.class_id and b.frame_index-a.frame_index between 1 and 15 and abs(b.center_y-a.center_y)<=14e0),
p1 as (select *,58e-2*(abs(delay-6e0)/14e0)+42e-2*(cd/14e0)-15e-2*(5e-1*(ca+cb)) as cost from p0 where uf>=now_f-15 and df>=now_f-30),
e as (select *,row_number() over (partition by source_id,class_id order by step,cost,ua,ue,da,de) as rk from p1),
s(source_id,class_id,rk,us,ds,ok) as (
 select source_id,class_id,rk,[ue],[de],true from e where rk=1
 union all
 select e.source_id,e.class_id,e.rk,case when list_contains(s.us,e.ue) or list_contains(s.ds,e.de) then s.us else list_append(s.us,e.ue) end,
  case when list_contains(s.us,e.ue) or list_contains(s.ds,e.de) then s.ds else list_append(s.ds,e.de) end,
  not (list_contains(s.us,e.ue) or list_contains(s.ds,e.de)) from s join e on s.source_id=e.source_id and s.class_id=e.class_id and e.rk=s.rk+1),
f as (select e.*,row_number() over (partition by e.source_id,e.class_id order by e.rk) as n from s join e on s.source_id=e.source_id and s.class_id=e.class_id and s.rk=e.rk where s.ok)"""


@query(
    "jn15_consensus",
    fx.ctes("fx_timed").rstrip()
    + ",\n"
    + FUSED
    + """ select source_id,class_id,step,ue as first_id,de as second_id,uf as first_frame,df as second_frame,delay as delay_frames,round(cd,6) as cross_axis_distance,
 round(sqrt(ca*cb),6) as fused_confidence,n as cumulative_count from f""",
)
def jn15(spark, sf):
    a, b = _two_sources(spark, sf)
    out = assoc.consensus(a, b, ["source_id", "class_id"], 1, 15, 6.0, 14.0)
    return r6(out, "cross_axis_distance", "fused_confidence")


@query(
    "jn15_consensus_leftovers",
    fx.ctes("fx_timed").rstrip()
    + ",\n"
    + FUSED
    + """,mx as (select source_id,class_id,max(cur) as m from (select source_id,class_id,cur from a union all select source_id,class_id,cur from b) z group by 1,2),
l as (select 'first' as side,a.source_id,a.class_id,a.frame_index<mx.m-15 as gone from a join mx using (source_id,class_id) where not exists (select 1 from f where f.source_id=a.source_id and f.class_id=a.class_id and f.ue=a.event_id)
 union all select 'second',b.source_id,b.class_id,b.frame_index<mx.m-30 from b join mx using (source_id,class_id) where not exists (select 1 from f where f.source_id=b.source_id and f.class_id=b.class_id and f.de=b.event_id))
select side,source_id,class_id,count(*) filter (gone) as rejected,count(*) filter (not gone) as pending from l group by 1,2,3""",
)
def jn15l(spark, sf):
    a, b = _two_sources(spark, sf)
    keys = ["source_id", "class_id"]
    fused = assoc.consensus(a, b, keys, 1, 15, 6.0, 14.0)
    return assoc.consensus_leftovers(a, b, fused, keys, 15)


def tagged(spark, sf):
    a, b = _two_sources(spark, sf)
    cols = ["source_id", "class_id", "event_id", "frame_index", "center_y", "confidence", "velocity_x", "current_frame"]
    return a.select(*cols, F.lit(0).alias("side")).unionByName(b.select(*cols, F.lit(1).alias("side")))


PAIR = k.PairConfig(min_delay=1, max_delay=15, nominal=6.0, max_cross=14.0, line_distance=12.0)


@query("st4_associate_stream", fx.ctes("fx_timed").rstrip() + ",\n" + SIDES.replace("{order}", SCORE_ORDER))
def st4(spark, sf):
    """The streaming associator replayed over the table; it must agree with the set-based form."""
    rows = tagged(spark, sf).drop("current_frame")
    return tr.associate_stream(rows, ["source_id", "class_id"], PAIR).select(
        "source_id", "event_id", "upstream_id", "delay_frames", "cross_axis_distance", "verified"
    )


@query(
    "st5_consensus_stream",
    fx.ctes("fx_timed").rstrip()
    + ",\n"
    + FUSED
    + " select source_id,class_id,ue as first_id,de as second_id,delay as delay_frames,round(sqrt(ca*cb),6) as fused_confidence from f",
)
def st5(spark, sf):
    """The streaming consensus replayed over the table; its fused rows must agree with the set-based form."""
    rows = tagged(spark, sf).withColumnRenamed("frame_index", "event_frame")
    out = tr.consensus_stream(rows, ["source_id", "class_id"], PAIR).filter("state = 'fused'")
    cols = ["source_id", "class_id", "first_id", "second_id", "delay_frames", "fused_confidence"]
    return r6(out.select(*cols), "fused_confidence")


REJECTED = """,every_row as (select source_id,class_id,cur from a union all select source_id,class_id,cur from b),
left_over as (select a.source_id,a.class_id,a.frame_index+15 as deadline,a.event_id as first_id,cast(null as bigint) as second_id from a
  where not exists (select 1 from f where f.source_id=a.source_id and f.class_id=a.class_id and f.ue=a.event_id)
 union all select b.source_id,b.class_id,b.frame_index+30,null,b.event_id from b
  where not exists (select 1 from f where f.source_id=b.source_id and f.class_id=b.class_id and f.de=b.event_id))"""


@query(
    "st5_consensus_rejections",
    fx.ctes("fx_timed").rstrip() + ",\n" + FUSED + REJECTED
    + """ select l.source_id,l.class_id,min(z.cur) as frame_index,first_id,second_id from left_over l join every_row z on z.source_id=l.source_id and z.class_id=l.class_id
 and z.cur>l.deadline group by l.source_id,l.class_id,first_id,second_id""",
)
def st5r(spark, sf):
    rows = tagged(spark, sf).withColumnRenamed("frame_index", "event_frame")
    out = tr.consensus_stream(rows, ["source_id", "class_id"], PAIR).filter("state = 'rejected'")
    return out.select("source_id", "class_id", "frame_index", "first_id", "second_id")


@query("st6_consensus_counter")
def st6(spark, sf):
    t = fx.timed(spark, sf)
    rows = t.select(
        "source_id",
        "frame_index",
        F.when(F.col("event_type").isin("click", "view"), 0).otherwise(1).alias("side"),
        (F.col("detections") % 2).cast("int").alias("class_id"),
        (F.col("event_id") % 7).cast("double").alias("y"),
        (F.col("value") * 100).alias("score"),
    )
    cfg = k.RingConfig(min_delay=1, max_delay=20, nominal_delay=6, max_y=5.0, motion=3.0, cell_refractory=2, droplet_refractory=3, thresholds=(500.0, 500.0))
    out = tr.consensus_counter(rows, ["source_id"], cfg)
    return out.groupBy("source_id", "class_id").agg(F.count(F.lit(1)).alias("events"), F.avg("delay_frames").alias("mean_delay")).withColumn("mean_delay", F.round("mean_delay", 6))


REFRACT = """l as (select source_id,frame_index,value,lag(value) over w as a,lead(value) over w as b from fx_timed window w as (partition by source_id order by frame_index)),
pk as (select *,row_number() over (partition by source_id order by frame_index) rk from l where value>=1e1 and value>=a and value>b),
s(source_id,rk,last_f,ok,frame_index) as (
 select source_id,rk,frame_index,true,frame_index from pk where rk=1
 union all
 select p.source_id,p.rk,case when p.frame_index-s.last_f>=7 then p.frame_index else s.last_f end,p.frame_index-s.last_f>=7,p.frame_index from s join pk p on p.source_id=s.source_id and p.rk=s.rk+1)
select source_id,frame_index from s where ok"""


@query("st7_refractory_peaks", fx.ctes("fx_timed").rstrip() + ",\n" + REFRACT)
def st7(spark, sf):
    peaks = wn.temporal_peaks(fx.timed(spark, sf), ["source_id"], "frame_index", "value", 10.0)
    return tr.refractory(peaks, ["source_id"], "frame_index", 7).select("source_id", "frame_index")


# The feed has one row per source and frame, so a frame links one row to the nearest live track. The SQL keeps the live
# tracks of a source in a list and walks its rows in order.
LIVE = "list_filter(s.tr,lambda t: r.frame_index-1-t.seen<={missed})"


def walk_sql(rows: str, keys: list[str], missed: int, cost: str, within: str, fresh: str, updated: str) -> str:
    """``cost``/``within`` over a live track t and the row r; ``fresh``/``updated`` are the new track structs."""
    live = LIVE.replace("{missed}", str(missed))
    pick = f"list_sort(list_transform(list_filter({live},lambda t: {within}),lambda t: {{'c':{cost},'id':t.id}}))[1].id"
    on = " and ".join(f"r.{k}=s.{k}" for k in keys)
    cols, rcols = ",".join(keys), ",".join(f"r.{k}" for k in keys)
    first = fresh.replace("{new}", "cast(1 as bigint)")
    other = fresh.replace("{new}", "s.n+1")
    return f"""r as ({rows}),
s({cols},rk,tr,n,hit) as (
 select {cols},rk,[{first}],cast(1 as bigint),cast(1 as bigint) from r where rk=1
 union all
 select {rcols},r.rk,case when {pick} is null then list_append({live},{other}) else list_transform({live},lambda t: case when t.id={pick} then {updated} else t end) end,
  case when {pick} is null then s.n+1 else s.n end,coalesce({pick},s.n+1)
 from s join r on {on} and r.rk=s.rk+1),
o as (select {",".join(f"s.{k}" for k in keys)},r.frame_index,r.det_idx,list_filter(s.tr,lambda t: t.id=s.hit)[1] as t from s join r on {on} and r.rk=s.rk)"""


TWO_HIT = walk_sql(
    "select source_id,frame_index,event_id as det_idx,y1 as y,confidence as score,row_number() over (partition by source_id order by frame_index) as rk from fx_stream",
    ["source_id"], 1, "abs(t.y-r.y)", "abs(t.y-r.y)<=3e0",
    "{'id':{new},'y':r.y,'hits':1,'best':r.score,'seen':r.frame_index}",
    "{'id':t.id,'y':r.y,'hits':t.hits+1,'best':greatest(t.best,r.score),'seen':r.frame_index}",
)


@query(
    "st7_two_hit",
    fx.ctes("fx_stream").rstrip() + ",\n" + TWO_HIT + " select source_id,frame_index,t.id as track_id,round(t.y,6) as y,round(t.best,6) as score from o where t.hits=2",
)
def st7t(spark, sf):
    rows = detections(spark, sf).select("source_id", "frame_index", "det_idx", F.col("y1").alias("y"), F.col("confidence").alias("score"))
    return r6(tr.two_hit(rows, ["source_id"], k.TwoHitConfig(max_motion=3.0, max_missed=1)), "y", "score")


def points(spark, sf):
    return detections(spark, sf).select(
        "source_id",
        F.expr("frame_index div 12").alias("sequence_id"),
        "frame_index",
        "det_idx",
        ((F.col("x1") + F.col("x2")) / 2 + F.col("event_id") % 5).alias("x"),
        ((F.col("y1") + F.col("y2")) / 2).alias("y"),
        F.col("confidence").alias("score"),
    )


POINT_ROWS = """select source_id,frame_index//12 as sequence_id,frame_index,event_id as det_idx,cast((x1+x2)/2+event_id%5 as double) as x,(y1+y2)/2 as y,confidence as score,
 row_number() over (partition by source_id,frame_index//12 order by frame_index) as rk from fx_stream"""
AWAY = "sqrt((t.x-r.x)*(t.x-r.x)+(t.y-r.y)*(t.y-r.y))"


def points_sql(reach: str, smooth: str, rest: str) -> str:
    return walk_sql(
        POINT_ROWS, ["source_id", "sequence_id"], 2, AWAY, f"{AWAY}<={reach}",
        "{'id':{new},'x':r.x,'y':r.y,'first':r.frame_index,'seen':r.frame_index,'hits':1,'total':r.score,'top':r.score,'best':r.frame_index}",
        f"{{'id':t.id,'x':{smooth}*r.x+{rest}*t.x,'y':{smooth}*r.y+{rest}*t.y,'first':t.first,'seen':r.frame_index,'hits':t.hits+1,'total':t.total+r.score,"
        "'top':greatest(t.top,r.score),'best':case when r.score>t.top then r.frame_index else t.best end}",
    )


TRACK_COLS = """t.id as track_id,round(t.x,6) as x,round(t.y,6) as y,t.first as first_frame,t.seen as last_frame,cast(t.hits as int) as hits,round(t.total/t.hits,6) as mean_score,
 round(t.top,6) as max_score,t.best as best_frame,round(least(1e0,greatest(0e0,65e-2*(t.total/t.hits)+35e-2*least(t.hits/4e0,1e0))),9) as confidence,
 t.hits>=3 and least(1e0,greatest(0e0,65e-2*(t.total/t.hits)+35e-2*least(t.hits/4e0,1e0)))>={gate} as confirmed"""


@query(
    "st8_track_candidates",
    fx.ctes("fx_stream").rstrip()
    + ",\n"
    + points_sql("14e0", "1e0", "0e0")
    + ",z as (select *,row_number() over (partition by source_id,sequence_id,t.id order by frame_index desc) as k from o) select source_id,sequence_id,"
    + TRACK_COLS.replace("{gate}", "5e-1")
    + " from z where k=1",
)
def st8(spark, sf):
    rows = tr.track_points(points(spark, sf), ["source_id", "sequence_id"], k.PointConfig(max_distance=14.0, max_missed=2))
    rows = rows.filter("kind = 'track'").drop("kind", "det_idx", "frame_index")
    return r6(rows, "x", "y", "mean_score", "max_score").withColumn("confidence", F.round("confidence", 9))


SMOOTH = fx.ctes("fx_stream").rstrip() + ",\n" + points_sql("16e0", "7e-1", "(1e0-7e-1)")


@query(
    "st9_track_particles",
    SMOOTH + " select source_id,sequence_id,frame_index,det_idx," + TRACK_COLS.replace("{gate}", "6e-1") + " from o",
)
def st9(spark, sf):
    cfg = k.PointConfig(max_distance=16.0, max_missed=2, smoothing=0.7, min_hits=3, confidence=0.6)
    rows = tr.track_points(points(spark, sf), ["source_id", "sequence_id"], cfg).filter("kind = 'observation'").drop("kind")
    return r6(rows, "x", "y", "mean_score", "max_score").withColumn("confidence", F.round("confidence", 9))


SEQUENCE = """r as (select source_id,frame_index,(x1+x2)/2+event_id%5 as x,(y1+y2)/2 as y,row_number() over (partition by source_id order by frame_index) as rk from fx_stream),
s(source_id,rk,frame_index,x,y,v,track_id,is_new,raw) as (
 select source_id,rk,frame_index,cast(x as double),y,0e0,cast(1 as bigint),true,y from r where rk=1
 union all
 select r.source_id,r.rk,r.frame_index,case when r.frame_index-s.frame_index>3 or r.y-s.raw>4 then r.x else 75e-2*r.x+25e-2*s.x end,
  case when r.frame_index-s.frame_index>3 or r.y-s.raw>4 then r.y else 75e-2*r.y+25e-2*(s.y+s.v*(r.frame_index-s.frame_index)) end,
  case when r.frame_index-s.frame_index>3 or r.y-s.raw>4 then 0e0 else 65e-2*s.v+35e-2*((75e-2*r.y+25e-2*(s.y+s.v*(r.frame_index-s.frame_index))-s.y)/(r.frame_index-s.frame_index)) end,
  case when r.frame_index-s.frame_index>3 or r.y-s.raw>4 then s.track_id+1 else s.track_id end,r.frame_index-s.frame_index>3 or r.y-s.raw>4,r.y
 from s join r on r.source_id=s.source_id and r.rk=s.rk+1)
select source_id,frame_index,track_id,round(x,6) as x,round(y,6) as y,round(v,6) as velocity,is_new from s"""


@query("st10_sequence_filter", fx.ctes("fx_stream").rstrip() + ",\n" + SEQUENCE)
def st10(spark, sf):
    rows = points(spark, sf).select("source_id", "frame_index", "x", "y")
    return r6(tr.sequence_filter(rows, ["source_id"], k.SequenceConfig(jump=4.0, max_missing=3)), "x", "y", "velocity")


@query(
    "st11_gated_score",
    SMOOTH
    + """,g as (select source_id,sequence_id,t.id as track_id,cast(t.hits as int) as hits,t.total/t.hits as m from o where t.hits=3)
select source_id,sequence_id,track_id,hits,round(m,6) as mean_score,round(m,6) as probability,round(least(1e0,greatest(0e0,8e-1*m+2e-1*least(hits/4e0,1e0))),6) as confidence,
 m>=7e-1 and least(1e0,greatest(0e0,8e-1*m+2e-1*least(hits/4e0,1e0)))>=75e-2 as confirmed from g""",
)
def st11(spark, sf):
    cfg = k.PointConfig(max_distance=16.0, max_missed=2, smoothing=0.7, min_hits=3, confidence=0.6)
    obs = tr.track_points(points(spark, sf), ["source_id", "sequence_id"], cfg).filter("kind = 'observation'")
    obs = obs.select("source_id", "sequence_id", "track_id", "frame_index", "hits", "mean_score")
    out = st.gated_score(obs, ["source_id", "sequence_id", "track_id"], "frame_index", "hits", 3, F.col("mean_score"), 0.7, 0.75)
    return r6(out.drop("frame_index"), "mean_score", "probability", "confidence")


@query(
    "st12_latest_only",
    "select user_id,arg_max(event_id,(ts,event_id)) as event_id,count(*)-1 as dropped from events group by 1",
)
def st12(spark, sf):
    e = fx.table(spark, sf, "events").select("user_id", "ts", "event_id")
    return st.latest_only(e, "user_id", "ts").select("user_id", "event_id", "dropped")


def two_regions(spark, sf):
    """Region A sees every frame, region B the same objects five frames later."""
    a = detections(spark, sf).withColumn("region", F.lit("detection"))
    b = a.withColumns({"region": F.lit("verification"), "frame_index": F.col("frame_index") + 5, "y1": F.col("y1") + 1, "y2": F.col("y2") + 1})
    return a.unionByName(b)


@query("st13_dual_roi_counts")
def st13(spark, sf):
    cfg = {"detection": LINE, "verification": LINE}
    pair = k.PairConfig(min_delay=1, max_delay=20, max_cross=10.0, line_distance=50.0)
    out = tr.dual_roi_counts(two_regions(spark, sf), "source_id", "region", cfg, "detection", "verification", pair)
    return out.select("source_id", "class_id", "frame_index", "track_id", "upstream_id", "delay_frames", "verified", "verified_count")


@query(
    "st14_burst_sessions",
    """with l as (select user_id as src,ts,cast(round(value,0) as int) as size,lag(ts) over (partition by user_id order by ts,event_id) as pt,event_id from events),
b as (select *,sum(case when pt is null or epoch_us(ts)-epoch_us(pt)>21600000000 then 1 else 0 end) over (partition by src order by ts,event_id) as k from l)
select src,epoch_us(min(ts)) as start_us,epoch_us(max(ts)) as end_us,cast(sum(size) as bigint) as bytes,count(*) as packets from b group by src,k""",
)
def st14(spark, sf):
    e = fx.table(spark, sf, "events").select(
        F.col("user_id").alias("src"), F.col("ts").cast("timestamp").alias("ts"), F.round("value").cast("int").alias("size")
    )
    out = st.burst_sessions(e, ["src"], "6 hours")
    return out.select("src", fx.wall_micros(F.col("start_ts")).alias("start_us"), fx.wall_micros(F.col("end_ts")).alias("end_us"), "bytes", "packets")


@query(
    "st15_running_counts",
    "select epoch_us(date_trunc('hour',ts)) as window_us,event_type,count(*) as n from events group by 1,2",
)
def st15(spark, sf):
    e = fx.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = st.running_counts(e, ["event_type"], "1 hour")
    return out.select(fx.wall_micros(F.col("window_start")).alias("window_us"), "event_type", "n")


@query("st16_fusion_counts")
def st16(spark, sf):
    first = detections(spark, sf)
    second = first.filter("event_id % 6 <> 0").withColumn("frame_index", F.col("frame_index") + 4)
    pair = k.PairConfig(min_delay=1, max_delay=12, nominal=4.0, max_cross=10.0)
    out = tr.fusion_counts(first, second, "source_id", LINE, LINE, pair)
    return r6(out, "cross_axis_distance", "fused_confidence")


JN16 = """d as (select source_id,frame_index,event_id as det_idx,confidence,(x1+x2)/2 as x,(y1+y2)/2 as y from fx_stream),
f as (select source_id,frame_index,lag(frame_index) over (partition by source_id order by frame_index) as pf from (select distinct source_id,frame_index from d) z),
m as (select f.source_id,f.frame_index,(c.x-p.x)/(f.frame_index-f.pf) as vx,(c.y-p.y)/(f.frame_index-f.pf) as vy from f join d c on c.source_id=f.source_id and c.frame_index=f.frame_index
 join d p on p.source_id=f.source_id and p.frame_index=f.pf where sqrt((c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y))<=8e1 and abs(c.y-p.y)<=3e1)
select f.source_id,f.frame_index,count(m.vx) as matches,round(coalesce(quantile_cont(m.vx,5e-1),0e0),6) as vx,round(coalesce(quantile_cont(m.vy,5e-1),0e0),6) as vy
 from f left join m on m.source_id=f.source_id and m.frame_index=f.frame_index group by 1,2"""


@query("jn16_estimate_velocity", fx.ctes("fx_stream").rstrip() + ",\n" + JN16)
def jn16(spark, sf):
    d = detections(spark, sf).select(
        "source_id", "frame_index", "det_idx", "confidence", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y")
    )
    return r6(estimate_velocity(d, ["source_id"]), "vx", "vy")


SHARED = iou("t", "r")
AHEAD = "sqrt(((r.x1+r.x2)*5e-1-(2*t.x-t.px))*((r.x1+r.x2)*5e-1-(2*t.x-t.px))+((r.y1+r.y2)*5e-1-(2*t.y-t.py))*((r.y1+r.y2)*5e-1-(2*t.y-t.py)))"
OPT_COST = f"65e-2*{AHEAD}/325e-1+35e-2*(1e0-{SHARED})"
ORIGIN = "case when (r.x1+r.x2)*5e-1<=155e0-39e-1 then -1 when (r.x1+r.x2)*5e-1>=155e0+39e-1 then 1 else 0 end"
OPTIMAL = walk_sql(
    "select source_id,frame_index,event_id as det_idx,class_id,x1,y1,x2,y2,row_number() over (partition by source_id order by frame_index) as rk from fx_stream",
    ["source_id"], 3, OPT_COST, f"({AHEAD}<=325e-1 or {SHARED}>=5e-2) and {OPT_COST}<1e0",
    f"{{'id':{{new}},'x':(r.x1+r.x2)*5e-1,'y':(r.y1+r.y2)*5e-1,'px':(r.x1+r.x2)*5e-1,'py':(r.y1+r.y2)*5e-1,'x1':r.x1,'y1':r.y1,'x2':r.x2,'y2':r.y2,'org':{ORIGIN},'hits':1,'seen':r.frame_index,'done':false,'now':false}}",
    f"{{'id':t.id,'x':(r.x1+r.x2)*5e-1,'y':(r.y1+r.y2)*5e-1,'px':t.x,'py':t.y,'x1':r.x1,'y1':r.y1,'x2':r.x2,'y2':r.y2,'org':case when t.org=0 then {ORIGIN} else t.org end,'hits':t.hits+1,'seen':r.frame_index,"
    f"'done':t.done or (t.org=-1 and {ORIGIN}=1 and t.hits+1>=2),'now':not t.done and t.org=-1 and {ORIGIN}=1 and t.hits+1>=2}}",
)
ORACLES["st3_track_optimal"] = (
    fx.ctes("fx_stream").rstrip()
    + ",\n"
    + OPTIMAL
    + " select o.source_id,o.frame_index,o.det_idx,t.id as track_id,f.class_id,round(t.x,6) as center_x,round(t.y,6) as center_y,t.now as crossed from o join fx_stream f on f.event_id=o.det_idx"
)


# The same operators as streams: the table comes in three micro-batches, up to two frames out of order.
FPS = 10.0
CLOCK = Clock("ts", 1000 / FPS)
LAG_FRAMES, ORIGIN_US = 2, 946_684_800_000_000


def live(table, frame="frame_index"):
    frame_ms = int(CLOCK.frame_ms)
    lag = F.pmod(F.xxhash64("source_id", frame), F.lit(LAG_FRAMES + 1)) * frame_ms
    return as_stream(table.withColumn("ts", st.frame_time(frame, FPS, ORIGIN_US)), "ts", (LAG_FRAMES + 1) * frame_ms, lag_ms=lag)


@query("st1_line_stream")
def st1s(spark, sf):
    """Crossings of the line tracker as a stream; the rows are those of the table form."""
    rows = run_to_end(tr.track_lines(live(detections(spark, sf)), ["source_id"], LINE, clock=CLOCK)).filter("kind = 'event'")
    cols = ["source_id", "frame_index", "track_id", "class_id", "hits", *NUMBERS]
    return r6(rows.select(*cols), *NUMBERS)


@query("st3_optimal_stream", ORACLES["st3_track_optimal"])
def st3s(spark, sf):
    cfg = k.OptimalConfig(model_width=130.0, line_x=155.0, minimum_hits=2, max_misses=3, max_center_distance=0.25, hysteresis=0.03)
    rows = run_to_end(tr.track_optimal(live(detections(spark, sf)), ["source_id"], cfg, clock=CLOCK)).drop("late_rows")
    return r6(rows, "center_x", "center_y")


@query("st8_candidate_stream", ORACLES["st8_track_candidates"])
def st8s(spark, sf):
    cfg = k.PointConfig(max_distance=14.0, max_missed=2)
    rows = run_to_end(tr.track_points(live(points(spark, sf)), ["source_id", "sequence_id"], cfg, clock=CLOCK))
    rows = rows.filter("kind = 'track'").drop("kind", "det_idx", "frame_index", "late_rows")
    return r6(rows, "x", "y", "mean_score", "max_score").withColumn("confidence", F.round("confidence", 9))


@query("st9_particle_stream", ORACLES["st9_track_particles"])
def st9s(spark, sf):
    cfg = k.PointConfig(max_distance=16.0, max_missed=2, smoothing=0.7, min_hits=3, confidence=0.6)
    rows = run_to_end(tr.track_points(live(points(spark, sf)), ["source_id", "sequence_id"], cfg, clock=CLOCK))
    rows = rows.filter("kind = 'observation'").drop("kind", "late_rows")
    return r6(rows, "x", "y", "mean_score", "max_score").withColumn("confidence", F.round("confidence", 9))


@query("st4_associator_stream", ORACLES["st4_associate_stream"])
def st4s(spark, sf):
    rows = live(tagged(spark, sf).drop("current_frame"))
    out = run_to_end(tr.associate_stream(rows, ["source_id", "class_id"], PAIR, clock=CLOCK))
    return out.select("source_id", "event_id", "upstream_id", "delay_frames", "cross_axis_distance", "verified")


@query(
    "st5_event_time_stream",
    fx.ctes("fx_timed").rstrip() + ",\n" + FUSED + REJECTED
    + """ select 'fused' as state,source_id,class_id,ue as first_id,de as second_id,round(sqrt(ca*cb),6) as fused_confidence from f
 union all select 'rejected',source_id,class_id,first_id,second_id,null from left_over""",
)
def st5s(spark, sf):
    """Both inputs of the consensus as one tagged stream; at its end every event is fused or rejected by its timer."""
    rows = live(tagged(spark, sf).withColumnRenamed("frame_index", "event_frame"), "current_frame")
    out = run_to_end(tr.consensus_stream(rows, ["source_id", "class_id"], PAIR, clock=CLOCK))
    return r6(out.select("state", "source_id", "class_id", "first_id", "second_id", "fused_confidence"), "fused_confidence")


@query(
    "st12_latest_stream",
    fx.ctes("fx_timed").rstrip() + " select source_id,max(frame_index) as frame_index,count(*) as received,true as balanced from fx_timed group by 1",
)
def st12s(spark, sf):
    """Load shedding on the stream: the last frame sent of each source, and whether sent and dropped rows add up to those received."""
    rows = live(fx.timed(spark, sf).select("source_id", "frame_index", "event_id"))
    out = run_to_end(st.latest_stream(rows, "source_id", "frame_index"))
    balanced = F.sum(F.col("dropped") + F.col("sent").cast("long")) == F.max("received")
    return out.groupBy("source_id").agg(F.max(F.when(F.col("sent"), F.col("frame_index"))).alias("frame_index"), F.max("received").alias("received"), balanced.alias("balanced"))
