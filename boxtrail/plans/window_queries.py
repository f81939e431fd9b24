"""Registered queries: windows, sessions, as-of lookups, summaries and robust scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtrail.operators import datasets as ds, telemetry as tl, windows as wn
from boxtrail.plans import fixtures as fx
from boxtrail.plans.geometry_queries import FRAME_COUNTS, frame_counts
from boxtrail.plans.matching_queries import r6
from boxtrail.plans.registry import query

TIMED, STREAM, DET = fx.ctes("fx_timed"), fx.ctes("fx_stream"), fx.ctes("fx_gt", "fx_det")


@query(
    "wn1_pct_rank_avg",
    """with e as (select event_id,event_type,case when event_type='error' then null else value end as v from events),
r as (select event_id,v,rank() over (order by v) as r,count(*) over (partition by v) as c from e where v is not null)
select e.event_id,round(coalesce((r.r+(r.c-1)/2e0)/(select count(*) from r),5e-1),6) as pct from e left join r on e.event_id=r.event_id""",
)
def wn1(spark, sf):
    e = fx.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v")
    )
    return r6(wn.pct_rank_avg(e, [], "v", "pct").select("event_id", "pct"), "pct")


@query(
    "wn2_moving_average",
    TIMED.rstrip()
    + """,
k as (select *,row_number() over (partition by source_id order by frame_index) rn,count(*) over (partition by source_id) n,
 first_value(value) over (partition by source_id order by frame_index) fv,
 sum(value) over (partition by source_id order by frame_index rows between 4 preceding and current row) s from fx_timed)
select source_id,frame_index,round(case when n<5 then value else (s+greatest(5-rn,0)*fv)/5e0 end,6) as smooth from k""",
)
def wn2(spark, sf):
    t = fx.timed(spark, sf)
    return r6(wn.moving_average(t, ["source_id"], ["frame_index"], "value", 5, "smooth").select("source_id", "frame_index", "smooth"), "smooth")


@query(
    "wn3_rolling_mean",
    TIMED
    + """select source_id,frame_index,round(avg(value) over (partition by source_id order by frame_index rows between 29 preceding and current row),6) as m30
 from fx_timed""",
)
def wn3(spark, sf):
    t = fx.timed(spark, sf)
    return r6(wn.rolling_mean(t, ["source_id"], ["frame_index"], "value", 30, "m30").select("source_id", "frame_index", "m30"), "m30")


@query(
    "wn4_step_features",
    STREAM.rstrip()
    + """,
c as (select source_id,frame_index,frame_index//12 as run_id,(x1+x2)/2 as x,(y1+y2)/2 as y,confidence as r from fx_stream),
l as (select *,lag(x) over w as px,lag(y) over w as py,lag(r) over w as pr from c window w as (partition by source_id,run_id order by frame_index))
select source_id,frame_index,round(coalesce(sqrt((x-px)*(x-px)+(y-py)*(y-py)),0e0),6) as step_px,round(coalesce(r-pr,0e0),6) as radius_change from l""",
)
def wn4(spark, sf):
    st = fx.stream(spark, sf).select(
        "source_id",
        "frame_index",
        F.expr("frame_index div 12").alias("run_id"),
        ((F.col("x1") + F.col("x2")) / 2).alias("x"),
        ((F.col("y1") + F.col("y2")) / 2).alias("y"),
        F.col("confidence").alias("r"),
    )
    out = wn.step_features(st, ["source_id", "run_id"], ["frame_index"], "x", "y", "r")
    return r6(out.select("source_id", "frame_index", "step_px", "radius_change"), "step_px", "radius_change")


@query(
    "wn5_segment_sequences",
    STREAM.rstrip()
    + """,
l as (select source_id,frame_index,(y1+y2)/2 as y,lag(frame_index) over w as pf,lag((y1+y2)/2) over w as py from fx_stream
 window w as (partition by source_id order by frame_index))
select source_id,frame_index,cast(sum(case when pf is null or frame_index-pf>2 or y-py>5 then 1 else 0 end) over (partition by source_id order by frame_index) as bigint) as sequence_id from l""",
)
def wn5(spark, sf):
    st = fx.stream(spark, sf).withColumn("y", (F.col("y1") + F.col("y2")) / 2)
    out = wn.segment_sequences(st, ["source_id"], "frame_index", "y", 2, 5.0)
    return out.select("source_id", "frame_index", "sequence_id")


@query(
    "wn6_bursts",
    """with p as (select distinct user_id as src,cast(epoch_us(ts) as double)/1e6 as ts,event_id as seq,cast(round(value,0) as int) as size from events),
l as (select *,lag(ts) over (partition by src order by ts,seq,size) as pt from p),
b as (select *,sum(case when pt is null or ts-pt>21600 then 1 else 0 end) over (partition by src order by ts,seq,size) as burst_id from l)
select src,cast(burst_id as bigint) as burst_id,round(min(ts),3) as start_ts,round(max(ts),3) as end_ts,cast(sum(size) as bigint) as bytes,count(*) as packets,
 round((max(ts)-min(ts))*1000,3) as ms from b group by 1,2""",
)
def wn6(spark, sf):
    e = fx.table(spark, sf, "events")
    p = e.select(
        F.col("user_id").alias("src"),
        (fx.wall_micros(F.col("ts")).cast("double") / 1e6).alias("ts"),
        F.col("event_id").alias("seq"),
        F.round("value").cast("int").alias("size"),
    )
    out = wn.bursts(p, ["src"], 21600.0, ["src", "seq", "size"])
    return out.withColumns({c: F.round(c, 3) for c in ("start_ts", "end_ts", "ms")})


@query(
    "wn7_temporal_peaks",
    TIMED.rstrip()
    + """,
l as (select source_id,frame_index,value,lag(value) over w as a,lead(value) over w as b from fx_timed window w as (partition by source_id order by frame_index))
select source_id,frame_index,round(value,6) as value from l where value>=1e1 and value>=a and value>b""",
)
def wn7(spark, sf):
    out = wn.temporal_peaks(fx.timed(spark, sf), ["source_id"], "frame_index", "value", 10.0)
    return r6(out.select("source_id", "frame_index", "value"), "value")


@query(
    "wn8_cumulative_serial",
    """select event_id,event_type,row_number() over (partition by event_type order by ts,event_id) as cumulative_count,
 concat('D',lpad(cast(row_number() over (order by ts,event_id) as varchar),6,'0')) as serial_id from events""",
)
def wn8(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", "event_type", "ts")
    counted = wn.cumulative_counts(e, ["event_type"], ["ts", "event_id"])
    return wn.serial_ids(counted, ["ts", "event_id"], "D", 6).drop("ts")


WN9 = """t as (select source_id,cast(k*15 as bigint) as target from (select distinct source_id from fx_timed) a cross join (select unnest(range(1,5)) as k) b),
c as (select t.source_id,t.target,f.frame_index,f.value from t join fx_timed f on f.source_id=t.source_id and abs(f.frame_index-t.target)<=10),
w as (select source_id,target,list(frame_index order by value desc,frame_index) as wish from c group by 1,2),
e as (select *,row_number() over (partition by source_id order by target) rk from w),
s(source_id,rk,used,target,frame_index) as (
 select source_id,rk,[wish[1]],target,wish[1] from e where rk=1
 union all
 select e.source_id,e.rk,case when list_filter(e.wish,lambda x: not list_contains(s.used,x))[1] is null then s.used
  else list_append(s.used,list_filter(e.wish,lambda x: not list_contains(s.used,x))[1]) end,e.target,
  list_filter(e.wish,lambda x: not list_contains(s.used,x))[1] from s join e on s.source_id=e.source_id and e.rk=s.rk+1)
select source_id,target,cast(frame_index as bigint) as frame_index from s where frame_index is not null"""


@query("wn9_best_in_window", TIMED.rstrip() + ",\n" + WN9)
def wn9(spark, sf):
    f = fx.timed(spark, sf)
    targets = f.select("source_id").distinct().select(
        "source_id", F.explode(F.array(*[F.lit(15 * k).cast("long") for k in range(1, 5)])).alias("target")
    )
    out = wn.best_in_window(f.select("source_id", "frame_index", "value"), targets, ["source_id"], 10, "value")
    return out.select("source_id", "target", "frame_index")


@query(
    "jn13_latest_result",
    TIMED.rstrip()
    + """,
r as (select source_id,frame_index+3+event_id%4 as done,frame_index as result_frame from fx_timed where event_type='purchase'),
r1 as (select source_id,done,max(result_frame) as result_frame from r group by 1,2)
select f.source_id,f.frame_index,r1.result_frame as latest_result,
 case when r1.result_frame is null then 0 else greatest(0,f.frame_index-r1.result_frame) end as lag_frames
 from fx_timed f asof left join r1 on f.source_id=r1.source_id and f.frame_index>=r1.done""",
)
def jn13(spark, sf):
    f = fx.timed(spark, sf)
    results = f.filter("event_type = 'purchase'").select(
        "source_id", (F.col("frame_index") + 3 + F.col("event_id") % 4).alias("done"), F.col("frame_index").alias("result_frame")
    )
    return wn.latest_result(f, results, ["source_id"], "frame_index", "done")


@query(
    "ag22_percentiles",
    "select metric,"
    + ",".join(f"round(quantile_cont(v,{m / 100}),6) as p{m}" for m in (1, 5, 50, 95, 99))
    + """ from (select 'quantity' as metric,l_quantity as v from lineitem union all select 'price',l_extendedprice from lineitem
 union all select 'tax',l_tax from lineitem) z group by 1""",
)
def ag22(spark, sf):
    li = fx.table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax")
    )
    out = tl.percentile_table(li, [], ["quantity", "price", "tax"])
    return r6(out, *[f"p{m}" for m in (1, 5, 50, 95, 99)])


@query(
    "ag22_distribution",
    """select l_returnflag,round(min(l_quantity),6) as minimum,round(avg(l_quantity),6) as mean,round(max(l_quantity),6) as maximum,
 round(quantile_cont(l_quantity,5e-2),6) as p05,round(quantile_cont(l_quantity,95e-2),6) as p95 from lineitem group by 1""",
)
def ag22d(spark, sf):
    li = fx.table(spark, sf, "lineitem").select("l_returnflag", "l_quantity")
    return r6(tl.distribution(li, ["l_returnflag"], "l_quantity"), "minimum", "mean", "maximum", "p05", "p95")


@query(
    "ag23_timing_summary",
    """select event_type,round(avg(value),6) as mean_ms,round(quantile_cont(value,5e-1),6) as median_ms,round(quantile_cont(value,95e-2),6) as p95_ms,
 min(value) as min_ms,max(value) as max_ms,round(1000e0/avg(value),6) as mean_fps from events group by 1""",
)
def ag23(spark, sf):
    e = fx.table(spark, sf, "events")
    return r6(tl.timing_summary(e, ["event_type"], "value"), "mean_ms", "median_ms", "p95_ms", "mean_fps")


@query(
    "ag23_count_summary",
    TIMED.rstrip()
    + """,
l as (select source_id,detections,abs(detections-lag(detections) over (partition by source_id order by frame_index)) as d from fx_timed)
select source_id,min(detections) as minimum,max(detections) as maximum,round(avg(detections),6) as mean,
 round(quantile_cont(cast(detections as double),5e-1),6) as median,round(coalesce(avg(d),0e0),6) as mean_absolute_frame_delta from l group by 1""",
)
def ag23c(spark, sf):
    out = tl.count_summary(fx.timed(spark, sf), ["source_id"], ["frame_index"], "detections")
    return r6(out, "mean", "median", "mean_absolute_frame_delta")


@query(
    "ag18_box_size_stats",
    fx.ctes("fx_gt").rstrip()
    + """,
r as (select class_id,w,row_number() over (partition by class_id order by w)-1 as i,count(*) over (partition by class_id)-1 as n from fx_gt)
select class_id,"""
    + ",".join(
        f"round(max(case when i=round_even(n*{q},0) then w end),6) as {name}"
        for name, q in (("minimum", "0e0"), ("p10", "1e-1"), ("median", "5e-1"), ("p90", "9e-1"), ("maximum", "1e0"))
    )
    + " from r group by 1",
)
def ag18(spark, sf):
    t = fx.gt(spark, sf).select("class_id", "w")
    return r6(tl.nearest_rank(t, ["class_id"], "w"), "minimum", "p10", "median", "p90", "maximum")


@query(
    "ag18_truncated_p95",
    """with r as (select event_type,value,row_number() over (partition by event_type order by value)-1 as i,count(*) over (partition by event_type)-1 as n from events)
select event_type,max(case when i=floor(n*95e-2) then value end) as p95 from r group by 1""",
)
def ag18t(spark, sf):
    from boxtrail.operators.ordered import quantiles

    e = fx.table(spark, sf, "events")
    return quantiles(e, ["event_type"], F.col("value"), {"p95": 0.95}, "truncated")


@query(
    "ag24_hardware_summary",
    """with r as (select o_orderstatus as build,o_orderkey%7<>0 as exact,case when o_orderkey%7=0 then o_orderkey%5 else 0 end as mismatches,
 case when o_orderkey%7=0 then o_totalprice/1e6 else 0e0 end as max_error,cast(3000000+o_custkey as double) as cycles,1e1+cast(o_custkey%100 as double)/1e1 as latency_ms from orders)
select build,count(*) filter (exact) as frames_exact,bool_and(exact) as all_exact,cast(sum(mismatches) as bigint) as mismatches,round(max(max_error),6) as max_error,
 min(cycles) as cycles_min,round(avg(cycles),4) as cycles_mean,max(cycles) as cycles_max,min(latency_ms) as latency_ms_min,round(avg(latency_ms),6) as latency_ms_mean,
 max(latency_ms) as latency_ms_max,round(min(1000e0/latency_ms),6) as fps_min,round(avg(1000e0/latency_ms),6) as fps_mean,round(max(1000e0/latency_ms),6) as fps_max from r group by 1""",
)
def ag24(spark, sf):
    o = fx.table(spark, sf, "orders")
    bad = F.col("o_orderkey") % 7 == 0
    r = o.select(
        F.col("o_orderstatus").alias("build"),
        (~bad).alias("exact"),
        F.when(bad, F.col("o_orderkey") % 5).otherwise(0).alias("mismatches"),
        F.when(bad, F.col("o_totalprice") / 1e6).otherwise(0.0).alias("max_error"),
        (3000000 + F.col("o_custkey")).cast("double").alias("cycles"),
        (10 + (F.col("o_custkey") % 100).cast("double") / 10).alias("latency_ms"),
    )
    out = tl.hardware_summary(r, ["build"])
    out = out.withColumn("cycles_mean", F.round("cycles_mean", 4))
    return r6(out, "max_error", "latency_ms_mean", "fps_min", "fps_mean", "fps_max")


@query(
    "ag25_run_report",
    TIMED
    + """select a.run_id,a.cell_crossings,a.droplet_crossings,a.verified,a.edge_hits,b.lag_mean,b.frames,b.lag_p95,c.payload_mean,c.payload_max,e.coasted_updates from
 (select source_id%10 as run_id,count(*) filter (event_id%2=0) as cell_crossings,count(*) filter (event_id%2=1) as droplet_crossings,
  count(*) filter (value>1e1) as verified,count(*) filter (detections=0) as edge_hits from fx_timed where event_type='purchase' group by 1) a
 join (select source_id%10 as run_id,round(avg(detections),6) as lag_mean,count(*) as frames,round(quantile_cont(cast(detections as double),95e-2),6) as lag_p95 from fx_timed group by 1) b using (run_id)
 join (select source_id%10 as run_id,round(avg(value),6) as payload_mean,max(value) as payload_max from fx_timed where event_type<>'error' group by 1) c using (run_id)
 join (select source_id%10 as run_id,count(*) filter (event_type='error') as coasted_updates from fx_timed group by 1) e using (run_id)""",
)
def ag25(spark, sf):
    t = fx.timed(spark, sf).withColumn("run_id", F.col("source_id") % 10)
    crossings = t.filter("event_type = 'purchase'").select(
        "run_id",
        F.when(F.col("event_id") % 2 == 0, "cell").otherwise("droplet").alias("class_name"),
        (F.col("value") > 10).alias("verified"),
        (F.col("detections") == 0).alias("edge"),
    )
    lag = t.select("run_id", F.col("detections").alias("lag_frames"))
    sent = t.filter("event_type <> 'error'").select("run_id", F.col("value").alias("payload_bytes"))
    updates = t.select("run_id", F.when(F.col("event_type") == "error", "coasted").otherwise("observation").alias("kind"))
    return r6(tl.run_report(crossings, lag, sent, ["run_id"], updates), "lag_mean", "lag_p95", "payload_mean")


def _z(col, src):
    return f"abs({col}-m_{col})/greatest(14826e-4*d_{col},1e-6)"


FEATS = """,
fr as (select fc.image_id,cast(cells as double) as cells,cast(droplets as double) as droplets,uncertainty,q.sharpness,q.brightness,q.contrast from fc join (
 select image_id,avg(w)*1e3 as sharpness,avg(cx)*255e0 as brightness,avg(h)*1e3 as contrast from fx_gt group by 1) q using (image_id)),
md as (select """ + ",".join(f"quantile_cont({c},5e-1) as m_{c}" for c in tl.HARD_WEIGHTS) + """ from fr),
ad as (select """ + ",".join(f"quantile_cont(abs({c}-m_{c}),5e-1) as d_{c}" for c in tl.HARD_WEIGHTS) + """ from fr,md)
"""


def hard_frames(spark, sf):
    q = fx.gt(spark, sf).groupBy("image_id").agg(
        (F.avg("w") * 1000).alias("sharpness"), (F.avg("cx") * 255).alias("brightness"), (F.avg("h") * 1000).alias("contrast")
    )
    return frame_counts(spark, sf).join(q, "image_id")


@query(
    "ag27_robust_z",
    DET.rstrip() + ",\n" + FRAME_COUNTS + FEATS
    + f"select image_id,round({_z('cells', 'fr')},5) as z_cells,round({_z('sharpness', 'fr')},5) as z_sharpness from fr,md,ad",
)
def ag27(spark, sf):
    out = tl.robust_z(hard_frames(spark, sf), [], ["cells", "sharpness"])
    return out.select("image_id", F.round("z_cells", 5).alias("z_cells"), F.round("z_sharpness", 5).alias("z_sharpness"))


@query(
    "ag27_robust_threshold",
    """with m as (select event_type,quantile_cont(value,5e-1) as md from events group by 1),
d as (select e.event_type,md,quantile_cont(abs(value-md),5e-1) as mad from events e join m using (event_type) group by 1,2)
select event_type,round(greatest(12e0,md+25e-1*greatest(14826e-4*mad,1e0)),6) as threshold from d""",
)
def ag27t(spark, sf):
    return r6(tl.robust_threshold(fx.table(spark, sf, "events"), ["event_type"], "value", 2.5, 12.0), "threshold")


@query(
    "ag28_hard_score",
    DET.rstrip() + ",\n" + FRAME_COUNTS + FEATS
    + "select image_id,round("
    + "+".join(f"{w}*{_z(c, 'fr')}" for c, w in tl.HARD_WEIGHTS.items())
    + "+8e-1*uncertainty,4) as hard_score from fr,md,ad",
)
def ag28(spark, sf):
    out = tl.hard_score(hard_frames(spark, sf), [])
    return out.select("image_id", F.round("hard_score", 4).alias("hard_score"))


@query(
    "ag31_command_counts",
    """select command,count(*) as count,starts_with(command,'get ') as is_get from (
 select concat(case when event_id%3=0 then 'get ' else 'set ' end,event_type,' ',cast(user_id%5 as varchar)) as command from events) z
 group by 1 order by 2 desc,1 limit 15""",
)
def ag31(spark, sf):
    e = fx.table(spark, sf, "events")
    verb = F.when(F.col("event_id") % 3 == 0, "get ").otherwise("set ")
    p = e.select(F.concat(verb, "event_type", F.lit(" "), (F.col("user_id") % 5).cast("string")).alias("command"))
    return tl.command_counts(p, 15)


@query(
    "ag32_compare_vectors",
    """with v as (select label,vec_id,generate_subscripts(embedding,1) as i,unnest(embedding) as x from embeddings),
p as (select label,cast(x as double) as a,round_even(cast(x as double)/1e-2,0)*1e-2 as b from v)
select label,count(*) as n,count(*) filter (abs(a-b)=0) as exact,count(*) filter (abs(a-b)<=1e-6) as tolerant,round(avg(abs(a-b)),8) as mae,
 round(max(abs(a-b)),8) as max_error,round(min(a),6) as minimum,round(max(a),6) as maximum from p group by 1""",
)
def ag32(spark, sf):
    v = fx.table(spark, sf, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "x"))
    a = v.select("label", "vec_id", "i", F.col("x").cast("double").alias("x"))
    b = a.withColumn("x", F.rint(F.col("x") / 0.01) * 0.01)
    out = tl.compare_vectors(a, b, ["label", "vec_id", "i"], "x", ["label"])
    out = out.withColumns({"mae": F.round("mae", 8), "max_error": F.round("max_error", 8)})
    return r6(out, "minimum", "maximum")


@query(
    "ag33_parity_report",
    """with p as (select event_id,value>1e1 as e,round_even(value,0)>1e1 as a from events),
f as (select list(event_id order by event_id) as l from (select event_id from p where e<>a order by event_id limit 20) z)
select count(*) as vectors,count(*) filter (e=a) as exact,count(*) filter (e<>a) as mismatches,round(count(*) filter (e=a)*1e0/count(*),6) as accuracy,
 any_value(array_to_string(l,',')) as first_mismatches from p,f""",
)
def ag33(spark, sf):
    e = fx.table(spark, sf, "events").select(
        "event_id", (F.col("value") > 10).alias("e"), (F.rint("value") > 10).alias("a")
    )
    out = tl.parity_report(e, "e", "a", "event_id")
    return r6(out, "accuracy").withColumn("first_mismatches", F.array_join(F.col("first_mismatches").cast("array<string>"), ","))


@query(
    "ag34_grid_sample_score",
    fx.ctes("fx_gt").rstrip()
    + """,
g as (select image_id,class_id,l_partkey%3=0 as t,cast(l_partkey%100 as double)/1e2>=(case when class_id=0 then 4e-1 else 6e-1 end) as p from fx_gt),
c as (select image_id,class_id,count(*) filter (t and p) tp,count(*) filter (not t and p) fp,count(*) filter (t and not p) fn from g group by 1,2)
select image_id,round(avg(case when 2*tp+fp+fn=0 then 1e0 else 2e0*tp/(2*tp+fp+fn) end),6) as sample_score from c group by 1""",
)
def ag34(spark, sf):
    t = fx.gt(spark, sf).select(
        "image_id",
        "class_id",
        (F.col("l_partkey") % 3 == 0).cast("int").alias("truth"),
        ((F.col("l_partkey") % 100).cast("double") / 100).alias("p"),
    )
    return r6(ds.grid_sample_score(t, ["image_id"], "truth", "p", {0: 0.4, 1: 0.6}), "sample_score")


@query(
    "fn_histogram_entropy",
    """with b as (select l_suppkey,least(63,floor(cast(l_partkey%256 as double)/4e0)) as bin,count(*) as c from lineitem group by 1,2),
t as (select l_suppkey,sum(c) as n from b group by 1)
select l_suppkey,round(-sum(c*1e0/n*log2(c*1e0/n)),6) as entropy from b join t using (l_suppkey) group by 1""",
)
def fn_entropy(spark, sf):
    from boxtrail.functions.stats import histogram_entropy

    li = fx.table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") % 256).cast("double").alias("v"))
    return r6(histogram_entropy(li, ["l_suppkey"], "v"), "entropy")


@query(
    "fn_patch_stats",
    """with v as (select l_suppkey,l_partkey%256 as g from lineitem where l_linenumber>1),
b as (select l_suppkey,least(floor(g/4e0),63) as bin,count(*) as c from v group by 1,2),
t as (select l_suppkey,sum(c) as n from b group by 1),
e as (select l_suppkey,round(-sum(c*1e0/n*log2(c*1e0/n)),6) as entropy from b join t using (l_suppkey) group by 1),
s as (select l_suppkey,round(avg(g),6) as mean,round(stddev_pop(g),6) as std,round(quantile_cont(cast(g as double),5e-1),6) as median,
 round(quantile_cont(cast(g as double),1e-1),6) as p10,round(quantile_cont(cast(g as double),9e-1),6) as p90 from v group by 1)
select l_suppkey,mean,std,median,p10,p90,round(p90-p10,6) as contrast,entropy from s join e using (l_suppkey)""",
)
def fn_patch(spark, sf):
    """Gray values of masked pixels; the first line of an order lies outside the mask."""
    from boxtrail.functions.stats import gray_patch_stats

    gray = F.when(F.col("l_linenumber") > 1, F.col("l_partkey") % 256)
    rows = fx.table(spark, sf, "lineitem").select("l_suppkey", gray.alias("g"))
    return r6(gray_patch_stats(rows, ["l_suppkey"], "g"), "mean", "std", "median", "p10", "p90", "contrast", "entropy")


@query(
    "fn_slug",
    r"select page_id,regexp_replace(regexp_replace(lower(url),'[^\p{L}\p{N}]','_','g'),'^_+|_+$','','g') as slug from pages",
)
def fn_slug(spark, sf):
    from boxtrail.functions.stats import slug

    return fx.table(spark, sf, "pages").select("page_id", slug(F.col("url")).alias("slug"))


@query(
    "fn_arg_index",
    "select vec_id,list_position(embedding,list_max(embedding))-1 as largest,list_position(embedding,list_min(embedding))-1 as smallest from embeddings",
)
def fn_arg(spark, sf):
    from boxtrail.functions.stats import arg_index

    v = F.col("embedding")
    return fx.table(spark, sf, "embeddings").select(
        "vec_id", arg_index(v, F.array_max(v)).alias("largest"), arg_index(v, F.array_min(v)).alias("smallest")
    )


@query("fn_frame_time", fx.ctes("fx_frames").rstrip() + " select event_id,frame_index*40000 as at_us from fx_frames")
def fn_time(spark, sf):
    """Event time of every frame at 25 frames a second, in microseconds."""
    from boxtrail.streaming.streams import frame_time

    return fx.frames(spark, sf).select("event_id", F.unix_micros(frame_time("frame_index", 25.0)).alias("at_us"))
