"""Registered queries: pairing, matching, suppression, fusion and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boxtrail.operators import matching as m, metrics as mt
from boxtrail.plans import fixtures as fx
from boxtrail.plans.registry import query
from boxtrail.plans.sqltext import BEST, COUNTS, big, iou, matched, pairs, prf


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def both(spark, sf):
    truth = fx.gt(spark, sf)
    return fx.det(spark, sf, truth), truth


@query(
    "jn1_iou_pairs",
    fx.ctes("fx_gt", "fx_det").rstrip()
    + ",\n"
    + pairs(0.5)
    + " select image_id,class_id,det_idx,gt_idx,round(iou,6) as iou from pairs",
)
def jn1(spark, sf):
    d, t = both(spark, sf)
    return r6(m.pair(d, t, 0.5).drop("confidence"), "iou")


@query(
    "jn2_match_best",
    matched(0.5) + " select image_id,class_id,det_idx,gt_idx,round(iou,6) as iou from best",
)
def jn2(spark, sf):
    d, t = both(spark, sf)
    return r6(m.match_best(d, t, 0.5).drop("confidence"), "iou")


@query(
    "ag1_detection_metrics",
    matched(0.5).rstrip()
    + ",\n"
    + COUNTS
    + f""" select coalesce(class_id,-1) as class_id,{big('tp', 'fp', 'fn')},{prf()} from (
 select class_id,tp,fp,fn from cnt union all select null,sum(tp),sum(fp),sum(fn) from cnt) z""",
)
def ag1(spark, sf):
    d, t = both(spark, sf)
    rows = mt.detection_metrics(d, t, m.match_best(d, t, 0.5))
    rows = rows.withColumn("class_id", F.coalesce("class_id", F.lit(-1)))
    return r6(rows, "precision", "recall", "f1")


@query(
    "jn3_match_greedy_iou",
    fx.ctes("fx_gt", "fx_det").rstrip()
    + ",\n"
    + pairs(0.3)
    + """,
e as (select *,row_number() over (partition by image_id,class_id order by iou desc,det_idx desc,gt_idx desc) rk from pairs),
s(image_id,class_id,rk,ds,gs,ok,det_idx,gt_idx,iou) as (
 select image_id,class_id,rk,[cast(det_idx as bigint)],[cast(gt_idx as bigint)],true,det_idx,gt_idx,iou from e where rk=1
 union all
 select e.image_id,e.class_id,e.rk,
  case when list_contains(s.ds,e.det_idx) or list_contains(s.gs,e.gt_idx) then s.ds else list_append(s.ds,e.det_idx) end,
  case when list_contains(s.ds,e.det_idx) or list_contains(s.gs,e.gt_idx) then s.gs else list_append(s.gs,e.gt_idx) end,
  not (list_contains(s.ds,e.det_idx) or list_contains(s.gs,e.gt_idx)),e.det_idx,e.gt_idx,e.iou
 from s join e on s.image_id=e.image_id and s.class_id=e.class_id and e.rk=s.rk+1)
select image_id,class_id,det_idx,gt_idx,round(iou,6) as iou from s where ok""",
)
def jn3(spark, sf):
    d, t = both(spark, sf)
    return r6(m.match_greedy_iou(d, t, 0.3), "iou")


@query(
    "jn4_match_center",
    fx.ctes("fx_gt", "fx_det").rstrip()
    + """,
c as (select d.image_id,d.det_idx,g.gt_idx,
 sqrt(((d.x1+d.x2)/2-(g.x1+g.x2)/2)*((d.x1+d.x2)/2-(g.x1+g.x2)/2)+((d.y1+d.y2)/2-(g.y1+g.y2)/2)*((d.y1+d.y2)/2-(g.y1+g.y2)/2)) as dist
 from fx_det d join fx_gt g on d.image_id=g.image_id),
w as (select image_id,det_idx,list(gt_idx order by dist,gt_idx) as wish from c where dist<=65e-3 group by 1,2),
e as (select *,row_number() over (partition by image_id order by det_idx) rk from w),
s(image_id,rk,used,det_idx,gt_idx) as (
 select image_id,rk,[wish[1]],det_idx,wish[1] from e where rk=1
 union all
 select e.image_id,e.rk,case when list_filter(e.wish,lambda x: not list_contains(s.used,x))[1] is null then s.used
   else list_append(s.used,list_filter(e.wish,lambda x: not list_contains(s.used,x))[1]) end,
  e.det_idx,list_filter(e.wish,lambda x: not list_contains(s.used,x))[1]
 from s join e on s.image_id=e.image_id and e.rk=s.rk+1)
select image_id,det_idx,cast(gt_idx as bigint) as gt_idx from s where gt_idx is not null""",
)
def jn4(spark, sf):
    d, t = both(spark, sf)
    return m.match_center(d, t).select("image_id", "det_idx", "gt_idx")


@query(
    "so1_nms",
    fx.ctes("fx_gt", "fx_det").rstrip()
    + f""",
e as (select *,row_number() over (partition by image_id,class_id order by confidence desc,det_idx) rk from fx_det),
s(image_id,class_id,rk,kept,ok,det_idx,confidence) as (
 select image_id,class_id,rk,[{{'x1':x1,'y1':y1,'x2':x2,'y2':y2}}],true,det_idx,confidence from e where rk=1
 union all
 select e.image_id,e.class_id,e.rk,
  case when len(list_filter(s.kept,lambda k: {iou('k', 'e')}>45e-2))=0
   then list_append(s.kept,{{'x1':e.x1,'y1':e.y1,'x2':e.x2,'y2':e.y2}}) else s.kept end,
  len(list_filter(s.kept,lambda k: {iou('k', 'e')}>45e-2))=0,e.det_idx,e.confidence
 from s join e on s.image_id=e.image_id and s.class_id=e.class_id and e.rk=s.rk+1)
select image_id,class_id,det_idx,round(confidence,6) as confidence from s where ok""",
)
def so1(spark, sf):
    d, _ = both(spark, sf)
    return r6(m.nms(d, 0.45).select("image_id", "class_id", "det_idx", "confidence"), "confidence")


@query(
    "so1_nms_topk",
    fx.ctes("fx_gt", "fx_det").rstrip()
    + f""",
e0 as (select *,row_number() over (partition by image_id,class_id order by confidence desc,det_idx) rk from fx_det),
e as (select * from e0 where rk<=5),
s(image_id,class_id,rk,kept,ok,det_idx) as (
 select image_id,class_id,rk,[{{'x1':x1,'y1':y1,'x2':x2,'y2':y2}}],true,det_idx from e where rk=1
 union all
 select e.image_id,e.class_id,e.rk,
  case when len(s.kept)<3 and len(list_filter(s.kept,lambda k: {iou('k', 'e')}>45e-2))=0
   then list_append(s.kept,{{'x1':e.x1,'y1':e.y1,'x2':e.x2,'y2':e.y2}}) else s.kept end,
  len(s.kept)<3 and len(list_filter(s.kept,lambda k: {iou('k', 'e')}>45e-2))=0,e.det_idx
 from s join e on s.image_id=e.image_id and s.class_id=e.class_id and e.rk=s.rk+1)
select image_id,class_id,det_idx from s where ok""",
)
def so1_topk(spark, sf):
    """Top 5 candidates per class enter, at most 3 leave: both numbers are the operator's own settings."""
    d, _ = both(spark, sf)
    return m.nms(d, 0.45, pre_topk=5, max_detections=3).select("image_id", "class_id", "det_idx")


@query(
    "so2_suppress_nearby",
    fx.ctes("fx_cand").rstrip()
    + """,
e as (select *,row_number() over (partition by sequence_id order by proposal_score desc,candidate_idx) rk from fx_cand),
s(sequence_id,rk,kept,ok,candidate_idx) as (
 select sequence_id,rk,[{'x':center_x_px,'y':center_y_px}],true,candidate_idx from e where rk=1
 union all
 select e.sequence_id,e.rk,
  case when len(list_filter(s.kept,lambda k: sqrt((k.x-e.center_x_px)*(k.x-e.center_x_px)+(k.y-e.center_y_px)*(k.y-e.center_y_px))<20e0))=0
   then list_append(s.kept,{'x':e.center_x_px,'y':e.center_y_px}) else s.kept end,
  len(list_filter(s.kept,lambda k: sqrt((k.x-e.center_x_px)*(k.x-e.center_x_px)+(k.y-e.center_y_px)*(k.y-e.center_y_px))<20e0))=0,
  e.candidate_idx
 from s join e on s.sequence_id=e.sequence_id and e.rk=s.rk+1)
select sequence_id,candidate_idx from s where ok""",
)
def so2(spark, sf):
    c = fx.candidates(spark, sf)
    kept = m.suppress_nearby(
        c, ["sequence_id"], "proposal_score", "candidate_idx", 20.0, xy=("center_x_px", "center_y_px")
    )
    return kept.select("sequence_id", "candidate_idx")


@query(
    "jn7_fuse_boxes",
    fx.ctes("fx_gt", "fx_det").rstrip()
    + f""",
a as (select image_id,det_idx,x1,y1,x2,y2 from fx_det where det_idx%2=0),
b as (select image_id,det_idx,x1,y1,x2,y2 from fx_det where det_idx%2=1),
seed as (select image_id,list({{'x1':x1,'y1':y1,'x2':x2,'y2':y2}} order by det_idx) as kept from a group by 1),
e as (select *,row_number() over (partition by image_id order by det_idx) rk from b),
clash(image_id) as (select 1),
s(image_id,rk,kept,ok,det_idx) as (
 select image_id,cast(0 as bigint),kept,false,cast(-1 as bigint) from seed
 union all
 select e.image_id,e.rk,case when len(list_filter(s.kept,lambda k: {iou('k', 'e')}>=15e-2 or
   sqrt(power((k.x1+k.x2)/2-(e.x1+e.x2)/2,2)+power((k.y1+k.y2)/2-(e.y1+e.y2)/2,2))<=55e-3))=0
   then list_append(s.kept,{{'x1':e.x1,'y1':e.y1,'x2':e.x2,'y2':e.y2}}) else s.kept end,
  len(list_filter(s.kept,lambda k: {iou('k', 'e')}>=15e-2 or
   sqrt(power((k.x1+k.x2)/2-(e.x1+e.x2)/2,2)+power((k.y1+k.y2)/2-(e.y1+e.y2)/2,2))<=55e-3))=0,cast(e.det_idx as bigint)
 from s join e on s.image_id=e.image_id and e.rk=s.rk+1)
select image_id,cast(1 as int) as source,det_idx from s where ok
union all select image_id,cast(0 as int),cast(det_idx as bigint) from a""",
)
def jn7(spark, sf):
    d, _ = both(spark, sf)
    first, second = d.filter("det_idx % 2 = 0"), d.filter("det_idx % 2 = 1")
    out = m.fuse_boxes(first, second)
    return out.select("image_id", "source", F.col("det_idx").cast("long").alias("det_idx"))


FREE = "list_filter(e1.wish,lambda x: not list_contains(s1.used,x))[1]"
CLEAR = f"len(list_filter(s2.kept,lambda k: {iou('k', 'cd')}>=3e-1))=0"
REFINE = (
    fx.ctes("fx_gt", "fx_det").rstrip()
    + ",\n"
    + pairs(0.5)
    + f""",
w as (select image_id,class_id,gt_idx,list(det_idx order by iou desc,det_idx desc) as wish from pairs group by 1,2,3),
e1 as (select *,row_number() over (partition by image_id,class_id order by gt_idx) as rk from w),
s1(image_id,class_id,rk,used,gt_idx,det_idx) as (
 select image_id,class_id,rk,[wish[1]],gt_idx,wish[1] from e1 where rk=1
 union all
 select e1.image_id,e1.class_id,e1.rk,case when {FREE} is null then s1.used else list_append(s1.used,{FREE}) end,e1.gt_idx,{FREE}
 from s1 join e1 on e1.image_id=s1.image_id and e1.class_id=s1.class_id and e1.rk=s1.rk+1),
ln as (select s1.image_id,s1.class_id,s1.gt_idx,s1.det_idx,p.iou from s1 join pairs p on p.image_id=s1.image_id and p.class_id=s1.class_id and p.gt_idx=s1.gt_idx and p.det_idx=s1.det_idx),
rf as (select g.image_id,g.class_id,ln.iou,"""
    + ",".join(f"case when ln.det_idx is null then g.{c} else 5e-1*g.{c}+5e-1*d.{c} end as {c}" for c in ("x1", "y1", "x2", "y2"))
    + f""" from fx_gt g left join ln on ln.image_id=g.image_id and ln.class_id=g.class_id and ln.gt_idx=g.gt_idx
 left join fx_det d on d.image_id=ln.image_id and d.class_id=ln.class_id and d.det_idx=ln.det_idx),
cd as (select d.*,row_number() over (partition by image_id,class_id order by confidence desc,det_idx) as rk from fx_det d
 where confidence>=case when class_id=0 then 7e-1 else 75e-2 end and not exists (select 1 from ln where ln.image_id=d.image_id and ln.class_id=d.class_id and ln.det_idx=d.det_idx)),
s2(image_id,class_id,rk,kept,ok) as (
 select image_id,class_id,cast(0 as bigint),list({{'x1':x1,'y1':y1,'x2':x2,'y2':y2}}),false from rf group by 1,2
 union all
 select cd.image_id,cd.class_id,cd.rk,case when {CLEAR} then list_append(s2.kept,{{'x1':cd.x1,'y1':cd.y1,'x2':cd.x2,'y2':cd.y2}}) else s2.kept end,{CLEAR}
 from s2 join cd on cd.image_id=s2.image_id and cd.class_id=s2.class_id and cd.rk=s2.rk+1),
t as (select (select count(distinct image_id) from fx_gt) as images,(select count(*) from rf) as ground_truth,(select count(*) from ln) as matched,
 (select count(*) from s2 where ok) as added,(select avg(iou) from ln) as mi)
select images,ground_truth,matched,added,ground_truth+added as output,round(mi,6) as mean_match_iou from t"""
)


@query("jn5_refine_labels_totals", REFINE)
def jn5(spark, sf):
    """Totals over all images of teacher refinement with blend one half."""
    d, t = both(spark, sf)
    _, totals = m.refine_labels(t, d, 0.5, 0.5, {0: 0.7, 1: 0.75}, 0.3)
    weighted = F.sum(F.col("mean_match_iou") * F.col("matched")) / F.greatest(F.sum("matched"), F.lit(1))
    return totals.agg(
        F.count(F.lit(1)).alias("images"),
        *[F.sum(c).alias(c) for c in ("ground_truth", "matched", "added", "output")],
        F.round(weighted, 6).alias("mean_match_iou"),
    )


JN6_SQL = (
    fx.ctes("fx_gt", "fx_det", settled=True).rstrip()
    + """,
small as materialized (select image_id,det_idx,(x1+x2)/2 as cx,(y1+y2)/2 as cy from fx_det where class_id=0),
large as materialized (select image_id,(x1+x2)/2 as cx,(y1+y2)/2 as cy,(x2-x1)*13e-1/2 as rx,(y2-y1)*13e-1/2 as ry from fx_det where class_id=1),
inside as materialized (select image_id,det_idx from (select c.image_id,c.det_idx,case when c.cx between d.cx-d.rx and d.cx+d.rx then 1 else 0 end
 +case when c.cy between d.cy-d.ry and d.cy+d.ry then 1 else 0 end as axes from small c join large d on c.image_id=d.image_id) z group by 1,2 having max(axes)=2)
select image_id,class_id,det_idx from fx_det left join (select image_id,det_idx,true as held from inside) i using (image_id,det_idx)
 where class_id<>0 or confidence>=9e-1 or held"""
)


@query("jn6_associate", JN6_SQL)
def jn6(spark, sf):
    from boxtrail.operators.guards import associate

    d, _ = both(spark, sf)
    return associate(d, 1.3, True, 0.9).select("image_id", "class_id", "det_idx")


@query(
    "jn18_best_iou_per_truth",
    fx.ctes("fx_gt", "fx_det").rstrip()
    + f"""
select g.image_id,g.class_id,g.gt_idx,round(coalesce(max({iou('d', 'g')}),0e0),6) as best_iou,
 bool_or(g.x1<=5e-2 or g.y1<=5e-2 or g.x2>=95e-2 or g.y2>=95e-2) as edge
from fx_gt g left join fx_det d on d.image_id=g.image_id and d.class_id=g.class_id group by 1,2,3""",
)
def jn18(spark, sf):
    from boxtrail.operators.failures import best_iou_per_truth

    d, t = both(spark, sf)
    return r6(best_iou_per_truth(d, t, 0.05), "best_iou")


@query(
    "ag26_missed_by_edge",
    fx.ctes("fx_gt", "fx_det").rstrip()
    + f""",
b as (select g.image_id,g.class_id,g.gt_idx,coalesce(max({iou('d', 'g')}),0e0) as best_iou,
 bool_or(g.x1<=5e-2 or g.y1<=5e-2 or g.x2>=95e-2 or g.y2>=95e-2) as edge
from fx_gt g left join fx_det d on d.image_id=g.image_id and d.class_id=g.class_id group by 1,2,3)
select class_id,count(*) as truths,count(*) filter (best_iou<5e-1) as missed,
 count(*) filter (best_iou<5e-1 and edge) as missed_edge,count(*) filter (best_iou<5e-1 and not edge) as missed_interior,
 round(avg(best_iou),6) as mean_best_iou from b group by 1""",
)
def ag26(spark, sf):
    from boxtrail.operators.failures import best_iou_per_truth, missed_by_edge

    d, t = both(spark, sf)
    return r6(missed_by_edge(best_iou_per_truth(d, t, 0.05), 0.5), "mean_best_iou")


PER_IMAGE = """,
nd as (select image_id,class_id,count(*) c from fx_det group by 1,2),ng as (select image_id,class_id,count(*) c from fx_gt group by 1,2),
nt as (select image_id,class_id,count(*) c,avg(iou) i from best group by 1,2),
ic as (select g.image_id,g.class_id,coalesce(t.c,0) tp,coalesce(d.c,0)-coalesce(t.c,0) fp,g.c-coalesce(t.c,0) fn,t.i
 from ng g left join nd d using (image_id,class_id) left join nt t using (image_id,class_id))"""


@query(
    "ag26_per_image_metrics",
    matched(0.5).rstrip()
    + PER_IMAGE
    + f""",
im as (select image_id,sum(tp) tp,sum(fp) fp,sum(fn) fn,sum(i*tp) s from ic group by 1)
select image_id,{big('tp', 'fp', 'fn')},{prf()},round(case when tp>0 then s/tp end,6) as matched_mean_iou from im""",
)
def ag26_images(spark, sf):
    from boxtrail.operators.failures import per_image_metrics

    d, t = both(spark, sf)
    return r6(per_image_metrics(d, t, m.match_best(d, t, 0.5)), "precision", "recall", "f1", "matched_mean_iou")


@query(
    "pr26_image_status",
    matched(0.5).rstrip()
    + PER_IMAGE
    + """ select image_id,case when fp>0 and fn>0 then 'mixed' when fn>0 then 'miss' when fp>0 then 'false_positive' else 'correct' end as status
 from ic where class_id=1""",
)
def pr26(spark, sf):
    from boxtrail.functions.scores import image_status
    from boxtrail.operators.metrics import match_counts

    d, t = both(spark, sf)
    rows = match_counts(d, t, m.match_best(d, t, 0.5), ["image_id", "class_id"])
    rows = rows.filter("class_id = 1 and tp + fn > 0")
    return rows.select("image_id", image_status(F.col("fp"), F.col("fn")).alias("status"))


PR27_SQL = (
    fx.ctes("fx_gt", "fx_det").rstrip()
    + ",\n"
    + pairs(0.5)
    + ",\n"
    + BEST
    + ",\n"
    + (pairs(0.3) + ",\n" + BEST)
    .replace("pairs", "qairs")
    .replace("b1", "c1")
    .replace("b2", "c2")
    .replace("best as", "west as")
    + """,
k as (select g.image_id,g.class_id,g.c ng,coalesce(d.c,0) nd,coalesce(a.c,0) t5,coalesce(b.c,0) t3
 from (select image_id,class_id,count(*) c from fx_gt group by 1,2) g
 left join (select image_id,class_id,count(*) c from fx_det group by 1,2) d using (image_id,class_id)
 left join (select image_id,class_id,count(*) c from best group by 1,2) a using (image_id,class_id)
 left join (select image_id,class_id,count(*) c from west group by 1,2) b using (image_id,class_id))
select image_id,class_id,case when nd=t5 and ng=t5 then 'clean_iou50' when nd=t3 and ng=t3 then 'localization_only'
 else 'true_detection_error' end as category from k"""
)


@query("pr27_failure_category", PR27_SQL)
def pr27(spark, sf):
    from boxtrail.operators.failures import failure_categories

    d, t = both(spark, sf)
    return failure_categories(d, t).select("image_id", "class_id", "category")


@query(
    "so4_hard_cases",
    matched(0.5).rstrip()
    + PER_IMAGE
    + """,
im as (select image_id,cast(sum(tp) as bigint) tp,cast(sum(fp) as bigint) fp,cast(sum(fn) as bigint) fn,coalesce(sum(i*tp)/nullif(sum(tp),0),0e0) iou from ic group by 1),
o as (select *,case when 2*tp+fp+fn>0 then 2e0*tp/(2*tp+fp+fn) else 0e0 end f1 from im),
k as (select *,row_number() over (order by round(f1,9),-(fp+fn),round(iou,9),image_id) as rank from o)
select rank,image_id,case when iou<6e-1 and fp+fn>0 then 'localization_and_label_review' when fn>fp then 'missed_objects'
 when fp>fn then 'false_or_duplicate_objects' else 'balanced_error_review' end as priority,tp,fp,fn from k where rank<=40""",
)
def so4(spark, sf):
    """The 40 hardest images; the limit is the report's own size."""
    from boxtrail.operators.failures import hard_cases, per_image_metrics

    d, t = both(spark, sf)
    rows = per_image_metrics(d, t, m.match_best(d, t, 0.5))
    return hard_cases(rows, 40).select("rank", "image_id", "priority", "tp", "fp", "fn")


def tile_sql() -> str:
    return (
        fx.ctes("fx_gt", "fx_det").rstrip()
        + """,
tiles as (select distinct image_id//4 as source_id,image_id%4 as tile,image_id,cast(image_id%4 as double)*8e-1 as tx from fx_det),
ctr as (select *,(tx+5e-1+lag(tx+5e-1) over (partition by source_id order by tx))/2 as lo,
 (tx+5e-1+lead(tx+5e-1) over (partition by source_id order by tx))/2 as hi,
 min(tx) over (partition by source_id) as rx1,max(tx+1e0) over (partition by source_id) as rx2 from tiles)
select t.source_id,d.class_id,d.image_id,d.det_idx,round((t.tx+d.x1-t.rx1)/(t.rx2-t.rx1),6) as x1,round(d.y1,6) as y1,
 round((t.tx+d.x2-t.rx1)/(t.rx2-t.rx1),6) as x2,round(d.y2,6) as y2 from fx_det d join ctr t on d.image_id=t.image_id
 where (t.lo is null or t.tx+(d.x1+d.x2)/2>=t.lo) and (t.hi is null or t.tx+(d.x1+d.x2)/2<t.hi)"""
    )


def tiled(spark, sf):
    d, _ = both(spark, sf)
    tiles = d.select("image_id").distinct().select(
        F.expr("image_id div 4").alias("source_id"),
        "image_id",
        (F.col("image_id") % 4 * 0.8).alias("tile_x"),
        F.lit(0.0).alias("tile_y"),
        F.lit(1.0).alias("tile_w"),
        F.lit(1.0).alias("tile_h"),
    )
    return d, tiles


@query("jn17_owned_boxes", tile_sql())
def jn17_owned(spark, sf):
    from boxtrail.operators.tiles import owned_boxes

    d, tiles = tiled(spark, sf)
    out = owned_boxes(d, tiles).select("source_id", "class_id", "image_id", "det_idx", "x1", "y1", "x2", "y2")
    return r6(out, "x1", "y1", "x2", "y2")


def merged_sql() -> str:
    owned = tile_sql().replace("round(", "(").replace(",6)", ")").replace("d.class_id,", "d.class_id,d.confidence,")
    head, body = owned.rsplit("\nselect t.source_id", 1)
    return (
        head
        + ",\now as (select t.source_id"
        + body
        + f"""),
e as (select *,row_number() over (partition by source_id,class_id order by confidence desc,image_id,det_idx) as rk from ow),
s(source_id,class_id,rk,kept,ok) as (
 select source_id,class_id,rk,[{{'x1':x1,'y1':y1,'x2':x2,'y2':y2}}],true from e where rk=1
 union all
 select e.source_id,e.class_id,e.rk,case when len(list_filter(s.kept,lambda k: {iou('k', 'e')}>5e-1))=0 then list_append(s.kept,{{'x1':e.x1,'y1':e.y1,'x2':e.x2,'y2':e.y2}}) else s.kept end,
  len(list_filter(s.kept,lambda k: {iou('k', 'e')}>5e-1))=0 from s join e on s.source_id=e.source_id and s.class_id=e.class_id and e.rk=s.rk+1)
select e.source_id,e.class_id,e.image_id,e.det_idx,round(e.confidence,6) as confidence,round(e.x1,6) as x1,round(e.y1,6) as y1,round(e.x2,6) as x2,round(e.y2,6) as y2
 from s join e on s.source_id=e.source_id and s.class_id=e.class_id and s.rk=e.rk where s.ok"""
    )


@query("jn17_merge_tiles", merged_sql())
def jn17(spark, sf):
    from boxtrail.operators.tiles import merge_tiles

    d, tiles = tiled(spark, sf)
    return r6(merge_tiles(d, tiles), "confidence", "x1", "y1", "x2", "y2")


