"""Registered queries: sweeps, curves, calibration, audits, selection, splits and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtrail.functions import geometry as g
from boxtrail.operators import (
    calibration as cal,
    datasets as ds,
    features as ft,
    guards as gd,
    matching as m,
    metrics as mt,
)
from boxtrail.operators.grid import with_grid
from boxtrail.plans import fixtures as fx
from boxtrail.plans.geometry_queries import TRACKS, WEAK, simple_tracks, weak_tracks
from boxtrail.plans.matching_queries import both, r6
from boxtrail.plans.registry import query
from boxtrail.plans.sqltext import big, iou, matched, prf

CAND, GT = fx.ctes("fx_cand"), fx.ctes("fx_gt")

# Binary scores: quality label against a length score, over the labelled documents.
SCORES = """sc as (select l.doc_id,l.quality as label,round(least(1e0,ln(1e0+d.n_chars)/12e0)*(55e-2+45e-2*l.quality*cast((l.doc_id*7)%10 as double)/1e1),2) as p
 from labels l join documents d on l.doc_id=d.doc_id)"""


def scores(spark, sf):
    j = fx.table(spark, sf, "labels").join(fx.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    base = F.least(F.lit(1.0), F.ln(1.0 + F.col("n_chars")) / 12)
    p = base * (0.55 + 0.45 * F.col("quality") * ((F.col("doc_id") * 7) % 10).cast("double") / 10)
    return j.select("doc_id", F.col("quality").alias("label"), F.round(p, 2).alias("p"))


CONF = "cast(sum(case when {0} then 1 else 0 end) as bigint)"


def binary_sql(thr: str) -> str:
    return (
        f"select {thr} as threshold,{CONF.format(f'p>={thr} and label=1')} as tp,{CONF.format(f'p>={thr} and label<>1')} as fp,"
        f"{CONF.format(f'p<{thr} and label<>1')} as tn,{CONF.format(f'p<{thr} and label=1')} as fn from sc"
    )


@query(
    "ag3_binary_metrics",
    "with "
    + SCORES
    + ",b as ("
    + binary_sql("5e-1")
    + f""") select tp,fp,tn,fn,{prf()},round((tp+tn)*1e0/(tp+fp+tn+fn),6) as accuracy,round(tn*1e0/greatest(tn+fp,1),6) as specificity from b""",
)
def ag3(spark, sf):
    out = mt.binary_metrics(scores(spark, sf), "label", "p", 0.5)
    return r6(out, "precision", "recall", "f1", "accuracy", "specificity")


@query(
    "ag4_roc_auc",
    "with "
    + SCORES
    + """ select round(sum(case when a.p>b.p then 1e0 when a.p=b.p then 5e-1 else 0e0 end)/count(*),6) as roc_auc from sc a cross join sc b where a.label=1 and b.label=0""",
)
def ag4(spark, sf):
    return r6(mt.roc_auc(scores(spark, sf), "label", "p"), "roc_auc")


@query(
    "ag4_average_precision",
    "with "
    + SCORES
    + """,d as (select p,sum(label) as pos,count(*) as n from sc group by 1),
c as (select *,sum(pos) over (order by p desc) as ctp,sum(n) over (order by p desc) as cn from d)
select round(sum(pos*(ctp*1e0/cn))/sum(pos),6) as average_precision from c""",
)
def ag4p(spark, sf):
    return r6(mt.average_precision(scores(spark, sf), "label", "p"), "average_precision")


FLAGS = """fl as (select d.class_id,d.image_id,d.det_idx,d.confidence,case when b.det_idx is null then 0 else 1 end as hit from fx_det d
 left join best b on d.image_id=b.image_id and d.class_id=b.class_id and d.det_idx=b.det_idx),
cv as (select f.class_id,image_id,det_idx,confidence,sum(hit) over w*1e0/count(*) over w as precision,sum(hit) over w*1e0/n.c as recall from fl f
 join (select class_id,count(*) c from fx_gt group by 1) n on n.class_id=f.class_id window w as (partition by f.class_id order by confidence desc,image_id,det_idx rows unbounded preceding))"""


@query(
    "ag5_pr_curve",
    matched(0.5).rstrip()
    + ",\n"
    + FLAGS
    + " select class_id,image_id,det_idx,round(confidence,6) as confidence,round(precision,6) as precision,round(recall,6) as recall from cv",
)
def ag5(spark, sf):
    d, t = both(spark, sf)
    return r6(mt.pr_curve(d, t, m.match_best(d, t, 0.5)), "confidence", "precision", "recall")


@query(
    "ag5_ap50",
    matched(0.5).rstrip()
    + ",\n"
    + FLAGS
    + """,pt as (select class_id,unnest(range(0,101)) as k from (select distinct class_id from fx_gt) z),
mx as (select pt.class_id,pt.k,coalesce(max(cv.precision),0e0) as p from pt left join cv on cv.class_id=pt.class_id and floor(cv.recall*100+1e-9)>=pt.k group by 1,2)
select class_id,round(avg(p),6) as ap from mx group by 1""",
)
def ag5ap(spark, sf):
    d, t = both(spark, sf)
    curve = mt.pr_curve(d, t, m.match_best(d, t, 0.5))
    return r6(mt.average_precision_101(curve, t), "ap")


THRESHOLDS = [round(0.30 + 0.05 * i, 2) for i in range(13)]
SWEEP = (
    matched(0.5).rstrip()
    + ",\n"
    + "th as (select cast(t as double) as threshold from (values "
    + ",".join(f"({t:e})" for t in THRESHOLDS)
    + """) v(t)),
sw as (select m.class_id,threshold,coalesce((select count(*) from best b where b.class_id=m.class_id and b.confidence>=threshold),0) as tp,
 coalesce((select count(*) from fx_det d where d.class_id=m.class_id and d.confidence>=threshold),0) as nd,m.ng
 from (select class_id,count(*) ng from fx_gt group by 1) m cross join th),
rw as (select class_id,threshold,tp,nd-tp as fp,ng-tp as fn from sw)"""
)


def sweep(spark, sf):
    d, t = both(spark, sf)
    return mt.confidence_sweep(d, t, m.match_best(d, t, 0.5), THRESHOLDS)


@query("ag6_confidence_sweep", SWEEP + f" select class_id,threshold,{big('tp', 'fp', 'fn')},{prf()} from rw")
def ag6(spark, sf):
    return r6(sweep(spark, sf), "precision", "recall", "f1")


@query(
    "ag6_select_threshold",
    SWEEP
    + """,f as (select *,2e0*tp/(2*tp+fp+fn) as f1,case when tp+fp>0 then tp*1e0/(tp+fp) else 0e0 end as p from rw),
k as (select class_id,'f1_high' as policy,threshold,row_number() over (partition by class_id order by f1 desc,threshold desc) r from f
 union all select class_id,'f1_precision',threshold,row_number() over (partition by class_id order by f1 desc,p desc,threshold desc) from f)
select class_id,policy,threshold from k where r=1""",
)
def ag6s(spark, sf):
    from boxtrail.session import materialize

    rows = materialize(sweep(spark, sf))
    pick = [
        mt.select_threshold(rows, p, ["class_id"]).select("class_id", F.lit(p).alias("policy"), "threshold")
        for p in ("f1_high", "f1_precision")
    ]
    return pick[0].unionByName(pick[1])


BIN = [round(0.05 + 0.005 * i, 3) for i in range(181)]
BIN_SQL = (
    "with "
    + SCORES
    + ",th as (select round(5e-2+5e-3*k,3) as threshold from (select unnest(range(0,181)) as k) z),"
    + """bs as (select threshold,"""
    + ",".join(
        f"cast(count(*) filter ({c}) as bigint) as {n}"
        for n, c in (
            ("tp", "p>=threshold and label=1"),
            ("fp", "p>=threshold and label<>1"),
            ("tn", "p<threshold and label<>1"),
            ("fn", "p<threshold and label=1"),
        )
    )
    + " from sc cross join th group by 1)"
)


@query("ag6_binary_sweep", BIN_SQL + f" select threshold,tp,fp,tn,fn,{prf()},round(tn*1e0/greatest(tn+fp,1),6) as specificity from bs")
def ag6b(spark, sf):
    return r6(mt.binary_sweep(scores(spark, sf), "label", "p", BIN), "precision", "recall", "f1", "specificity")


@query(
    "ag6_binary_policies",
    BIN_SQL
    + """,f as (select threshold,case when tp+fp>0 then tp*1e0/(tp+fp) else 0e0 end as p,case when tp+fn>0 then tp*1e0/(tp+fn) else 0e0 end as r,
 case when 2*tp+fp+fn>0 then 2e0*tp/(2*tp+fp+fn) else 0e0 end as f1,tn*1e0/greatest(tn+fp,1) as sp from bs),
k as (select 'shortfall' as policy,threshold,row_number() over (order by round(f1+8e-2*r-5e-1*greatest(0e0,9e-1-r),9) desc,threshold) n from f
 union all select 'recall_floor',threshold,row_number() over (order by case when r>=9e-1 then 1 else 0 end desc,round(f1,9) desc,
  round(case when r>=9e-1 then p else r end,9) desc,round(case when r>=9e-1 then sp else p end,9) desc,case when r>=9e-1 then -threshold else threshold end) from f
 union all select 'precision_floor',threshold,row_number() over (order by case when p>=9e-1 then 1 else 0 end desc,
  round(case when p>=9e-1 then r else f1 end,9) desc,round(f1,9) desc,threshold desc) from f)
select policy,threshold from k where n=1""",
)
def ag6p(spark, sf):
    rows = mt.binary_sweep(scores(spark, sf), "label", "p", BIN)
    rows = rows.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "specificity")})
    out = None
    for p in ("shortfall", "recall_floor", "precision_floor"):
        one = mt.select_threshold(rows, p).select(F.lit(p).alias("policy"), "threshold")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "ag2_combined_metrics",
    SWEEP
    + f""",f as (select *,2e0*tp/(2*tp+fp+fn) as f1 from rw)
select ta as threshold_a,tb as threshold_b,{big('tp', 'fp', 'fn')},{prf()},round((fa+fb)/2,6) as macro_f1 from (select a.threshold as ta,b.threshold as tb,
 a.tp+b.tp as tp,a.fp+b.fp as fp,a.fn+b.fn as fn,a.f1 as fa,b.f1 as fb from f a cross join f b where a.class_id=0 and b.class_id=1) z""",
)
def ag2(spark, sf):
    rows = sweep(spark, sf)
    out = mt.combined_metrics(rows.filter("class_id = 0"), rows.filter("class_id = 1"))
    return r6(out, "precision", "recall", "f1", "macro_f1")


@query(
    "jn12_threshold_grid",
    fx.ctes("fx_gt", "fx_det")
    + """select grid_id,class_id,count(*) as kept from fx_det cross join (values (0,5e-1),(1,6e-1),(2,7e-1),(3,8e-1)) g(grid_id,thr) where confidence>=thr group by 1,2""",
)
def jn12(spark, sf):
    d, _ = both(spark, sf)
    grid = [{"thr": t} for t in (0.5, 0.6, 0.7, 0.8)]
    rows = with_grid(d.select("class_id", "confidence"), grid).filter("confidence >= thr")
    return rows.groupBy("grid_id", "class_id").agg(F.count(F.lit(1)).alias("kept"))


GUARD = """sp as (select image_id,gt_idx,floor(cx*24e0) as sx,floor(cy*24e0) as sy,cast(l_partkey%60 as int) as response,cast(l_partkey%30 as int) as contrast from fx_gt),
ce as (select image_id,det_idx,confidence,floor((x1+x2)/2*24e0) as sx,floor((y1+y2)/2*24e0) as sy from fx_det where class_id=0),
hit as (select c.image_id,c.det_idx,s.response,s.contrast,row_number() over (partition by c.image_id,c.det_idx order by s.response desc,s.sy,s.sx,s.contrast desc) r
 from ce c join sp s on c.image_id=s.image_id and abs(c.sx-s.sx)<=2 and abs(c.sy-s.sy)<=2),
gst as (select c.image_id,c.det_idx,case when confidence>=9e-1 then 'accepted' when confidence<5e-1 then 'ignored'
 when h.response>=28 and h.contrast>=12 then 'guarded' else 'rejected' end as state from ce c left join hit h on c.image_id=h.image_id and c.det_idx=h.det_idx and h.r=1)"""


# The same with both sides written first, joined on the image alone.
GUARD_SETTLED = GUARD.replace("sp as (", "sp as materialized (").replace("ce as (", "ce as materialized (").replace(
    "from ce c join sp s on c.image_id=s.image_id and abs(c.sx-s.sx)<=2 and abs(c.sy-s.sy)<=2)",
    "from (select ce.*,sp.sx as px,sp.sy as py,response,contrast from ce join sp using (image_id)) s, lateral (select s.image_id,s.det_idx) c"
    " where greatest(abs(s.sx-s.px),abs(s.sy-s.py))<=2)",
).replace("order by s.response desc,s.sy,s.sx,s.contrast desc", "order by s.response desc,s.py,s.px,s.contrast desc")


def guard_inputs(spark, sf):
    d, t = both(spark, sf)
    det = d.filter("class_id = 0").select(
        "image_id", "class_id", "det_idx", "confidence", *g.Box._fields,
        F.floor((F.col("x1") + F.col("x2")) / 2 * 24).alias("x"), F.floor((F.col("y1") + F.col("y2")) / 2 * 24).alias("y"),
    )
    pts = t.select(
        "image_id", F.floor(F.col("cx") * 24).alias("x"), F.floor(F.col("cy") * 24).alias("y"),
        (F.col("l_partkey") % 60).cast("int").alias("response"), (F.col("l_partkey") % 30).cast("int").alias("contrast"),
    )
    return det, pts, t


@query("jn8_guarded_accept", fx.ctes("fx_gt", "fx_det", settled=True).rstrip() + ",\n" + GUARD_SETTLED + " select image_id,det_idx,state from gst")
def jn8(spark, sf):
    det, pts, _ = guard_inputs(spark, sf)
    return gd.guarded_accept(det, pts, 0.5, 0.9, 28, 2, 12).select("image_id", "det_idx", "state")


GUARD_GRID = [(lo, r) for lo in (0.5, 0.6, 0.7) for r in (20, 32, 44)]


@query(
    "ag7_guard_grid_search",
    matched(0.5).rstrip()
    + ",\n"
    + GUARD
    + ",st as (select * from (values "
    + ",".join(f"({i},{lo:e},{r})" for i, (lo, r) in enumerate(GUARD_GRID))
    + f""") v(grid_id,lo,need)),
nm as (select image_id,det_idx,gt_idx from b1 where r=1 and class_id=0),
kp as (select st.grid_id,ce.image_id,nm.gt_idx from ce cross join st left join hit h on ce.image_id=h.image_id and ce.det_idx=h.det_idx and h.r=1
 left join nm on nm.image_id=ce.image_id and nm.det_idx=ce.det_idx where ce.confidence>=9e-1 or (ce.confidence>=lo and h.response>=need)),
ct as (select grid_id,count(*) as nd,count(distinct case when gt_idx is not null then (image_id,gt_idx) end) as tp,(select count(*) from fx_gt where class_id=0) as ng from kp group by 1),
q as (select grid_id,tp,nd-tp as fp,ng-tp as fn,2e0*tp/(nd+ng) as f,tp*1e0/nd as p,tp*1e0/ng as r from ct),
g as (select *,case when p>=7e-1 then f else f*p/7e-1 end as gf from q)
select cast(grid_id as int) as grid_id,{big('tp', 'fp', 'fn')},{prf()},round(gf,6) as guarded_f1 from g order by round(gf,12) desc,round(r,12) desc,round(p,12) desc,grid_id limit 1""",
)
def ag7(spark, sf):
    """Guarded F1 over low-confidence and response settings; support is found once, then every setting is a filter."""
    det, pts, truth = guard_inputs(spark, sf)
    rows = gd.with_support(det, pts, 2, ["image_id"])
    keep = [
        (F.col("confidence") >= 0.9) | ((F.col("confidence") >= lo) & (F.col("response") >= r)) for lo, r in GUARD_GRID
    ]
    counts = cal.overall(cal.filter_sweep(rows, truth.filter("class_id = 0"), keep))
    out = cal.guard_policy(counts)
    return r6(cal.pick_guarded(out), "precision", "recall", "f1", "guarded_f1")


@query("ag8_calibrate_geometry")
def ag8(spark, sf):
    """Coordinate descent over the full grid of each parameter."""
    d, t = both(spark, sf)
    res = cal.calibrate_geometry(d.filter("class_id = 1"), t.filter("class_id = 1"))
    return spark.createDataFrame([res]).select(*sorted(res))


MOVES = (
    fx.ctes("fx_gt", "fx_det", settled=True).rstrip()
    + """,
st as (select unnest(range(21)) as grid_id),
mv as (select grid_id,image_id,class_id,det_idx,greatest(0e0,cx-w/2) as x1,greatest(0e0,y1) as y1,least(1e0,cx+w/2) as x2,least(1e0,y2) as y2 from (
 select grid_id,image_id,class_id,det_idx,(x1+x2)/2 as cx,(x2-x1)*round(8e-1+25e-3*grid_id,3) as w,(y1+y2)/2-(y2-y1)/2 as y1,(y1+y2)/2+(y2-y1)/2 as y2 from fx_det, st) z),
pa as (select grid_id,image_id,class_id,d.det_idx,g.gt_idx,"""
    + iou("d", "g")
    + """ as iou from mv d join fx_gt g using (image_id,class_id)),
nm as (select *,row_number() over (partition by grid_id,image_id,class_id,det_idx order by iou desc,gt_idx) r from pa where iou>=5e-1),
ct as (select grid_id,count(distinct (image_id,class_id,gt_idx)) as tp from nm where r=1 group by 1)
select cast(grid_id as int) as grid_id,coalesce(tp,0) as tp from st left join ct using (grid_id)"""
)


@query("ag8_move_sweep", MOVES)
def ag8_sweep(spark, sf):
    """One step of the calibration: truths found under each width scale."""
    d, t = both(spark, sf)
    return cal.move_sweep(d, t, [{**cal.NEUTRAL, "width_scale": v} for v in cal.STEPS["width_scale"]])


ASSOC = """need as (select c.image_id,c.det_idx,min(greatest(abs((c.x1+c.x2)/2-(d.x1+d.x2)/2)/((d.x2-d.x1)/2),abs((c.y1+c.y2)/2-(d.y1+d.y2)/2)/((d.y2-d.y1)/2))) as needed
 from fx_det c join fx_det d on c.image_id=d.image_id and c.class_id=0 and d.class_id=1 group by 1,2),
gr as (select row_number() over (order by e,k,t)-1 as g0,* from (values """ + ",".join(
    f"({e:e},{str(k).lower()},{t:e})" for e, k, t in cal.ASSOCIATION_GRID
) + """) v(e,k,t)),
kp as (select g0,d.* from fx_det d cross join gr left join need n on n.image_id=d.image_id and n.det_idx=d.det_idx
 where d.class_id<>0 or n.needed<=gr.e or (gr.k and d.confidence>=gr.t))"""


@query(
    "ag9_association_sweep",
    fx.ctes("fx_gt", "fx_det").rstrip()
    + ",\n"
    + ASSOC
    + """,
pa as (select * from (select d.g0,d.image_id,d.class_id,d.det_idx,d.confidence,g.gt_idx,"""
    + iou("d", "g")
    + """ as iou from kp d join fx_gt g on d.image_id=g.image_id and d.class_id=g.class_id) z where iou>=5e-1),
a1 as (select *,row_number() over (partition by g0,image_id,class_id,det_idx order by iou desc,gt_idx) r from pa),
a2 as (select *,row_number() over (partition by g0,image_id,class_id,gt_idx order by confidence desc,det_idx) k from a1 where r=1)
select gr.e as expansion,gr.k as keep_orphans,gr.t as orphan_threshold,cast(x.tp as bigint) as tp,y.nd-x.tp as fp,z.ng-x.tp as fn from gr
 join (select g0,count(*) tp from a2 where k=1 group by 1) x using (g0) join (select g0,count(*) nd from kp group by 1) y using (g0) cross join (select count(*) ng from fx_gt) z""",
)
def ag9(spark, sf):
    d, t = both(spark, sf)
    return cal.association_sweep(d, t).select("expansion", "keep_orphans", "orphan_threshold", "tp", "fp", "fn")


@query(
    "ag16_audit_labels",
    GT
    + """select gw,gh,count(*) as boxes,cast(count(*)-count(distinct (image_id,class_id,gx,gy)) as bigint) as collisions from (
 select *,least(floor(cx*gw),gw-1) as gx,least(floor(cy*gh),gh-1) as gy from fx_gt cross join (values (6,6),(8,8),(12,6)) g(gw,gh)) z group by 1,2""",
)
def ag16(spark, sf):
    return ds.audit_labels(fx.gt(spark, sf), [(6, 6), (8, 8), (12, 6)], [])


@query(
    "ag16_label_totals",
    GT
    + """select l_returnflag,count(distinct image_id) as images,count(*) as boxes,count(*) filter (class_id=0) as cell_boxes,count(*) filter (class_id=1) as droplet_boxes from fx_gt group by 1""",
)
def ag16t(spark, sf):
    return ds.label_totals(fx.gt(spark, sf), ["l_returnflag"])


MANIFEST = """mf as (select doc_id,source as group_id,concat(lang,'_',doc_id%23) as source_video,case when doc_id%10<7 then 'train' when doc_id%10<8 then 'valid' else 'test' end as split,
 case when n_chars%3=0 then 'native' else 'blur' end as quality_profile,cast(n_chars as double) as up,cast(doc_id%500+1 as double) as nat from documents)"""


def manifest(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    k = F.col("doc_id") % 10
    return d.select(
        "doc_id",
        F.col("source").alias("group_id"),
        F.concat_ws("_", "lang", (F.col("doc_id") % 23).cast("string")).alias("source_video"),
        F.when(k < 7, "train").when(k < 8, "valid").otherwise("test").alias("split"),
        F.when(F.col("n_chars") % 3 == 0, "native").otherwise("blur").alias("quality_profile"),
        F.col("n_chars").cast("double").alias("up"),
        (F.col("doc_id") % 500 + 1).cast("double").alias("nat"),
    )


@query(
    "ag19_leaked_groups",
    "with " + MANIFEST + " select source_video,array_to_string(list_sort(list(distinct split)),'|') as splits from mf group by 1 having count(distinct split)>1",
)
def ag19(spark, sf):
    return ds.leaked(manifest(spark, sf), "source_video").withColumn("splits", F.array_join("splits", "|"))


@query(
    "ag19_leakage_audit",
    "with "
    + MANIFEST
    + """,a as (select (select count(*) from (select group_id from mf group by 1 having count(distinct split)>1) z) as group_leakage,
 (select count(*) from (select source_video from mf group by 1 having count(distinct split)>1) z) as video_leakage,
 (select count(*) from mf) as rows,(select bool_or(split<>'train' and quality_profile<>'native') from mf) as synthetic_outside_train)
select *,concat_ws('+',case when group_leakage>0 then concat('group_leakage=',group_leakage) end,case when video_leakage>0 then concat('video_leakage=',video_leakage) end,
 case when synthetic_outside_train then 'synthetic_variant_outside_train' end) as failures,
 case when group_leakage>0 or video_leakage>0 or synthetic_outside_train then 'FAIL' else 'PASS' end as status from a""",
)
def ag19a(spark, sf):
    return ds.leakage_audit(manifest(spark, sf), "group_id", "source_video", "quality_profile")


@query(
    "ag20_profile_stats",
    "with "
    + MANIFEST
    + " select quality_profile,count(*) as images,round(avg(up/greatest(nat,1e-6)),6) as mean_ratio,round(min(up/greatest(nat,1e-6)),6) as min_ratio,round(max(up/greatest(nat,1e-6)),6) as max_ratio from mf group by 1",
)
def ag20(spark, sf):
    out = ds.profile_stats(manifest(spark, sf), "quality_profile", {"ratio": ("up", "nat")})
    return r6(out, "mean_ratio", "min_ratio", "max_ratio")


@query(
    "ag21_exact_duplicates",
    "select count(*) as rows,count(distinct text) as distinct_contents,count(*)-count(distinct text) as duplicates from documents",
)
def ag21(spark, sf):
    return ds.exact_duplicates(fx.table(spark, sf, "documents"), "text")


@query(
    "ag21_near_duplicates",
    """with v as (select vec_id,label,list_transform(embedding,lambda x: cast(x as double)) as e from embeddings),
md as (select *,list_sort(e[2:64]) as t from v),
h as (select vec_id,label,list_transform(e,lambda x: case when x>(t[32]+t[32])/2 then 1 else 0 end) as bits from md),
l as (select *,lag(bits) over (partition by label order by vec_id) as pb,lag(vec_id) over (partition by label order by vec_id) as left_id from h),
d as (select label,left_id,vec_id as right_id,cast(list_sum(list_transform(list_zip(bits,pb),lambda z: case when z[1]<>z[2] then 1 else 0 end)) as int) as hamming from l where pb is not null)
select * from d where hamming<=24""",
)
def ag21n(spark, sf):
    """Neighbouring vectors of a label within 24 of 64 bits (the fixture has no image copies, so the limit is wide)."""
    e = fx.table(spark, sf, "embeddings").withColumn("h", ds.median_hash(F.col("embedding")))
    return ds.near_duplicates(e, ["label"], "vec_id", "h", "vec_id", 24)


@query(
    "ag30_group_stats",
    """select user_id,count(*) filter (event_type='click') as click,count(*) filter (event_type='purchase') as purchase,count(*) filter (event_type='error') as error from events group by 1""",
)
def ag30(spark, sf):
    return ds.group_stats(fx.table(spark, sf, "events"), ["user_id"], "event_type", ["click", "purchase", "error"])


@query(
    "jn20_verify_derived",
    """with src as (select doc_id,lang,n_chars from documents),dv as (select d.doc_id,v,case when d.doc_id%5=0 and v=1 then 'xx' else d.lang end as lang,
 d.n_chars+(case when d.doc_id%7=0 then v else 0 end) as n_chars,case when d.doc_id%4=0 then 0 else v end as c from documents d cross join (values (0),(1),(2)) t(v))
select s.doc_id,count(*) as variants,bool_and(dv.n_chars=s.n_chars) as same_shape,bool_and(dv.lang=s.lang) as same_labels,count(*)=count(distinct dv.c) as all_distinct from dv join src s using (doc_id) group by 1""",
)
def jn20(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    src = d.select("doc_id", F.col("n_chars").alias("width"), F.lit(1).alias("height"), F.col("lang").alias("label_text"))
    v = d.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    out = v.select(
        "doc_id",
        F.col("v").alias("variant"),
        (F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, F.col("v")).otherwise(0)).alias("width"),
        F.lit(1).alias("height"),
        F.when((F.col("doc_id") % 5 == 0) & (F.col("v") == 1), "xx").otherwise(F.col("lang")).alias("label_text"),
        F.concat("doc_id", F.lit("-"), F.when(F.col("doc_id") % 4 == 0, 0).otherwise(F.col("v"))).alias("content"),
    )
    return ds.verify_derived(src, out, "doc_id")


@query(
    "jn11_apply_split",
    "with m as (select distinct n_nationkey as k,case when n_regionkey<2 then 'train' when n_regionkey=2 then 'valid' else 'test' end as split from nation where n_nationkey<20) "
    "select c_custkey,c_nationkey,coalesce(split,'not_used') as split from customer left join m on k=c_nationkey",
)
def jn11(spark, sf):
    n = fx.table(spark, sf, "nation").filter("n_nationkey < 20")
    split = F.when(F.col("n_regionkey") < 2, "train").when(F.col("n_regionkey") == 2, "valid").otherwise("test")
    mapping = n.select(F.col("n_nationkey").alias("c_nationkey"), split.alias("split"))
    return ds.apply_split(fx.table(spark, sf, "customer").select("c_custkey", "c_nationkey"), mapping, "c_nationkey")


@query(
    "jn10_join_labels",
    CAND.rstrip() + ",\n" + TRACKS + ",\n" + WEAK + " select c.sequence_id,c.candidate_idx,w.weak_label from fx_cand c join wk w on w.sequence_id=c.sequence_id and w.track_id=c.track_id where w.weak_label>=0",
)
def jn10(spark, sf):
    labels = weak_tracks(spark, sf).filter("weak_label >= 0").select("sequence_id", "track_id", "weak_label")
    c = fx.candidates(spark, sf).select("sequence_id", "track_id", "candidate_idx")
    return ds.join_many_to_one(c, labels, ["sequence_id", "track_id"]).drop("track_id")


@query(
    "ag13_sample_weights",
    CAND.rstrip() + ",\n" + TRACKS + ",\n" + WEAK
    + " select c.sequence_id,c.candidate_idx,round(w.weak_label_confidence/w.hits,6) as sample_weight from fx_cand c join wk w on w.sequence_id=c.sequence_id and w.track_id=c.track_id where w.weak_label>=0",
)
def ag13(spark, sf):
    labels = weak_tracks(spark, sf).filter("weak_label >= 0").select("sequence_id", "track_id", "weak_label_confidence")
    c = fx.candidates(spark, sf).select("sequence_id", "track_id", "candidate_idx").join(labels, ["sequence_id", "track_id"])
    out = ft.sample_weights(c, ["sequence_id", "track_id"], "weak_label_confidence")
    return r6(out.select("sequence_id", "candidate_idx", "sample_weight"), "sample_weight")


@query(
    "ag11_track_features",
    CAND.rstrip()
    + """,
l as (select *,sqrt(power(center_x_px-lag(center_x_px) over w,2)+power(center_y_px-lag(center_y_px) over w,2)) as st from fx_cand window w as (partition by sequence_id,track_id order by frame_index))
select sequence_id,track_id,count(*) as hits,min(frame_index) as first_frame,max(frame_index) as last_frame,
 arg_max(frame_index,(proposal_score,-frame_index)) as best_frame,max(frame_index)-min(frame_index)+1 as duration_frames,
 round(count(*)*1e0/(max(frame_index)-min(frame_index)+1),6) as persistence_ratio,round(coalesce(sum(st),0e0),5) as path_length_px,
 round(coalesce(avg(st),0e0),5) as mean_speed_px_per_frame,round(coalesce(max(st),0e0),5) as max_speed_px_per_frame,
 round(sqrt(power(arg_max(center_x_px,frame_index)-arg_min(center_x_px,frame_index),2)+power(arg_max(center_y_px,frame_index)-arg_min(center_y_px,frame_index),2)),5) as displacement_px,
 round(avg(circularity),5) as circularity_mean,round(stddev_pop(circularity),5) as circularity_std,round(max(circularity),5) as circularity_max,
 case when count(*)>=3 then 'persistent' else 'transient' end as temporal_status from l group by 1,2""",
)
def ag11(spark, sf):
    feats = ["proposal_score", "pixel_area", "circularity", "solidity", "local_contrast", "blackhat_mean", "blackhat_max", "temporal_mean", "radial_distance_norm"]
    out = ft.track_features(
        fx.candidates(spark, sf), ["sequence_id", "track_id"], feats, "center_x_px", "center_y_px", "proposal_score"
    )
    rounded = ["path_length_px", "mean_speed_px_per_frame", "max_speed_px_per_frame", "displacement_px", "circularity_mean", "circularity_std", "circularity_max"]
    out = out.withColumns({c: F.round(c, 5) for c in rounded})
    return r6(out, "persistence_ratio").select(
        "sequence_id", "track_id", "hits", "first_frame", "last_frame", "best_frame", "duration_frames", "persistence_ratio", *rounded, "temporal_status"
    )


@query(
    "ag12_track_predictions",
    CAND
    + """select sequence_id,track_id,round(avg(proposal_score),6) as probability_mean,round(max(proposal_score),6) as probability_max,count(*) as observations,
 cast(case when count(*)>=2 and round(avg(proposal_score),9)>=45e-2 then 1 else 0 end as int) as predicted from fx_cand group by 1,2""",
)
def ag12(spark, sf):
    c = fx.candidates(spark, sf)
    out = ft.track_predictions(c, ["sequence_id", "track_id"], "proposal_score", 2, 0.45 - 1e-9)
    return r6(out, "probability_mean", "probability_max")


@query(
    "ag14_cluster_profiles",
    CAND
    + "select track_id,metric,count(v) as count,round(avg(v),5) as mean,round(stddev_samp(v),5) as std,round(quantile_cont(v,5e-1),5) as median from (select track_id,'pixel_area' as metric,pixel_area as v from fx_cand union all select track_id,'circularity',circularity from fx_cand union all select track_id,'solidity',solidity from fx_cand) z group by 1,2",
)
def ag14(spark, sf):
    out = ft.cluster_profiles(fx.candidates(spark, sf), "track_id", ["pixel_area", "circularity", "solidity"])
    return out.withColumns({c: F.round(c, 5) for c in ("mean", "std", "median")})


@query(
    "ag15_correlation_matrix",
    CAND
    + " union all ".join(
        f"select '{a}' as a,'{b}' as b,round(corr({a},{b}),5) as corr from fx_cand"
        for i, a in enumerate(("pixel_area", "circularity", "solidity"))
        for b in ("pixel_area", "circularity", "solidity")[i:]
    ),
)
def ag15(spark, sf):
    out = ft.correlation_matrix(fx.candidates(spark, sf), ["pixel_area", "circularity", "solidity"])
    return out.withColumn("corr", F.round("corr", 5))


@query(
    "jn19_aggregate_sequences",
    CAND.rstrip()
    + ",\n"
    + TRACKS
    + """,fr as (select o_orderkey as sequence_id,o_custkey%100 as frame_index,o_totalprice/1e4 as radius_px from orders)
select f.sequence_id,min(f.frame_index) as first_frame,max(f.frame_index) as last_frame,count(*) as frames_observed,round(avg(radius_px),6) as radius_mean_px,
 round(stddev_pop(radius_px),6) as radius_std_px,round(min(radius_px),6) as radius_min_px,round(max(radius_px),6) as radius_max_px,
 coalesce(max(c.n),0) as candidate_observations,coalesce(max(t.n),0) as candidate_tracks,coalesce(max(t.p),0) as persistent_candidate_tracks,round(coalesce(max(t.m),0e0),6) as max_candidate_score
 from fr f left join (select sequence_id,count(*) n from fx_cand group by 1) c using (sequence_id)
 left join (select sequence_id,count(*) n,count(*) filter (hits>=3) p,max(best_proposal_score) m from tr group by 1) t using (sequence_id) group by 1""",
)
def jn19(spark, sf):
    frames = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sequence_id"), (F.col("o_custkey") % 100).alias("frame_index"), (F.col("o_totalprice") / 1e4).alias("radius_px")
    )
    out = ft.aggregate_sequences(frames, fx.candidates(spark, sf), simple_tracks(spark, sf), ["sequence_id"])
    return r6(out, "radius_mean_px", "radius_std_px", "radius_min_px", "radius_max_px", "max_candidate_score")


CIRCLES = """ob as (select user_id as video_id,event_id as obs_idx,60e0+cast(event_id%40 as double) as x,20e0+cast((event_id*3)%25 as double) as r from events)"""


def circles(spark, sf):
    return fx.table(spark, sf, "events").select(
        F.col("user_id").alias("video_id"),
        F.col("event_id").alias("obs_idx"),
        (60 + (F.col("event_id") % 40).cast("double")).alias("x"),
        (20 + ((F.col("event_id") * 3) % 25).cast("double")).alias("r"),
    )


@query(
    "ag29_dominant_circle",
    "with "
    + CIRCLES
    + """,dn as (select a.video_id,a.obs_idx,a.x,a.r,count(*) as density from ob a join ob b on a.video_id=b.video_id and abs(a.x-b.x)<=12 and abs(a.r-b.r)<=7 group by 1,2,3,4),
sd as (select *,row_number() over (partition by video_id order by density desc,obs_idx) k from dn),
il as (select o.video_id,count(*) as inliers,quantile_cont(o.x,5e-1) as cx,quantile_cont(o.r,5e-1) as rr from ob o join sd s on s.k=1 and s.video_id=o.video_id and abs(o.x-s.x)<=14 and abs(o.r-s.r)<=9 group by 1),
n as (select video_id,count(*) as observations from ob group by 1)
select video_id,observations,inliers,case when observations<12 then 'too_few_observations' when inliers<10 then 'cluster_too_small' else 'ok' end as state,
 case when observations>=12 and inliers>=10 then cx end as center_x,case when observations>=12 and inliers>=10 then rr end as radius from n left join il using (video_id)""",
)
def ag29(spark, sf):
    return ft.dominant_circle(circles(spark, sf), ["video_id"])


@query(
    "ag29_inlier_median",
    "with "
    + CIRCLES
    + """,m as (select video_id,quantile_cont(x,5e-1) as mx,quantile_cont(r,5e-1) as mr from ob group by 1),
i as (select o.video_id,count(*) as n,quantile_cont(x,5e-1) as ix,quantile_cont(r,5e-1) as ir from ob o join m on m.video_id=o.video_id and abs(x-mx)<=8 group by 1)
select m.video_id,coalesce(n,0) as inliers,case when coalesce(n,0)>=8 then ix else mx end as center_x,case when coalesce(n,0)>=8 then ir else mr end as radius from m left join i using (video_id)""",
)
def ag29i(spark, sf):
    return ft.inlier_median(circles(spark, sf), ["video_id"], 8.0, 8)


@query(
    "jn9_refine_by_circle",
    fx.ctes("fx_gt", "fx_det", settled=True).rstrip()
    + """,
ci as materialized (select o_orderkey as image_id,10e0+cast(o_custkey%80 as double) as circle_x,10e0+cast(o_custkey%60 as double) as circle_y,15e0+cast(o_custkey%20 as double) as radius from orders),
p as (select d.image_id,class_id,det_idx,confidence,(x1+x2)/2*96e0 as x,(y1+y2)/2*96e0 as y,circle_x,circle_y,radius,
 sqrt(power((x1+x2)/2*96e0-circle_x,2)+power((y1+y2)/2*96e0-circle_y,2)) as dist from fx_det d join ci on ci.image_id=d.image_id),
k as (select *,row_number() over (partition by image_id order by dist,-confidence,det_idx) r from p where class_id=1),
c as (select image_id,det_idx from k where r=1 and dist<=greatest(55e0,radius*125e-2))
select p.image_id,class_id,p.det_idx,round(confidence,6) as confidence,round(case when class_id=1 then circle_x else x end,5) as x,round(case when class_id=1 then circle_y else y end,5) as y,
 round(case when class_id=1 then radius*104e-2 end,5) as half_size from p join c on c.image_id=p.image_id where (class_id=1 and p.det_idx=c.det_idx) or (class_id=0 and dist<=radius*92e-2)""",
)
def jn9(spark, sf):
    d, _ = both(spark, sf)
    px = d.select("image_id", "class_id", "det_idx", "confidence", ((F.col("x1") + F.col("x2")) / 2 * 96).alias("x"), ((F.col("y1") + F.col("y2")) / 2 * 96).alias("y"))
    c = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("image_id"), (10 + (F.col("o_custkey") % 80).cast("double")).alias("circle_x"),
        (10 + (F.col("o_custkey") % 60).cast("double")).alias("circle_y"), (15 + (F.col("o_custkey") % 20).cast("double")).alias("radius"),
    )
    out = gd.refine_by_circle(px, c)
    return r6(out, "confidence").withColumns({k: F.round(k, 5) for k in ("x", "y", "half_size")})
