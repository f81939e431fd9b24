"""Registered queries: spaced and diverse selection, review queues, splits, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtrail.functions import scores as sc
from boxtrail.operators import datasets as ds, selection as sel, splits as sp
from boxtrail.operators.ordered import indexed
from boxtrail.plans import fixtures as fx
from boxtrail.plans.matching_queries import r6
from boxtrail.plans.registry import query

TIMED = fx.ctes("fx_timed")


@query(
    "so3_select_with_gap",
    TIMED.rstrip()
    + """,
e as (select *,row_number() over (partition by source_id order by value desc,frame_index) rk from fx_timed),
s(source_id,rk,kept,ok,frame_index) as (
 select source_id,rk,[frame_index],true,frame_index from e where rk=1
 union all
 select e.source_id,e.rk,case when len(s.kept)<6 and len(list_filter(s.kept,lambda k: abs(k-e.frame_index)<8))=0 then list_append(s.kept,e.frame_index) else s.kept end,
  len(s.kept)<6 and len(list_filter(s.kept,lambda k: abs(k-e.frame_index)<8))=0,e.frame_index from s join e on s.source_id=e.source_id and e.rk=s.rk+1)
select source_id,frame_index from s where ok""",
)
def so3(spark, sf):
    """Six spaced frames per source: the count is the operator's own setting."""
    out = sel.select_with_gap(fx.timed(spark, sf), ["source_id"], "frame_index", "value", 6, 8)
    return out.select("source_id", "frame_index")


OPEN = "list_filter(q.fr,lambda f: len(list_filter(q.used,lambda u: abs(u-f)<8))=0)"
NEAREST = f"list_sort(list_transform({OPEN},lambda f: {{'d':abs(f-(q.lo+q.i*((q.hi-q.lo)/greatest(q.need-1,1)))),'f':f}}))[1].f"
FILL = (
    TIMED.rstrip()
    + """,
e as (select *,row_number() over (partition by source_id order by value desc,frame_index) rk from fx_timed),
s(source_id,rk,kept) as (
 select source_id,rk,[frame_index] from e where rk=1
 union all
 select e.source_id,e.rk,case when len(s.kept)<3 and len(list_filter(s.kept,lambda k: abs(k-e.frame_index)<8))=0 then list_append(s.kept,e.frame_index) else s.kept end
 from s join e on s.source_id=e.source_id and e.rk=s.rk+1),
h as (select source_id,arg_max(kept,rk) as used from s group by 1),
b as (select source_id,list(frame_index order by frame_index) as fr,cast(min(frame_index) as double) as lo,cast(max(frame_index) as double) as hi from fx_timed group by 1),
q(source_id,i,used,fr,lo,hi,need,pick) as (
 select source_id,0,used,fr,lo,hi,6-len(used),cast(null as bigint) from h join b using (source_id)
 union all
 select source_id,i+1,case when {N} is null then used else list_append(used,{N}) end,fr,lo,hi,need,{N} from q where i<need)
select source_id,pick as frame_index from q where pick is not null""".replace("{N}", NEAREST)
)


@query("so3_fill_representative", FILL)
def so3_fill(spark, sf):
    f = fx.timed(spark, sf)
    hard = sel.select_with_gap(f, ["source_id"], "frame_index", "value", 3, 8)
    return sel.fill_representative(f, ["source_id"], "frame_index", hard, 3, 6, 8)


@query(
    "so5_evenly_spaced",
    TIMED.rstrip()
    + """,
n as (select source_id,count(*) as n from fx_timed group by 1),
w as (select distinct source_id,cast(case when k=6 then n-1 else round_even(k*(cast(n-1 as double)/6e0),0) end as bigint) as i from n cross join (select unnest(range(0,7)) as k) z)
select f.source_id,f.frame_index from (select *,row_number() over (partition by source_id order by frame_index)-1 as i from fx_timed) f join w on w.source_id=f.source_id and w.i=f.i""",
)
def so5(spark, sf):
    return sel.evenly_spaced(fx.timed(spark, sf), ["source_id"], ["frame_index"], 7).select("source_id", "frame_index")


@query(
    "so5_every_nth_then_thin",
    TIMED.rstrip()
    + """,
b as (select *,row_number() over (partition by source_id order by frame_index)-1 as i,count(*) over (partition by source_id) as n from fx_timed where frame_index%3=0),
w as (select distinct source_id,n,cast(case when n<=9 then k else round_even(k*(n-1)/8e0,0) end as bigint) as i from (select distinct source_id,n from b) q cross join (select unnest(range(0,9)) as k) z)
select b.source_id,b.frame_index from b join w on w.source_id=b.source_id and w.i=b.i""",
)
def so5n(spark, sf):
    return sel.every_nth_then_thin(fx.timed(spark, sf), ["source_id"], "frame_index", 3, 9).select("source_id", "frame_index")


@query(
    "so6_diverse_records",
    TIMED.rstrip()
    + """,
r as (select source_id as video,frame_index//16 as seq,frame_index,value,row_number() over (partition by source_id,frame_index//16 order by frame_index)-1 as i from fx_timed),
a as (select video,seq,count(*) as n,arg_min(i,(-value,i)) as hi,arg_min(i,(value,i)) as lo from r group by 1,2),
o as (select video,seq,least(4,n) as c,list_concat([hi,lo],case when least(4,n)=1 then [cast(0 as bigint)] else list_transform(range(0,least(4,n)),lambda k: case when k=least(4,n)-1 then n-1
 else cast(round_even(k*(cast(n-1 as double)/greatest(least(4,n)-1,1)),0) as bigint) end) end) as l from a),
u as (select video,seq,c,unnest(l) as i,generate_subscripts(l,1) as p from o),
d as (select video,seq,c,i,min(p) as p from u group by 1,2,3,4),
k as (select *,row_number() over (partition by video,seq order by p) as q from d),
ch as (select r.video,r.seq,r.frame_index,row_number() over (partition by r.video order by r.frame_index,r.seq)-1 as j,count(*) over (partition by r.video) as m from r join k on k.video=r.video and k.seq=r.seq and k.i=r.i and k.q<=k.c),
w as (select distinct video,m,cast(case when m<=10 then t when t=9 then m-1 else round_even(t*(cast(m-1 as double)/9e0),0) end as bigint) as j from (select distinct video,m from ch) z cross join (select unnest(range(0,10)) as t) y)
select ch.video,ch.seq,ch.frame_index from ch join w on w.video=ch.video and w.j=ch.j""",
)
def so6(spark, sf):
    r = fx.timed(spark, sf).select(
        F.col("source_id").alias("video"), F.expr("frame_index div 16").alias("seq"), "frame_index", "value"
    )
    return sel.diverse_records(r, "video", "seq", "frame_index", "value", 4, 10).select("video", "seq", "frame_index")


@query(
    "so7_audit_rows",
    TIMED.rstrip()
    + """,
el as (select source_id,event_id as frame,row_number() over (partition by source_id order by event_id)-1 as i,count(*) over (partition by source_id) as n from fx_timed where detections=0),
q as (select greatest(1,cast(ceil(120e0/count(distinct source_id)) as bigint)) as q from el),
w as (select distinct source_id,n,least(q,n) as c,case when least(q,n)=1 then 0 when k=least(q,n)-1 then n-1 else cast(floor(k*(cast(n-1 as double)/greatest(least(q,n)-1,1))) as bigint) end as i
 from (select distinct source_id,n from el) z cross join q cross join (select unnest(range(0,60)) as k) y where k<least(q,n)),
pk as (select distinct el.source_id,el.frame from el join w on w.source_id=el.source_id and w.i=el.i),
rs as (select source_id,frame,row_number() over (order by frame,source_id) as r from el where not exists (select 1 from pk where pk.source_id=el.source_id and pk.frame=el.frame)),
al as (select * from pk union all select source_id,frame from rs where r<=120-(select count(*) from pk))
select source_id,frame from (select *,row_number() over (order by frame,source_id) as z from al) t where z<=120""",
)
def so7(spark, sf):
    """An audit of 120 frames: the size is the operator's own setting."""
    el = fx.timed(spark, sf).filter("detections = 0").select("source_id", F.col("event_id").alias("frame"))
    return sel.audit_rows(el, "source_id", "frame", 120)


TR = """tk as (select sequence_id*3+track_id as track_key,cast((sequence_id+track_id)%5 as int) as cluster_id,count(*) as hits,round(max(proposal_score),3) as best,avg(circularity) as a1,avg(solidity) as a2 from fx_cand group by sequence_id,track_id)"""


def clustered(spark, sf):
    c = fx.candidates(spark, sf)
    return c.groupBy("sequence_id", "track_id").agg(
        F.count(F.lit(1)).alias("hits"),
        F.round(F.max("proposal_score"), 3).alias("best"),
        F.avg("circularity").alias("a1"),
        F.avg("solidity").alias("a2"),
    ).select(
        (F.col("sequence_id") * 3 + F.col("track_id")).alias("track_key"),
        ((F.col("sequence_id") + F.col("track_id")) % 5).cast("int").alias("cluster_id"),
        "hits",
        "best",
        "a1",
        "a2",
    )


@query(
    "so8_review_queue",
    fx.ctes("fx_cand").rstrip()
    + ",\n"
    + TR
    + """,
k as (select *,case when hits>=3 then 0 else 1 end as kind,row_number() over (partition by cluster_id,case when hits>=3 then 0 else 1 end order by best desc,track_key) as r from tk),
p as (select *,0 as tier from k where kind=0 and r<=40),
pn as (select cluster_id,count(*) as n from p group by 1),
t as (select k.*,1 as tier from k left join pn using (cluster_id) where kind=1 and r<=80-coalesce(n,0)),
f as (select * from p union all select * from t),
fn as (select cluster_id,count(*) as n from f group by 1),
m as (select tk.*,row_number() over (partition by cluster_id order by best desc,track_key) as r from tk where track_key not in (select track_key from f)),
mm as (select m.cluster_id,m.track_key,2 as tier from m left join fn using (cluster_id) where r<=80-coalesce(n,0))
select cluster_id,track_key,tier from f union all select cluster_id,track_key,tier from mm""",
)
def so8(spark, sf):
    """Eighty rows per cluster: the queue length is the operator's own setting."""
    out = sel.review_queue(clustered(spark, sf), "cluster_id", "track_key", "best", "hits", 80)
    return out.select("cluster_id", "track_key", "tier")


@query(
    "so9_representatives",
    fx.ctes("fx_cand").rstrip()
    + ",\n"
    + TR
    + """,m as (select cluster_id,avg(a1) as m1,avg(a2) as m2 from tk group by 1)
select cluster_id,track_key,round(sqrt((a1-m1)*(a1-m1)+(a2-m2)*(a2-m2)),6) as centroid_distance from tk join m using (cluster_id)""",
)
def so9(spark, sf):
    out = sel.representatives(clustered(spark, sf), "cluster_id", "track_key", ["a1", "a2"], "hits")
    return r6(out.select("cluster_id", "track_key", "centroid_distance"), "centroid_distance")


@query(
    "so10_review_package",
    fx.ctes("fx_cand").rstrip()
    + ",\n"
    + TR
    + """,c as (select *,hits>=2 and best>=3e-1 as confirmed from tk),
n as (select *,row_number() over (partition by confirmed order by best desc,hits desc,track_key) as i from c)
select track_key,concat(case when confirmed then 'P' else 'U' end,case when i<10000 then lpad(cast(i as varchar),4,'0') else cast(i as varchar) end) as review_id,
 case when confirmed then 'likely_particle' else 'uncertain' end as suggested_label from n""",
)
def so10(spark, sf):
    t = clustered(spark, sf).withColumns(
        {"confirmed": (F.col("hits") >= 2) & (F.col("best") >= 0.3), "confidence": F.col("best")}
    )
    return sel.review_package(t, "track_key").select("track_key", "review_id", "suggested_label")


BAL = """d as (select doc_id,n_chars%3=0 as pos,n_chars%3<>0 and n_chars%7=0 as amb from documents),
mx as (select round_even(count(*) filter (pos)*6e-1,0) as m from d),
b as (select doc_id,row_number() over (order by md5(concat('42:',doc_id)),doc_id) as r from d where not pos and not amb)"""


def balance(spark, sf):
    n = F.col("n_chars")
    d = fx.table(spark, sf, "documents").select(
        "doc_id", (n % 3 == 0).alias("pos"), ((n % 3 != 0) & (n % 7 == 0)).alias("amb")
    )
    return sel.balance_background(d, "doc_id", "pos", "amb", 0.6, 42)


@query(
    "so11_balance_background",
    "with " + BAL + " select doc_id from d where pos union all select doc_id from b,mx where r<=m",
)
def so11(spark, sf):
    return balance(spark, sf)[0].select("doc_id")


@query(
    "so11_balance_stats",
    "with "
    + BAL
    + """ select count(*) as source_images,count(*) filter (pos) as positive_images,count(*) filter (not pos and not amb) as clean_background_candidates,
 count(*) filter (amb) as dropped_ambiguous_fragments,cast(least(any_value(m),count(*) filter (not pos and not amb)) as bigint) as selected_background_images,
 cast(count(*) filter (pos)+least(any_value(m),count(*) filter (not pos and not amb)) as bigint) as selected_images from d,mx""",
)
def so11s(spark, sf):
    return balance(spark, sf)[1]


GROUPS = """gp as (select l_suppkey as group_id,count(*) filter (l_partkey%2=0) as cells,count(*) filter (l_partkey%2=1) as droplets from lineitem group by 1),
tt as (select count(*) as n,sum(cells) as tc,sum(droplets) as td from gp),
tr as (select t.k as trial,group_id,cells,droplets,row_number() over (partition by t.k order by md5(concat('7:',t.k,':',group_id)),group_id) as p from gp cross join (select unnest(range(0,{trials})) as k) t),
sp as (select trial,group_id,cells,droplets,case when p<=round_even(n*7e-1,0) then 'train' when p<=round_even(n*7e-1,0)+round_even(n*15e-2,0) then 'valid' else 'test' end as split from tr,tt),
ag as (select trial,split,sum(cells) as c,sum(droplets) as d,case split when 'train' then 7e-1 else 15e-2 end as q from sp group by 1,2),
sc as (select trial,sum(power((c-tc*q)/greatest(tc*q,1e0),2)+power((d-td*q)/greatest(td*q,1e0),2)) as score from ag,tt group by 1),
bt as (select arg_min(trial,(round(score,12),trial)) as trial from sc)""".replace("{trials}", "5000")


@query("so12_grouped_split", "with " + GROUPS + " select group_id,split from sp join bt using (trial)")
def so12(spark, sf):
    li = fx.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    measures = {"cells": F.count_if(F.col("l_partkey") % 2 == 0), "droplets": F.count_if(F.col("l_partkey") % 2 == 1)}
    groups = sp.group_totals(li.withColumnRenamed("l_suppkey", "group_id"), "group_id", measures)
    return sp.grouped_split(groups, "group_id", ["cells", "droplets"], 5000, 7)


def trial_sql(groups: str, trials: int, seed: int, train: str, valid: str, error: str, ok: str) -> str:
    """The trial search in SQL: ``error`` and ``ok`` are written over a split's sums c (size), d (positives), b."""
    return f"""with gp as ({groups}),
tt as (select count(*) as n,sum(c) as tc,sum(d) as td,sum(b) as tb from gp),
tr as (select t.k as trial,gp.*,row_number() over (partition by t.k order by md5(concat('{seed}:',t.k,':',group_id)),group_id) as p from gp cross join (select unnest(range(0,{trials})) as k) t),
sp as (select trial,group_id,c,d,b,case when p<={train} then 'train' when p<={train}+{valid} then 'valid' else 'test' end as split from tr,tt),
ag as (select trial,split,sum(c) as c,sum(d) as d,sum(b) as b,case split when 'train' then 7e-1 else 15e-2 end as q from sp group by 1,2),
sc as (select trial,sum({error}) as score from ag,tt group by 1 having bool_and({ok}) and count(*)=3),
bt as (select arg_min(trial,(round(score,12),trial)) as trial from sc)
select group_id,split from sp join bt using (trial)"""


def _square(value: str, total: str) -> str:
    return f"power(({value}-{total}*q)/greatest({total}*q,1e0),2)"


VALID, HALF = "greatest(1,round_even(n*15e-2,0))", "round_even(n*15e-2,0)"


@query(
    "so12_grouped_split_weighted",
    trial_sql(
        "select d.doc_id%40 as group_id,count(*) as c,count(*) filter (quality=1) as d,count(*) filter (quality=0) as b from documents d join labels l on d.doc_id=l.doc_id group by 1",
        50000, 7, f"(n-{VALID}-{VALID})", VALID, f"{_square('c', 'tc')}+4e0*{_square('d', 'td')}+{_square('b', 'tb')}", "d>0",
    ),
)
def so12w(spark, sf):
    """Weighted 1/4/1 variant that needs positives in every split."""
    d = fx.table(spark, sf, "documents").join(fx.table(spark, sf, "labels"), "doc_id")
    d = d.select((F.col("doc_id") % 40).alias("group_id"), "quality")
    groups = sp.group_totals(
        d,
        "group_id",
        {"total": F.count(F.lit(1)), "particle": F.count_if(F.col("quality") == 1), "background": F.count_if(F.col("quality") == 0)},
    )
    return sp.grouped_split(
        groups, "group_id", ["total", "particle", "background"], 50000, 7,
        weights={"particle": 4.0}, required={"particle": "any"}, at_least_one=True,
    )


@query(
    "so12_grouped_split_rate",
    trial_sql(
        "select doc_id%40 as group_id,count(*) as c,count(*) filter (quality=1) as d,0 as b from labels group by 1",
        120, 42, "round_even(n*7e-1,0)", HALF, "abs(c*1e0/tc-q)+8e-1*abs(d*1e0/c-td*1e0/tc)", "d>0 and d<c",
    ),
)
def so12r(spark, sf):
    """Absolute size error plus 0.8 rate error; both classes must be in every split."""
    d = fx.table(spark, sf, "labels").select((F.col("doc_id") % 40).alias("group_id"), "quality")
    groups = sp.group_totals(d, "group_id", {"total": F.count(F.lit(1)), "particle": F.count_if(F.col("quality") == 1)})
    return sp.grouped_split(
        groups, "group_id", ["total", "particle"], 120, 42, required={"particle": "both"}, kind="rate"
    )


@query(
    "so13_chronological_split",
    """with f as (select distinct cast(o_orderdate as date) as frame from orders),r as (select frame,row_number() over (order by frame) as p,count(*) over () as n from f)
select cast(frame as varchar) as frame,case when p<=round_even(n*7e-1,0) then 'train' when p<=round_even(n*7e-1,0)+round_even(n*15e-2,0) then 'valid' else 'test' end as split from r""",
)
def so13(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("frame"))
    return sp.chronological_split(o, "frame").withColumn("frame", F.col("frame").cast("string"))


@query(
    "so13_mapped_split",
    "select c_custkey,case c_mktsegment when 'BUILDING' then 'valid' when 'MACHINERY' then 'test' else 'train' end as split from customer",
)
def so13m(spark, sf):
    c = fx.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    mapping = {"BUILDING": "valid", "MACHINERY": "test", "AUTOMOBILE": "train", "FURNITURE": "train", "HOUSEHOLD": "train"}
    return sp.mapped_split(c, "c_mktsegment", mapping).select("c_custkey", "split")


@query(
    "so13_assign_profiles",
    """with r as (select s_suppkey,row_number() over (order by md5(concat('5:',s_suppkey)),s_suppkey) as p,count(*) over () as n from supplier)
select s_suppkey,case when p<=n//2 then 'native' when p<=n//2+n//4 then 'blur' else 'noise' end as profile from r""",
)
def so13p(spark, sf):
    s = fx.table(spark, sf, "supplier").select("s_suppkey")
    n = s.count()
    counts = {"native": n // 2, "blur": n // 4, "noise": n - n // 2 - n // 4}
    return sp.assign_profiles(s, ["s_suppkey"], counts, 5)


@query(
    "se1_union_segments",
    "select event_id,'head' as part from events where event_type='click' union all select event_id,'tail' from events where event_type='error'",
)
def se1(spark, sf):
    e = fx.table(spark, sf, "events")
    head = e.filter("event_type = 'click'").select("event_id", F.lit("head").alias("part"))
    return head.unionByName(e.filter("event_type = 'error'").select("event_id", F.lit("tail").alias("part")))


@query(
    "se2_remainder",
    "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag='A')",
)
def se2(spark, sf):
    chosen = fx.table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return fx.table(spark, sf, "orders").select("o_orderkey").join(chosen, "o_orderkey", "left_anti")


@query("se3_distinct_keys", "select distinct l_orderkey,l_linenumber from lineitem")
def se3(spark, sf):
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates()


@query(
    "se4_diff_tables",
    """with e as (select event_id,event_type,round(value,2) as value from events where event_id%11<>0),a as (select event_id,event_type,round(case when event_id%17=0 then value+1 else value end,2) as value from events where event_id%13<>0)
select coalesce(e.event_id,a.event_id) as event_id,case when a.event_id is null then 'missing' when e.event_id is null then 'unexpected' else 'changed' end as state
 from e full outer join a on e.event_id=a.event_id where a.event_id is null or e.event_id is null or e.value is distinct from a.value or e.event_type is distinct from a.event_type""",
)
def se4(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", "event_type", "value")
    expected = e.filter("event_id % 11 <> 0").withColumn("value", F.round("value", 2))
    moved = F.when(F.col("event_id") % 17 == 0, F.col("value") + 1).otherwise(F.col("value"))
    actual = e.filter("event_id % 13 <> 0").withColumn("value", F.round(moved, 2))
    return ds.diff_tables(expected, actual, ["event_id"]).select("event_id", "state")


@query(
    "sc6_merge_segments",
    "select row_number() over (order by ts,event_id)-1 as frame_index,event_id from events",
)
def sc6(spark, sf):
    """Two halves of the event feed put back together after the range checks."""
    e = fx.table(spark, sf, "events").select("event_id", "ts")
    rows = indexed(e, [], ["ts", "event_id"], "frame_index").withColumn("frame_index", F.col("frame_index") - 1)
    rows = rows.withColumns({"width": F.lit(1280), "height": F.lit(800)})
    n = rows.count()
    half = n // 2
    first, second = rows.filter(F.col("frame_index") < half), rows.filter(F.col("frame_index") >= half)
    return ds.merge_segments(first, second, "frame_index", n, ["width", "height"]).select("frame_index", "event_id")


@query("st_gated_confidence", TIMED + "select event_id,round(least(1e0,greatest(0e0,8e-1*(value/(value+1e1))+2e-1*least(detections/4e0,1e0))),6) as confidence from fx_timed")
def gated(spark, sf):
    t = fx.timed(spark, sf)
    p = F.col("value") / (F.col("value") + 10)
    return r6(t.select("event_id", sc.gated_confidence(p, F.col("detections"), 3).alias("confidence")), "confidence")


