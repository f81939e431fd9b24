"""Small pieces of SQL text shared by the checks."""

from __future__ import annotations

from boxtrail.plans.fixtures import ctes


def inter(a: str, b: str) -> str:
    return (
        f"(greatest(0e0,least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))"
        f"*greatest(0e0,least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)))"
    )


def iou(a: str, b: str) -> str:
    i = inter(a, b)
    return f"({i}/(({a}.x2-{a}.x1)*({a}.y2-{a}.y1)+({b}.x2-{b}.x1)*({b}.y2-{b}.y1)-{i}))"


def pairs(thr: float, det: str = "fx_det", gt: str = "fx_gt") -> str:
    return (
        f"pairs as (select * from (select d.image_id,d.class_id,d.det_idx,d.confidence,g.gt_idx,{iou('d', 'g')} as iou "
        f"from {det} d join {gt} g on d.image_id=g.image_id and d.class_id=g.class_id) z where iou>={thr:e})"
    )


BEST = """b1 as (select *,row_number() over (partition by image_id,class_id,det_idx order by iou desc,gt_idx) r from pairs),
b2 as (select *,row_number() over (partition by image_id,class_id,gt_idx order by confidence desc,det_idx) k from b1 where r=1),
best as (select image_id,class_id,det_idx,gt_idx,confidence,iou from b2 where k=1)"""


def matched(thr: float = 0.5, *views: str) -> str:
    """``with`` prefix ending in ``best``: true positives of the best-then-check rule."""
    return ctes("fx_gt", "fx_det", *views).rstrip() + ",\n" + pairs(thr) + ",\n" + BEST + "\n"


COUNTS = """cnt as (select m.class_id,coalesce(t.tp,0) as tp,coalesce(n.nd,0)-coalesce(t.tp,0) as fp,m.ng-coalesce(t.tp,0) as fn
 from (select class_id,count(*) ng from fx_gt group by 1) m left join (select class_id,count(*) nd from fx_det group by 1) n
 on m.class_id=n.class_id left join (select class_id,count(*) tp from best group by 1) t on m.class_id=t.class_id)"""


def ratio(n: str, d: str) -> str:
    return f"(case when ({d})>0 then ({n})*1e0/({d}) else 0e0 end)"


def prf(tp="tp", fp="fp", fn="fn", digits: int = 6) -> str:
    """precision, recall, f1 columns. F1 in its count form, which equals 2PR/(P+R)."""
    return (
        f"round({ratio(tp, f'{tp}+{fp}')},{digits}) as precision,round({ratio(tp, f'{tp}+{fn}')},{digits}) as recall,"
        f"round({ratio(f'2*({tp})', f'2*({tp})+{fp}+{fn}')},{digits}) as f1"
    )


def big(*cols: str) -> str:
    return ",".join(f"cast({c} as bigint) as {c}" for c in cols)
