"""Registered queries: scans, sinks, packed records and fragments over data derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtrail.functions.udtf import register_functions
from boxtrail.operators.decode import keep_code
from boxtrail.plans import fixtures as fx
from boxtrail.plans.matching_queries import both
from boxtrail.plans.registry import query
from boxtrail.plans.sqltext import COUNTS, matched, prf
from boxtrail.session import scratch_path
from boxtrail.sources import coco, files, labels as lb, records as rc

GT = fx.ctes("fx_gt")
C8 = "least(1e0,greatest(0e0,{0}))"
CENTER = {
    "cx": f"({C8.format('x1')}+{C8.format('x2')})/2",
    "cy": f"({C8.format('y1')}+{C8.format('y2')})/2",
    "w": f"{C8.format('x2')}-{C8.format('x1')}",
    "h": f"{C8.format('y2')}-{C8.format('y1')}",
}


def bodies(spark, sf, digits=6):
    return lb.label_bodies(fx.gt(spark, sf), "image_id", ["gt_idx"], digits)


@query(
    "sc7_label_bodies",
    GT
    + "select image_id,string_agg(printf('%d %.8f %.8f %.8f %.8f',class_id,"
    + ",".join(CENTER.values())
    + "),chr(10) order by gt_idx) as body from fx_gt group by 1",
)
def sc7(spark, sf):
    return bodies(spark, sf, 8)


@query(
    "sc1_labels_round_trip",
    GT + "select image_id,cast(gt_idx+1 as int) as line_no,class_id," + ",".join(f"round({v},4) as {n}" for n, v in CENTER.items()) + " from fx_gt",
)
def sc1(spark, sf):
    """Boxes written as label bodies to the shared folder, read back and parsed strictly."""
    path = scratch_path(spark, "labels")
    lb.write_labels(bodies(spark, sf), path)
    back = spark.read.parquet(path).select(F.col("image_id").cast("string").alias("file"), F.col("body").alias("value"))
    rows = lb.parse_labels(lb.split_lines(back), 2)
    out = rows.withColumn("image_id", F.col("file").cast("long")).drop("file")
    return out.withColumns({c: F.round(c, 4) for c in ("cx", "cy", "w", "h")})


LINES = """ln as (select l_orderkey as file_id,l_linenumber,l_partkey,l_suppkey,case l_partkey%5 when 0 then concat(l_suppkey%3,' 0.5 0.5 0.1 0.1') when 1 then '0 0.5 0.5 0.1'
 when 2 then concat('1 0.5 1.',l_suppkey%10,' 0.1 0.1') when 3 then '1 a 0.5 0.1 0.1' else '0 0.25 0.5 0.0 0.1' end as v from lineitem)"""


def label_lines(spark, sf):
    k = F.col("l_partkey") % 5
    v = (
        F.when(k == 0, F.concat((F.col("l_suppkey") % 3).cast("string"), F.lit(" 0.5 0.5 0.1 0.1")))
        .when(k == 1, "0 0.5 0.5 0.1")
        .when(k == 2, F.concat(F.lit("1 0.5 1."), (F.col("l_suppkey") % 10).cast("string"), F.lit(" 0.1 0.1")))
        .when(k == 3, "1 a 0.5 0.1 0.1")
        .otherwise("0 0.25 0.5 0.0 0.1")
    )
    return fx.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("file"), F.lit(1).alias("line_no"), v.alias("value")
    )


@query(
    "sc1_rejected_labels",
    "with " + LINES + """ select concat_ws('-',file_id,l_linenumber,l_partkey,l_suppkey) as file,case l_partkey%5 when 0 then 'class out of range' when 1 then 'expected 5 fields'
 when 2 then 'coordinate outside 0..1' when 3 then 'not a number' else 'empty box' end as reason from ln where not (l_partkey%5=0 and l_suppkey%3<2) and not (l_partkey%5=2 and l_suppkey%10=0)
 """,
)
def sc1_bad(spark, sf):
    return lb.rejected_labels(label_lines(spark, sf), 2).select("file", "reason")


@query(
    "sc2_labels_lenient",
    GT
    + "select image_id,cast(gt_idx+1 as int) as line_no,class_id,"
    + ",".join(
        f"round(({CENTER[c]}{s}({CENTER[d]})/2)*{size},2) as {n}"
        for n, c, s, d, size in (("x1", "cx", "-", "w", "64e1"), ("y1", "cy", "-", "h", "48e1"), ("x2", "cx", "+", "w", "64e1"), ("y2", "cy", "+", "h", "48e1"))
    )
    + " from fx_gt",
)
def sc2(spark, sf):
    b = bodies(spark, sf, 8).select(F.col("image_id").cast("string").alias("file"), F.concat("body", F.lit("\nnot a label")).alias("value"))
    sizes = b.select("file", F.lit(640).alias("width"), F.lit(480).alias("height"))
    rows = lb.parse_labels_lenient(lb.split_lines(b), sizes).withColumn("image_id", F.col("file").cast("long")).drop("file")
    return rows.withColumns({c: F.round(c, 2) for c in ("x1", "y1", "x2", "y2")})


@query(
    "sc3_coco",
    GT
    + """select cast(image_id%4 as varchar) as split,image_id,count(*) filter (class_id=1) as boxes,round(coalesce(sum(case when class_id=1 then w*640 end),0e0),4) as width_sum from fx_gt group by 1,2""",
)
def sc3(spark, sf):
    """Orders as COCO export files (up to 256 orders a file), droplets kept; an image without droplets stays with zero boxes."""
    t = fx.gt(spark, sf).withColumn("split", (F.col("image_id") % 4).cast("string"))
    ann = F.struct(
        F.col("gt_idx").cast("long").alias("id"), F.col("image_id").alias("image_id"), F.col("class_id").alias("category_id"),
        F.array(F.col("x1") * 640, F.col("y1") * 480, F.col("w") * 640, F.col("h") * 480).alias("bbox"),
    )
    image = F.struct(F.col("image_id").alias("id"), F.concat(F.lit("src"), F.col("image_id"), F.lit("_tile0.jpg")).alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    folder = F.concat_ws("-", "split", F.floor(F.col("image_id") / 1024).cast("string")).alias("split")
    docs = t.groupBy(folder).agg(F.collect_set(image).alias("images"), F.collect_list(ann).alias("annotations"))
    docs = docs.select(
        "split",
        "images",
        "annotations",
        F.array(F.struct(F.lit(0).alias("id"), F.lit("Cell ").alias("name")), F.struct(F.lit(1).alias("id"), F.lit("Droplet").alias("name"))).alias("categories"),
    )
    path = scratch_path(spark, "coco")
    coco.write_coco(docs, path)
    images, boxes = coco.read_coco(spark, path, ["droplet"])
    rows = coco.coco_rows(images, boxes).withColumn("split", F.substring_index("split", "-", 1))
    out = rows.groupBy("split", "image_id").agg(
        F.count("class_name").alias("boxes"), F.round(F.coalesce(F.sum("w"), F.lit(0.0)), 4).alias("width_sum")
    )
    return out


@query(
    "sc4_parse_names",
    """select doc_id,cast(doc_id%7 as int) as tile_id,cast(doc_id as int) as source_id,cast(n_chars as int) as tile_x,cast(doc_id%13 as int) as tile_y,
 case when doc_id%2=0 then concat('v_src',lpad(cast(doc_id as varchar),6,'0'),'_tile',doc_id%7,'_x',n_chars,'_y',doc_id%13,'.jpg') else concat('v_src',lpad(cast(doc_id as varchar),6,'0'),'_tile',doc_id%7,'_x',n_chars,'_y',doc_id%13,'.png') end as clean_name from documents""",
)
def sc4(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "n_chars")
    stem = F.format_string("v_src%06d_tile%d_x%d_y%d", "doc_id", F.col("doc_id") % 7, "n_chars", F.col("doc_id") % 13)
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(stem, F.lit("_jpg.rf.0a1b2c.jpg"))).otherwise(F.concat(F.lit("images/"), stem, F.lit(".png")))
    return lb.parse_names(d.withColumn("name", name), "name").drop("name", "n_chars")


@query(
    "sc5_result_tables",
    "select event_id,user_id,event_type,round(value,2) as value,case when event_type='error' then null else cast(event_id%2=0 as int) end as even from events",
)
def sc5(spark, sf):
    """A result table through CSV with fixed columns: extra columns are left out, nulls stay nulls."""
    e = fx.table(spark, sf, "events").withColumns(
        {"value": F.round("value", 2), "even": F.when(F.col("event_type") != "error", F.col("event_id") % 2 == 0)}
    )
    path = scratch_path(spark, "results")
    cols = ["event_id", "user_id", "event_type", "value", "even"]
    files.write_tables({"events": e}, path, {"events": cols}, "csv")
    return files.read_table(spark, f"{path}/events", "event_id long, user_id long, event_type string, value double, even int", "csv")


@query(
    "sc8_file_manifest",
    """select concat('b',cast(doc_id//256 as varchar)) as name,count(*) as docs,sum(strlen(coalesce(text,''))+1)::bigint as bytes,
 sha256(string_agg(coalesce(text,'')||chr(10),'' order by doc_id,text nulls first)) as sha256 from documents group by 1""",
)
def sc8(spark, sf):
    """The texts in files of 256 documents; the manifest must give each file's size and digest."""
    d = fx.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 256).alias("b"), "doc_id", F.coalesce("text", F.lit("")).alias("value"), "text")
    path = scratch_path(spark, "manifest")
    d.repartition("b").sortWithinPartitions("b", "doc_id", "text").select("b", "value").write.partitionBy("b").text(path)
    found = files.file_manifest(spark, path, "part-*")
    name = F.concat(F.lit("b"), F.regexp_extract("path", r"b=(\d+)", 1)).alias("name")
    docs = d.groupBy(F.concat(F.lit("b"), "b").alias("name")).agg(F.count(F.lit(1)).alias("docs"))
    return found.select(name, "bytes", "sha256").join(docs, "name")


@query(
    "sc9_run_metrics",
    """with m as (select s_suppkey,round(avg(ps),6) as v from (select l_suppkey as s_suppkey,l_tax as ps from lineitem) z group by 1)
select concat('run',s_suppkey) as run,32 as weight_bits,v as validation_macro_f1,round(v/2,6) as valid_cell_f1 from m order by v desc,run limit 1""",
)
def sc9(spark, sf):
    """One metrics document per supplier, read back with a declared schema; the best run is reported."""
    m = fx.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_tax"), 6).alias("v"))
    per = F.create_map(F.lit("cell"), F.struct(F.col("v").alias("precision"), F.col("v").alias("recall"), F.round(F.col("v") / 2, 6).alias("f1")))
    doc = F.struct(F.lit("gray").alias("feature_mode"), F.lit(3).alias("best_epoch"), F.struct(F.lit(100).alias("total")).alias("parameters"),
                   F.struct(F.col("v").alias("macro_f1"), per.alias("per_class")).alias("validation"), F.struct(F.col("v").alias("macro_f1"), per.alias("per_class")).alias("test"))
    path = scratch_path(spark, "metrics")
    m.select(F.concat(F.lit("run"), "l_suppkey").alias("run"), doc.alias("d")).select("run", "d.*").write.json(path)
    rows = files.run_metrics(spark.read.schema(files.METRICS + ", run string").json(path), ["cell"])
    return files.best_run(rows).select("run", "weight_bits", "validation_macro_f1", "valid_cell_f1")


REVIEWS = """rv as (select event_id,case when event_id%4=0 then 'audit' else 'candidate' end as item_type,case when event_id%3=0 then 'pending' else 'reviewed' end as review_status,
 case event_id%5 when 0 then 'particle' when 1 then 'background' when 2 then 'unsure' else null end as lab from events)"""


def reviews(spark, sf):
    e = fx.table(spark, sf, "events")
    m = F.col("event_id")
    return e.select(
        F.concat(F.lit("R"), m).alias("review_id"),
        F.when(m % 4 == 0, "audit").otherwise("candidate").alias("item_type"),
        F.when(m % 3 == 0, "pending").otherwise("reviewed").alias("review_status"),
        F.when(m % 5 == 0, "particle").when(m % 5 == 1, "background").when(m % 5 == 2, "unsure").alias("reviewed_label"),
        (m % 50).cast("int").alias("droplet_sequence"),
        (m * 3).alias("best_frame"),
        F.concat(F.lit('[{"x": '), m % 64, F.lit(', "y": 5}, {"x": 7, "y": '), m % 32, F.lit("}]")).alias("points_json"),
    )


@query(
    "sc10_usable_reviews",
    "with " + REVIEWS + " select concat('R',event_id) as review_id,lab as reviewed_label from rv where item_type='candidate' and review_status='reviewed' and lab in ('particle','background')",
)
def sc10(spark, sf):
    path = scratch_path(spark, "reviews")
    reviews(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return files.usable_reviews(files.read_reviews(spark, path)).select("review_id", "reviewed_label")


@query(
    "sc10_review_counts",
    "with " + REVIEWS + " select concat(item_type,':',review_status,':',coalesce(lab,'')) as kind,count(*) as n from rv group by 1",
)
def sc10c(spark, sf):
    return files.review_counts(reviews(spark, sf))


@query(
    "sc11_points",
    "select concat('R',event_id) as review_id,1 as point_index,cast(event_id%64 as int) as x,5 as y from events union all select concat('R',event_id),2,7,cast(event_id%32 as int) from events",
)
def sc11(spark, sf):
    return files.explode_points(reviews(spark, sf).withColumn("size", F.lit(64)), "points_json", "size", ["review_id"])


@query(
    "sc12_report_json",
    matched(0.5).rstrip()
    + ",\n"
    + COUNTS
    + """,al as (select class_id,tp,fp,fn from cnt union all select -1,sum(tp),sum(fp),sum(fn) from cnt),
r as (select class_id,tp,fp,fn,"""
    + prf()
    + """ from al)
select '{"classes":{'||string_agg('"'||class_id||'":{"tp":'||tp||',"fp":'||fp||',"fn":'||fn||',"f1":'||f1||'}',',' order by cast(class_id as varchar))||'},"policy":"best-then-check at IoU 0.5"}' as report from r""",
)
def sc12(spark, sf):
    from boxtrail.operators import matching as m, metrics as mt

    d, t = both(spark, sf)
    rows = mt.detection_metrics(d, t, m.match_best(d, t, 0.5)).withColumns({"class_id": F.coalesce("class_id", F.lit(-1)), "f1": F.round("f1", 6)})
    one = rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("class_id").cast("string"), F.struct("tp", "fp", "fn", "f1"))))).alias("classes"))
    return files.report_json(one.withColumn("policy", F.lit("best-then-check at IoU 0.5")))


CODES = """cd as (select image_id,class_id,class_id as slot,cast(floor(cy*8e0) as int) as gy,cast(floor(cx*8e0) as int) as gx,max(cast(l_partkey%200-100 as int)) as obj,
 max(cast(l_partkey%90-45 as int)) as tx,max(cast(l_partkey%80-40 as int)) as ty,max(cast(l_partkey%70-35 as int)) as tw,max(cast(l_partkey%60-30 as int)) as th from fx_gt group by 1,2,3,4,5)"""


def codes(spark, sf):
    t, p = fx.gt(spark, sf), F.col("l_partkey")
    rows = t.select(
        "image_id", "class_id", F.col("class_id").alias("slot"), F.floor(F.col("cy") * 8).cast("int").alias("gy"), F.floor(F.col("cx") * 8).cast("int").alias("gx"),
        *[(p % n - n // 2).cast("int").alias(c) for c, n in zip(rc.CODES, (200, 90, 80, 70, 60))],
    )
    return rows.groupBy("image_id", "class_id", "slot", "gy", "gx").agg(*[F.max(c).alias(c) for c in rc.CODES])


LIMITS = {0: -20, 1: 10}


@query(
    "sc14_encode_records",
    GT.rstrip()
    + ",\n"
    + CODES
    + """,h as (select image_id,gy*8+gx as g,slot,"""
    + "concat(" + ",".join(f"lpad(upper(printf('%x',({v}+256)%256)),2,'0')" for v in ("(gy*8+gx)%256", "(gy*8+gx)//256", "slot", *rc.CODES))
    + """) as b from cd where obj>=case when class_id=0 then -20 else 10 end)
select image_id,string_agg(b,'' order by g,slot) as payload from h group by 1""",
)
def sc14(spark, sf):
    out = rc.encode_records(codes(spark, sf), ["image_id"], 8, LIMITS)
    return out.select("image_id", F.hex("payload").alias("payload"))


DECODED = GT.rstrip() + ",\n" + CODES + " select image_id,slot,gy,gx,obj,tx,ty,tw,th from cd where obj>=case when class_id=0 then -20 else 10 end"


@query("sc13_decode_records", DECODED)
def sc13(spark, sf):
    packed = rc.encode_records(codes(spark, sf), ["image_id"], 8, LIMITS)
    return rc.decode_records(packed, ["image_id"], 8, 8, 2)


@query("sc13_decode_long_records", DECODED)
def sc13l(spark, sf):
    packed = rc.encode_records(codes(spark, sf), ["image_id"], 8, LIMITS, rc.LONG_RECORD)
    return rc.decode_records(packed, ["image_id"], 8, 8, 2, rc.LONG_RECORD)


@query(
    "ud3_decode_udtf",
    GT.rstrip() + ",\n" + CODES + " select image_id,gy*8+gx as grid_index,slot,obj,tx,ty,tw,th from cd where obj>=case when class_id=0 then -20 else 10 end",
)
def ud3(spark, sf):
    register_functions(spark)
    packed = rc.encode_records(codes(spark, sf), ["image_id"], 8, LIMITS)
    return spark.sql("select p.image_id, r.* from {packed} p, lateral decode_records(p.payload) r", packed=packed)


@query(
    "ud1_sql_functions",
    fx.ctes("fx_stream") + "select event_id,case when (x1+x2)/2<=150e0 then -1 when (x1+x2)/2>=160e0 then 1 else 0 end as side,round(1e2/11e2,6) as overlap from fx_stream",
)
def ud1(spark, sf):
    """Line side and overlap with a shifted copy, called from SQL text."""
    register_functions(spark)
    return spark.sql(
        "select event_id, line_side((x1+x2)/2, 155D, 5D) as side, round(box_iou(x1,y1,x2,y2,x1+15D,y1+10D,x2+15D,y2+10D),6) as overlap from {s}",
        s=fx.stream(spark, sf),
    )


@query("ud4_fold_udaf", "select l_orderkey,round(sum(l_quantity*l_tax),4) as weighted from lineitem group by 1")
def ud4(spark, sf):
    from boxtrail.functions.folds import fold

    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_tax")
    total = fold(["l_quantity", "l_tax"], F.lit(0.0), lambda acc, e: acc + e["l_quantity"] * e["l_tax"])
    return li.groupBy("l_orderkey").agg(F.round(total, 4).alias("weighted"))


def fragments(spark, sf):
    """Results of the encoder cut into 1400-byte fragments would be one chunk; a small payload limit makes several."""
    packed = rc.encode_records(codes(spark, sf), ["image_id"], 8, LIMITS, rc.LONG_RECORD)
    size, limit = F.length("payload"), 39
    n = F.greatest(F.lit(1), F.ceil(size / limit)).cast("int")
    rows = packed.select(
        F.col("image_id").alias("frame_id"), "payload", size.alias("total_bytes"), n.alias("chunk_count"),
        (size / 13).cast("int").alias("record_count"), F.lit(1000).alias("infer_us"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"),
    )
    off = F.col("chunk_index") * limit
    rows = rows.select(
        "frame_id", (F.col("frame_id") % 2).cast("int").alias("roi_id"), "chunk_index", "chunk_count", "total_bytes", off.alias("offset"), "record_count", "infer_us",
        F.col("payload").substr(off + 1, F.lit(limit)).alias("payload"),
    )
    # Every third result repeats its fragments; every fifth loses its last one.
    twice = rows.filter("frame_id % 3 = 0")
    return rows.unionByName(twice).filter("not (frame_id % 5 = 0 and chunk_count > 1 and chunk_index = chunk_count - 1)")


@query(
    "sc15_reassemble",
    GT.rstrip()
    + ",\n"
    + CODES
    + """,n as (select image_id,count(*) as c from cd where obj>=case when class_id=0 then -20 else 10 end group by 1)
select image_id as frame_id,case when image_id%5=0 and ceil(c*13/39e0)>1 then 'timeout' else 'complete' end as state,cast(c as int) as record_count,
 cast(case when image_id%5=0 and ceil(c*13/39e0)>1 then null else c*13 end as int) as bytes from n""",
)
def sc15(spark, sf):
    out = rc.reassemble(fragments(spark, sf), ["frame_id", "roi_id"], rc.LONG_RECORD, 39)
    return out.select("frame_id", "state", "record_count", F.length("payload").alias("bytes"))


def responses(spark, sf):
    """A status record, then one box record per truth box and one detector record, per image."""
    t = fx.gt(spark, sf)
    b = F.upper(F.concat(F.lit("4342"), *[F.lpad(F.hex(v.cast("long")), 2, "0") for v in (
        F.col("class_id"), F.col("l_partkey") % 256, F.floor(F.greatest(F.col("x1"), F.lit(0.0)) * 90), F.floor(F.greatest(F.col("y1"), F.lit(0.0)) * 90),
        F.floor(F.least(F.col("x2"), F.lit(1.0)) * 95), F.floor(F.least(F.col("y2"), F.lit(1.0)) * 95))]))
    agg = t.groupBy("image_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("gt_idx", b.alias("b")))), lambda x: x["b"]), "").alias("boxes"),
        F.count_if(F.col("class_id") == 1).alias("nd"), F.count_if(F.col("class_id") == 0).alias("nc"),
    )
    two = lambda c: F.concat(F.lpad(F.hex(c % 256), 2, "0"), F.lpad(F.hex((c / 256).cast("long")), 2, "0"))
    status = F.concat(F.lit("485953"), F.lpad(F.hex(F.col("image_id") % 256), 2, "0"), two(F.col("nd")), two(F.col("nc")))
    return agg.select("image_id", F.unhex(F.concat(status, "boxes", F.lit("0100000102030405"))).alias("payload"))


@query(
    "sc16_demux_status",
    GT + "select image_id,cast(image_id%256 as int) as flags,cast((image_id%256)//4%2 as int) as bit2,count(*) filter (class_id=1) as droplet_count,count(*) filter (class_id=0) as cell_count from fx_gt group by 1",
)
def sc16(spark, sf):
    status, _, _ = rc.demux_records(responses(spark, sf), ["image_id"])
    return status.withColumn("bit2", rc.flag(F.col("flags"), 2).cast("int"))


def _scaled(v, lo, scale, shift=""):
    return f"cast(round_even({lo}+({v}{shift})*{scale},0) as int)"


@query(
    "sc16_demux_boxes",
    GT.rstrip()
    + """,b as (select image_id,gt_idx,class_id,cast(l_partkey%256 as int) as score_code,floor(greatest(x1,0e0)*90) as a,floor(greatest(y1,0e0)*90) as b,floor(least(x2,1e0)*95) as c,floor(least(y2,1e0)*95) as d from fx_gt)
select image_id,cast(gt_idx+1 as int) as rec,class_id,score_code,"""
    + f"{_scaled('a', '100e0', '125e-2')} as x1,{_scaled('b', '200e0', '15e-1')} as y1,{_scaled('c', '100e0', '125e-2', '+1')}-1 as x2,{_scaled('d', '200e0', '15e-1', '+1')}-1 as y2 from b",
)
def sc16b(spark, sf):
    _, boxes, _ = rc.demux_records(responses(spark, sf), ["image_id"])
    return rc.scale_boxes(boxes, (100, 200, 220, 344))


@query(
    "fn_byte_sum",
    "select doc_id,cast(list_sum(list_transform(range(1,length(lang)+1),lambda i: ord(substr(lang,i,1))))%65536 as bigint) as total from documents",
)
def fn_bytes(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.encode("lang", "utf-8").alias("b"))
    return d.select("doc_id", rc.byte_sum(F.col("b")).alias("total"))


@query("fn_keep_code", "select doc_id,cast(ceil(ln(p/(1e0-p))/5e-2+3) as int) as code from (select doc_id,2e-1+cast(doc_id%60 as double)/1e2 as p from documents) z")
def fn_keep(spark, sf):
    p = 0.2 + (F.col("doc_id") % 60).cast("double") / 100
    return fx.table(spark, sf, "documents").select("doc_id", keep_code(p, 0.05, 3).alias("code"))




def pixels(spark, sf):
    """Embeddings as 8x8 gray images."""
    e = fx.table(spark, sf, "embeddings")
    value = lambda v: F.least(F.greatest(F.rint(128 + v.cast("double") * 600), F.lit(0.0)), F.lit(255.0)).cast("int")
    text = F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(value(v)), 2, "0")), "")
    return e.select("vec_id", F.unhex(text).alias("data"))


@query(
    "pr30_image_quality",
    """with p as (select vec_id,generate_subscripts(embedding,1)-1 as i,least(255e0,greatest(0e0,round_even(128e0+cast(unnest(embedding) as double)*6e2,0))) as v from embeddings),
x as (select vec_id,i//8 as y,i%8 as x,v from p),
l as (select c.vec_id,c.v,u.v+d.v+l.v+r.v-4*c.v as lap from x c join x u on u.vec_id=c.vec_id and u.x=c.x and u.y=case when c.y=0 then 1 else c.y-1 end
 join x d on d.vec_id=c.vec_id and d.x=c.x and d.y=case when c.y=7 then 6 else c.y+1 end
 join x l on l.vec_id=c.vec_id and l.y=c.y and l.x=case when c.x=0 then 1 else c.x-1 end join x r on r.vec_id=c.vec_id and r.y=c.y and r.x=case when c.x=7 then 6 else c.x+1 end),
a as (select vec_id,avg(v) as b,stddev_pop(v) as c,var_pop(lap) as s,count(*) filter (v<=4)/64e0 as dk,count(*) filter (v>=251)/64e0 as br from l group by 1)
select vec_id,round(b,4) as brightness,round(c,4) as contrast,round(s,6) as sharpness,round(dk,6) as clipped_dark,round(br,6) as clipped_bright,round(s*greatest(1e-1,1e0-dk-br),5) as score from a""",
)
def pr30(spark, sf):
    from boxtrail.functions.images import image_quality

    q = image_quality(F.lit(8), F.lit(8), F.lit(1), F.col("data"))
    out = pixels(spark, sf).select("vec_id", q.alias("q")).select("vec_id", "q.*")
    digits = {"brightness": 4, "contrast": 4, "sharpness": 6, "clipped_dark": 6, "clipped_bright": 6, "score": 5}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})
