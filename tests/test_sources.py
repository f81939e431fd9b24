import json
import random

import pytest
from pyspark.sql import functions as F

from boxtrail.operators import datasets as ds
from boxtrail.sources import coco, files, labels as lb, records as rc


def write(path, name, text):
    target = path / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)


def test_strict_scan_reports_file_and_line(spark, tmp_path):
    write(tmp_path, "train/a.txt", "0 0.5 0.5 0.1 0.1\n1 0.2 0.2 0.1 0.1\n")
    write(tmp_path, "train/empty.txt", "")
    assert lb.read_labels(spark, str(tmp_path), 2).count() == 2
    write(tmp_path, "train/b.txt", "0 0.5 0.5 0.1 0.1\n0 0.5 1.5 0.1 0.1\n")
    with pytest.raises(Exception, match=r"b\.txt:2:coordinate outside"):
        lb.read_labels(spark, str(tmp_path), 2).collect()
    assert lb.read_labels(spark, str(tmp_path), 2, "quarantine").count() == 3
    bad = lb.rejected_labels(lb.scan_lines(spark, str(tmp_path)), 2).collect()
    assert [(r.line_no, r.reason) for r in bad] == [(2, "coordinate outside 0..1")]


def test_label_files_round_trip(spark, tmp_path):
    boxes = spark.createDataFrame([(7, 0, 1, 0.1, 0.2, 0.3, 0.4), (7, 1, 0, -0.1, 0.0, 0.1, 0.1)], "image_id long, i int, class_id int, x1 double, y1 double, x2 double, y2 double")
    bodies = lb.label_bodies(boxes, "image_id", ["i"]).withColumn("split", F.lit("train"))
    assert bodies.first().body == "1 0.200000 0.300000 0.200000 0.200000\n0 0.050000 0.050000 0.100000 0.100000"
    lb.write_labels(bodies, str(tmp_path / "out"), "split", per_file=True)
    back = lb.read_labels(spark, str(tmp_path / "out"), 2)
    assert sorted(r.class_id for r in back.collect()) == [0, 1]
    assert "image_id=7" in back.first().file


@pytest.mark.parametrize("route", ["plain", "hot"])
def test_crowded_bodies_are_the_same(spark, request, route):
    if route == "hot":
        request.getfixturevalue("hot")
    rows = [(1, i, 0, 0.1, 0.1, 0.2, 0.2 + i / 100) for i in range(9)]
    df = spark.createDataFrame(rows, "image_id long, i int, class_id int, x1 double, y1 double, x2 double, y2 double")
    lines = lb.label_bodies(df, "image_id", ["i"]).first().body.split("\n")
    assert len(lines) == 9 and lines == sorted(lines, key=lambda s: float(s.split()[-1]))


def test_coco(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "x_src000012_tile3_jpg.rf.ab.jpg", "width": 100, "height": 50}, {"id": 2, "file_name": "y_src000013.jpg", "width": 100, "height": 50}],
        "annotations": [{"id": 1, "image_id": 1, "category_id": 5, "bbox": [10, 10, 20, 20]}, {"id": 2, "image_id": 1, "category_id": 6, "bbox": [1, 1, 2, 2]}],
        "categories": [{"id": 5, "name": " Cell"}, {"id": 6, "name": "junk"}],
    }
    write(tmp_path, "train/_annotations.coco.json", json.dumps(doc))
    images, boxes = coco.read_coco(spark, str(tmp_path), ["cell"])
    named = coco.assert_unique_names(lb.parse_names(images, "file_name"))
    rows = {r.image_id: r for r in coco.coco_rows(named, boxes).collect()}
    assert rows[1].class_name == "cell" and rows[2].class_name is None
    assert (rows[1].source_id, rows[1].tile_id, rows[1].clean_name) == (12, 3, "x_src000012_tile3.jpg")
    with pytest.raises(ValueError, match="duplicate image name"):
        coco.assert_unique_names(named.unionByName(named))
    with pytest.raises(Exception, match="no source id"):
        lb.parse_names(spark.createDataFrame([("plain.jpg",)], "n string"), "n").collect()


def test_coco_files_written_and_read(spark, tmp_path):
    schema = "split string, " + coco.SCHEMA
    rows = [(f"s{k}", [(k, f"x{k}.jpg", 10, 10)], [(1, k, 0, [1.0, 2.0, 3.0, 4.0])], [(0, "Cell")]) for k in range(5)]
    root = str(tmp_path / "export")
    for _ in range(2):  # a repeated write replaces the same files
        coco.write_coco(spark.createDataFrame(rows, schema), root)
    write(tmp_path, "export/deep/er/_annotations.coco.json", "{}")
    for at in (root, "file://" + root):
        images, boxes = coco.read_coco(spark, at, ["cell"])
        assert sorted((r.split, r.image_id) for r in images.collect()) == [(f"s{k}", k) for k in range(5)]
        assert {(r.x, r.h) for r in boxes.collect()} == {(1.0, 4.0)}
    (tmp_path / "none").mkdir()
    assert coco.read_coco(spark, str(tmp_path / "none"), ["cell"])[0].count() == 0


def packets(payload, limit=39, **change):
    n = max(1, -(-len(payload) // limit))
    rows = []
    for i in range(n):
        row = dict(frame_id=1, roi_id=0, chunk_index=i, chunk_count=n, total_bytes=len(payload), offset=i * limit, record_count=len(payload) // 13, infer_us=5, payload=payload[i * limit : (i + 1) * limit])
        rows.append(row)
    return rows


PACKET = "frame_id int, roi_id int, chunk_index int, chunk_count int, total_bytes int, offset int, record_count int, infer_us int, payload binary"


@pytest.mark.parametrize("case,state", [("ok", "complete"), ("repeat", "complete"), ("gap", "timeout"), ("conflict", "conflicting_duplicate"), ("mixed", "inconsistent_header"), ("truncated", "invalid_geometry")])
def test_reassembly(spark, case, state):
    payload = bytes(range(13)) * 7
    rows = packets(payload)
    random.Random(1).shuffle(rows)
    if case == "repeat":
        rows = rows + rows + rows
    if case == "gap":
        rows = [r for r in rows if r["chunk_index"] != 1]
    if case == "conflict":
        rows.append({**rows[0], "payload": bytes([255]) + rows[0]["payload"][1:]})
    if case == "mixed":
        rows[0] = {**rows[0], "infer_us": 6}
    if case == "truncated":
        rows[0] = {**rows[0], "payload": rows[0]["payload"][:-1]}
    got = rc.reassemble(spark.createDataFrame(rows, PACKET), ["frame_id", "roi_id"], 13, 39).first()
    assert got.state == state
    assert (bytes(got.payload) == payload) if state == "complete" else got.payload is None


def test_codec_drops_rows_below_the_limit(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, 0, 10, -1, 2, -128, 127), (1, 0, 0, 1, 2, 12, 3, 4, 5, 6), (1, 0, 1, 0, 1, 9, 0, 0, 0, 0)],
                                 "image_id int, class_id int, slot int, gy int, gx int, obj int, tx int, ty int, tw int, th int")
    packed = rc.encode_records(rows, ["image_id"], 3, {0: 10})
    assert len(packed.first().payload) == 16
    got = rc.decode_records(packed, ["image_id"], 3, 2, 3).orderBy("gy").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 0, 10, -1, 2, -128, 127), (0, 1, 2, 12, 3, 4, 5, 6)]


@pytest.mark.parametrize("payload,text", [(b"\0" * 7, "whole number"), (b"\xff\xff\0" + b"\0" * 5, "outside the grid"), (b"\0" * 16, "duplicate record")])
def test_bad_records_raise(spark, payload, text):
    df = spark.createDataFrame([(1, bytearray(payload))], "image_id int, payload binary")
    with pytest.raises(Exception, match=text):
        rc.decode_records(df, ["image_id"], 3, 2, 3).collect()


def test_demux_needs_one_status(spark):
    df = spark.createDataFrame([(1, bytearray(b"CB\0\1\0\0\1\1"))], "i int, payload binary")
    with pytest.raises(Exception, match="exactly one status"):
        rc.demux_records(df, ["i"])[0].collect()


def test_reviews_with_byte_order_mark(spark, tmp_path):
    head = "review_id,item_type,review_status,reviewed_label,droplet_sequence,best_frame,points_json"
    (tmp_path / "r.csv").write_text("﻿" + head + '\nR1,candidate,reviewed,particle,1,5,"[{""x"": 1, ""y"": 2}]"\nR2,audit,reviewed,particle,1,6,\n', encoding="utf-8")
    reviews = files.read_reviews(spark, str(tmp_path / "r.csv"))
    assert [r.review_id for r in files.usable_reviews(reviews).collect()] == ["R1"]
    pts = files.explode_points(reviews.filter("review_id='R1'").withColumn("size", F.lit(32)), "points_json", "size", ["review_id"]).first()
    assert (pts.point_index, pts.x, pts.y) == (1, 1, 2)
    with pytest.raises(Exception, match="outside the region"):
        files.explode_points(reviews.withColumn("size", F.lit(2)), "points_json", "size", ["review_id"]).collect()
    with pytest.raises(ValueError, match="not unique"):
        files.usable_reviews(reviews.unionByName(reviews))


def test_segments_must_fit(spark):
    rows = spark.range(10).select(F.col("id").alias("frame"), F.lit(3).alias("w"))
    a, b = rows.filter("frame < 5"), rows.filter("frame >= 5")
    assert ds.merge_segments(a, b, "frame", 10, ["w"]).count() == 10
    for bad in (lambda: ds.merge_segments(b, a, "frame", 10, ["w"]), lambda: ds.merge_segments(a, b.filter("frame > 6"), "frame", 10, ["w"])):
        with pytest.raises(ValueError):
            bad()


def test_split_map_rules(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "g string")
    m = spark.createDataFrame([("a", "train")], "g string, split string")
    assert {r.g: r.split for r in ds.apply_split(rows, m, "g").collect()} == {"a": "train", "b": "not_used"}
    with pytest.raises(Exception, match="no split for group"):
        ds.apply_split(rows, m, "g", strict=True).collect()
    with pytest.raises(ValueError, match="more than one split"):
        ds.apply_split(rows, m.unionByName(spark.createDataFrame([("a", "test")], "g string, split string")), "g")


def test_manifest_hash(spark, tmp_path):
    import hashlib

    write(tmp_path, "d/x.bin", "hello")
    r = files.file_manifest(spark, str(tmp_path)).first()
    assert r.sha256 == hashlib.sha256(b"hello").hexdigest() and r.bytes == 5
