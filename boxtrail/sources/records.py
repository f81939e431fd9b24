"""Packed detection records and datagram fragments held in binary columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Record sizes, status and box record marks, working size of the box records, flag bits in use,
# fragment payload limit and the largest legal number of records in one result.
SHORT_RECORD, LONG_RECORD = 8, 13
STATUS_MARK, BOX_MARK = "485953", "4342"
WORKING_SIZE = 96
MAX_PAYLOAD = 1400
MAX_RECORDS = 576 * 3


def byte_at(payload: Column, position) -> Column:
    """Unsigned byte at a 1-based position."""
    return F.conv(F.hex(F.substring(payload, position, 1)), 16, 10).cast("int")


def signed(value: Column, bits: int) -> Column:
    return F.when(value >= (1 << (bits - 1)), value - (1 << bits)).otherwise(value)


def little_endian(payload: Column, position: int, size: int) -> Column:
    total = byte_at(payload, position).cast("long")
    for i in range(1, size):
        total = total + F.shiftleft(byte_at(payload, position + i).cast("long"), 8 * i)
    return total


def byte_sum(payload: Column) -> Column:
    """Sum of the bytes modulo 65536."""
    n = F.length(F.hex(payload)) / 2
    each = F.transform(
        F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))),
        lambda i: F.coalesce(F.conv(F.hex(payload.substr(i, F.lit(1))), 16, 10).cast("long"), F.lit(0).cast("long")),
    )
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, v: a + v) % 65536


def _slices(df: DataFrame, ident: list[str], width: int) -> DataFrame:
    """One row per record of a payload; a payload that is not a whole number of records raises."""
    size = F.length("payload")
    bad = F.raise_error(F.lit("payload is not a whole number of records")).cast("int")
    n = F.when(size % width == 0, (size / width).cast("int")).otherwise(bad)
    index = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    rows = df.select(*ident, "payload", index.alias("rec"))
    return rows.select(*ident, "rec", F.col("payload").substr(F.col("rec") * width + 1, F.lit(width)).alias("record"))


CODES = ("obj", "tx", "ty", "tw", "th")


def decode_records(df: DataFrame, ident: list[str], grid_w: int, grid_h: int, slots: int, width: int = SHORT_RECORD) -> DataFrame:
    """Rows (ident, slot, gy, gx and five codes) of packed records.

    8-byte records hold five signed bytes, 13-byte ones five signed little-endian shorts. Indexes outside the grid
    and repeated (grid, slot) records raise.
    """
    step = 1 if width == SHORT_RECORD else 2
    rows = _slices(df, ident, width)
    r = F.col("record")
    rows = rows.select(
        *ident,
        "rec",
        little_endian(r, 1, 2).cast("int").alias("grid_index"),
        byte_at(r, 3).alias("slot"),
        *[signed(little_endian(r, 4 + step * i, step), 8 * step).cast("int").alias(c) for i, c in enumerate(CODES)],
    )
    inside = (F.col("grid_index") < grid_w * grid_h) & (F.col("slot") < slots)
    key = [*ident, "grid_index", "slot"]
    first = {c: F.first(c).alias(c) for c in CODES}
    once = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *first.values())
    problem = F.when(~inside, "record outside the grid").when(F.col("_n") > 1, "duplicate record")
    # The check feeds an output column, so no optimizer step can prune it away.
    checked = F.when(problem.isNull(), F.col("slot")).otherwise(F.raise_error(problem).cast("int"))
    return once.select(
        *ident,
        checked.alias("slot"),
        F.floor(F.col("grid_index") / grid_w).cast("int").alias("gy"),
        (F.col("grid_index") % grid_w).cast("int").alias("gx"),
        *CODES,
    )


def _byte_hex(value: Column, bits: int = 8) -> Column:
    """Little-endian hex of an integer of 8 or 16 bits."""
    word = F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(1 << bits))), bits // 4, "0")
    return word if bits == 8 else F.concat(F.substring(word, 3, 2), F.substring(word, 1, 2))


def encode_records(rows: DataFrame, ident: list[str], grid_w: int, limits: dict[int, int], width: int = SHORT_RECORD) -> DataFrame:
    """Payload per ident from rows whose objectness code reaches the class limit, ordered by (grid, slot).

    A payload holds at most grid x slots records, so its array is bounded by the grid.
    """
    table = F.create_map(*[F.lit(v) for kv in limits.items() for v in (int(kv[0]), int(kv[1]))])
    kept = rows.filter(F.col("obj") >= table[F.col("class_id")])
    index = F.col("gy") * grid_w + F.col("gx")
    bits = 8 if width == SHORT_RECORD else 16
    body = F.concat(_byte_hex(index, 16), _byte_hex(F.col("slot")), *[_byte_hex(F.col(c), bits) for c in CODES])
    item = F.struct(index.alias("g"), F.col("slot").alias("s"), body.alias("b"))
    packed = kept.groupBy(*ident).agg(F.sort_array(F.collect_list(item)).alias("_r"))
    text = F.array_join(F.transform("_r", lambda x: x["b"]), "")
    return packed.select(*ident, F.unhex(text).alias("payload"))


def demux_records(df: DataFrame, ident: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(status, boxes, detector records) of mixed 8-byte responses, told apart by their first bytes.

    Each response has exactly one status record; a box has a known class and lies inside the working image.
    """
    rows = _slices(df, ident, SHORT_RECORD)
    r, mark = F.col("record"), F.hex("record")
    kind = F.when(mark.startswith(STATUS_MARK), "status").when(mark.startswith(BOX_MARK), "box").otherwise("detector")
    rows = rows.withColumn("kind", kind)
    counts = rows.groupBy(*ident).agg(
        F.count_if(F.col("kind") == "status").alias("n"), F.max(F.when(F.col("kind") == "status", r)).alias("s")
    )
    missing = df.select(*ident).join(counts, ident, "left")
    flags = F.when(F.coalesce("n", F.lit(0)) == 1, byte_at(F.col("s"), 4)).otherwise(
        F.raise_error(F.lit("response needs exactly one status record")).cast("int")
    )
    status = missing.select(
        *ident,
        flags.alias("flags"),
        little_endian(F.col("s"), 5, 2).alias("droplet_count"),
        little_endian(F.col("s"), 7, 2).alias("cell_count"),
    )
    x1, y1, x2, y2 = (byte_at(r, p) for p in (5, 6, 7, 8))
    cls = byte_at(r, 3)
    ok = (cls <= 1) & (x1 <= x2) & (y1 <= y2) & (x2 < WORKING_SIZE) & (y2 < WORKING_SIZE)
    bad = F.raise_error(F.concat(F.lit("invalid box record "), mark)).cast("int")
    boxes = rows.filter("kind = 'box'").select(
        *ident, "rec", F.when(ok, cls).otherwise(bad).alias("class_id"), byte_at(r, 4).alias("score_code"),
        x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"),
    )
    return status, boxes, rows.filter("kind = 'detector'").select(*ident, "rec", "record")


def flag(flags: Column, bit: int) -> Column:
    return F.getbit(flags, F.lit(bit))


def scale_boxes(boxes: DataFrame, roi: tuple[int, int, int, int]) -> DataFrame:
    """Working-size boxes (inclusive corners) to frame pixels."""
    sx, sy = (roi[2] - roi[0]) / WORKING_SIZE, (roi[3] - roi[1]) / WORKING_SIZE
    return boxes.withColumns(
        {
            "x1": F.rint(roi[0] + F.col("x1") * sx).cast("int"),
            "y1": F.rint(roi[1] + F.col("y1") * sy).cast("int"),
            "x2": (F.rint(roi[0] + (F.col("x2") + 1) * sx) - 1).cast("int"),
            "y2": (F.rint(roi[1] + (F.col("y2") + 1) * sy) - 1).cast("int"),
        }
    )


def reassemble(packets: DataFrame, keys: list[str], record_bytes: int = LONG_RECORD, max_payload: int = MAX_PAYLOAD) -> DataFrame:
    """Whole payloads from fragments: state ``complete``, ``timeout`` (a gap) or the reason of rejection.

    Identical repeats are fine in any number; they collapse before anything is gathered. A result has a bounded
    number of chunks, so gathering one is bounded too.
    """
    size = F.length("payload")
    expected = F.greatest(F.lit(1), F.ceil(F.col("total_bytes") / max_payload))
    wrong = (
        (F.col("total_bytes") > MAX_RECORDS * record_bytes)
        | (F.col("total_bytes") != F.col("record_count") * record_bytes)
        | (F.col("chunk_count") != expected)
        | (F.col("chunk_index") >= F.col("chunk_count"))
        | (F.col("offset") != F.col("chunk_index") * max_payload)
        | (size != F.least(F.lit(max_payload), F.col("total_bytes") - F.col("offset")))
    )
    head = ["total_bytes", "chunk_count", "record_count", "infer_us"]
    cols = [*keys, *head, "chunk_index", "offset", "payload"]
    # Repeats collapse here; what is left of a chunk are its distinct contents.
    once = packets.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_wrong", wrong)
    per_chunk = once.groupBy(*keys, "chunk_index").agg(
        F.count_distinct("payload").alias("_contents"),
        F.bool_or("_wrong").alias("_wrong"),
        F.min(F.struct(*head)).alias("_lo"),
        F.max(F.struct(*head)).alias("_hi"),
        F.min("payload").alias("_p"),
    )
    group = per_chunk.groupBy(*keys).agg(
        F.max("_contents").alias("_contents"),
        F.bool_or("_wrong").alias("_wrong"),
        F.min("_lo").alias("_lo"),
        F.max("_hi").alias("_hi"),
        F.count(F.lit(1)).alias("_have"),
    )
    state = (
        F.when(F.col("_wrong"), "invalid_geometry")
        .when(F.col("_lo") != F.col("_hi"), "inconsistent_header")
        .when(F.col("_contents") > 1, "conflicting_duplicate")
        .when(F.col("_have") < F.col("_lo.chunk_count"), "timeout")
        .otherwise("complete")
    )
    judged = group.select(*keys, state.alias("state"), "_lo.record_count", "_lo.infer_us")
    good = per_chunk.join(judged.filter("state = 'complete'").select(*keys), keys, "left_semi")
    joined = good.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("chunk_index", "_p"))).alias("_c"))
    payload = F.unhex(F.array_join(F.transform("_c", lambda c: F.hex(c["_p"])), ""))
    return judged.join(joined.select(*keys, payload.alias("payload")), keys, "left")
