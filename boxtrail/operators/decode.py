"""Detector head decoding and quantization over long grid tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from boxtrail.functions.geometry import Box, clamp, xywh_to_xyxy


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dequantize(code: Column, scale, zero_point=0) -> Column:
    return (code - zero_point) * scale


def dequantize_channels(df: DataFrame, channels: DataFrame, acc: str = "acc") -> DataFrame:
    """Accumulator codes to reals with a per-channel bias; ``channels`` (channel, scale, bias) is one row a channel."""
    return df.join(F.broadcast(channels), "channel").withColumn("value", F.col(acc) * F.col("scale") + F.col("bias"))


def requantize(value: Column, scale, bits: int) -> Column:
    low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    return F.least(F.greatest(F.rint(value / scale), F.lit(float(low))), F.lit(float(high)))


def quantize(pixel: Column, scale, bits: int = 8) -> Column:
    return clamp(F.rint(pixel / 255.0 / scale), 0.0, float((1 << bits) - 1)).cast("int")


def reduce_codes(code: Column, bits: int) -> Column:
    """Code at fewer bits, expanded back to 0..255."""
    if not 1 <= bits <= 8:
        raise ValueError("bits must be 1..8")
    top = (1 << bits) - 1
    if bits == 8:
        return code.cast("int")
    return F.rint(F.rint(code * top / 255.0) * 255.0 / top).cast("int")


def object_code(probability: Column, scale) -> Column:
    return F.rint(F.ln(probability / (1 - probability)) / scale).cast("int")


def keep_code(probability: Column, scale, zero_point=0) -> Column:
    """Lowest objectness code that still reaches a probability."""
    return F.ceil(F.ln(probability / (1 - probability)) / scale + zero_point).cast("int")


# Two grid rows lie this far apart in a cell's number, so the cells beside it are ranges of numbers.
GRID_ROW = 1 << 32


def local_peaks(cells: DataFrame, keys: list[str], value: str, tolerance: float = 1e-7) -> DataFrame:
    """Cells (gy, gx) whose value is the maximum of their 3x3 neighbourhood, within a tolerance.

    A grid's cells are sorted once by their number along its rows; the nine cells around one are three short ranges of it. In a
    grid of very many cells every cell sends its value to its nine neighbours instead, which pre-aggregate to a maximum before
    the shuffle.
    """
    from boxtrail.operators.skew import union_routes
    from boxtrail.session import WINDOW_ROWS, setting

    def ranged(df):
        number = F.col("gy").cast("long") * F.lit(GRID_ROW).cast("long") + F.col("gx").cast("long")
        rows = Window.partitionBy(*keys).orderBy("_at")
        peaks = [F.max(value).over(rows.rangeBetween(dy * GRID_ROW - 1, dy * GRID_ROW + 1)) for dy in (-1, 0, 1)]
        near = df.withColumn("_at", number).withColumns({f"_peak{i}": p for i, p in enumerate(peaks)})
        peak = F.greatest(*[f"_peak{i}" for i in range(3)])
        return near.filter(F.col(value) >= peak - tolerance).select(*df.columns)

    def sent(df):
        step = F.array(F.lit(-1), F.lit(0), F.lit(1))
        spread = df.select(*keys, "gy", F.explode(step).alias("_dy"), "gx", value)
        spread = spread.select(*keys, (F.col("gy") + F.col("_dy")).alias("gy"), "gx", F.explode(step).alias("_dx"), value)
        near = spread.groupBy(*keys, "gy", (F.col("gx") + F.col("_dx")).alias("gx")).agg(F.max(value).alias("_peak"))
        joined = df.join(near, [*keys, "gy", "gx"])
        return joined.filter(F.col(value) >= F.col("_peak") - tolerance).select(*df.columns)

    first = [*keys, "gy", "gx"]
    placed = cells.dropna(subset=first).select(*first, *[c for c in cells.columns if c not in first])
    return union_routes(placed, keys, ranged, sent, setting(cells.sparkSession, WINDOW_ROWS))


def decode_grid(
    grid: DataFrame, anchors: dict[int, tuple[float, float]], width: int, height: int, thresholds: dict[int, float]
) -> DataFrame:
    """Grid rows (image_id, class_id, slot, gy, gx, obj, tx, ty, tw, th) to clamped boxes with confidence.

    A cell survives when its objectness is a local peak of its slot and reaches the class threshold.
    """
    conf = grid.withColumn("confidence", sigmoid(F.col("obj")))
    limit = F.create_map(*[F.lit(v) for kv in thresholds.items() for v in (int(kv[0]), float(kv[1]))])
    peaks = local_peaks(conf, ["image_id", "class_id", "slot"], "confidence")
    kept = peaks.filter(F.col("confidence") >= limit[F.col("class_id")])

    def size(i, t):
        anchor = F.create_map(*[F.lit(v) for c, a in anchors.items() for v in (int(c), float(a[i]))])
        return anchor[F.col("class_id")] * F.exp(clamp(t, -3.0, 2.0))

    cx = (F.col("gx") + sigmoid(F.col("tx"))) / width
    cy = (F.col("gy") + sigmoid(F.col("ty"))) / height
    raw = xywh_to_xyxy(cx, cy, size(0, F.col("tw")), size(1, F.col("th")))
    cols = [clamp(c).alias(n) for n, c in zip(Box._fields, raw)]
    return kept.select("image_id", "class_id", "slot", "gy", "gx", "confidence", *cols)


def encode_targets(
    labels: DataFrame, grid_w: int, grid_h: int, slots: dict[int, int], anchors: dict[int, tuple[float, float]]
) -> tuple[DataFrame, DataFrame]:
    """(slot rows, collisions per image) of labels (image_id, gt_idx, class_id, cx, cy, w, h).

    Labels fill the free slots of their grid cell in order; once full, a label replaces the smallest held box only
    when it is larger. The final content is the first n labels with that rule applied, so it is a fold per cell.
    """
    from boxtrail.operators.skew import union_routes

    keys = ["image_id", "class_id", "gy", "gx"]
    gx = F.least(F.floor(F.col("cx") * grid_w), F.lit(grid_w - 1)).cast("int")
    gy = F.least(F.floor(F.col("cy") * grid_h), F.lit(grid_h - 1)).cast("int")
    rows = labels.withColumns({"gx": gx, "gy": gy})
    capacity = F.create_map(*[F.lit(v) for kv in slots.items() for v in (int(kv[0]), int(kv[1]))])
    item = F.struct("gt_idx", "cx", "cy", "w", "h", (F.col("w") * F.col("h")).alias("a"))

    def fold(df):
        packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_e"))
        shape = "gt_idx:bigint,cx:double,cy:double,w:double,h:double,a:double"
        start = F.expr(f"cast(array() as array<struct<{shape}>>)")
        room = capacity[F.col("class_id")]

        def step(acc, e):
            least = F.array_min(F.transform(acc, lambda x: x["a"]))
            at = F.array_position(F.transform(acc, lambda x: x["a"]), least)
            swapped = F.transform(acc, lambda x, i: F.when(i + 1 == at, e).otherwise(x))
            return (
                F.when(F.size(acc) < room, F.array_append(acc, e)).when(e["a"] > least, swapped).otherwise(acc)
            )

        held = packed.select(*keys, F.posexplode(F.aggregate("_e", start, step)).alias("slot", "v"))
        return held.select(*keys, "slot", *[F.col(f"v.{c}").alias(c) for c in ("gt_idx", "cx", "cy", "w", "h")])

    def spread(df):
        """A hot cell ends up holding its largest boxes; slots are filled and replaced in a fixed order, so the
        fold is replayed on the few rows that can change it: the running largest ones."""
        n = max(slots.values())
        return fold(_fold_survivors(df, keys, n))

    cast = rows.withColumn("gt_idx", F.col("gt_idx").cast("long"))
    held = union_routes(cast, keys, fold, spread)
    ax, ay = (F.create_map(*[F.lit(v) for c, a in anchors.items() for v in (int(c), float(a[i]))]) for i in (0, 1))
    out = held.select(
        *keys,
        "slot",
        "gt_idx",
        (F.col("cx") * grid_w - F.col("gx")).alias("tx"),
        (F.col("cy") * grid_h - F.col("gy")).alias("ty"),
        F.ln(F.col("w") / ax[F.col("class_id")]).alias("tw"),
        F.ln(F.col("h") / ay[F.col("class_id")]).alias("th"),
    )
    per_cell = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    over = F.greatest(F.col("n") - capacity[F.col("class_id")], F.lit(0))
    return out, per_cell.groupBy("image_id").agg(F.sum(over).alias("collisions"))


def _fold_survivors(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows that can take part in the slot fold: the first ``n``, and every row larger than the n-th largest before it.

    Chunks of the label order are reduced to their own survivors first, again and again, until groups are small.
    """
    from boxtrail.session import materialize

    from boxtrail.operators.ordered import indexed
    from boxtrail.session import FOLD_ROWS, setting

    limit = setting(df.sparkSession, FOLD_ROWS)
    rest = materialize(df.select(*keys, "gt_idx", "cx", "cy", "w", "h"))
    while True:
        before = rest.count()
        numbered = indexed(rest, keys, ["gt_idx"], "_i").withColumn("_chunk", F.floor(F.col("_i") / limit))
        item = F.struct("gt_idx", "cx", "cy", "w", "h")
        packed = numbered.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(item)).alias("_e"))

        def step(acc, e):
            area = e["w"] * e["h"]
            bigger = F.size(F.filter(acc["top"], lambda a: a >= area))
            top = F.slice(F.sort_array(F.array_append(acc["top"], area), False), 1, n)
            kept = F.when(bigger < n, F.array_append(acc["rows"], e)).otherwise(acc["rows"])
            return F.struct(top.alias("top"), kept.alias("rows"))

        start = F.expr(
            "named_struct('top',cast(array() as array<double>),'rows',"
            "cast(array() as array<struct<gt_idx:bigint,cx:double,cy:double,w:double,h:double>>))"
        )
        kept = packed.select(*keys, F.explode(F.aggregate("_e", start, step)["rows"]).alias("v"))
        rest = materialize(kept.select(*keys, "v.*"))
        if rest.count() == before:
            return rest
