"""Removal of byte strings that occur more than once, by column-wise construction over a collection of passages.

A string of ``length`` bytes can only equal another one if both hold the same anchor, the first of their ``anchor``-byte strings
by hash, at the same place. So the texts are cut into passages: runs of neighbouring strings with one anchor. Passages whose
anchor occurs once hold nothing that is repeated; the others, equal ones counted together, are the documents of many small
collections, one per anchor and several in a bucket.

In a bucket all passages stand under each other by their anchor. From the last column to the first, each round inserts one symbol
per passage in front of its suffix: the symbols in the order of the suffixes are the newest column of the collection's
Burrows-Wheeler transform, sorting them stably gives the new order, and the common prefix of two neighbours is one more than the
least one that stood between them, or 0 where the symbols differ. Columns are read one after the other and only the newest one is
kept, since equal strings stand in the same column. A string is repeated when it shares ``length`` symbols with a neighbour or
when its passage was counted more than once.

An anchor with more than ``GROUP`` different passages is split: the first half of its strings share a longer context to its
right, the second half one to its left, and each half is grouped by that context. After at most log2(length) splits the
context is the whole string, so no group stays large and no pair is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.components import forget, keep
from boxtrail.llm.flat import flat_texts, mix, prefix_codes, slices, span_codes
from boxtrail.session import ship_package

LENGTH, ANCHOR = 200, 32
BLOCK_BYTES, PIECE = 1 << 20, 1 << 20
GROUP = 4096
# A spot is one long: first string's start in the block, number of strings, place of the anchor in the first string.
COUNT_BITS, PLACE_BITS = 12, 12
_POSITION = 26


def anchor_size(length: int) -> int:
    if not 2 <= length < 1 << PLACE_BITS:
        raise ValueError(f"strings of 2 to {(1 << PLACE_BITS) - 1} bytes only")
    return max(1, min(ANCHOR, length // 4))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, from the running minima of blocks of that width in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def find_passages(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of the first string, number of strings, start of the anchor) of every passage, by position.

    Strings that would cross from one text into the next are left out.
    """
    anchor, found = anchor_size(length), []
    for base in range(0, max(len(data) - length + 1, 0), PIECE):
        part = data[base : base + PIECE + length - 1]
        prefix = prefix_codes(part)
        at = np.arange(len(part) - anchor + 1)
        code = span_codes(prefix, at, at + anchor)
        first = ((code >> np.uint64(_POSITION + 1)).astype(np.int64) << _POSITION) | at
        place = sliding_minimum(first, length - anchor + 1) & ((1 << _POSITION) - 1)
        start = np.arange(len(place))
        text = np.searchsorted(bounds, start + base, side="right") - 1
        inside = start + base + length <= bounds[text + 1]
        new = np.ones(len(place), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
        new &= inside
        head = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        found.append((head + base, np.bincount(run[inside], minlength=len(head)), place[head] + base))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def to_blocks(documents: DataFrame, text: str, key: str, length: int) -> DataFrame:
    """One row per run of texts of at most ``BLOCK_BYTES``: block, keys, bounds, packed bytes, spots of its passages."""
    rows = documents.select(documents[key].alias("key"), documents[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                texts = flat_texts(part.column("text"))
                start, count, place = find_passages(texts.data, texts.bounds, length)
                spots = (start << (COUNT_BITS + PLACE_BITS)) | (count << PLACE_BITS) | (place - start)
                columns = [one(part.column("key")), one(pa.array(texts.bounds)), pa.array([pa.compress(texts.data.tobytes(), codec="zstd", asbytes=True)]), one(pa.array(spots))]
                yield pa.RecordBatch.from_arrays(columns, names=["keys", "bounds", "data", "spots"])

    blocks = rows.mapInArrow(run, f"keys array<{rows.schema['key'].dataType.simpleString()}>, bounds array<bigint>, data binary, spots array<bigint>")
    return blocks.withColumn("block", F.monotonically_increasing_id())


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=n, codec="zstd", asbytes=True), dtype=np.uint8) if n else np.zeros(0, np.uint8)


def spot_parts(spots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of strings, place of the anchor)."""
    return spots >> (COUNT_BITS + PLACE_BITS), spots >> PLACE_BITS & ((1 << COUNT_BITS) - 1), spots & ((1 << PLACE_BITS) - 1)


def passages(blocks: DataFrame, length: int) -> DataFrame:
    """(key, own, block, spot): hash of the anchor, hash of the whole passage with the anchor's place, where it stands."""
    anchor = anchor_size(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                spots = batch.column(3)[r].values.to_numpy(zero_copy_only=False)
                data = unpacked(batch.column(2)[r].as_py(), batch.column(1)[r].values[-1].as_py())
                start, count, place = spot_parts(spots)
                for base in range(0, max(len(data), 1), PIECE):
                    a, b = np.searchsorted(start, [base, base + PIECE])
                    prefix = prefix_codes(data[base : base + PIECE + length - 1])
                    s, p = start[a:b] - base, place[a:b]
                    key = span_codes(prefix, s + p, s + p + anchor)
                    own = mix(span_codes(prefix, s, s + count[a:b] + length - 1) + p.astype(np.uint64))
                    block = np.full(b - a, batch.column(0)[r].as_py(), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own.view(np.int64)), pa.array(block), pa.array(spots[a:b])], names=["key", "own", "block", "spot"])

    return blocks.select("block", "bounds", "data", "spots").mapInArrow(run, "key bigint, own bigint, block bigint, spot bigint")


def byte_rows(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes of several spans as a binary column."""
    bounds = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def class_bytes(blocks: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """(key, own, n, place, data): the bytes of each class, taken from the one block that its row names."""
    wanted = classes.groupBy("block").agg(F.collect_list(F.struct("key", "own", "n", "spot")).alias("wanted"))
    rows = blocks.select("block", "bounds", "data").join(wanted, "block").select("bounds", "data", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                data = unpacked(batch.column(1)[r].as_py(), batch.column(0)[r].values[-1].as_py())
                key, own, n, spot = batch.column(2)[r].values.flatten()
                for a in range(0, len(spot), 8192):
                    part = slice(a, a + 8192)
                    start, count, place = spot_parts(spot.to_numpy(zero_copy_only=False)[part])
                    columns = [key[part], own[part], n[part], pa.array(place.astype(np.int32)), byte_rows(data, start, count + length - 1)]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "own", "n", "place", "data"])

    return rows.mapInArrow(run, "key bigint, own bigint, n bigint, place int, data binary")


def number(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little", signed=True)


def split_classes(rows: DataFrame, length: int) -> DataFrame:
    """Both halves of each passage's strings as passages of their own, keyed by the longer context that each half shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data, place, low, high = r["data"], r["place"], r["low"], r["high"]
                middle = (low + high + 1) // 2
                for a, b in ((low, middle - 1), (middle, high)):
                    # String number j of the passage has the anchor at place - j.
                    first, last = max(place - b, 0), min(place - a, len(data) - length)
                    if first <= last:
                        part = data[first : last + length]
                        context = data[place - a : place - b + length]
                        out.append(r | {"shift": r["shift"] + first, "key": number(a, b, context), "own": number(place - first, part), "place": place - first, "data": part, "low": a, "high": b})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return rows.mapInArrow(run, rows.schema)


def repeated_strings(data: pa.Array, place: np.ndarray, group: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, first, last) of every run of strings in a collection that occur elsewhere in it; passages sorted by group."""
    rows, ahead = len(data), length - anchor_size(length)
    bounds = np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset : data.offset + rows + 1].astype(np.int64)
    body = np.frombuffer(data.buffers()[2], dtype=np.uint8)
    size = np.diff(bounds)
    # Column c holds the symbols c - ahead after the anchor's start; 0 stands outside a passage.
    left = ahead - place
    symbols = np.zeros((ahead + length, rows), dtype=np.uint16)
    for a in range(0, rows, 1024):
        z = size[a : a + 1024]
        doc = np.repeat(np.arange(len(z)), z)
        k = np.arange(z.sum()) - np.repeat(np.cumsum(z) - z, z)
        symbols[left[a : a + 1024][doc] + k, a + doc] = body[bounds[a] : bounds[a] + z.sum()].astype(np.uint16) + 1
    order, common = np.arange(rows), np.zeros(rows, dtype=np.int32)
    opens = np.ones(rows, dtype=bool)
    opens[1:] = group[1:] != group[:-1]
    of_slot = np.cumsum(opens) - 1
    found = np.zeros((ahead + 1, rows), dtype=bool)
    last = left + size - length
    for c in range(ahead + length - 1, -1, -1):
        transform = symbols[c][order]
        same = transform[1:] == transform[:-1]
        falls = np.flatnonzero((transform[1:] < transform[:-1]) & ~opens[1:])
        if len(falls):
            # Groups whose symbols are out of order are sorted anew; the others keep their order.
            touched = np.zeros(of_slot[-1] + 1, dtype=bool)
            touched[of_slot[falls + 1]] = True
            slots = np.flatnonzero(touched[of_slot])
            code = of_slot[slots] * 257 + transform[slots]
            moved = np.argsort(code, kind="stable")
            sorted_code = code[moved]
            old = common[slots]
            link = np.flatnonzero(sorted_code[1:] == sorted_code[:-1])
            new = np.zeros(len(slots), dtype=np.int32)
            if len(link):
                # Least common prefix between two neighbours: over the slots after the first up to the second.
                pairs = np.empty(2 * len(link), dtype=np.int64)
                pairs[0::2], pairs[1::2] = moved[link] + 1, moved[link + 1] + 1
                new[link + 1] = np.minimum.reduceat(np.append(old, 0), pairs)[0::2] + 1
            common[1:] = np.where(same & ~opens[1:], common[1:] + 1, 0)
            common[slots] = new
            order[slots] = order[slots[moved]]
        else:
            common[1:] = np.where(same & ~opens[1:], common[1:] + 1, 0)
        if c <= ahead:
            near = common >= length
            near[:-1] |= near[1:]
            found[c, order] = near | many[order]
            found[c] &= (left <= c) & (c <= last)
    edge = np.diff(np.pad(found.T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return row, first - left[row], end - 1 - left[row]


def repeated_runs(classes: DataFrame, length: int, buckets: int) -> DataFrame:
    """(key, own, first, last): runs of repeated strings of each class, found bucket by bucket."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("own", "ascending")]).combine_chunks()
        column = lambda name: table.column(name).to_numpy()
        data = table.column("data").chunk(0) if table.column("data").num_chunks else pa.array([], pa.binary())
        row, first, last = repeated_strings(data, column("place").astype(np.int64), column("key"), column("n") > 1, length)
        out = [pa.array(column("key")[row]), pa.array(column("own")[row]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
        return pa.table(out, names=["key", "own", "first", "last"])

    rows = classes.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInArrow(run, "key bigint, own bigint, first int, last int")


def class_runs(classes: DataFrame, length: int, group: int) -> DataFrame:
    """(key, own, first, last) of the classes (key, own, n, place, data), anchors with many classes split until they are small."""
    ahead = length - anchor_size(length)
    start = classes.select(F.col("key").alias("root_key"), F.col("own").alias("root_own"), F.lit(0).alias("shift"), "*", F.lit(0).alias("low"), F.lit(ahead).alias("high"))
    hot = keep(classes.groupBy("key").count().where(F.col("count") > group).select("key"), "crowded")
    if hot.isEmpty():
        return repeated_runs(classes, length, 1 + classes.count() // group)
    done, open_ = [start.join(hot, "key", "left_anti").select(*start.columns)], start.join(hot, "key", "left_semi").select(*start.columns)
    while True:
        open_ = keep(split_classes(open_, length), "split-passages")
        hot = keep(open_.groupBy("key").agg(F.approx_count_distinct("own").alias("n")).where(F.col("n") > group).select("key"), "crowded")
        # A context of the whole string has one class, so it is never split again.
        hot = keep(open_.where("low < high").join(hot, "key", "left_semi").select("key").distinct(), "crowded")
        done.append(open_.join(hot, "key", "left_anti").select(*start.columns))
        if hot.isEmpty():
            break
        open_ = open_.join(hot, "key", "left_semi").select(*start.columns)
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    rows = keep(rows, "passage-parts")
    leaves = keep(rows.groupBy("key", "own").agg(F.sum("n").alias("n"), F.first("place").alias("place"), F.first("data").alias("data")), "leaf-classes")
    runs = keep(repeated_runs(leaves, length, 1 + leaves.count() // group), "leaf-runs")
    back = rows.select("root_key", "root_own", "shift", "key", "own").join(runs, ["key", "own"])
    return back.select(F.col("root_key").alias("key"), F.col("root_own").alias("own"), (F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last"))


def merged(starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [from, to) of bytes that are covered by strings starting at each start and the ``count - 1`` places after it."""
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], (starts + counts + length - 1)[order]
    reach = np.maximum.accumulate(end)
    new = np.ones(len(begin), dtype=bool)
    new[1:] = begin[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return begin[head], reach[np.append(head[1:], len(begin)) - 1] if len(begin) else reach


def cut_texts(blocks: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """(key, n_bytes, kept, spans) of every text; ``runs`` has (block, run): start and number of repeated strings in one long."""
    lists = runs.groupBy("block").agg(F.collect_list("run").alias("runs"))
    rows = blocks.select("block", "keys", "bounds", "data").join(lists, "block", "left").select("keys", "bounds", "data", "runs")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                bounds = batch.column(1)[r].values.to_numpy(zero_copy_only=False)
                data = unpacked(batch.column(2)[r].as_py(), int(bounds[-1]))
                cell = batch.column(3)[r].values
                packed = np.zeros(0, np.int64) if cell is None else cell.to_numpy(zero_copy_only=False)
                begin, end = merged(packed >> COUNT_BITS, packed & ((1 << COUNT_BITS) - 1), length)
                # Runs of neighbouring texts may touch: each is cut where a text begins.
                text = np.searchsorted(bounds, begin, side="right") - 1
                over = np.searchsorted(bounds, end, side="left") - text
                text = np.repeat(text, over) + np.arange(over.sum()) - np.repeat(np.cumsum(over) - over, over)
                begin, end = np.maximum(np.repeat(begin, over), bounds[text]), np.minimum(np.repeat(end, over), bounds[text + 1])
                text, begin, end = (x[end > begin] for x in (text, begin, end))
                gone = np.zeros(len(data) + 1, dtype=np.int8)
                gone[begin] += 1
                np.subtract.at(gone, end, 1)
                stays = np.cumsum(gone[:-1]) == 0
                left = np.concatenate(([0], np.cumsum(stays)))[bounds]
                kept = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[stays]))])
                cuts = pa.StructArray.from_arrays([pa.array(begin - bounds[text]), pa.array(end - bounds[text])], names=["start", "end"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(bounds))).astype(np.int32)), cuts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[r].values, pa.array(np.diff(bounds)), kept, spans], names=["key", "n_bytes", "kept", "spans"])

    return rows.mapInArrow(run, f"key {kind}, n_bytes bigint, kept binary, spans array<struct<start:bigint,end:bigint>>")


def remove_repeats(documents: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """One row per row of ``documents``: key, ``n_bytes``, ``kept`` (remaining bytes) and ``spans`` (maximal removed runs, start and end).

    Every byte that is covered by a string of ``length`` bytes that also starts anywhere else, in the same text or another, is
    removed; strings are judged on the input and never cross texts. A null text is empty, and texts shorter than ``length``
    lose nothing. Rows that repeat a text repeat all of its strings, whatever their keys; rows without a key are treated like
    the others. An empty table gives no rows. Other columns are ignored. Passages are told apart by two 64-bit hashes, the
    strings in them symbol by symbol.
    """
    ship_package(documents.sparkSession)
    blocks = keep(to_blocks(documents, text, key, length), "text-blocks")
    every = passages(blocks, length)
    repeated = keep(every.groupBy("key").count().where("count > 1").select("key"), "repeated-anchors")
    members = keep(every.join(repeated, "key").select("key", "own", "block", "spot"), "passages")
    forget(repeated)
    classes = keep(members.groupBy("key", "own").agg(F.count("*").alias("n"), F.min(F.struct("block", "spot")).alias("at")).select("key", "own", "n", "at.block", "at.spot"), "classes")
    with_bytes = keep(class_bytes(blocks, classes, length), "class-bytes")
    forget(classes)
    runs = keep(class_runs(with_bytes, length, group), "class-runs")
    forget(with_bytes)
    start = F.shiftright("spot", COUNT_BITS + PLACE_BITS) + F.col("first")
    found = members.join(runs, ["key", "own"]).select("block", (F.shiftleft(start, COUNT_BITS) + (F.col("last") - F.col("first") + 1)).alias("run"))
    return cut_texts(blocks, found, length).withColumnRenamed("key", key)
