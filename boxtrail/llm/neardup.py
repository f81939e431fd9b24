"""Near-duplicates by a chosen-path set similarity join over word shingles.

Documents with equal shingle sets form one class. Independent trees grow from the root, which holds all classes: a node of more
than ``NODE`` classes is branched by the values of minwise tokens that the node itself chooses, a smaller one is compared
exhaustively inside one task, on samples of the shingle sets that cannot miss a link of sets up to ``SAMPLE`` shingles. A node
puts out only a maximum spanning forest of its likely pairs, so its output is linear; the pairs are confirmed on full sets and
contracted to components. Where a confirmation fails, the nodes that relied on it are compared again and put out every likely
pair between different components.

Large groups of near copies branch slowly, as they share most tokens. In a crowded node all classes first meet a few leaders
(the class with the most copies, and some by hash); these links are confirmed and contracted. A node within one component is
dropped, and where at most ``NODE`` classes lie outside its largest component, only these meet the node, in chunks. The others
branch on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.components import components, forget, keep
from boxtrail.llm.flat import Words, distinct_per_text, flat_texts, grams, mix, slices, words_of
from boxtrail.session import ship_package

SHINGLE, MINWISE, TREES = 5, 32, 16
# Classes that are compared exhaustively; rows of a bucket of nodes; leaders of a crowded node.
NODE, BUCKET, LEADERS = 1024, 2048, 4
# Levels of a tree, and the share of crowded nodes with two children: the expected number of children is about 1 / similarity, so
# trees neither die out nor grow along large groups of near copies.
LEVELS, EXTRA = 64, 0.2
# Levels between two rounds of leaders.
LEADER_STEP = 4
SAMPLE, STRIPE = 512, 128
# A link between sampled sets is missed by the estimate with probability below 1e-6 (five deviations).
DEVIATIONS = 5.0
SLICE = 1 << 20
KEY_BROADCAST_ROWS = 1_000_000
_STEP = mix(np.arange(7001, 7001 + MINWISE, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(9001, 9001 + MINWISE, dtype=np.uint64))
_SAMPLE_SALT = np.uint64(0x51ED270B)


def shingle_sets(words: Words, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, code) of the ``size``-word shingles; a text with fewer words has its whole sequence as one."""
    at, code = grams(words, size)
    text, codes = [words.text[at]], [code]
    count = words.counts(rows)
    for k in range(1, size):
        at, code = grams(words, k)
        mine = count[words.text[at]] == k
        text.append(words.text[at][mine])
        codes.append(mix(code[mine] + np.uint64(k)))
    return distinct_per_text(np.concatenate(text), np.concatenate(codes))


def set_digests(text: np.ndarray, code: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two order-free 64-bit hashes of each text's set."""
    bounds = np.searchsorted(text, np.arange(rows + 1))
    out = []
    for salt in (0x1234567, 0x89ABCDEF01):
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(code ^ np.uint64(salt)), dtype=np.uint64)))
        out.append((run[bounds[1:]] - run[bounds[:-1]]).view(np.int64))
    return np.diff(bounds), *out


def samples(text: np.ndarray, code: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(level, deeper, bounds, marks): 16-bit marks of a consistent sample of each text's set.

    A set of up to ``SAMPLE`` shingles is marked whole (level 0); a larger one keeps those whose hash has ``level`` zero bits.
    The first ``deeper`` marks of a text are its sample one level further up.
    """
    n = np.diff(np.searchsorted(text, np.arange(rows + 1)))
    level = np.ceil(np.log2(np.maximum(n, 1) / SAMPLE)).clip(0).astype(np.int64)
    hashed = mix(code ^ _SAMPLE_SALT)
    low = np.uint64(1) << level.astype(np.uint64)
    stay = (hashed & (low - np.uint64(1))[text]) == 0
    text, hashed = text[stay], hashed[stay]
    deep = (hashed & low[text]) == 0
    bounds = np.searchsorted(text, np.arange(rows + 1))
    run = np.concatenate(([0], np.cumsum(deep)))
    deeper = run[bounds[1:]] - run[bounds[:-1]]
    before, start = run[:-1] - run[bounds[text]], bounds[text]
    place = np.where(deep, start + before, start + deeper[text] + np.arange(len(text)) - start - before)
    marks = np.empty(len(text), dtype="<u2")
    marks[place] = (hashed >> np.uint64(40)).astype(np.uint16)
    return level, deeper, bounds, marks


def signatures(documents: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(key, n, d1, d2, level, deeper, marks, mh): set size, set digest, marked sample and minwise tokens (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = flat_texts(part.column("text"), lower=True)
                doc, code = shingle_sets(words_of(texts), texts.rows, size)
                n, d1, d2 = set_digests(doc, code, texts.rows)
                real = np.flatnonzero(n)
                first = np.searchsorted(doc, real)
                mh = np.zeros((texts.rows, MINWISE), dtype=np.int32)
                for k in range(MINWISE if len(real) else 0):
                    high = ((code * _STEP[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
                    mh[real, k] = np.minimum.reduceat(high, first).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(texts.rows + 1, dtype=np.int32) * MINWISE), pa.array(mh.ravel()), mask=pa.array(n == 0))
                level, deeper, bounds, marks = samples(doc, code, texts.rows)
                packed = pa.Array.from_buffers(pa.binary(), texts.rows, [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(marks)])
                columns = [part.column("key"), pa.array(n.astype(np.int64)), pa.array(d1), pa.array(d2), pa.array(level.astype(np.int32)), pa.array(deeper.astype(np.int32)), packed, lists]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "d1", "d2", "level", "deeper", "marks", "mh"])

    rows = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n long, d1 long, d2 long, level int, deeper int, marks binary, mh array<int>")


def full_sets(documents: DataFrame, wanted: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(id, n, codes) of the wanted classes (key, d1, d2, n, id), their sets made anew from the texts."""
    ids = wanted.select("key").distinct()
    if wanted.count() <= KEY_BROADCAST_ROWS:
        ids = F.broadcast(ids)
    rows = documents.select(documents[key].alias("key"), documents[text].alias("text")).join(ids, "key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = flat_texts(part.column("text"), lower=True)
                doc, code = shingle_sets(words_of(texts), texts.rows, size)
                n, d1, d2 = set_digests(doc, code, texts.rows)
                at = np.searchsorted(doc, np.arange(texts.rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(code.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n.astype(np.int64)), pa.array(d1), pa.array(d2), lists], names=["key", "n", "d1", "d2", "codes"])

    sets = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n long, d1 long, d2 long, codes array<bigint>")
    return sets.join(wanted, ["key", "n", "d1", "d2"]).groupBy("id", "n").agg(F.first("codes").alias("codes"))


def likeness(n: np.ndarray, level: np.ndarray, deeper: np.ndarray, marks: list[np.ndarray], percent: int, leads: np.ndarray) -> np.ndarray:
    """Similarity of each lead (row) and each class (column) by their marks, -1 where they cannot be linked.

    On whole sets the number of common shingles is at most the number of common marks and of the doubled marks of either set,
    so no link is missed. Rows are judged a stripe at a time, which bounds the memory.
    """
    out, share = np.full((len(leads), len(n)), -1, dtype=np.float32), percent / 100
    for top in np.unique(level):
        rows = np.flatnonzero((level == top) | (level == top - 1))
        first = np.flatnonzero(np.isin(leads, rows))
        at_lead = np.searchsorted(rows, leads[first])
        own = [marks[r] if level[r] == top else marks[r][: deeper[r]] for r in rows]
        # Counts are whole numbers far below 2^24, so single precision holds them and the test on whole sets exactly.
        size = np.array([len(m) for m in own], dtype=np.float32)
        kinds, at = np.unique(np.concatenate(own), return_inverse=True)
        row, column = np.divmod(np.unique(np.repeat(np.arange(len(rows)), size.astype(np.int64)) * max(len(kinds), 1) + at), max(len(kinds), 1))
        doubled = size - np.bincount(row, minlength=len(rows)).astype(np.float32)
        shared = np.bincount(column, minlength=len(kinds)) > 1
        row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.minimum.outer(doubled[at_lead], doubled)
        for a in range(0, int(shared.sum()), NODE):
            part = slice(*np.searchsorted(column, [a, a + NODE]))
            held = np.zeros((len(rows), min(NODE, int(shared.sum()) - a)), dtype=np.float32)
            held[row[part], column[part] - a] = 1
            both += held[at_lead] @ held.T
        whole = n[rows].astype(np.float64)
        for a in range(0, len(first), STRIPE):
            mine, common = at_lead[a : a + STRIPE], both[a : a + STRIPE]
            union = np.maximum(size[mine, None] + size - common, 1)
            fits = 100 * common >= percent * union if top == 0 else common >= share * union - DEVIATIONS * np.sqrt(share * (1 - share) * union)
            fits &= 100 * np.minimum(whole[mine, None], whole) >= percent * np.maximum(whole[mine, None], whole)
            fits &= np.maximum(level[rows][mine, None], level[rows]) == top
            fits[np.arange(len(mine)), mine] = False
            x, y = np.nonzero(fits)
            out[first[a + x], rows[y]] = common[x, y] / union[x, y]
    return out


def forest(weight: np.ndarray, leads: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest between the components, grown class by class; a component counts as joined."""
    left, best, by = np.ones(len(comp), dtype=bool), np.full(len(comp), -1, dtype=np.float32), np.zeros(len(comp), dtype=np.int64)
    row = np.full(len(comp), -1)
    row[leads] = np.arange(len(leads))
    edges = []
    while left.any():
        v = int(np.argmax(np.where(left, best, -2.0)))
        if best[v] >= 0:
            edges.append((int(by[v]), v))
        new = np.flatnonzero(left & (comp == comp[v]))
        left[new] = False
        own, others = row[new[row[new] >= 0]], new[row[new] < 0]
        if len(own):
            top = weight[own].max(0) if len(own) > 1 else weight[own[0]]
            better = top > best
            best[better], by[better] = top[better], leads[own[weight[own].argmax(0)[better]]] if len(own) > 1 else leads[own[0]]
        if len(others):
            seen = weight[:, others]
            better = leads[seen.max(1) > best[leads]]
            best[better], by[better] = seen.max(1)[row[better]], others[seen.argmax(1)[row[better]]]
    return edges


def cell_pairs(rows: DataFrame, percent: int, every: bool) -> DataFrame:
    """(a, b): likely pairs of classes in the cells of ``rows`` (cell, id, lead, comp, n, level, deeper, marks).

    One of the two is a lead, their components differ, and only a spanning forest of each cell is put out unless ``every`` is set.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("id", "ascending")]).combine_chunks()
        cell, ids, comp, n, level, deeper = (table.column(c).to_numpy() for c in ("cell", "id", "comp", "n", "level", "deeper"))
        lead = table.column("lead").to_numpy(zero_copy_only=False)
        marks = [np.frombuffer(m, dtype="<u2") for m in table.column("marks").to_pylist()]
        bounds = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell)) if len(cell) else np.zeros(1, np.int64)
        one, two = [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if (comp[a:b] == comp[a]).all():
                continue
            leads = np.flatnonzero(lead[a:b])
            weight = likeness(n[a:b], level[a:b], deeper[a:b], marks[a:b], percent, leads)
            weight[comp[a:b][leads, None] == comp[a:b]] = -1
            if every:
                x, y = np.nonzero(weight >= 0)
                x = leads[x]
            else:
                x, y = np.array(forest(weight, leads, comp[a:b]), dtype=np.int64).reshape(-1, 2).T
            one.append(ids[a + np.minimum(x, y)])
            two.append(ids[a + np.maximum(x, y)])
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(one or none), "b": np.concatenate(two or none)})

    return rows.groupBy("bucket").applyInArrow(run, "a bigint, b bigint").distinct()


class PathJoin:
    """State of one join: the classes, the full sets that were needed, and the components found so far."""

    def __init__(self, documents: DataFrame, classes: DataFrame, text: str, key: str, size: int, percent: int):
        self.documents, self.classes = documents, classes
        self.text, self.key, self.size, self.percent = text, key, size, percent
        self.sets: DataFrame | None = None
        self.roots: DataFrame | None = None

    def with_comp(self, rows: DataFrame) -> DataFrame:
        if self.roots is None:
            return rows.withColumn("comp", F.col("id"))
        found = self.roots.select("id", F.col("root").alias("comp"))
        return rows.join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    def fetch(self, pairs: DataFrame) -> None:
        """Make the full sets of the classes in ``pairs`` that are not there yet."""
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        if self.sets is not None:
            ids = ids.join(self.sets.select("id"), "id", "left_anti")
        wanted = keep(self.classes.join(ids, "id").select("id", "key", "n", "d1", "d2"), "wanted")
        if self.sets is not None and wanted.isEmpty():
            return
        new = keep(full_sets(self.documents, wanted, self.text, self.key, self.size), "sets")
        forget(wanted)
        self.sets = new if self.sets is None else self.sets.unionByName(new)

    def confirm(self, pairs: DataFrame) -> DataFrame | None:
        """Take the pairs that are linked on their full sets into the components; the pairs that are not, None without pairs."""
        if pairs.isEmpty():
            return None
        self.fetch(pairs)
        one = self.sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("codes").alias("ca"))
        two = self.sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("codes").alias("cb"))
        both = F.size(F.array_intersect("ca", "cb"))
        judged = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), (F.col("na") + F.col("nb")).alias("sum"))
        judged = keep(judged.select("a", "b", (100 * F.col("both") >= self.percent * (F.col("sum") - F.col("both"))).alias("linked")), "judged")
        links = judged.where("linked").select("a", "b")
        if not links.isEmpty():
            before = self.roots
            old = [] if before is None else [before.select(F.col("id").alias("a"), F.col("root").alias("b"))]
            self.roots = components(links.union(old[0]) if old else links)
            forget(*([] if before is None else [before]))
        return judged.where("not linked").select("a", "b")

    def pairs(self, rows: DataFrame, every: bool = False) -> DataFrame:
        """Likely pairs of the cells of ``rows`` (cell, id, lead), written."""
        buckets = 1 + rows.count() // BUCKET
        sample = self.with_comp(self.classes.select("id", "n", "level", "deeper", "marks"))
        cells = rows.join(sample, "id").withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(buckets)))
        return keep(cell_pairs(cells, self.percent, every), "pairs")

    def chunked(self, crowd: DataFrame, leads: DataFrame) -> DataFrame:
        """(cell, id, lead): every crowded node (node, rows, id) in chunks of ``NODE`` classes, its leads (node, rows, id) in each."""
        chunks = F.ceil(F.col("rows") / NODE).cast("int")
        own = crowd.join(leads.select("node", "id").withColumn("led", F.lit(True)), ["node", "id"], "left").where("led is null")
        own = own.select(F.xxhash64("node", F.pmod(F.xxhash64("id"), chunks).cast("int")).alias("cell"), "id", F.lit(False).alias("lead"))
        each = leads.select("node", "id", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
        return own.unionByName(each.select(F.xxhash64("node", "chunk").alias("cell"), "id", F.lit(True).alias("lead")))

    def every_chunk(self, crowd: DataFrame) -> DataFrame:
        """(cell, id, lead): every two chunks of a node (node, rows, id) as one cell; what the longest path could not part."""
        chunks = F.ceil(F.col("rows") / NODE).cast("int")
        own = F.pmod(F.xxhash64("id"), chunks).cast("int")
        rows = crowd.select("node", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        return rows.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "id", F.lit(True).alias("lead"))

    def lead(self, crowd: DataFrame) -> None:
        """Let all classes of the crowded nodes (node, rows, id) meet the nodes' leaders, and contract what is linked."""
        ranked = crowd.join(self.classes.select("id", "copies"), "id")
        picks = [F.max(F.struct("copies", "id"))["id"]]
        picks += [F.min(F.struct(F.xxhash64("node", "id", F.lit(k)).alias("h"), "id"))["id"] for k in range(1, LEADERS)]
        chosen = ranked.groupBy("node").agg(F.first("rows").alias("rows"), F.array_distinct(F.array(*picks)).alias("ids"))
        chosen = keep(chosen.select("node", "rows", F.explode("ids").alias("id")), "leaders")
        found = self.pairs(self.chunked(crowd, chosen))
        self.confirm(found)
        forget(found, chosen)

    def told_apart(self, crowd: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(cells, rest): what few classes outside a node's main component have to meet, and the nodes with many of them."""
        rows = keep(self.with_comp(crowd), "crowd-components")
        sizes = rows.groupBy("node", "comp").agg(F.count("*").alias("k")).groupBy("node").agg(F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("all"))
        main = keep(sizes.select("node", F.col("m.comp").alias("main"), (F.col("all") - F.col("m.k")).alias("outside")).where("outside > 0"), "main")
        few = rows.join(main.where(F.col("outside") <= NODE), "node")
        cells = keep(self.chunked(few.select("node", "rows", "id"), few.where("comp <> main").select("node", "rows", "id")), "cells")
        rest = keep(rows.join(main.where(F.col("outside") > NODE).select("node"), "node").select("node", "rows", "id"), "crowd")
        forget(rows, main)
        return cells, rest

    def grow(self) -> list[DataFrame]:
        """The cells (cell, id, lead) in which the classes of all trees meet."""
        whole = F.lit(True).alias("lead")
        if self.classes.count() <= NODE:
            return [self.classes.select(F.lit(0).cast("long").alias("cell"), "id", whole)]
        cells = []
        branches = [F.xxhash64(F.lit(t), F.get("mh", F.lit(t % MINWISE))) for t in range(TREES)]
        nodes = self.classes.select("id", F.explode(F.array(*branches)).alias("node"))
        for level in range(1, LEVELS + 1):
            # Nodes of the same classes, in whatever tree, are one node.
            info = nodes.groupBy("node").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("id")).alias("members")).where("rows > 1")
            info = keep(info.groupBy("rows", "members").agg(F.min("node").alias("node")).select("node", "rows"), "nodes")
            met = keep(nodes.join(info, "node").select("node", "rows", "id"), "met")
            cells.append(met.where(F.col("rows") <= NODE).select(F.col("node").alias("cell"), "id", whole))
            crowd = met.where(F.col("rows") > NODE)
            if info.where(F.col("rows") > NODE).isEmpty():
                break
            if level % LEADER_STEP == 1:
                self.lead(crowd)
            few, crowd = self.told_apart(crowd)
            cells.append(few)
            if crowd.isEmpty():
                break
            if level == LEVELS:
                cells.append(self.every_chunk(crowd))
                break
            at = [F.pmod(F.xxhash64("node", F.lit(k)), F.lit(MINWISE)).cast("int") for k in range(2)]
            second = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(100)) < int(100 * EXTRA)
            picks = F.when(second, F.array(*at)).otherwise(F.array(at[0]))
            tokens = crowd.select("node", "id").join(self.classes.select("id", "mh"), "id")
            nodes = tokens.select("node", "id", "mh", F.explode(picks).alias("at")).select(F.xxhash64("node", "at", F.get("mh", F.col("at"))).alias("node"), "id")
        return cells

    def run(self) -> None:
        cells = self.grow()
        rows = cells[0]
        for more in cells[1:]:
            rows = rows.unionByName(more)
        pairs = self.pairs(rows)
        failed = self.confirm(pairs)
        if failed is None or failed.isEmpty():
            return
        # What stood behind a failed pair in a forest is looked at again, now between different components only.
        again = rows.join(failed.select(F.col("a").alias("id")).distinct(), "id").select("cell").distinct()
        self.confirm(self.pairs(rows.join(again, "cell"), every=True).join(failed, ["a", "b"], "left_anti"))


def near_duplicates(documents: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, percent: int = 80) -> DataFrame:
    """One row per document row: key, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets; ``component_id`` is the
    smallest key that can be reached over links and ``kept`` marks the document that has it. Null and empty texts, and texts
    without words, have an empty set and are linked with nothing. A document without a key is linked with nothing, has no
    component and is kept. Rows that repeat a key share its component; all of them that carry the smallest key are kept.
    """
    ship_package(documents.sparkSession)
    rows = keep(signatures(documents, text, key, size).withColumn("uid", F.monotonically_increasing_id()), "signatures")
    real = rows.where("n > 0 and key is not null")
    found = keep(real.groupBy("n", "d1", "d2").agg(F.min("uid").alias("id"), F.min("key").alias("low"), F.count("*").alias("copies")), "classes")
    own = found.select("id", "low", "copies").join(real.withColumnRenamed("uid", "id"), "id")
    classes = keep(own.select("id", "key", "low", "copies", "n", "d1", "d2", "level", "deeper", "marks", "mh"), "class-rows")
    join = PathJoin(documents, classes, text, key, size, percent)
    join.run()
    with_root = join.with_comp(classes.select("id", "low", "copies", "n", "d1", "d2"))
    lowest = keep(with_root.groupBy("comp").agg(F.min("low").alias("component"), F.sum("copies").alias("members")).where("members > 1"), "lowest")
    labels = keep(with_root.join(lowest, "comp").select("n", "d1", "d2", "component"), "labels")
    out = rows.join(labels, ["n", "d1", "d2"], "left")
    component = F.when(F.col("key").isNull(), None).otherwise(F.coalesce("component", "key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))
