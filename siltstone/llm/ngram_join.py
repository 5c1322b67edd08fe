"""Jaccard join of word shingles by count-vector R-trees.

A document is the set of its hashed 5-word shingles. The shingles are hashed
into groups, and a set's counts per group are a point in R-trees (see
``count_tree``): pairs of nodes, then of sets, are left out by the sum of their
corners' coordinate minima. Pairs that survive the bound are verified on the
sets themselves, so the links are exact.

One tree over all documents would be searched by every document, and hashed
counts of unrelated texts of like length lie so close that its upper nodes prune
little. So it is a forest, whose trees are found without losing a pair:

1. Equal sets are one class from here on.
2. Two sets with Jaccard similarity s share one of the n - ceil(s n) + 1 shingles
   of each that come first in any order common to all. The order takes the
   corpus's rarest groups first, so shared passages come last. There is a tree
   for each such shingle. In it a set of n shingles, of which r don't come before
   the shingle, shares r with another one at most if it is the first that they
   share; that limits a partner's size (``reach``), and the tree's nodes are
   pruned by it. So texts that share a template and are below the similarity meet
   in trees without a pair. What the bound leaves is connected; connected classes
   form a shard.
3. A shard's texts are brought together, and a tree over their sets leaves the
   pairs for the exact test. Pairs that are connected already are skipped, as
   only components are asked for.

Every group goes through a tree, whatever its size. A group above the limits (of
a shingle or a shard) is dealt twice at random into cells, which connects what is
dense; then only the members outside of its largest part are compared with all
its cells. So a task holds a cell or two, and all pairs that could still connect
something are tested.

Defined results: a text without words (or null) is empty and linked with
nothing, its component is its id; a very long text is one set like any other.
Rows with equal ids are documents of their own; a null id names a component only
if all its ids are null. Columns other than the id and the text don't matter,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.batches import by_bytes
from siltstone.llm.components import connected_components
from siltstone.llm.count_tree import Forest, need, reach
from siltstone.llm.rows import identified, if_few, narrow, row_hash, without
from siltstone.llm.shingles import mixed, shingle_sets
from siltstone.scratch import written

PERCENT = 80
#: Groups in which the corpus's shingles are counted for the order: 512 kB.
ORDER_BITS = 16
#: Coordinates of a point: about a group for eight shingles, within these bounds. Trees have the lower number.
COARSE, FINE = 64, 1024
#: Members of a cell, and shingles of the sets in one: 32 MB.
CELL = 4096
CELL_SHINGLES = 4_000_000
#: Texts of a shard that are dealt at random into a cell; as many of a dense one connect it as well.
DEALT = 256
#: Classes of a cell that the estimate of a shingle's classes goes by, about.
SAMPLED = 64
#: Bits of a shingle's hash that tell trees apart. Two shingles in one tree cost time only.
TOKEN_BITS = 48
#: Rows of small groups that are joined at once, and bytes of text that are encoded at once.
ROWS = 8000
SLICE = 500_000


def point(s: np.ndarray, bits: int) -> np.ndarray:
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def bits_for(n: int) -> int:
    return int(np.clip(n // 8, COARSE, FINE)).bit_length() - 1


def packed(p: np.ndarray) -> bytes:
    """A point in one byte a group if its counts allow it, else in four."""
    return p.astype(np.uint8 if p.max(initial=0) < 256 else "<u4").tobytes()


def unpacked(raw: list[bytes], n: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The points of sets of n shingles: all with COARSE groups, and by number of groups (rows' places, whole points)."""
    coarse = np.zeros((len(raw), COARSE), np.int32)
    groups = np.array([1 << bits_for(x) for x in n.tolist()], np.int64)
    width = np.array([len(x) for x in raw], np.int64) // groups
    fine: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for g in np.unique(groups).tolist():
        place, whole = np.full(len(raw), -1), np.zeros((int((groups == g).sum()), g), np.int32)
        place[groups == g] = np.arange(len(whole))
        for w, kind in ((1, np.uint8), (4, "<u4")):
            rows = np.flatnonzero((groups == g) & (width == w))
            if len(rows):
                whole[place[rows]] = np.frombuffer(b"".join(raw[r] for r in rows.tolist()), kind).reshape(len(rows), g)
        coarse[groups == g] = whole.reshape(len(whole), COARSE, -1).sum(2, dtype=np.int32)
        fine[g] = (place, whole)
    return coarse, fine


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with their shingles and bounds."""
    text = pc.fill_null(batch.column("text"), "").cast(pa.large_binary())
    lengths = np.array(pc.binary_length(text))
    begin = np.flatnonzero(np.diff(np.r_[-1, np.cumsum(lengths) // SLICE]))
    for a, b in zip(begin.tolist(), np.r_[begin[1:], len(lengths)].tolist(), strict=True):
        data = np.frombuffer(b"".join(text.slice(a, b - a).to_pylist()), np.uint8)
        yield batch.slice(a, b - a), *shingle_sets(data, np.r_[0, np.cumsum(lengths[a:b])])


def _group_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << ORDER_BITS, np.int64)
    for batch in batches:
        for _, s, _ in _texts(batch):
            total += point(s, ORDER_BITS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["part", "n"])


def identity(s: np.ndarray) -> tuple[int, int]:
    """A set's 128 bits: sum and exclusive or of differently mixed members."""
    with np.errstate(over="ignore"):
        a = mixed(s + np.uint64(1)).sum(dtype=np.uint64)
        b = np.bitwise_xor.reduce(mixed(s ^ np.uint64(0x5851F42D4C957F2D))) if len(s) else np.uint64(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _signatures(total: np.ndarray, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, s, bounds in _texts(batch):
                out: list[list] = [[], [], [], [], []]
                rare = total[(s >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    one, n = s[a:b], int(b - a)
                    first = n - -(-percent * n // 100) + 1 if n else 0
                    order = np.lexsort((one, rare[a:b]))[:first]
                    for column, value in zip(out, (n, *identity(one), (one[order] >> np.uint64(64 - TOKEN_BITS)).astype(np.int64), packed(point(one, bits_for(n)))), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("key", "tie", "mark")), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.binary())],
                    names=["key", "tie", "mark", "n", "h1", "h2", "tokens", "point"],
                )

    return run


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups, about ``rows`` rows each, of batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(whole.num_rows, bool)
        for k in keys:
            x = np.array(whole.column(k))
            same &= x == x[-1]
        cut = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def number_groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Each row's group, from 0, in a table sorted by ``keys``."""
    change = np.zeros(table.num_rows, bool)
    for k in keys:
        x = np.array(table.column(k))
        change[1:] |= x[1:] != x[:-1]
    return np.cumsum(change)


def _edges(cls: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    moved = np.flatnonzero(cls[root] != cls)
    return pa.RecordBatch.from_arrays([pa.array(cls[moved]), pa.array(cls[root[moved]])], names=["a", "b"])


def _met(percent: int) -> Callable:
    """Classes that meet in a shingle (g) to edges between those that the bound leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, ["g", "cell"], ROWS):
            n, most = np.array(t.column("n")), np.array(t.column("reach")).astype(np.int64)
            coarse, fine = unpacked(t.column("point").to_pylist(), n)

            def bounded(i: np.ndarray, j: np.ndarray, _parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """By the points with as many groups as both have."""
                ok = np.ones(len(i), bool)
                for g, (place_g, whole_g) in fine.items():
                    for h, (place_h, whole_h) in fine.items():
                        width = min(g, h)
                        pairs = np.flatnonzero((place_g[i] >= 0) & (place_h[j] >= 0)) if width > COARSE else ()
                        for a in range(0, len(pairs), 2000):
                            some = pairs[a : a + 2000]
                            x, y = (w[p[k[some]]].reshape(len(some), width, -1).sum(2, dtype=np.int32) for w, p, k in ((whole_g, place_g, i), (whole_h, place_h, j)))
                            ok[some] = np.minimum(x, y).sum(1) >= need(n[i[some]], n[j[some]], percent)
                return i[ok], j[ok]

            forest = Forest(number_groups(t, ["g", "cell"]), coarse, n, most, percent)
            yield _edges(np.array(t.column("cls")), forest.connect(bounded, np.array(t.column("side")) == 2))

    return run


def _verified(percent: int) -> Callable:
    """Texts of a shard (g) to edges: each class with one that its links connect it with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, ["g", "cell"], 512):
            sets: list[np.ndarray] = []
            for _, s, bounds in _texts(t.combine_chunks().to_batches()[0]):
                sets += [s[a:b].copy() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            # a text that isn't the class's, or repeats it, is none of the shard's
            h1, h2, cls, group = (np.array(x) for x in (t.column("h1"), t.column("h2"), t.column("cls"), number_groups(t, ["g", "cell"])))
            fresh = np.r_[True, (cls[1:] != cls[:-1]) | (group[1:] != group[:-1])]
            keep = np.array([k for k, s in enumerate(sets) if fresh[k] and identity(s) == (h1[k], h2[k])], np.int64)
            if len(keep) < 2:
                continue
            sets, cls, group, side = [sets[k] for k in keep], cls[keep], group[keep], np.array(t.column("side"))[keep]
            n = np.array([len(s) for s in sets])
            members, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
            coarse_bits, fine_bits = COARSE.bit_length() - 1, FINE.bit_length() - 1
            coarse = np.bincount(owner * COARSE + (members >> np.uint64(64 - coarse_bits)).astype(np.int64), minlength=len(sets) * COARSE).reshape(-1, COARSE).astype(np.int32)

            def linked(i: np.ndarray, j: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                names = parts.tolist()
                over: dict[int, int] = {}

                def find(x: int) -> int:
                    while x in over:
                        x = over[x]
                    return x

                out: tuple[list[int], list[int]] = ([], [])
                fine: dict[int, np.ndarray] = {}
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    x, y = find(names[a]), find(names[b])
                    if x == y:
                        continue
                    for k in (a, b):
                        if k not in fine:
                            fine[k] = point(sets[k], fine_bits)
                    least = need(int(n[a]), int(n[b]), percent)
                    if np.minimum(fine[a], fine[b]).sum() < least or len(np.intersect1d(sets[a], sets[b], assume_unique=True)) < least:
                        continue
                    over[max(x, y)] = min(x, y)
                    out[0].append(a)
                    out[1].append(b)
                return np.array(out[0], np.int64), np.array(out[1], np.int64)

            yield _edges(cls, Forest(group, coarse, n, reach(n, n, percent), percent).connect(linked, side == 2))

    return run


def _inside(rows: DataFrame, blocks: DataFrame, join: Callable, payload: list[str], label: str) -> DataFrame:
    """Edges (a, b) that connect the members of each group as all their links would.

    rows: g, cls and the payload that ``join`` takes; blocks, of each group above
    the limits: g, the number of cells that it is dealt into at random, and the
    number of cells (wide) in which it is compared with its members outside. ``join`` makes edges from g,
    cell, side, cls and payload sorted by g, cell, cls and side; side 2 isn't compared with side 2.
    """

    def joined(dealt: DataFrame) -> DataFrame:
        sorted_ = dealt.select("g", F.col("cell").cast("long").alias("cell"), "side", "cls", *payload).repartition("g", "cell").sortWithinPartitions("g", "cell", "cls", "side")
        return sorted_.transform(by_bytes).mapInArrow(join, "a long, b long")

    def cell(seed: int, of: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "cls"), F.col(of))

    if blocks.isEmpty():
        return written(joined(rows.select("*", F.lit(0).alias("cell"), F.lit(1).alias("side"))), label)
    sized = written(rows.join(if_few(blocks), "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), f"{label}-sized")
    large = sized.filter("blocks > 1")
    once = joined(sized.select("*", cell(0, "blocks").alias("cell"), F.lit(1).alias("side")))
    again = joined(large.select("*", cell(1, "blocks").alias("cell"), F.lit(1).alias("side")))
    dense = written(once.unionByName(again), f"{label}-dense")
    parts = connected_components(dense).select(F.col("node").alias("cls"), F.col("component").alias("part"))
    placed = written(narrow(large.select("g", "cls").join(parts, "cls", "left").withColumn("part", F.coalesce("part", "cls"))), f"{label}-placed")
    sizes = placed.groupBy("g", "part").agg(F.count("*").alias("size"))
    largest = written(narrow(sizes.groupBy("g").agg(F.max_by("part", F.struct("size", "part")).alias("largest"))), f"{label}-largest")
    outer = written(placed.join(if_few(largest), "g").filter("part <> largest").select("g", "cls"), f"{label}-outer")
    outer_blocks = written(narrow(outer.groupBy("g").agg(F.ceil(F.count("*") / CELL).alias("outer_blocks"))), f"{label}-outer-cells")
    if outer_blocks.isEmpty():
        return dense
    # those outside of the largest part, in cells of their own, against all cells
    left = large.join(if_few(outer_blocks), "g")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    inner = left.select("*", cell(3, "wide").alias("x"), every("outer_blocks").alias("y")).withColumn("side", F.lit(2))
    crossed = left.join(if_few(outer), ["g", "cls"], "left_semi").select("*", every("wide").alias("x"), cell(2, "outer_blocks").alias("y")).withColumn("side", F.lit(1))
    # a member outside meets its own row of the inner side; of the two the one of side 1 comes first
    crossing = joined(inner.unionByName(crossed).withColumn("cell", F.col("x") * F.col("outer_blocks") + F.col("y")))
    return written(dense.unionByName(crossing), label)


def components(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id; part, which tells components apart and is null without shingles; tie, a hash of the row."""
    words = F.col(text).cast("string")
    texts = docs.select(F.col(key).alias("key"), row_hash(docs).alias("tie"), words.alias("text"), F.xxhash64(words).alias("mark"))
    kind = dict(texts.dtypes)["key"]
    counts = texts.select("text").transform(by_bytes).mapInArrow(_group_counts, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << ORDER_BITS, np.int64)
    total[np.array(counts.column("part"))] = np.array(counts.column("n"))
    seen = written(
        texts.transform(by_bytes).mapInArrow(_signatures(total, percent), f"key {kind}, tie long, mark long, n long, h1 long, h2 long, tokens array<bigint>, point binary").withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "signatures",
    )
    same = ["n", "h1", "h2"]
    classes = written(
        seen.filter("n > 0")
        .groupBy(*same)
        .agg(F.min("row").alias("cls"), F.min("key").alias("least"), F.min_by(F.struct("key", "mark"), "row").alias("one"), F.any_value("tokens").alias("tokens"), F.any_value("point").alias("point")),
        "classes",
    )
    # shingles with very many classes, by those of a share of the classes; a miss costs time only
    rate = max(1, CELL // SAMPLED)
    some = classes.filter(F.pmod(F.xxhash64(F.lit(5), "cls"), F.lit(rate)) == 0).select(F.explode("tokens").alias("g"))
    blocks = written(narrow(some.groupBy("g").agg(F.ceil(F.count("*") * rate / CELL).alias("blocks")).filter("blocks > 1").withColumn("wide", F.col("blocks"))), "frequent")
    # these rows are by far the most that are shuffled, so they have nothing but what the window needs
    reaches = F.floor((F.col("n") - F.col("place")) * (100 + percent) / percent) - F.col("n")
    placed = classes.select("cls", "n", F.posexplode("tokens").alias("place", "g")).select("cls", "g", F.col("n").cast("int").alias("n"), reaches.cast("int").alias("reach"))
    if not blocks.isEmpty():
        placed = placed.join(if_few(blocks.drop("wide")), "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    else:
        placed = placed.withColumns({"blocks": F.lit(1), "salt": F.lit(0)})
    # of the others, those that some size and reach in the group go with
    own = Window.partitionBy("g", "salt")
    possible = (F.count("*").over(own) > 1) & (F.min("n").over(own) <= F.col("reach")) & (F.max("reach").over(own) >= F.col("n"))
    met = placed.select("g", "cls", "reach", ((F.col("blocks") > 1) | possible).alias("may_meet")).filter("may_meet").drop("may_meet")
    pointed = met.join(classes.select("cls", "n", "point"), "cls")
    shards = connected_components(_inside(pointed, blocks, _met(percent), ["n", "reach", "point"], "met"))
    named = shards.select(F.col("node").alias("cls"), F.col("component").alias("g")).join(classes.select("cls", "one", *same), "cls")
    asked = written(narrow(named.select("cls", "g", *same, F.col("one.key").alias("asked"), F.col("one.mark").alias("its_mark"))), "asked")
    limits = lambda members: F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("n") / CELL_SHINGLES))
    many = written(narrow(asked.groupBy("g").agg(limits(min(DEALT, CELL)).alias("blocks"), limits(CELL).alias("wide")).filter("blocks > 1")), "large")
    # only texts that are asked for move, if their list is short enough to go to where the texts are
    wanted = texts.join(if_few(asked.drop("n")), (F.col("mark") == F.col("its_mark")) & F.col("key").eqNullSafe(F.col("asked"))).select("g", "cls", "h1", "h2", "text")
    found = _inside(wanted, many, _verified(percent), ["h1", "h2", "text"], "linked")
    linked = connected_components(found).select(F.col("node").alias("cls"), F.col("component").alias("part"))
    joined = classes.select(*same, "cls", "least").join(linked, "cls", "left")
    names = written(narrow(joined.filter("part IS NOT NULL").groupBy("part").agg(F.min("least").alias("name"))), "names")
    named = joined.join(if_few(names), "part", "left").select(*same, F.when(F.col("part").isNull(), F.col("least")).otherwise(F.col("name")).alias("name"), F.coalesce("part", "cls").alias("part"))
    return seen.select("key", "tie", *same).join(named, same, "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("name", "key").alias("component_id"), "part", "tie"
    )


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` of each component, of the least id, with all its columns.

    Ids come before nulls. Of several rows of that id the one of least hash
    stays, and of rows that are alike in all columns one. Rows without a shingle
    are in no component and all stay.
    """
    judged = components(docs, text, key, percent).filter("part IS NOT NULL").select("part", F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), "tie").alias("row"))
    judged = written(judged, "judged")
    first = written(narrow(judged.groupBy("part").agg(F.min("row").alias("first"), F.count("*").alias("many")).filter("many > 1")), "firsts")
    gone = written(narrow(judged.join(if_few(first), "part").filter("row <> first").select("row.id", "row.tie").distinct()), "gone")
    repeated = written(narrow(judged.groupBy("row").count().filter("count > 1").select("row.id", "row.tie")), "repeated")
    return without(identified(docs, key).select("id", "tie", "row"), gone, repeated)
