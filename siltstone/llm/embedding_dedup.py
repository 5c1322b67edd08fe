"""Near-duplicate embeddings by cross-polytope hashing.

Vectors are compared within a label. Identical vectors form one class. A class
is hashed by several tables; each of a table's hashes is three rounds of random
signs and a fast Hadamard transform, then the index and sign of the largest
coordinate (Andoni et al., 2015). A class stands in its home bucket of each
table and in the buckets that are next best (multiprobe). Two classes meet where
one is at home; pairs that meet are verified by their cosine in double
precision, so no link is wrong, and each is counted only in the first bucket in
which the two meet.

Only places (bucket, class) are counted; vectors go along where a class shares
its bucket with another one, one of them at home. A bucket of more than BLOCK
classes is split into blocks, and each pair of blocks is a group of its own: no
task holds more than two blocks, and no pair is left out. Pairs are never
emitted: a group returns one row per class, with the links it counted and the
smallest class it is connected to. As links are counted, a bucket costs the
square of its classes in comparisons; rows grow by its classes over BLOCK only.

Recall for pairs at exactly the threshold (0.98, 64 dimensions) is 0.9999 with
TABLES = 4 and PROBES = 4; ``tests/llm`` measures it against brute force.

Defined results: a null label, a null, empty or zero vector, and one with null
or non-finite components link with nothing. Vectors of different lengths don't
link. Rows with equal ids are different vectors. A null id is no component's
name unless all its ids are null. Other columns are never looked at, so their
names don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import by_bytes
from siltstone.llm.components import connected_components
from siltstone.scratch import written

THRESHOLD = 0.98
TABLES = 4
HASHES = 2
PROBES = 4
BLOCK = 8192
#: Buckets up to this size are compared pair by pair, larger ones as matrices of so many rows.
SMALL = 48
STRIPE = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x


def codes(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """For each row: [table, probe] bucket numbers, the home bucket first."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = min(probes, width)
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        best, loss = [], []
        for k in range(hashes):
            y = padded
            for turn in range(3):
                signs = np.random.default_rng([d, t, k, turn]).choice([-1.0, 1.0], size=width)
                y = hadamard(y * signs) / np.sqrt(width)
            size = np.abs(y)
            order = np.argsort(-size, axis=1, kind="stable")[:, :near]
            top = np.take_along_axis(size, order, 1)
            best.append(order * 2 + (np.take_along_axis(y, order, 1) < 0))
            loss.append((top[:, :1] - top) ** 2)
        choices, losses = [], []
        for k in range(hashes):
            for j in range(1, near):
                code = np.zeros(n, np.int64)
                for m in range(hashes):
                    code = code * (2 * width) + best[m][:, j if m == k else 0]
                choices.append(code)
                losses.append(loss[k][:, j])
        home = np.zeros(n, np.int64)
        for m in range(hashes):
            home = home * (2 * width) + best[m][:, 0]
        out[:, t, 0] = home
        picked = np.argsort(np.stack(losses, 1), axis=1, kind="stable")[:, : probes - 1]
        others = np.take_along_axis(np.stack(choices, 1), picked, 1)
        out[:, t, 1 : 1 + others.shape[1]] = others
        out[:, t, 1 + others.shape[1] :] = home[:, None]
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        length = np.array(batch.column("dim"))
        for d in np.unique(length):
            part = batch.filter(pa.array(length == d))
            found = codes(matrix(part.column("vector")))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), TABLES * PROBES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "codes"])


def _ragged_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), i < j, inside each run."""
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    i = np.repeat(starts, sizes) + inside
    after = np.repeat(sizes, sizes) - inside - 1
    first = np.repeat(i, after)
    step = np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after)
    return first, first + 1 + step


def _linked(x, table, bucket, code, salt, mixed, starts, sizes, threshold):
    """The verified pairs that first meet in their run's bucket."""
    small = (sizes >= 2) & (sizes <= SMALL)
    found = [_ragged_pairs(starts[small], sizes[small])]
    near = np.zeros(len(found[0][0]), bool)
    for at in range(0, len(near), 100_000):
        i, j = found[0][0][at : at + 100_000], found[0][1][at : at + 100_000]
        near[at : at + 100_000] = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
    found[0] = (found[0][0][near], found[0][1][near])
    for s, m in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        for at in range(s, s + m, STRIPE):
            i, j = np.nonzero(np.triu(x[at : min(at + STRIPE, s + m)] @ x[at : s + m].T >= threshold, 1))
            found.append((i + at, j + at))
    i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    keep = ~mixed[i] | (salt[i] != salt[j])
    i, j = i[keep], j[keep]
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 50_000):
        a, b = i[at : at + 50_000], j[at : at + 50_000]
        ca, cb = code[a], code[b]
        a_home = (cb == ca[:, :, :1]).any(2)  # they meet in a's home bucket of the table
        b_home = (ca == cb[:, :, :1]).any(2)
        first = np.argmax(a_home | b_home, axis=1)
        row = np.arange(len(a))
        ha, hb = ca[row, first, 0], cb[row, first, 0]
        ma, mb = a_home[row, first], b_home[row, first]
        place = np.where(ma & mb, np.minimum(ha, hb), np.where(ma, ha, hb))
        out[at : at + 50_000] = (ma | mb) & (table[a] == first) & (bucket[a] == place)
    return i[out], j[out]


def _compared(threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 20_000:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            cell = np.array(whole.column("cell"))
            cut = int(np.searchsorted(cell, cell[-1]))  # rows are sorted by cell; the last may go on
            if cut:
                yield from run(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
        if held:
            yield from run(pa.Table.from_batches(held))

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        length = np.array(rows.column("dim"))
        for d in np.unique(length):
            part = rows.filter(pa.array(length == d)).combine_chunks()
            cell = np.array(part.column("cell"))
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[starts, len(cell)])
            x = matrix(part.column("vector").chunk(0))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            code = matrix(part.column("codes").chunk(0)).astype(np.int64).reshape(len(x), TABLES, PROBES)
            take = {n: np.array(part.column(n)) for n in ("node", "copies", "table", "bucket", "salt", "mixed")}
            i, j = _linked(x, take["table"], take["bucket"], code, take["salt"], take["mixed"], starts, sizes, threshold)
            if not len(i):
                continue
            links = np.bincount(i, take["copies"][j], len(x)) + np.bincount(j, take["copies"][i], len(x))
            root = np.arange(len(x))
            while True:
                least = np.minimum(root[i], root[j])
                after = root.copy()
                np.minimum.at(after, i, least)
                np.minimum.at(after, j, least)
                after = after[after]
                if (after == root).all():
                    break
                root = after
            some = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(take["node"][some]), pa.array(links[some].astype(np.int64)), pa.array(take["node"][root[some]])],
                names=["node", "links", "root"],
            )

    return compare


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``vectors``: the id, n_links, component_id, kept."""
    x = F.transform(F.col(vector), lambda v: v.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    usable = (
        F.col(label).isNotNull()
        & F.coalesce(F.size(vector) > 0, F.lit(False))
        & F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(vector, lambda v: v.cast("double") != 0), F.lit(False))
    )
    rows = written(
        vectors.select(
            F.monotonically_increasing_id().alias("node"),
            F.col(key).alias("key"),
            F.when(usable, F.struct(F.col(label).alias("label"), F.xxhash64(F.lit(1), x).alias("h1"), F.xxhash64(F.lit(2), x).alias("h2"))).alias("same"),
            F.when(usable, F.col(vector)).alias("vector"),
        ),
        "vectors",
    )
    classes = written(
        rows.filter("same IS NOT NULL")
        .groupBy("same")
        .agg(F.min("node").alias("node"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
        .select("*", F.size("vector").alias("dim")),
        "classes",
    )
    kinds = dict(classes.dtypes)
    hashed = written(
        classes.select("node", F.col("same.label").cast("string").alias("label"), "copies", "dim", "vector").transform(by_bytes).mapInArrow(
            _hashed, f"node long, label string, copies long, dim int, vector {kinds['vector']}, codes array<bigint>"
        ),
        "codes",
    )
    tables = F.transform(F.sequence(F.lit(0), F.lit(TABLES - 1)), lambda t: F.struct(t.cast("long").alias("table"), F.array_distinct(F.slice("codes", t * PROBES + 1, PROBES)).alias("buckets")))
    places = (
        hashed.select("node", "label", "dim", F.explode(tables).alias("t"))
        .select("node", "label", "dim", F.col("t.table").alias("table"), F.posexplode("t.buckets").alias("probe", "bucket"))
        .withColumn("spot", F.xxhash64("label", "dim", "table", "bucket"))
    )
    # classes meet where one is at home, so a bucket without a home has no pair, nor has one with one class
    spots = written(places.groupBy("spot").agg(F.count("*").alias("n"), F.min("probe").alias("home")).filter("n > 1 AND home = 0").select("spot", F.ceil(F.col("n") / BLOCK).alias("blocks")), "spots")
    dealt = (
        places.join(spots, "spot")
        .withColumn("salt", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("mixed", F.col("salt") != F.col("other"))
        .withColumn("pair", F.struct(F.least("salt", "other"), F.greatest("salt", "other")))
        # rows of a diagonal group carry mixed = false, those of a crossing one true
        .select("node", F.concat_ws(":", F.xxhash64("label", "dim", "table", "bucket", "pair"), F.xxhash64(F.lit(7), "label", "dim", "table", "bucket", "pair")).alias("cell"), "table", "bucket", "salt", "mixed")
        .join(hashed.select("node", "copies", "dim", "vector", "codes"), "node")
    )
    found = written(dealt.repartition("cell").sortWithinPartitions("cell").transform(by_bytes).mapInArrow(_compared(threshold), "node long, links long, root long"), "links")
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    judged = (
        classes.select("same", "node", "copies")
        .join(links, "node", "left")
        .join(parts, "node", "left")
        .select("same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    members = written(rows.select("node", "key", "same").join(judged, "same", "left"), "members")
    names = members.filter("n_links > 0").groupBy("component").agg(F.min("key").alias("name"))
    return members.join(names, "component", "left").select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("name", "key").alias("component_id"),
        F.coalesce(F.col("key") == F.coalesce("name", "key"), F.lit(False)).alias("kept"),
    )
