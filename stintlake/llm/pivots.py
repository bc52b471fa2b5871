"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its NEAREST nearest reference points (pivots). Two vectors whose
descriptions share SHARED pivots share two of their first pivots by number, where at most
NEAREST - SHARED + 2 come into question: so the inverted lists are kept by pairs of those, and
vectors that share a list are counted on, over their whole descriptions. A pair of vectors is
looked at in one list only, that of the two lowest pivots they share, and verified by its cosine.

Lists over BLOCK vectors long are cut into blocks, every pair of blocks is a group of its own. Pairs
never leave a task: a group gives its vectors' numbers of links, and links that span the
same components.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintlake.llm.common import stored, table
from stintlake.llm.graph import components

LEAST_COSINE = 0.93
#: Pivots for each dimension of the vectors, and at most.
PIVOTS_A_DIMENSION, MOST_PIVOTS = 8, 512
NEAREST = 8
SHARED = 3
#: Vectors that pivots are chosen from, at most: those with the smallest hashes.
SAMPLE = 4096
#: Two pivots from the sample have a cosine below this, so copies of a vector give one pivot.
APART = 0.5
BLOCK = 1000
#: Pairs looked at, and vectors described, at a time.
PAIRS, ROWS = 65_536, 512

LIST = ["label", "dim", "a", "b"]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows as doubles of length one; scaled first, so that no square over- or underflows."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


# --- pivots -----------------------------------------------------------------------------------


def chosen_pivots(sample: np.ndarray, dim: int) -> np.ndarray:
    """Reference points of a dimension: sampled vectors that are apart from each other, in their
    order, then random directions up to the number wanted."""
    wanted = min(MOST_PIVOTS, PIVOTS_A_DIMENSION * dim)
    picked = np.empty((0, dim))
    for x in unit(sample) if len(sample) else ():
        if len(picked) < wanted and not (len(picked) and (picked @ x).max() >= APART):
            picked = np.vstack([picked, x])
    rest = np.random.default_rng(dim).normal(size=(wanted - len(picked), dim))
    return np.vstack([picked, unit(rest)]) if len(rest) else picked


def fitted(classes: DataFrame) -> dict[int, np.ndarray]:
    """The sample, at most SAMPLE vectors, by dimension."""
    rows = classes.orderBy("node").select("embedding").limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for (x,) in rows:
        by_dim.setdefault(len(x), []).append(x)
    return {dim: chosen_pivots(np.array(xs, np.float64), dim) for dim, xs in by_dim.items()}


def described(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of each row's nearest pivots, ascending."""
    near = unit(vectors) @ pivots.T
    order = np.argsort(-near, axis=1, kind="stable")[:, :NEAREST]
    return np.sort(order, axis=1).astype(np.int16)


# --- lists ------------------------------------------------------------------------------------


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _entries(pivots: dict[int, np.ndarray], whole: bool):
    """A function from batches of classes to their entries: one for every pair of the first
    pivots, with description and vector if `whole`."""
    first = NEAREST - SHARED + 2

    def of_batch(batch, dim):
        if dim not in pivots:
            pivots[dim] = chosen_pivots(np.empty((0, dim)), dim)
        vectors = _matrix(batch.column("embedding"), dim)
        near = described(vectors, pivots[dim])
        low, high = np.triu_indices(min(first, near.shape[1]), 1)
        row = np.repeat(np.arange(batch.num_rows), len(low))
        label = batch.column("label").take(pa.array(row))
        a, b = near[:, low].ravel(), near[:, high].ravel()
        columns = [label, pa.array(np.full(len(row), dim, np.int32)), pa.array(a), pa.array(b)]
        if whole:
            columns += [batch.column(c).take(pa.array(row)) for c in ("na", "nb", "size")]
            for data in (near, vectors):
                each = pa.array([x.tobytes() for x in data], pa.binary())
                columns.append(each.take(pa.array(row)))
        names = [*LIST, "na", "nb", "size", "near", "vector"][: len(columns)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                dims = pa.compute.list_value_length(part.column("embedding")).to_numpy()
                for dim in np.unique(dims):
                    yield of_batch(part.filter(pa.array(dims == dim)), int(dim))

    return run


def _roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins the sets of i and j, each named by its least member."""
    while True:
        a, b = root[i], root[j]
        off = a != b
        if not off.any():
            return root
        i, j = i[off], j[off]
        np.minimum.at(root, np.maximum(a, b)[off], np.minimum(a, b)[off])
        while (root[root] != root).any():
            root = root[root]


def _partners(group: np.ndarray, crossed: np.ndarray, second: np.ndarray):
    """Where each row's partners begin, and their number: the rows behind it in its group; or, in
    a group of two blocks, the rows of the second block for those of the first."""
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(starts, len(group)))
    end = np.repeat(starts + sizes, sizes)
    middle = end - np.repeat(np.add.reduceat(second.astype(np.int64), starts), sizes)
    begin = np.where(crossed, middle, np.arange(len(group)) + 1)
    return begin, np.where(crossed & second, 0, end - begin)


def _verified(near, list_b, raw, size, begin, count, least):
    """Number of links of each row, and the row that names its component in its group."""
    n_links = np.zeros(len(near))
    root = np.arange(len(near))
    upto = np.cumsum(count)
    at = 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        i = np.repeat(np.arange(at, to), count[at:to])
        if len(i):
            j = np.arange(len(i)) - np.repeat(upto[at:to] - count[at:to] - upto[at] + count[at], count[at:to])
            j += begin[i]
            shared = (near[i][:, :, None] == near[j][:, None, :]).any(2)
            lowest = (shared & (near[i] <= list_b[i][:, None])).sum(1) == 2
            fit = lowest & (shared.sum(1) >= SHARED)
            i, j = i[fit], j[fit]
            for k in range(0, len(i), 8192):
                ik, jk = i[k : k + 8192], j[k : k + 8192]
                linked = np.einsum("ij,ij->i", unit(raw[ik]), unit(raw[jk])) >= least
                ik, jk = ik[linked], jk[linked]
                n_links += np.bincount(ik, size[jk], len(near)) + np.bincount(jk, size[ik], len(near))
                root = _roots(root, ik, jk)
        at = to
    return n_links, root


def _linked(kind: str, least: float):
    def of_rows(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        dim = rows["dim"][0].as_py()
        own, lo, hi = (rows[c].to_numpy() for c in ("own", "lo", "hi"))
        near, raw = (
            np.frombuffer(b"".join(rows[c].to_pylist()), t).reshape(rows.num_rows, -1)
            for c, t in (("near", np.int16), ("vector", kind))
        )
        assert raw.shape[1] == dim
        begin, count = _partners(group, lo != hi, own == hi)
        size = rows["size"].to_numpy()
        links, root = _verified(near, rows["b"].to_numpy(), raw, size, begin, count, least)
        some = np.flatnonzero(links)
        columns = [rows[c].to_numpy()[at] for at in (some, root[some]) for c in ("na", "nb")]
        columns.append(links[some].astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], ["na", "nb", "ra", "rb", "links"]
        )

    def groups_of(rows: pa.Table) -> np.ndarray:
        """A number for each row that changes where a group begins."""
        new = np.zeros(rows.num_rows, bool)
        for c in [*LIST, "lo", "hi"]:
            codes = rows[c].combine_chunks().dictionary_encode().indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(new)

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            if not rows.num_rows:
                continue
            group = groups_of(rows)
            whole = int(np.searchsorted(group, group[-1]))
            yield from done(rows.slice(0, whole), group[:whole])
            held = rows.slice(whole)
        if held is not None:
            yield from done(held, groups_of(held))

    def done(rows, group):
        dims = rows["dim"].to_numpy()
        for dim in np.unique(dims):
            mine = dims == dim
            yield of_rows(rows.filter(pa.array(mine)).combine_chunks(), group[mine])

    return run


def links(classes: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(na, nb, ra, rb, links): for vectors of a group that have links there, their number, and
    another vector (the group's lowest in that component). Each linked pair counts in one group."""
    kind = classes.schema["embedding"].dataType.elementType.simpleString()
    label = classes.schema["label"].dataType.simpleString()
    pivots = fitted(classes)
    vectors = classes.select("label", "node.*", "size", "embedding").toDF(
        "label", "na", "nb", "size", "embedding"
    )
    keys = f"label {label}, dim int, a short, b short"
    only_keys = vectors.mapInArrow(_entries(pivots, False), keys)
    # A list with a single vector links nothing and goes no further.
    sizes = only_keys.groupBy(*LIST).agg(F.count("*").alias("n")).where("n > 1")
    entries = vectors.mapInArrow(
        _entries(pivots, True), f"{keys}, na long, nb long, size long, near binary, vector binary"
    )
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.col("nb"), blocks).cast("int")
    blocked = entries.join(sizes, LIST).withColumns({"blocks": blocks, "own": own})
    dealt = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = [*LIST, "lo", "hi"]
    together = (
        dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
        .drop("n", "blocks", "other")
        .repartition(*group)
        .sortWithinPartitions(*group, "own")
    )
    raw = "<f4" if kind == "float" else "<f8"
    return together.mapInArrow(_linked(raw, least), "na long, nb long, ra long, rb long, links long")


# --- the operator -----------------------------------------------------------------------------


def _comparable(vector: Column, label: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        label.isNotNull() & vector.isNotNull() & ~F.coalesce(odd, F.lit(True))
        & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    )


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """A row per row of (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows link where their labels are equal, their vectors equally long and the cosine is `least`
    or more. Equal vectors of a label are one in the index, each linked with the others. Null label,
    null, empty or zero vectors and those with null or non-finite parts link with nothing: 0 links,
    a component of their own. Null vec_id: the component's least id, alone null; not kept. Repeated
    rows are other vectors, which link. No rows: none. Other columns are not looked at."""
    plain = vectors.select("vec_id", "label", "embedding")
    if plain.schema["embedding"].dataType.simpleString() != "array<float>":
        plain = plain.withColumn("embedding", F.col("embedding").cast("array<double>"))
    label, vector = F.col("label"), F.col("embedding")
    name = F.struct(F.xxhash64(label, vector).alias("a"), F.xxhash64(F.lit(7), vector, label).alias("b"))
    node = F.when(_comparable(vector, label), name)
    rows = plain.select("vec_id", node.alias("node"), "label", "embedding")
    classes = stored(
        rows.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.count("*").alias("size"), F.min("vec_id").alias("least"),
            F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"),
        ),
        "vector-classes",
    )
    found = stored(links(classes, least), "vector-links")
    pair = [F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("na", "nb"), ("ra", "rb"))]
    counts = found.groupBy(pair[0].alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.select(pair[0].alias("a"), pair[1].alias("b")))
    rooted = classes.drop("label", "embedding").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = (
        rooted.join(counts, "node", "left").join(ids, "root")
        .select("node", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    )
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return (
        rows.select("vec_id", "node").join(known, "node", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
        )
    )


def op11_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
