"""Near-duplicate vectors against brute force."""

import math

import numpy as np
import pytest

from stintlake.llm import pivots

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """(vec_id, n_links, component_id, kept) of rows (vec_id, vector, label) from all pairs."""
    units = []
    for _, v, label in rows:
        fit = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        v = np.array(v, np.float64) if fit else None
        units.append(v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) if fit else None)
    near = [set() for _ in rows]
    for i, x in enumerate(units):
        for j in range(i):
            y = units[j]
            if x is not None and y is not None and rows[i][2] == rows[j][2] and len(x) == len(y):
                if x @ y >= pivots.LEAST_COSINE:
                    near[i].add(j)
                    near[j].add(i)
    seen, out = {}, []
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()] - group:
                group.add(k)
                todo.append(k)
        least = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
        seen.update(dict.fromkeys(group, least))
    for i, (vec_id, _, _) in enumerate(rows):
        out.append((vec_id, len(near[i]), seen[i], vec_id is not None and vec_id == seen[i]))
    return sorted(out, key=repr)


def result(spark, rows, kinds=VECTORS, extra=()):
    df = spark.createDataFrame([(*r, *extra) for r in rows], kinds)
    return sorted((tuple(r) for r in pivots.near_vectors(df).collect()), key=repr)


def around(rng, centre, n, cosine):
    """Vectors at a given cosine from `centre`."""
    u = rng.normal(size=(n, len(centre)))
    u -= np.outer(u @ centre, centre)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return cosine * centre + math.sqrt(1 - cosine**2) * u


def tight(seed, dim=64, clusters=12, n=9):
    """Clusters whose members have cosines of about 0.98, and single vectors, over three labels."""
    rng, rows = np.random.default_rng(seed), []
    for k in range(clusters):
        for x in around(rng, pivots.unit(rng.normal(size=(1, dim)))[0], n, 0.99):
            rows.append((len(rows), (x * rng.uniform(0.1, 9)).astype(np.float32).tolist(), k % 3))
    for x in rng.normal(size=(60, dim)):
        rows.append((len(rows), x.astype(np.float32).tolist(), len(rows) % 3))
    return rows


def test_equals_brute_force(spark):
    rows = tight(1)
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(7)]  # exact copies
    rows += [(2000, rows[5][1], 99)]  # the same vector under another label
    assert result(spark, rows) == brute(rows)


def test_lists_cut_into_blocks_give_the_same(spark, monkeypatch):
    rows = tight(2, clusters=3, n=40)
    monkeypatch.setattr(pivots, "BLOCK", 8)
    monkeypatch.setattr(pivots, "PAIRS", 50)
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    x, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [
        (5, x, 1), (4, x, 1), (4, x, 1), (None, x, 1), (9, [2.0, 4.0, 6.0], 1), (8, x, None), (7, x, 2),
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (10, [1.0, None, 3.0], 1), (11, [1.0, nan, 3.0], 1),
        (12, [1.0, inf, 3.0], 1), (None, [5.0, -5.0, 1.0], 1), (13, [1.0, 2.0], 1), (14, [1.0, 2.1], 1),
        (15, [7.0], 1), (16, [9.0], 1), (17, [-9.0], 1), (18, [1e-40, 1e-40], 3), (19, [3e38, 3e38], 3),
    ]
    assert result(spark, rows) == brute(rows)
    clashing = VECTORS + ", node long, size long, n_links long, root string, na long"
    assert result(spark, rows, clashing, (1, 2, 3, "x", 4)) == brute(rows)


def test_doubles_and_no_rows(spark):
    rows = [(i, [1e200 * x, -3e200 * x], 0) for i, x in enumerate((1.0, 2.0, 5.0))] + [(9, [1e-300, 3e-300], 0)]
    assert result(spark, rows, VECTORS.replace("float", "double")) == brute(rows)
    assert result(spark, []) == []


@pytest.mark.parametrize("dim", [2, 3, 8, 32, 64, 300])
def test_nine_in_ten_links_at_the_limit_are_found(dim):
    """The share of pairs at a cosine of 0.93 that share enough pivots."""
    rng = np.random.default_rng(dim)
    centres = pivots.unit(rng.normal(size=(1500, dim)))
    others = np.vstack([around(rng, c, 1, 0.9301) for c in centres])
    points = pivots.chosen_pivots(centres[:400], dim)
    a, b = (pivots.described(x, points) for x in (centres, others))
    shared = (a[:, :, None] == b[:, None, :]).any(2).sum(1)
    assert (shared >= pivots.SHARED).mean() >= 0.9


def test_recall_on_the_given_vectors(spark):
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pylist()
    rng = np.random.default_rng(0)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in rows[:600]]
    for vec_id, v, label in list(rows[:200]):
        x = pivots.unit(np.array([v]))[0]
        for cosine in (0.935, 0.96):
            near = around(rng, x, 1, cosine)[0].astype(np.float32)
            rows.append((len(rows) * 10_000, near.tolist(), label))
    found, wanted = result(spark, rows), brute(rows)
    assert all(f[1] <= w[1] for f, w in zip(found, wanted, strict=True))
    assert sum(f[1] for f in found) >= 0.95 * sum(w[1] for w in wanted) > 0
