"""The epsilon grid order join against a comparison of all pairs."""

import numpy as np
import pytest

from scriptorium.llm import embedding_join


def brute(rows, threshold=0.93):
    """rows: vec_id, vector, label."""
    n = len(rows)
    usable = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    up, links = list(range(n)), [0] * n

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    def number(k):
        return (rows[k][0] is None, rows[k][0] or 0)

    scaled = [np.array(r[1], np.float64) / max(abs(x) for x in r[1]) if u else None for r, u in zip(rows, usable, strict=True)]
    unit = [x / np.linalg.norm(x) if u else None for x, u in zip(scaled, usable, strict=True)]
    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)), key=number)
                up[b] = a
    out = []
    for k in range(n):
        c = rows[root(k)][0]
        out.append((rows[k][0], links[k], c, rows[k][0] is not None and rows[k][0] == c))
    return sorted(out, key=order)


def order(r):
    return r[0] is None, r[0] or 0, r[1], r[2] or 0


def made(seed, many=160, dims=12, labels=3):
    """Vectors around few centres with unlike spread, chains of near ones, copies and rows that link with nothing."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(many):
        centre = np.random.default_rng(k % 9).normal(size=dims)
        rows.append((centre + rng.normal(size=dims) * rng.choice([0.02, 0.25, 0.4, 1.5])).astype(np.float32).tolist())
    rows += [rows[3]] * 12 + [(np.array(rows[4]) * 3).astype(np.float32).tolist()]
    angles = np.arange(30) * 0.3  # each within reach of its neighbours only
    rows += [[float(np.float32(np.cos(a))), float(np.float32(np.sin(a)))] + [0.0] * (dims - 2) for a in angles]
    ids = rng.permutation(len(rows)).tolist()
    out = [(i, v, int(rng.integers(labels)) if j < many else 1) for j, (i, v) in enumerate(zip(ids, rows, strict=True))]
    odd = [None, [], [0.0] * dims, [None] * dims, [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1), [1.0, 2.0], [1.0, 2.1], [3.0]]
    out += [(1000 + k, v, 1) for k, v in enumerate(odd)] + [(2000, rows[3], None), (2001, rows[3], None)]
    return out + [(None, rows[3], 1), (None, rows[5], 2), (7, rows[3], 1), (7, rows[3], 1), (None, None, None)]


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed, block, base, blocks, fan", [(1, 2048, 256, 16, 3), (2, 8, 3, 2, 1), (3, 5, 2, 1, 2)])
def test_against_all_pairs(spark, monkeypatch, seed, block, base, blocks, fan):
    for name, value in (("BLOCK", block), ("BASE", base), ("BLOCKS", blocks), ("FAN", fan), ("BROADCAST_ROWS", 20_000 if seed == 1 else 0)):
        monkeypatch.setattr(embedding_join, name, value)
    rows = made(seed)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, n long, component_id string").repartition(3)
    out = embedding_join.near_duplicates(table)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in out.collect()), key=order) == brute(rows)


def test_doubles_and_other_labels(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=5) * (1e200 if k % 2 else 1e-200)).tolist(), "ab"[k % 2]) for k in range(60)]
    got = embedding_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), threshold=0.8)
    assert sorted((tuple(r) for r in got.collect()), key=order) == brute(rows, 0.8)


def test_far_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", 10)
    rng = np.random.default_rng(5)
    rows = [(k, (np.eye(6)[k // 100] + rng.normal(size=6) * 0.01).tolist(), 0) for k in range(600)]
    classes = embedding_join.classes_of(spark.createDataFrame(rows, SCHEMA))
    grid = embedding_join.fit_grid(classes, 0.93, 8)
    blocks = embedding_join.blocks_of(classes, grid)
    pairs = embedding_join.close_blocks(blocks, grid).count()
    n = blocks.count()
    assert n >= 60 and pairs < n * (n + 1) / 2 / 4
    got = embedding_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(99, 100 * k) for k in range(6)}


def test_empty_tables(spark):
    assert embedding_join.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    got = embedding_join.near_duplicates(spark.createDataFrame([(1, None, 1), (2, [1.0], None)], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_reached_over_a_chain():
    links = np.zeros((50, 50), bool)
    links[np.arange(50), np.arange(50)] = links[np.arange(49), np.arange(1, 50)] = True
    x, y = embedding_join.reached(links, np.arange(100, 150), np.arange(200, 250))
    assert set(x) == set(y) == {100}
