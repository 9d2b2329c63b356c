"""The cover tree's invariants, what it prunes, and repeated rows against SQL."""

from __future__ import annotations

import time

import numpy as np
from compare import oracle, rows
from pyspark.sql import functions as F

from veilframe.llm import cover_tree, entry


def clustered(n, groups, seed=1, width=8):
    made = np.random.default_rng(seed)
    centres = made.normal(0, 2000, (groups, width))
    return np.floor(centres[np.arange(n) % groups] + made.normal(0, 6, (n, width)))


def nodes(root):
    stack = [root]
    while stack:
        x = stack.pop()
        yield x
        stack += x.children


def depth(root):
    return 1 + max(map(depth, root.children), default=0)


def test_levels_separation_nesting_and_covering():
    for points in (clustered(900, 30), np.random.default_rng(2).normal(0, 300, (300, 24)).round(), np.repeat(clustered(40, 4), 5, axis=0)):
        root = cover_tree.build(points, 100)
        for x in nodes(root):
            members = np.r_[x.queries, x.data]
            assert np.isclose(cover_tree.distances(points[members], x.centre).max(), x.radius) and x.place in members
            if not x.children:
                assert x.radius == 0 and x.level is None
                continue
            apart = cover_tree.BASE**x.level
            places = [c.place for c in x.children]
            assert x.place in places and x.radius <= apart * cover_tree.BASE * (1 + 1e-9)
            assert all(c.radius <= apart * (1 + 1e-9) for c in x.children)
            assert all(np.delete(cover_tree.distances(points[places], points[p]), i).min() > apart for i, p in enumerate(places))
            assert sorted(np.concatenate([np.r_[c.queries, c.data] for c in x.children])) == sorted(members)


def test_depth_on_the_table(spark, small):
    vectors = np.array([r[0] for r in spark.read.parquet(f"{small}/embeddings.parquet").select("embedding").collect()])
    assert depth(cover_tree.build(np.floor(256 * vectors.astype(np.float64)), 20)) > 1


def test_pairs_are_pruned_and_work_falls():
    met = {}
    for n in (600, 6000):
        points, seen = clustered(n, 60), {}
        scores, _ = cover_tree.search(np.r_[points[:50], points], np.r_[np.arange(50), np.arange(n)], 50, 5, seen=seen)
        product = points[:50] @ points.T
        product[np.arange(50), np.arange(50)] = -np.inf
        assert (scores == -np.sort(-product, axis=1)[:, :5]).all()
        assert seen["pruned"] and seen["met"] < 50 * n / 2  # of all pairs of points
        met[n] = seen["met"] / n
    assert met[6000] < met[600]


def test_a_known_score_leaves_only_better_ones():
    points = clustered(200, 5)
    ids = np.r_[np.arange(10), np.arange(200)]
    scores, _ = cover_tree.search(np.r_[points[:10], points], ids, 10, 3)
    again, _ = cover_tree.search(np.r_[points[:10], points], ids, 10, 3, known=scores[:, 2])
    assert (again == scores).all()


def test_cells_blocks_and_repeated_rows_equal_sql(spark, tmp_path, monkeypatch):
    for name, value in (("CELL_ROWS", 40), ("BLOCK_ROWS", 16), ("QUERY_ROWS", 2)):
        monkeypatch.setattr(cover_tree, name, value)
    points = clustered(420, 12, seed=4) / 256
    ids = [*range(400), *[51, 51, 52, 117] * 5]
    given = [(i, p.tolist()) for i, p in zip(ids, points, strict=True)]
    given += [(51, given[51][1])] * 3
    frame = spark.createDataFrame(given, "vec_id long, embedding array<double>").withColumns({"row": F.lit("x"), "cell": F.lit(1), "known": F.lit(None).cast("int")})
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    (tmp_path / "sql").mkdir()
    frame.select("vec_id", "embedding").toPandas().to_parquet(tmp_path / "sql/embeddings.parquet")
    got = cover_tree.top_k(spark.read.parquet(str(tmp_path / "embeddings.parquet")), F.col("vec_id") % 50 == 0, 5)
    assert rows(got.toArrow()) == rows(oracle(entry.OP5_SQL, str(tmp_path / "sql")))


def test_without_vectors_or_queries(spark):
    frame = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (50, []), (100, [])], "vec_id long, embedding array<double>")
    assert cover_tree.top_k(frame.where("vec_id < 50"), F.col("vec_id") % 50 == 0, 5).count() == 0
    assert cover_tree.top_k(frame.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    assert sorted(map(tuple, cover_tree.top_k(frame, F.col("vec_id") % 50 == 0, 5).collect())) == [(50, 1, 100, 0), (100, 1, 50, 0)]


def spread(n, width=64, seed=11):
    """Vectors without structure, of about equal lengths."""
    made = np.random.default_rng(seed).normal(0, 1, (n, width))
    return np.floor(256 * made / np.linalg.norm(made, axis=1, keepdims=True))


def test_queries_are_no_part_of_trees_and_vectors_without_structure_are_quick(monkeypatch):
    points, built, plain = spread(2048 + 1024), [], cover_tree.build
    monkeypatch.setattr(cover_tree, "build", lambda p, n: built.append(len(p)) or plain(p, n))
    began = time.process_time()
    scores, _ = cover_tree.search(points, np.arange(len(points)), 1024, 5)
    assert time.process_time() - began < 5 and sum(built) == 2048
    assert (scores == -np.sort(-(points[:1024] @ points[1024:].T), axis=1)[:, :5]).all()


def test_search_equals_brute_force_on_all_kinds(monkeypatch):
    monkeypatch.setattr(cover_tree, "TREE_ROWS", 150)
    monkeypatch.setattr(cover_tree, "WALK_ROWS", 16)
    kinds = [spread(400, 16), clustered(400, 9), clustered(400, 9) * 2.0**14, spread(400, 8) * 2.0**20, np.repeat(clustered(100, 3), 4, axis=0), np.zeros((400, 3)), np.ones((400, 0))]
    kinds.append(np.r_[spread(40, 4), np.repeat(spread(1, 4, 3), 360, axis=0)])
    for points in kinds:
        ids = np.r_[np.arange(40) * 3, np.random.default_rng(5).integers(0, 300, 360)]
        scores, found = cover_tree.search(points, ids, 40, 5)
        product = points.astype(np.int64) @ points.astype(np.int64).T
        for q in range(40):
            others = 40 + np.flatnonzero(ids[40:] != ids[q])
            best = sorted(zip((-product[q, others]).tolist(), ids[others].tolist(), strict=True))[:5]
            assert list(zip((-scores[q]).tolist(), found[q].tolist(), strict=True)) == best


def test_wide_vectors_make_smaller_tasks():
    rows = cover_tree.for_width
    assert rows(8192, 64) == 8192 and rows(8192, 256) == 4096 and rows(8192, 10**6) == 1024 and rows(2, 10**6) == 1


def test_larger_tables_are_quick_and_many_results_are_whole():
    points = spread(400 + 16_384, seed=12)
    product = np.sort(-(points[:400] @ points[400:].T), axis=1)
    began = time.process_time()
    scores, _ = cover_tree.search(points, np.arange(len(points)), 400, 5)
    assert time.process_time() - began < 15 and (scores == -product[:, :5]).all()
    scores, _ = cover_tree.search(points[:470], np.arange(470), 400, 200)
    assert (scores[:, :70] == -np.sort(-(points[:400] @ points[400:470].T), axis=1)).all() and (scores[:, 70:] == -(2**63)).all()
