from __future__ import annotations

import time
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import metric_join, posting_lists, sharding, warc
from llm.common import components
from llm.queries import QUERIES
from tests.llm.helpers import SF_DIR, least_reachable

ODD = [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7]


def near_vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 5, 8))
    x = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, 8)) * rng.choice([0.0, 0.05, 0.4], size=(n, 1))
    return [v.astype(np.float32).tolist() for v in x]


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + k, v, 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")


def links(vectors):
    x = np.array(vectors, float)
    u = x / np.sqrt((x * x).sum(1))[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s


@pytest.mark.parametrize("block", [16, 4096])
def test_range_join_equals_brute_force(spark, block):
    vectors = near_vectors(300)
    df = frame(spark, vectors).union(frame(spark, ODD, 300)).repartition(4)
    out = {r["vec_id"]: r for r in metric_join.range_join(df, block=block).collect()}
    s = links(vectors) >= 0.95
    least = least_reachable(range(300), [(int(a), int(b)) for a, b in zip(*np.nonzero(s), strict=True)])
    assert len(out) == 305
    for k in range(305):
        want = (int(s[k].sum()), least[k]) if k < 300 else (0, k)
        assert (out[k]["n_links"], out[k]["component_id"]) == want and out[k]["kept"] == (want[1] == k)


def test_copies_do_not_make_large_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 64))
    x[600:700] = x[:100] + rng.normal(size=(100, 64)) * 0.05
    block, join = 64, metric_join._join

    def limited(least):
        inner = join(least)

        def run(batches):
            def counted():
                sides = {}
                for batch in batches:
                    for side in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        sides[side] = sides.get(side, 0) + 1
                        if sides[side] > 2 * block:
                            raise ValueError("large tile")
                    yield batch

            yield from inner(counted())

        return run

    monkeypatch.setattr(metric_join, "_join", limited)
    out = {r["vec_id"]: r["n_links"] for r in metric_join.range_join(frame(spark, x.tolist()), block=block).collect()}
    want = (links(x.astype(np.float32)) >= 0.95).sum(1)
    assert out == {k: int(n) for k, n in enumerate(want)} and sum(out.values()) >= 200


def test_range_join_edge_cases(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert metric_join.range_join(empty).count() == 0
    assert {r["n_links"] for r in metric_join.range_join(frame(spark, ODD)).collect()} == {0}
    rows = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (3, [2.0, 0.0], 3), (3, [2.0, 0.0], 3)], "vec_id long, embedding array<double>, rep int")
    out = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in metric_join.range_join(rows).collect())
    assert out == [("3", 2, 3, True), ("3", 2, 3, True), ("4", 2, 3, False), ("None", 0, None, False)]


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 400) if k % 97] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    nodes = {x for e in edges for x in e}
    want = least_reachable(nodes, edges)
    assert out == {n: want[n] for n in out} and {n for n in nodes if sum(want[m] == want[n] for m in nodes) > 1} <= set(out)


def test_search_finds_the_nearest(spark):
    vectors = near_vectors(1500, 3)
    df = frame(spark, vectors).union(frame(spark, ODD, 1500))
    out = posting_lists.nearest(df, df.where("vec_id % 50 = 0"), per_list=40, chunk=64).toPandas()
    s, hit, total = links(vectors), 0, 0
    for q in range(0, 1500, 50):
        want = np.lexsort((np.arange(1500), -s[q]))[:5]
        rows = out[out["query_id"] == q].sort_values("rank")
        assert rows["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(rows["vec_id"])
        assert np.allclose(rows["score"], s[q][rows["vec_id"]], atol=1e-12) and (np.diff(rows["score"]) <= 0).all()
        hit, total = hit + len(set(want) & set(rows["vec_id"])), total + 5
    assert hit / total >= 0.9 and set(out["query_id"]) == set(range(0, 1500, 50))


def test_ties_go_to_the_smaller_id(spark):
    vectors = [[1.0, 0.0]] * 40 + [[0.9, 0.1]] * 3
    df = frame(spark, vectors).repartition(5)
    out = posting_lists.nearest(df, df.where("vec_id in (0, 3, 41)"), chunk=8).toPandas().sort_values(["query_id", "rank"])
    assert out[out["query_id"] == 0]["vec_id"].tolist() == [1, 2, 3, 4, 5]
    assert out[out["query_id"] == 3]["vec_id"].tolist() == [0, 1, 2, 4, 5]
    assert out[out["query_id"] == 41]["vec_id"].tolist() == [40, 42, 0, 1, 2]
    few = frame(spark, vectors[:2])
    assert posting_lists.nearest(few, few).count() == 2
    assert posting_lists.nearest(frame(spark, ODD), frame(spark, ODD)).count() == 0


def test_graph_reaches_all_centroids():
    x = np.random.default_rng(0).normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = posting_lists.Index(x, posting_lists.neighbour_graph(x, 6))
    ids, cos = posting_lists.search_graph(index, x[:20], 300)
    assert all(set(r) == set(range(300)) for r in ids.tolist()) and (np.diff(cos, axis=1) <= 1e-12).all()


def test_bounded_search_visits_what_a_full_one_does():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4096 + 1024, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = posting_lists.Index(x[:4096], posting_lists.neighbour_graph(x[:4096]))
    queries, sizes, start = x[4096:], np.full(4096, 10), time.time()
    near = queries + 0.5 * x[:1024]
    near /= np.linalg.norm(near, axis=1)[:, None]
    found = posting_lists.visited(index, near, 1.1, sizes, 24)
    assert time.time() - start < 30
    far = np.sqrt(np.maximum(0, 2 - 2 * near @ index.centroids.T))
    want = [np.flatnonzero(row <= 1.1 * row.min() + 1e-12) for row in far]
    assert np.mean([len(set(w) & set(f)) / len(w) for w, f in zip(want, found, strict=True)]) > 0.9
    assert all(10 * len(f) >= 24 for f in found)


def test_ratio_is_fitted_to_recall():
    x = np.array(near_vectors(3000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    centre = posting_lists.balanced_centroids(x, 60)
    index = posting_lists.Index(centre, posting_lists.neighbour_graph(centre))
    some, all_ = (posting_lists.fitted_ratio(index, x, recall=r) for r in (0.8, 1.0))
    assert 1 <= some <= all_ and posting_lists.fitted_ratio(index, x[:1]) == 1


# -- shards -----------------------------------------------------------------------------------------------

def test_shards_have_exact_sizes_and_gapless_slots(spark):
    rows = [(k if k % 9 else None, "t" * (k % 5) if k % 7 else None, "x", k) for k in range(1003)] + [(1, "t", "x", 1)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, _block long").repartition(6, "_block")
    df.write.mode("overwrite").parquet(path := df.sparkSession.conf.get("spark.sql.warehouse.dir") + "/shards_test")
    source = spark.read.parquet(path)
    out = sharding.shuffle_to_shards(source, 5, least_block=16).toPandas()
    counts = out.groupby("shard")["slot"].agg(["count", "min", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1 and len(out) == 1007 and len(counts) == 5
    assert (counts["min"] == 0).all() and (counts["max"] + 1 == counts["count"]).all() and (counts["nunique"] == counts["count"]).all()
    assert sorted(map(str, out[["doc_id", "text", "_block"]].itertuples(index=False, name=None))) == sorted(
        map(str, source.select("doc_id", "text", "_block").toPandas().itertuples(index=False, name=None)))
    again = sharding.shuffle_to_shards(source, 5, least_block=16).toPandas()
    key = ["_block", "shard", "slot"]
    assert sorted(out[key].values.tolist()) == sorted(again[key].values.tolist())
    assert sharding.shuffle_to_shards(source.limit(0)).count() == 0


def test_matrix_has_exact_sums_and_uniform_marginals():
    ends, room = np.array([0, 30, 30, 75, 100]), np.array([40, 35, 25])
    total = np.zeros((4, 3))
    for seed in range(600):
        rows = np.array([sharding.matrix_row(p, ends, room, seed) for p in range(4)])
        assert (rows.sum(1) == np.diff(ends)).all() and (rows.sum(0) == room).all() and (rows >= 0).all()
        total += rows
    assert np.allclose(total / 600, np.outer(np.diff(ends), room) / 100, atol=0.6)


def test_large_draws_have_the_right_moments():
    rng = np.random.default_rng(0)
    good, bad, n = 3 * 10**9, 5 * 10**9, 10**6
    draws = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(200)])
    sigma = math.sqrt(n * 3 / 8 * 5 / 8)
    assert abs(draws.mean() - n * 3 / 8) < 5 * sigma / math.sqrt(200) and 0.8 * sigma < draws.std() < 1.2 * sigma
    assert sharding.drawn(rng, np.array([10**9, 10**9, 7]), 2 * 10**9 + 7).tolist() == [10**9, 10**9, 7]


# -- archives ---------------------------------------------------------------------------------------------

LONG = "<p>" + "é" * 700 + "</p>"
PAGES = [(1, "http://a/", LONG, 0), (2, "http://b/", LONG, 0), (9, None, LONG, 0), (9, "http://again/", LONG, 0), (None, "http://n/", LONG, 0), (3, "http://c/\r\nX: y", "short", 0),
         (4, "http://d/", "short", 0), (5, "", None, 0), (6, "u", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n" * 80, 0), (7, "v", "x" * 3_000_000, 0)]


@pytest.mark.parametrize("sent", [1 << 18, 0])
def test_archive_round_trip(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(warc, "SENT_DIGESTS", sent)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest int").repartition(3)
    warc.archive(df, f"file://{tmp_path}/w")
    out = warc.pages_of(spark, f"file://{tmp_path}/w").collect()
    assert len(out) == len(PAGES)
    seen = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out)
    n = len(LONG.encode())
    assert seen == sorted([("1", "revisit", 9, n), ("2", "revisit", 9, n), ("9", "response", None, n), ("9", "response", None, n), ("None", "revisit", 9, n),
                           ("3", "response", None, 5), ("4", "response", None, 5), ("5", "response", None, 0), ("6", "response", None, 2240), ("7", "response", None, 3_000_000)])
    import hashlib

    html = {r[0]: (r[2] or "").encode() for r in PAGES}
    for r in out:
        assert r["payload_digest"] == hashlib.sha1(html[r["page_id"]]).hexdigest()
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == html[r["page_id"]]


def test_predicates_reach_the_scan_and_spare_payloads(spark, tmp_path, monkeypatch):
    warc.archive(spark.createDataFrame(PAGES, "page_id long, url string, html string, x int"), str(tmp_path / "w"))
    rows = warc.read(spark, str(tmp_path / "w")).where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://c"))
    assert [r["content_length"] > 0 for r in rows.collect()] == [True]
    assert "'record_type" not in rows._jdf.queryExecution().executedPlan().toString().split("Filter")[0]
    assert all(r["payload"] is None for r in warc.read(spark, str(tmp_path / "w"), payload="false").collect())
    reader = warc.WarcReader(str(tmp_path / "w"), True, 1)
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("content_length",), 3)])) == [warc.EqualTo(("content_length",), 3)]
    kept = []
    take = warc._Source.take
    monkeypatch.setattr(warc._Source, "take", lambda self, n, keep: (kept.append(n) if keep else None, take(self, n, keep))[1])
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {r["record_type"] for r in found} == {"revisit"} and len(kept) == len(found)


def test_plain_archives_and_empty_folders(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    data = warc.record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:a>", "Content-Type": "text/plain"}, b"note\r\n\r\n")
    data += warc.record({"WARC-Type": "response", "WARC-Record-ID": "<urn:b>", "Content-Type": "application/http; msgtype=response"}, block)
    (tmp_path / "one.warc").write_bytes(data)
    out = warc.read(spark, str(tmp_path)).orderBy("record_id").collect()
    assert [(r["record_type"], bytes(r["payload"]), r["http_length"]) for r in out] == [("warcinfo", b"note\r\n\r\n", None), ("response", b"hi", 2)]
    (tmp_path / "none").mkdir()
    assert warc.read(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "cut.warc").write_bytes(data[:-20])
    with pytest.raises(Exception, match="archive ends"):
        warc.read(spark, str(tmp_path / "cut.warc")).count()


def test_archive_of_an_empty_table(spark, tmp_path):
    warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.pages_of(spark, str(tmp_path / "w")).count() == 0


def test_warc_query_matches_its_sql(spark):
    import __spark_entry__ as entry
    from tests.compare import check, duck

    name = "op6_warc_source"
    assert ": ok" in check(spark, duck(SF_DIR), SF_DIR, name, QUERIES[name], entry.oracle_sql()[name])


def test_lists_of_queries_go_back_in_small_batches(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    index = posting_lists.Index(x[:600], posting_lists.neighbour_graph(x[:600]), 1.9)
    queries = x[600:]
    batch = pa.record_batch([pa.array(np.arange(300)), pa.ListArray.from_arrays(np.arange(0, 2401, 8, dtype=np.int32), pa.array(queries.ravel()))], names=["id", "vector"])
    monkeypatch.setattr(posting_lists, "PIECE", 1000)
    monkeypatch.setattr(posting_lists, "CELLS", 1 << 12)  # six queries look at all centroids at once
    looked = []
    ranked = posting_lists.ranked
    monkeypatch.setattr(posting_lists, "ranked", lambda index, rows: looked.append(len(rows)) or ranked(index, rows))
    shared = type("Shared", (), {"value": index})
    parts = list(posting_lists._lists(shared, np.ones(600, np.int64), 24)(iter([batch])))
    assert max(p.num_rows for p in parts) <= 1000 and max(looked) == 6
    got = {(q, c) for p in parts for c, q in zip(p.column(0).to_pylist(), p.column(1).to_pylist())}
    assert sum(p.num_rows for p in parts) == len(got) > 10_000
    far = np.sqrt(np.maximum(0, 2 - 2 * (queries @ index.centroids.T)))
    within = {(i, c) for i, c in zip(*map(np.ndarray.tolist, np.nonzero(far <= 1.9 * far.min(1, keepdims=True))))}
    # Besides these only what a query needs to meet entries enough.
    assert within <= got and all(far[q, c] <= np.sort(far[q])[23] + 1e-12 for q, c in got - within)
    assert all(np.allclose(p.column(2).values.to_numpy().reshape(-1, 8)[:len(p.column(1))], queries[p.column(1).to_numpy()]) for p in parts)


def test_queries_are_dealt_to_tasks_of_their_own(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    seen, stage = {}, posting_lists.stage
    posting_lists.stage = lambda df, label: seen.setdefault(label, df.rdd.getNumPartitions()) and stage(df, label)
    try:
        assert posting_lists.nearest(rows, rows).count() == 2000
    finally:
        posting_lists.stage = stage
    assert seen["queries"] == int(spark.conf.get("spark.sql.shuffle.partitions"))
