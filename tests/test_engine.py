import datetime as dt
import itertools
import json
import zlib

import pytest
from pyspark.sql import functions as F

from chronoframe.functions import text
from chronoframe.operators import conflict, graph, lifecycle, reconcile, temporal, vector_search
from chronoframe.operators.views import View, Views
from chronoframe.plans.filters import Eq, Gt
from chronoframe.plans.query import Query
from chronoframe.sources import log as source
from chronoframe.streaming import feed

T = [dt.datetime(2024, 1, d) for d in range(1, 11)]


@pytest.fixture(scope="module")
def log(spark):
    rows = [("n", "k", 1, T[0], "P", "v1"), ("n", "k", 2, T[2], "P", "v2"), ("n", "k", 3, T[4], "D", None),
            ("n", "k", 4, T[6], "P", "v4"), ("n", "j", 5, T[1], "P", "w1"), ("m", "k", 6, T[1], "P", "x")]
    return spark.createDataFrame(rows, source.SCHEMA.replace(", content_id string", ""))


def test_as_of(log):
    def at(t):
        return {(r.ns, r.key): r.value for r in temporal.as_of(log, t).collect()}

    us = dt.timedelta(microseconds=1)
    assert at(T[0])["n", "k"] == "v1" and at(T[2] - us)["n", "k"] == "v1" and at(T[2])["n", "k"] == "v2"
    assert ("n", "k") not in at(T[4]) and at(T[9])["n", "k"] == "v4"
    assert at(T[0] - us) == {}


def test_changes(log):
    got = [(r.change, r.prev_value) for r in temporal.changes(log, ["value"]).where("ns='n' AND key='k'").orderBy("seq").collect()]
    assert got == [("insert", None), ("update", "v1"), ("delete", "v2"), ("insert", None)]


def test_as_of_join(spark, log):
    asked = spark.createDataFrame([("n", "k", T[3]), ("n", "j", T[0]), ("x", "y", T[0])], "ns string, key string, at timestamp")
    got = {(r.ns, r.key): r.version and r.version.value for r in temporal.as_of_join(asked, log).collect()}
    assert got == {("n", "k"): "v2", ("n", "j"): None, ("x", "y"): None}


def test_clock_laws(spark):
    clocks = [None, {}, {"a": 1}, {"b": 1}, {"a": 1, "b": 1}, {"a": 2, "b": 1}]
    rows = list(itertools.product(clocks, clocks))
    df = spark.createDataFrame(rows, "x map<string,bigint>, y map<string,bigint>")
    got = df.select("x", "y", conflict.compare(F.col("x"), F.col("y")).alias("c"), conflict.merge(F.col("x"), F.col("y")).alias("m")).collect()
    for r in got:
        x, y = r.x or {}, r.y or {}
        gaps = [x.get(k, 0) - y.get(k, 0) for k in {*x, *y}]
        under, over = any(g < 0 for g in gaps), any(g > 0 for g in gaps)
        want = {(1, 1): "concurrent", (1, 0): "less", (0, 1): "greater", (0, 0): "equal"}[under, over]
        assert r.c == want
        assert r.m == {k: max(x.get(k, 0), y.get(k, 0)) for k in {*x, *y}}


def test_graph_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (7, 8)], "parent int, child int")
    reach = {(r.src, r.dst) for r in graph.closure(edges).collect()}
    assert reach == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4) if a != b} | {(7, 8)}
    assert {(r.node, r.component) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)}
    pairs = spark.createDataFrame([(1, 4), (1, 8)], "a int, b int")
    assert [tuple(r) for r in graph.connected(edges, pairs).collect()] == [(1, 4)]
    assert [r.path for r in graph.shortest_paths(edges, pairs, 5).collect()] == [[1, 3, 4]]


def test_lca(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("a", "d"), ("b", "d")], "parent string, child string")
    pairs = spark.createDataFrame([("c", "d"), ("a", "c"), ("c", "b")], "a string, b string")
    assert {(r.a, r.b): r.lca for r in graph.lca(edges, pairs).collect()} == {("c", "d"): "r", ("a", "c"): "a", ("c", "b"): "r"}


def test_merkle(spark):
    a, b = spark.range(0, 500), spark.range(20, 510)
    root = lambda d: reconcile.merkle_root(d, "id", 64).first().hash
    assert root(a) == root(a.orderBy(F.desc("id"))) != root(b)
    got = {(r.id, r.side) for r in reconcile.merkle_diff(a, b, "id", 64).collect()}
    assert got == {(i, "a") for i in range(20)} | {(i, "b") for i in range(500, 510)}
    bloom = {r.id for r in reconcile.maybe_missing(a, b, "id", 500, 0.001).collect()}
    assert bloom <= set(range(500, 510)) and len(bloom) >= 8


def test_searches_without_limit(spark):
    vectors = spark.range(1_000_010).selectExpr("id AS key", "array(1.0D) AS embedding")
    assert vector_search.search(vectors, [1.0], None, 0.5).count() == 1_000_010
    pairs = spark.range(1_000_010).selectExpr("id AS a", "id + 1 AS b", "1.0D AS score")
    assert vector_search.unconnected(pairs, pairs.where("a < 5"), None).count() == 1_000_005


def test_bloom_grows_with_its_ids(spark):
    local, remote = spark.range(400_000).toDF("id"), spark.range(400_000, 402_000).toDF("id")
    assert reconcile.maybe_missing(local, remote, "id").count() >= 1_950


def test_tiers_match_one_by_one(spark):
    import random

    rng = random.Random(3)
    rows = [(i, round(rng.random(), 3)) for i in range(200)]
    hot, warm, cold = 10, 30, 50
    want, room = {}, {"hot": hot, "warm": warm, "cold": cold}
    for i, s in sorted(rows, key=lambda r: (-r[1], r[0])):
        for tier, least in (("hot", 0.6), ("warm", 0.3), ("cold", 0.1)):
            if s >= least and room[tier]:
                room[tier] -= 1
                want[i] = tier
                break
        else:
            want[i] = "deep"
    df = spark.createDataFrame(rows, "id int, importance double")
    assert {r.id: r.tier for r in lifecycle.plan_tiers(df, hot, warm, cold).collect()} == want


def test_views(spark, tmp_path):
    data = [[(i, i % 2 == 0) for i in range(10)]]
    views = Views(spark, str(tmp_path), lambda _: spark.createDataFrame(data[0], "key int, active boolean"))
    views.create(View("on", "items", Query().where(Eq("active", True)), auto_refresh=True))
    data[0] += [(i, i % 2 == 0) for i in range(10, 20)]
    assert views.rows("on").count() == 5
    assert views.refresh_source("items") == ["on"]
    assert views.rows("on").count() == 10 and views.rows("on", Gt("key", 15)).count() == 2
    with pytest.raises(ValueError):
        views.create(View("on", "items", Query()))
    again = Views(spark, str(tmp_path), views.read)  # as after a restart
    assert again.names() == ["on"] and again.rows("on").count() == 10 and again.info("on")["version"] == 2
    with pytest.raises(ValueError):
        again.create(View("on", "items", Query()))
    again.delete("on")
    assert Views(spark, str(tmp_path), views.read).names() == []


def test_wal_and_log(spark, log, tmp_path):
    source.write_wal(log, f"{tmp_path}/wal")
    bad = {"ns": "n", "key": "z", "seq": 9, "ts": "2024-01-01T00:00:00.000Z", "op": "P", "value": "q", "checksum": 1}
    good = dict(bad, key="g", checksum=zlib.crc32(b"n|g|9|1704067200000000|P|q"))
    (tmp_path / "wal" / "more.json").write_text("\n".join(["{broken", json.dumps(bad), json.dumps(good)]))
    back = source.replay_wal(spark, f"{tmp_path}/wal")
    assert {r.seq for r in back.where("key <> 'g'").collect()} == {1, 2, 3, 4, 5, 6}
    assert back.where("key = 'g'").count() == 1 and back.where("key = 'z'").count() == 0
    items = spark.createDataFrame([("n", "a", T[0], '{"a":1,"b":2}'), ("n", "b", T[0], '{"b":2,"a":1}')], "ns string, key string, ts timestamp, value string")
    source.put(spark, f"{tmp_path}/log", items, 1)
    source.delete(spark, f"{tmp_path}/log", items.where("key = 'a'"), T[1], 2)
    read = source.read(spark, f"{tmp_path}/log", "n")
    assert [r.key for r in temporal.latest(read).collect()] == ["b"]
    assert read.where("op = 'P'").select("content_id").distinct().count() == 1


def test_log_keeps_order_and_conflicts(spark, tmp_path):
    shape = "ns string, key string, ts timestamp, value string, parents array<string>"
    items = spark.createDataFrame([("n", "a", T[0], str(i), ["n:z"] * (i == 4)) for i in range(5)], shape).coalesce(1)
    source.put_with_parents(spark, f"{tmp_path}/l", f"{tmp_path}/e", items, 7)
    log = source.read(spark, f"{tmp_path}/l")
    assert source.get(log, "n", "a").first().value == "4" and source.next_seq(log) == 12
    assert [r.previous for r in source.linked(log).orderBy("seq").collect()][1:] == [r.write_id for r in source.linked(log).orderBy("seq").collect()][:-1]
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/e").collect()] == [("n:z", "n:a")]
    other = log.withColumn("value", F.lit("x")).withColumn("content_id", F.lit("y"))
    both = source.merge(log, other, log)
    assert both.count() == 10 and source.conflicts(both).count() == 5 and source.conflicts(log).count() == 0
    source.snapshot(log, f"{tmp_path}/s")
    assert source.restore(spark, f"{tmp_path}/s").count() == 5
    versions, values = source.split_values(log)
    assert source.with_values(versions, values).exceptAll(log.select("ns", "key", "seq", "ts", "op", "value", "content_id")).count() == 0 and "value" not in versions.columns
    keys = spark.createDataFrame([("n", "a", {"x": 2})], "ns string, key string, clock map<string,bigint>")
    source.delete_causal(spark, f"{tmp_path}/l", f"{tmp_path}/g", keys, T[1], 20, "x")
    assert source.get(source.read(spark, f"{tmp_path}/l"), "n", "a").count() == 0
    assert spark.read.parquet(f"{tmp_path}/g").first().clock == {"x": 3}


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.95])
def test_pairs_find_all(spark, threshold):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16))
    x[150:] = x[:150] + rng.standard_normal((150, 16)) * rng.uniform(0, 1.2, (150, 1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= threshold, 1)), strict=True)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key int, embedding array<double>")
    assert {(r.a, r.b) for r in vector_search.pairs(df, threshold).collect()} == want


def test_consolidation_and_moves(spark):
    from chronoframe.operators import memory

    rows = [(30.0, 0.8, 5), (29.9, 0.1, 0), (99.0, 0.81, 0), (99.0, 0.1, 6), (31.0, 0.0, 0)]
    df = spark.createDataFrame(rows, "age double, importance double, n int")
    got = [r[0] for r in df.select(memory.should_consolidate(F.col("age"), F.col("importance"), F.col("n"))).collect()]
    assert got == [True, False, False, False, True]
    moves = spark.createDataFrame([("hot", "cold"), ("hot", "warm"), ("deep", "cold"), ("deep", "hot"), ("cold", "deep"), ("warm", "hot")], "a string, b string")
    got = [r[0] for r in moves.select(lifecycle.transition(F.col("a"), F.col("b"))).collect()]
    assert got == ["other", "demote", "restore", "other", "archive", "promote"]
    items = spark.createDataFrame([(1, T[0], 3), (2, T[9], 1)], "id int, ts timestamp, descendants int")
    refs = spark.createDataFrame([(1,), (2,)], "dst int")
    got = {r.id: (r.fitness, r.fit) for r in lifecycle.fitness(items, refs, dt.datetime(2024, 1, 10, 12)).collect()}
    assert got == {1: (2, True), 2: (2, True)}


def test_stream(spark, log, tmp_path):
    log.write.parquet(f"{tmp_path}/log")
    seen = []
    wanted = feed.Subscription(ns="n", key="k", kinds=("update", "delete"))
    schema = "ns string, key string, seq bigint, ts timestamp, op string, value string"
    q = feed.subscribe(spark, f"{tmp_path}/log", schema, wanted, lambda df, _: seen.extend(df.collect()), f"{tmp_path}/cp", once=True)
    q.awaitTermination(120)
    assert sorted((r.seq, r.change, r.prev_value) for r in seen) == [(2, "update", "v1"), (3, "delete", "v2")]


@pytest.mark.parametrize("t", ["word " * 100, "a" * 333, "x. y\n\nz " * 40, "", None])
@pytest.mark.parametrize("size,overlap", [(100, 20), (10, 0), (7, 6)])
def test_chunks(t, size, overlap):
    got = text.chunks(t, size, overlap)
    assert all(0 < len(c) <= size for c in got)
    if not overlap:
        assert "".join(got) == (t or "")
    assert set("".join(got)) == set(t or "")


def test_chunk_sizes_are_checked():
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            text.chunks("x", size, overlap)


def _odd_vectors(spark):
    """Copies, unlike lengths, zeros, nulls and what isn't finite, dealt over many partitions."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 3)).tolist() + [[1.0, 2.0, 3.0]] * 40 + rng.standard_normal((20, 2)).tolist()
    x += [[0.0, 0.0, 0.0], None, [1.0, None, 2.0], [float("inf"), 0.0, 0.0], []]
    labels = [None if i % 7 == 0 else i % 3 for i in range(len(x))]
    rows = list(zip(range(len(x)), x, labels, strict=True)) + [(5, [1.0, 2.0, 3.0], 1), (None, [1.0, 2.0, 3.0], 1)]
    return spark.createDataFrame(rows, "key int, embedding array<double>, label int").repartition(7).cache()


def _joined(df):
    """Each pair by a plain join."""
    from chronoframe.functions import vectors as V

    usable = df.where("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    both = usable.toDF("a", "va", "la").join(usable.toDF("b", "vb", "lb"), F.expr("a < b"))
    return both.withColumn("score", V.cosine(F.col("va"), F.col("vb"))).where("score >= 0.5")


def _same(got, want):
    return sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_pairs_are_those_of_a_join_to_the_last_bit(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "LEAST_ROWS", 16)  # so that there are many blocks
    df = _odd_vectors(spark)
    assert _same(vector_search.pairs(df, 0.5), _joined(df).select("a", "b", "score"))
    assert vector_search.pairs(df.where("key < 0"), 0.5).count() == 0
    named = df.where("key < 100").withColumn("key", F.concat(F.lit("k"), "key"))
    assert _same(vector_search.pairs(named, 0.5), _joined(named).select("a", "b", "score"))
    single = df.withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert _same(vector_search.pairs(single, 0.5), _joined(single).select("a", "b", "score"))


def test_edge_stats_move_no_candidates(spark):
    edges = vector_search.typed_edges(vector_search.pairs(_odd_vectors(spark), 0.5))
    stats = vector_search.edge_stats(edges)
    want = vector_search.edge_stats(vector_search.typed_edges(_joined(_odd_vectors(spark))))
    assert {r.kind: r.edges for r in stats.collect()} == {r.kind: r.edges for r in want.collect()}
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan.lower() and plan.count("Join") == 1 and plan.count("Aggregate") == 1


def test_edge_stats_query_counts_copies_without_pairs(spark, tmp_path, monkeypatch):
    """Equal vectors are compared once; rows that share an id, however often, make no pair."""
    from chronoframe.queries import QUERIES

    monkeypatch.setattr(vector_search, "LEAST_ROWS", 16)
    odd = _odd_vectors(spark).withColumnRenamed("key", "vec_id")
    again = odd.where("vec_id % 5 = 0")
    for name, rows in (("unique", odd.dropDuplicates(["vec_id"])), ("odd", odd), ("again", odd.union(again).union(again))):
        rows.write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        joined = _joined(rows.withColumnRenamed("vec_id", "key"))
        want = vector_search.edge_stats(vector_search.typed_edges(joined)).collect()
        got = QUERIES["x_edge_stats"](spark, f"{tmp_path}/{name}").collect()
        assert {r.kind: r.edges for r in got} == {r.kind: r.edges for r in want}
        for r in got:
            mean = next(w.mean_strength for w in want if w.kind == r.kind)
            assert r.mean_strength == pytest.approx(mean, abs=1e-6, nan_ok=True)
    # 4.5 thousand million pairs: none of them is made
    rows = spark.range(100_000).selectExpr("id AS vec_id", "array(float(id % 3 + 1), float(1), float(0)) AS embedding", "1 AS label")
    rows.limit(95_000).write.parquet(f"{tmp_path}/many/embeddings.parquet")
    found = QUERIES["x_edge_stats"](spark, f"{tmp_path}/many")
    assert "score" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sum(r.edges for r in found.collect()) == 95_000 * 94_999 // 2


def test_pairs_apart(spark, monkeypatch):
    """Pairs of unlike labels, as SQL has them: a row without one is in none."""
    monkeypatch.setattr(vector_search, "LEAST_ROWS", 16)
    df = _odd_vectors(spark)
    want = _joined(df).where("la <> lb").select("a", "b", "score")
    assert want.count() and _same(vector_search.pairs(df, 0.5, apart="label"), want)


def test_unconnected_query_leaves_out_missing_labels(spark, tmp_path):
    from chronoframe.queries import QUERIES

    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 2), (3, [1.0, 0.2], None), (4, [1.0, 0.1], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["x_pairs_unconnected"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, 2), (1, 4)]


def test_pairs_of_few(spark):
    df = _odd_vectors(spark)
    few = df.where("key IN (3, 5, 70, 71, 118)")
    got = vector_search.pairs_of(df, few, 0.5).distinct()
    want = _joined(df).where("a IN (3, 5, 70, 71, 118) OR b IN (3, 5, 70, 71, 118)").select("a", "b", "score").distinct()
    assert _same(got, want)
    assert vector_search.pairs_of(df, df.where("key < 0"), 0.5).count() == 0


def test_explain_query_reads_the_hits_edges_alone(spark, tmp_path):
    from chronoframe import queries

    near = [[p + (0.001 * i if n == i else 0.0) for n, p in enumerate(queries.PROBE)] for i in range(40)]
    rows = [(i, v, i % 3) for i, v in enumerate(near)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.QUERIES["x_explain"](spark, str(tmp_path))
    # all are alike, so each hit shares the first rows with the others
    assert {r.explanation for r in found.collect()} == {"shares 5 neighbours by abstraction"} and found.count() == 30
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()
    vectors = queries._vectors(spark, str(tmp_path))
    edges = vector_search.typed_edges(vector_search.pairs(vectors, 0.5))
    want = vector_search.explain(queries._hits(spark, str(tmp_path)).select("key", "score"), edges)
    assert _same(found, want.select("key", "explanation"))
