"""Greedy stars in rounds, the fine metric, needles in texts, catalogs on disk and flushes, against brute force."""

import itertools
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmill.functions import images, pixels
from siftmill.operators import catalog, fine, grouping, needles, similarity
from siftmill.streaming import flush

# greedy stars


def plain_stars(order, pairs):
    partners = {}
    for a, b in pairs:
        if a in order and b in order and a != b:
            partners.setdefault(a, set()).add(b)
            partners.setdefault(b, set()).add(a)
    owner = {}
    for x in sorted(order, key=lambda i: (order[i] is not None, order[i] if order[i] is not None else 0, i)):
        if x not in owner:
            owner[x] = x
            owner |= {y: x for y in partners.get(x, ()) if y not in owner}
    return owner


@pytest.mark.parametrize(("n", "m", "block"), [(60, 90, 1_000_000), (200, 260, 7), (150, 1500, 40), (40, 0, 5)])
def test_stars_equal_the_sequential_greedy(spark, n, m, block):
    rnd = random.Random(n + m)
    order = {i: rnd.choice([None, 1, 2, 3, rnd.random()]) for i in range(n)}
    pairs = [(rnd.randrange(n + 5), rnd.randrange(n)) for _ in range(m)] + [(1, 1)] * 2 + ([(2, 3), (3, 2)] if m else [])
    items = spark.createDataFrame([(i, None if o is None else float(o)) for i, o in order.items()] + [(0, 9.0), (None, 1.0)], "id long, o double")
    links = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    order[0] = min((x for x in (order[0], 9.0)), key=lambda x: (x is not None, x or 0))
    got = {r.item_id: r.group_id for r in grouping.star_groups(items, links, order_col="o", block_edges=block).collect()}
    assert got == plain_stars(order, pairs)


@pytest.mark.parametrize("block", [50, 1_000_000])
def test_stars_along_a_chain_and_around_hubs(spark, block):
    chain = [(i, i + 1) for i in range(300)]
    hubs = [(1000, 1001 + i) for i in range(150)] + [(3000, 2000 + i) for i in range(150)]  # a hub that comes first, and one that comes last
    ids = sorted({x for p in chain + hubs for x in p} | {5000})
    got = {r.item_id: r.group_id for r in grouping.star_groups(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(chain + hubs, "a long, b long"), block_edges=block).collect()}
    assert got == plain_stars({i: 0 for i in ids}, chain + hubs)


def test_stars_of_a_long_chain_take_few_rounds(spark):
    n = 100_000
    got = grouping.star_groups(spark.range(n), spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert got.where("group_id <> item_id - item_id % 2").count() == 0 and got.count() == n


def test_stars_by_string_ids(spark):
    links = [("b", "a"), ("c", "b"), ("d", "c"), ("é", "d")]
    items = spark.createDataFrame([(x,) for x in "abcdé"], "id string")
    got = {r.item_id: r.group_id for r in grouping.star_groups(items, spark.createDataFrame(links, "a string, b string"), block_edges=2).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "é": "é"}


# fine metric


def test_fine_pairs_equal_pair_by_pair(spark, monkeypatch):
    monkeypatch.setattr(fine, "BLOCK", 4)
    rng = np.random.default_rng(2)
    base = [np.kron(rng.integers(0, 256, (8, 8)), np.ones((10, 12))).astype(np.uint8)[:, :, None] for _ in range(4)]
    xs = {i: np.clip(base[i % 4].astype(int) + rng.normal(0, [2, 40, 90][i % 3], base[0].shape), 0, 255).astype(np.uint8) for i in range(30)}
    xs |= {100 + i: xs[i] for i in range(6)}
    group = {i: i % 2 if i < 100 else (i - 100) % 2 for i in xs}
    rows = [(i, group[i], images.thumbnail_of(x)) for i, x in xs.items()] + [(200, None, images.thumbnail_of(xs[0])), (201, 0, None), (202, 0, b"short")]
    items = spark.createDataFrame(rows, "item_id long, group_id long, thumb binary")
    pairs = fine.fine_pairs(items, 0.5)
    got = {(r.a, r.b): r.score for r in pairs.collect()}
    same = {(i, 100 + i): 1.0 for i in range(6)}
    score = {(a, b): pixels.ssim_of(xs[a], xs[b], 64) for a, b in itertools.combinations(range(30), 2) if group[a] == group[b]}
    want = {p: s for p, s in score.items() if s >= 0.5} | same
    assert 0 < len(want) < len(score) and all(abs(s - 0.5) > 1e-3 for s in score.values())
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-3 for p in want)
    # clusters and medoids
    near = {i: {i} for i in [*xs, 201, 202]}
    for a, b in want:
        joined = near[a] | near[b]
        for i in joined:
            near[i] = joined
    cluster = {i: min(c) if len(c) > 1 else None for i, c in near.items()} | {200: None}
    found = fine.fine_clusters(items, pairs)
    assert {r.item_id: r.cluster for r in found.collect()} == cluster
    links = {i: [got[p] for p in got if i in p] for i in xs}
    best = {c: min((-round(sum(links[i]), 9), i) for i in xs if cluster[i] == c) for c in set(cluster.values()) - {None}}
    assert {r.cluster: r.medoid for r in fine.medoids(found, pairs).collect()} == {c: i for c, (_, i) in best.items()}


# needles


@pytest.mark.parametrize(("part", "most"), [(1 << 20, 8), (30, 8), (30, 0)])
def test_containment_equals_brute_force(spark, part, most, monkeypatch):
    monkeypatch.setattr(needles, "PART_CHARS", part)
    monkeypatch.setattr(similarity, "PART_CHARS", part)
    monkeypatch.setattr(similarity, "MOST_PARTS", most)
    rnd = random.Random(part)
    words = ["aa", "ab", "b", "é日", "🎉", "xyz", "a.b", "(", "\\n"]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(40))) or None) for i in range(60)] + [(60, ""), (61, "\n\t"), (62, "aa\nab\tb")]
    some = [(k, rnd.choice(texts)[1]) for k in range(40)]
    some = [(k, t and t[rnd.randrange(len(t)) :][: rnd.randrange(1, 70)]) for k, t in some] + [(90, ""), (91, None), (92, "aa"), (93, "aa"), (94, "\n"), (95, "not there")]
    items = spark.createDataFrame(texts, "doc_id long, text string")
    found = similarity.containment(items, spark.createDataFrame(some, "item_id long, needle string"), "text", "needle")
    assert found.columns == ["doc_id", "text", "item_id", "needle"]
    got = sorted((r.doc_id, r.item_id) for r in found.collect())
    assert got == sorted((i, k) for i, t in texts for k, n in some if t and n and n in t) and len(got) > 50
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_needles_without_any(spark):
    items = spark.createDataFrame([("file:///a/b",), (None,)], "uri string")
    none = spark.createDataFrame([(None,), ("",)], "path string")
    assert catalog.under_path(items, none).count() == 0
    assert [r.path for r in catalog.under_path(items, spark.createDataFrame([("/a",), ("/a",), ("/c",)], "path string")).collect()] == ["/a"]


# catalogs on disk


def written(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_upsert_writes_its_folders_only(spark, tmp_path):
    make = lambda rows: catalog.records(spark.createDataFrame(rows, "uri string, hash_value string, calculated_time double"))
    old = [(f"file:///{i}.jpg", f"h{i}", float(i)) for i in range(400)]
    table = catalog.CatalogTable(spark, f"{tmp_path}/t", 16)
    table.create(make([*old, ("file:///3.jpg", "later", 99.0)]))
    new = [("file:///7.jpg", "new", 0.0), ("file:///7.jpg", "newest", 1.0), ("file:///x.jpg", "x", 0.0), ("file:///8.jpg", "new", 0.0)]
    want = sorted(map(tuple, catalog.upsert(table.read(), make(new)).collect()), key=str)
    before = written(f"{tmp_path}/t")
    touched = table.upsert(make(new))
    after = written(f"{tmp_path}/t")
    assert sorted(map(tuple, table.read().collect()), key=str) == want and len(want) == 401
    assert 0 < len(touched) <= 3
    folder = lambda p: int(p.split("bucket=")[1].split("/")[0])
    assert {folder(p) for p in set(before) ^ set(after)} == set(touched)
    assert all(before[p] == after[p] for p in before if folder(p) not in touched)
    assert table.upsert(make(new).limit(0)) == [] and written(f"{tmp_path}/t") == after
    assert {r.uri: r.hash_value for r in table.read().collect()}["file:///7.jpg"] == "newest"


# flushes


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def put(path, name, n):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/.{name}", "w") as f:
        f.writelines(f'{{"uri": "{name}-{i}", "hash_value": "{i}"}}\n' for i in range(n))
    os.rename(f"{path}/.{name}", f"{path}/{name}")


def ran(spark, tmp_path, every, seconds, done):
    """Runs the stream until `done(query)`; one with processing-time timers never ends by itself."""
    stream = spark.readStream.schema("uri string, hash_value string").json(f"{tmp_path}/in")
    out = flush.flushed(stream, every, seconds, shards=1)
    q = out.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="500 milliseconds").start()
    until = time.time() + 60
    try:
        while not done(q) and time.time() < until and q.isActive:
            time.sleep(0.3)
    finally:
        q.stop()


def flushes(spark, tmp_path):
    if not os.path.isdir(f"{tmp_path}/out"):
        return []
    rows = spark.read.schema("shard int, flush long, why string, uri string, hash_value string").parquet(f"{tmp_path}/out")
    return sorted((r.flush, r.why, r.n) for r in rows.groupBy("flush", "why").agg(F.count_distinct("uri").alias("n")).collect())


def test_flush_by_count_across_a_restart(rocks, tmp_path):
    read = lambda n: lambda q: sum(p.numInputRows for p in q.recentProgress) >= n
    put(f"{tmp_path}/in", "a", 6)
    ran(rocks, tmp_path, 10, 3000, read(6))
    assert flushes(rocks, tmp_path) == []
    put(f"{tmp_path}/in", "b", 5)
    ran(rocks, tmp_path, 10, 3000, lambda q: flushes(rocks, tmp_path))
    assert flushes(rocks, tmp_path) == [(1, "count", 11)]


def test_flush_by_time(rocks, tmp_path):
    put(f"{tmp_path}/in", "a", 3)
    ran(rocks, tmp_path, 10, 2, lambda q: flushes(rocks, tmp_path))
    assert flushes(rocks, tmp_path) == [(1, "time", 3)]
