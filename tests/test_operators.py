"""Operators on small tables, against plain Python."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from siftmill.functions import hashing
from siftmill.operators import catalog, components, grouping, joins, metrics, prune, ranking, similarity
from siftmill.plans import cascade
from siftmill.sources import archives, files, hash_json


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def find(pairs, nodes):
    root = {n: n for n in nodes}

    def f(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((f(a), f(b)))
        root[b] = a
    return {n: f(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(rows(components.connected_components(spark.createDataFrame(edges, "a long, b long"))))
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = find([e for e in edges if e[0] != e[1]], nodes)
    assert got == want


def test_components_of_nothing(spark):
    assert rows(components.connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"))) == []


def test_hamming_join_is_exact(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(52) for _ in range(8)]
    values = [b ^ sum(1 << rnd.randrange(52) for _ in range(rnd.randrange(6))) for b in base for _ in range(6)] + base + base
    df = spark.createDataFrame([(i, [v & (1 << 52) - 1]) for i, v in enumerate(values)], "id long, chunks array<long>")
    for t in (0, 2, 5, 9):
        want = sorted((i, j, (values[i] ^ values[j] & (1 << 52) - 1).bit_count()) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= t)
        assert rows(similarity.hamming_pairs(df, t, 52)) == want


def test_wide_hashes(spark):
    rnd = random.Random(6)
    hs = [f"{rnd.getrandbits(100):025x}" for _ in range(20)]
    hs += [f"{int(h, 16) ^ (1 << rnd.randrange(100)):025x}" for h in hs]
    df = spark.createDataFrame(list(enumerate(hs)), "id long, h string").withColumn("chunks", hashing.hex_chunks(F.col("h"), 25))
    want = sorted((i, j, d) for i in range(40) for j in range(i + 1, 40) if (d := (int(hs[i], 16) ^ int(hs[j], 16)).bit_count()) <= 4)
    assert rows(similarity.hamming_pairs(df, 4, 100)) == want


def test_groups(spark):
    items = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    pairs = spark.createDataFrame([(1, 2), (3, 4), (2, 3), (5, 6)], "a long, b long")
    assert rows(grouping.similarity_groups(items, pairs)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 7)]
    assert rows(grouping.star_groups(items, pairs)) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7)]
    assert rows(grouping.labelled(grouping.density_clusters(items, pairs, min_samples=3))) == [(1, 2), (2, 2), (3, 2), (4, 2), (5, -1), (6, -1), (7, -1)]
    assert len(rows(grouping.groups_only(grouping.similarity_groups(items, pairs)))) == 6


def test_progressive(spark):
    x = spark.createDataFrame([("g", "a", 100, 5), ("g", "b", 100, 5), ("g", "c", 100, 4), ("g", "d", 90, 9)], "g string, item_id string, px long, size long")
    got = ranking.progressive(x, "g", [("size-tier", F.col("px"), True), ("bytes-tier", F.col("size"), True), ("name-tier", F.lower("item_id"), False)])
    assert {r.item_id: r.reason for r in got.collect()} == {"b": "name-tier", "c": "bytes-tier", "d": "size-tier"}


def test_watermarks(spark):
    x = spark.createDataFrame([("a", "1", True), ("a", "2", True), ("b", "3", False), ("b", "4", False), ("b", "5", True)], "g string, item_id string, m boolean")
    assert [r.item_id for r in ranking.watermarked(x, "g", "m").collect()] == ["5"]


def test_islands_and_indices(spark):
    x = spark.createDataFrame([("a.zip",), ("b.zip",), ("c.txt",), ("d.zip",)], "item_id string")
    got = {r.item_id: r.island for r in ranking.islands(x, F.col("item_id"), F.col("item_id").endswith(".zip")).collect()}
    assert got["a.zip"] == got["b.zip"] != got["d.zip"] and got["c.txt"] is None
    y = spark.range(10).select(F.lit(1).alias("g"), F.col("id").alias("item_id"))
    assert sorted(r["index"] for r in ranking.select_indices(y, "g", F.col("item_id"), 3, 5).collect()) == [0, 1, 2, 5, 6, 7, 8, 9]
    assert sorted(r["index"] for r in ranking.select_indices(y, "g", F.col("item_id"), start=2, stop=4).collect()) == [2, 3]
    assert ranking.sample_by_size(y.limit(2), "g", "item_id").count() == 2


@pytest.mark.parametrize(("n", "cap"), [(100, 80), (20, 4), (10, 2)])
def test_bounded_removal(spark, n, cap):
    x = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("item_id"), F.lit(0.95).alias("s"))
    assert ranking.bounded_removal(x, "g", "s").count() == cap


def test_prune(spark):
    x = spark.createDataFrame([("g", 1, "a DL.zip", True, 1), ("g", 2, "b.zip", True, 1)], "g string, item_id long, name string, zh boolean, size long")
    got = prune.prune(x, "g", "name", "zh", "size", [prune.PruneRule("keyword", ("dl",), "chinese", True)])
    assert {r.item_id: r.pruned_by for r in got.collect()} == {1: None, 2: 0}
    y = spark.createDataFrame([("g", 1, "Book.zip", False, 1), ("g", 2, "Book v2.zip", False, 1), ("g", 3, "Book v3.zip", False, 1)], x.schema)
    assert {r.item_id: r.pruned_by for r in prune.prune(y, "g", "name", "zh", "size", [prune.PruneRule("version")]).collect()} == {1: 0, 2: 0, 3: None}
    z = spark.createDataFrame([("g", 1, "a 广告.zip", True, 1)], x.schema)
    assert prune.prune(z, "g", "name", "zh", "size").first().pruned_by is None


def test_catalog(spark):
    new = catalog.records(spark.createDataFrame([("/local/path/image.jpg", "h1", 1.0), ("/local/path/image.jpg", "h2", 2.0), ("/x/y.png", "", 1.0)], "uri string, hash_value string, calculated_time double"))
    assert new.count() == 2
    cat = catalog.latest(new)
    assert cat.first().hash_value == "h2"
    q = spark.createDataFrame([("/local/path/image.png",), ("/local/path/image.jpg",), ("/none",)], "uri string")
    assert rows(catalog.smart_lookup(q, cat).select("uri", "hash_value", "match")) == sorted([("/local/path/image.png", "h2", "base"), ("/local/path/image.jpg", "h2", "exact"), ("/none", None, "none")])
    old = catalog.records(spark.createDataFrame([("/local/path/image.jpg", "h0", 9.0)], "uri string, hash_value string, calculated_time double"))
    assert catalog.upsert(old, new).first().hash_value == "h2"
    tiers = [("table", cat.select("uri", "hash_value")), ("memory", spark.createDataFrame([("/none", "m")], "uri string, hash_value string"))]
    assert {r.uri: r.tier for r in catalog.tiered_lookup(q, tiers).collect()} == {"/local/path/image.jpg": "table", "/none": "memory", "/local/path/image.png": None}


def test_metrics(spark):
    x = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v long")
    assert x.agg(metrics.upper_median("v").alias("m")).first().m == 3
    ads = spark.createDataFrame([("a", True)] * 3 + [("a", False)] + [("b", True)] * 2 + [("b", False)] * 2, "g string, ad boolean")
    assert [r.g for r in metrics.guarded_removals(ads, "g", F.col("ad")).collect()] == ["b", "b"]


def test_cascade(spark):
    items = spark.createDataFrame([(i, i % 3, i * 10) for i in range(9)], "item_id long, group_id long, size long")
    stages = [cascade.predicate("small", F.col("size") < 20), cascade.group_filter("size")]
    made, left = cascade.cascade(items, stages)
    gone, stay = {r.item_id for r in made.collect()}, {r.item_id for r in left.collect()}
    assert gone | stay == set(range(9)) and not gone & stay and stay == {6, 7, 8}
    assert cascade.group_filter(None)(items).count() == 0
    with pytest.raises(ValueError, match="no group filter"):
        cascade.group_filter("nonsense")


def test_near_duplicate_stage(spark):
    items = spark.createDataFrame([(1, [0b111], 5), (2, [0b110], 9), (3, [1 << 40], 1)], "item_id long, chunks array<long>, size long")
    stage = cascade.near_duplicates("chunks", 52, 2, lambda x: ranking.largest(x, "group_id", "size"))
    assert [r.item_id for r in stage(items).collect()] == [1]


def test_joins(spark):
    items = spark.createDataFrame([("/r/[artist]/sub/a.zip",), ("/r/plain/b.zip",)], "path string")
    folders = spark.createDataFrame([("/r/[artist]",), ("/r",), ("/r/plain",)], "folder string")
    assert {r.path: r.folder for r in joins.nearest_folder(items, folders).collect()} == {"/r/[artist]/sub/a.zip": "/r/[artist]", "/r/plain/b.zip": None}


def test_hash_files(spark, tmp_path):
    (tmp_path / "a_hash.json").write_text('{"_hash_params": "hash_size=10;hash_version=1", "hashes": {"u1": {"hash": "AAAABBBB", "size": 10}, "u2": "ccccdddd"}}')
    (tmp_path / "b_hash.json").write_text('{"_hash_params": "x", "dry_run": "false", "u1": {"hash": "eeeeffff"}, "p[hash-12345678].jpg": {}}')
    (tmp_path / "c.json").write_text("not json")
    got = {(r.uri, r.hash) for r in hash_json.read_hash_files(spark, str(tmp_path), hash_json.NAME_PATTERN).collect()}
    assert got == {("u1", "AAAABBBB"), ("u2", "ccccdddd"), ("u1", "eeeeffff"), ("p[hash-12345678].jpg", "12345678")}
    merged = {r.uri: r.hash for r in hash_json.merge_files(hash_json.read_hash_files(spark, str(tmp_path))).collect()}
    assert merged["u1"] == "eeeeffff"
    assert {r.file.rsplit("/", 1)[-1]: r.valid for r in hash_json.validate(spark, str(tmp_path)).collect()} == {"a_hash.json": True, "b_hash.json": True, "c.json": False}
    rows_, log = hash_json.migrate(spark, str(tmp_path), 5.0)
    assert rows_.count() == 3 and log.count() == 2
    out = hash_json.hash_json(rows_).first().value
    assert '"u2"' in out and "_hash_params" in out


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/1.png", b"xx")
        z.writestr("d/2.gif", b"yyy")
    (tmp_path / "b.cbz").write_bytes(b"no archive")
    got = archives.scan_archives(spark, str(tmp_path), with_content=True, test=True)
    assert {(r.inner, r.file_size, r.ok) for r in got.collect()} == {("d/1.png", 2, True), ("d/2.gif", 3, True), (None, None, False)}
    assert {r.n_images for r in archives.image_counts(got).collect()} == {2, 0}
    assert {r.excluded for r in archives.excluded_archives(got).collect()} == {True, False}


def test_files():
    assert files.load_rules('{"width_ranges": [[0, 900, "a"]]}')[0].max_width == 900
    tree = {"path": "/r", "compress_mode": "skip", "children": [{"path": "/r/漫画A", "compress_mode": "entire", "file_types": {"image": 3}}]}
    assert files.virtual_folders(tree) == ["/r/漫画A.folderzip"]


def test_best_pairs(spark, monkeypatch):
    """The best of all pairs, however rows are cut into parts; copies tie and go by id."""
    import numpy as np

    monkeypatch.setattr(similarity, "VECTOR_BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).round(1).tolist(), i % 3) for i in range(90)]
    rows += [(100 + i, rows[4][1], 1) for i in range(8)] + [(200, None, 0), (201, [0.0] * 5, 0), (202, [1.0], 0), (203, [2.0], 0), (204, [1.0] * 5, None), (205, [float("nan")] * 5, 0)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
    ok = [(i, np.array(v), k) for i, v, k in rows if k is not None and v and np.isfinite(v).all() and np.any(v)]
    want = [(a, b, float(u @ v / np.linalg.norm(u) / np.linalg.norm(v))) for a, u, p in ok for b, v, q in ok if a < b and p == q and len(u) == len(v)]
    want = sorted(((a, b, round(s, 6)) for a, b, s in want), key=lambda r: (-r[2], r[0], r[1]))
    for n in (5, 40, 100):
        assert [(r.a, r.b, round(r.score, 6)) for r in similarity.best_pairs(df, n, block_col="label").collect()] == want[:n]
