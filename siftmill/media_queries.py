"""Registered queries from archives' bytes to pixels and decisions, and over catalogs on disk; with those of `function_queries`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.function_queries import ORACLES, QUERIES, query, read
from siftmill.functions import hashing, images
from siftmill.operators import catalog, fine, fingerprint, grouping, ranking, similarity, structure
from siftmill.operators import language_profiles as profiles
from siftmill.plans import cascade, workflows
from siftmill.plans.scratch import Scratch
from siftmill.sources import archives, hash_json

__all__ = ["ORACLES", "QUERIES"]


def drawn(batches: Iterator[pa.RecordBatch], one) -> Iterator[pa.RecordBatch]:
    """(archive, inner, content, doc_id) that `one` makes of each id and text's bytes, in batches that end where contents reach images.BATCH_BYTES."""
    put = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary(), pa.int64()), strict=True)], ["archive", "inner", "content", "doc_id"])
    for b in batches:
        rows, size = [], 0
        for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary()), strict=True):
            rows.append(one(i, text.as_py()))
            size += len(rows[-1][2])
            if size >= images.BATCH_BYTES:
                yield put(rows)
                rows, size = [], 0
        if rows:
            yield put(rows)


def _pictures(spark, sf_dir) -> DataFrame:
    """(archive, inner, content, doc_id): the bytes of each whole text as pixels: 48 gray ones a line in a PNG, or 16 of three bytes in a BMP for odd
    ids. Forty to an archive. Some are damaged: ids that leave 4 modulo 14 have a wrong last checksum, those that leave 11 modulo 50 are no images."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def one(i: int, raw: bytes) -> tuple:
        h = max(1, -(-len(raw) // 48))
        x = np.frombuffer(raw.ljust(h * 48, b"\0"), np.uint8)
        data = images.bmp_bytes(x.reshape(h, 16, 3)) if i % 2 else images.png_bytes(x.reshape(h, 48, 1))
        if i % 14 == 4:
            data = data[:-1] + bytes([data[-1] ^ 1])
        if i % 50 == 11:
            data = b"no image"
        return f"a{i // 40}.zip", f"{i}.{'bmp' if i % 2 else 'png'}", data, i

    return docs.mapInArrow(lambda batches: drawn(batches, one), "archive string, inner string, content binary, doc_id long")


def _archives(spark, sf_dir) -> DataFrame:
    """(path, content): the pictures in ZIP files, each with a member that is no image."""
    p = _pictures(spark, sf_dir).drop("doc_id")
    notes = p.select("archive").distinct().select("archive", F.lit("notes.txt").alias("inner"), F.lit(b"about").alias("content"))
    return Scratch(spark, "archives").save(archives.pack(p.unionByName(notes)))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, greatest(1, (strlen(coalesce(text, '')) + 47) // 48) AS h FROM documents),
p AS (SELECT *, doc_id % 50 = 11 AS bad, sha256(encode(t) || unhex(repeat('00', 48 * h - strlen(t)))) AS s FROM d)
SELECT 'a' || doc_id // 40 || '.zip' AS archive, doc_id || CASE WHEN doc_id % 2 = 1 THEN '.bmp' ELSE '.png' END AS inner_path, CASE WHEN NOT bad THEN h END::INT AS height,
 CASE WHEN bad THEN NULL WHEN doc_id % 2 = 1 THEN 16 ELSE 48 END::INT AS width, CASE WHEN bad THEN NULL WHEN doc_id % 2 = 1 THEN 3 ELSE 1 END::INT AS channels, CASE WHEN NOT bad THEN s END AS pixels_sha256,
 CASE WHEN bad THEN NULL WHEN doc_id % 14 = 4 THEN 'unchecked' ELSE 'verified' END AS reader, bad AS failed FROM p""")
def archive_pixels(spark, sf_dir):
    """From archives' bytes to their images' pixels, by the ladder of readers; unreadable ones are rows too."""
    x = archives.members(_archives(spark, sf_dir), with_content=True, pattern=r"\.(?:png|bmp)$").select("archive", F.col("inner").alias("inner_path"), "content")
    x = images.decoded(x)
    return x.select("archive", "inner_path", "height", "width", "channels", F.sha2("data", 256).alias("pixels_sha256"), "reader", F.col("error").isNotNull().alias("failed"))


@query("""WITH i AS (SELECT 'a' || doc_id // 40 || '.zip' AS g, doc_id || '.bmp' AS i, 16 + doc_id % 5 * 4 AS w, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT g, i, w, (54 + (24 * w + 31) // 32 * 4 * greatest(1, (n + 3 * w - 1) // (3 * w)))::BIGINT AS size FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY size DESC, i) AS r, count(*) OVER (PARTITION BY g) AS n FROM s),
c AS (SELECT *, CASE WHEN r = 1 OR n > 2 AND r = n // 2 + 1 THEN 0 WHEN r <= greatest(3, n // 3) THEN 1 END AS p FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, CASE WHEN p = 0 THEN r END, md5(i), i) AS pick FROM c WHERE p IS NOT NULL),
m AS (SELECT g, list_sort(list(w)) AS ws FROM k WHERE pick <= 3 GROUP BY 1)
SELECT m.g AS archive, ws[len(ws) // 2 + 1]::INT AS width, n AS page_count FROM m JOIN (SELECT g, count(*) AS n FROM s GROUP BY 1) z ON z.g = m.g""")
def archive_metrics(spark, sf_dir):
    """Representative width and pages of archives of pictures of five widths, from their bytes; only the sampled members are decoded."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def one(i: int, raw: bytes) -> tuple:
        w = 16 + i % 5 * 4
        h = max(1, -(-len(raw) // (3 * w)))
        return f"a{i // 40}.zip", f"{i}.bmp", images.bmp_bytes(np.frombuffer(raw.ljust(h * w * 3, b"\0"), np.uint8).reshape(h, w, 3)), i

    p = docs.mapInArrow(lambda batches: drawn(batches, one), "archive string, inner string, content binary, doc_id long").drop("doc_id")
    notes = p.select("archive").distinct().select("archive", F.lit("notes.txt").alias("inner"), F.lit(b"about").alias("content"))
    files = Scratch(spark, "archives").save(archives.pack(p.unionByName(notes)))
    return workflows.archive_metrics(files).select("archive", "width", "page_count")


@query()
def archive_decisions(spark, sf_dir):
    """What a cascade takes out of archives, from their bytes: pictures that cannot be read, low ones, pages that look like text, and all but the
    largest of those with one fingerprint."""
    x = Scratch(spark, "decisions").save(workflows.archive_images(_archives(spark, sf_dir)))
    x = x.withColumn("item_id", F.col("uri")).withColumn("line", F.col("text_total"))
    largest = lambda y: ranking.largest(y, "group_id", "file_size", stage="size")
    stages = [
        cascade.predicate("unreadable", F.col("error").isNotNull()), cascade.predicate("small_image", F.col("height") < 10, F.format_string("%d lines", "height")),
        cascade.text_items("line", "text_total", 0.5), cascade.equal_duplicates(F.col("phash"), largest),
    ]
    return cascade.cascade(x, stages)[0]


def _vector_pictures(spark, sf_dir) -> DataFrame:
    """(item_id, chunks, thumb): each embedding as a picture, the products of its components beside each other, with its perceptual hash."""
    # a small table that much is made of: its few files would be as many tasks
    e = read(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding").repartition("vec_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from siftmill.functions import pixels

        for b in batches:
            ids, hashes, thumbs = [], [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist(), strict=True):
                v = np.nan_to_num(np.array([0.0 if q is None else q for q in v], float), posinf=0, neginf=0)[:64]
                if len(v) < 11 or not np.abs(v).max():
                    continue
                v = v / np.abs(v).max()
                x = np.rint(127.5 + 127.5 * np.outer(v, v)).astype(np.uint8)[:, :, None]
                ids.append(i)
                hashes.append(pixels.phash_of(x, 8))
                thumbs.append(images.thumbnail_of(x, 64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column("vec_id").type), pa.array(hashes, pa.string()), pa.array(thumbs, pa.binary())], ["item_id", "phash", "thumb"])

    x = e.mapInArrow(run, f"item_id {e.schema['vec_id'].dataType.simpleString()}, phash string, thumb binary")
    return Scratch(spark, "vector-pictures").save(x.withColumn("chunks", hashing.hex_chunks(F.col("phash"), 16)))


@query()
def fine_clusters(spark, sf_dir):
    """Embeddings as pictures: greedy groups of close perceptual hashes, in them clusters by structural similarity, and each cluster's medoid."""
    x = _vector_pictures(spark, sf_dir)
    save = Scratch(spark, "coarse").save
    stars = lambda c: save(grouping.star_groups(c, save(similarity.hamming_pairs(c, 5, 64))))
    coarse = grouping.by_class(x.select(F.col("item_id").alias("id"), "chunks"), "chunks", stars)
    pairs = fine.fine_pairs(x.join(coarse, "item_id"), 0.8)
    found = Scratch(spark, "clusters").save(fine.fine_clusters(x, pairs))
    best = fine.medoids(found, pairs)
    return found.join(best, "cluster", "left").select("item_id", "cluster", "medoid", F.round("mean_score", 6).alias("mean_score"))


@query()
def document_stars(spark, sf_dir):
    """Greedy stars over the SimHashes of all documents within 3 of 64 bits, found by bands: a hint, as the fingerprint is one."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    fp = Scratch(spark, "simhashes").save(fingerprint.simhash(docs).select("id", F.array("simhash").alias("chunks")))
    save = Scratch(spark, "document-stars").save
    stars = lambda c: save(grouping.star_groups(c, save(similarity.hamming_pairs(c, 3, 64, chunk_bits=64))))
    return grouping.by_class(fp, "chunks", stars)


@query("""SELECT 'file:///p/' || page_id || '.jpg' AS uri, CASE WHEN page_id % 50 = 7 THEN 'bb' ELSE 'aa' END || md5(url) AS hash_value, CASE WHEN page_id % 50 = 7 THEN 1.0 ELSE page_id END::DOUBLE AS calculated_time FROM pages
UNION ALL SELECT 'file:///n/' || page_id || '.jpg', 'cc', 2.0::DOUBLE FROM pages WHERE page_id % 97 = 5""")
def catalog_upsert(spark, sf_dir):
    """A catalog on disk after an upsert of some of its URIs and some new ones; new hashes count whatever their times."""
    pages = read(spark, sf_dir, "pages")
    uri = F.concat(F.lit("file:///p/"), F.col("page_id").cast("string"), F.lit(".jpg"))
    table = catalog.CatalogTable(spark, f"{Scratch(spark, 'catalog-table').base}/table", 16)
    table.create(catalog.records(pages.select(uri.alias("uri"), F.concat(F.lit("aa"), F.md5("url")).alias("hash_value"), F.col("page_id").cast("double").alias("calculated_time"))))
    changed = pages.where("page_id % 50 = 7").select(uri.alias("uri"), F.concat(F.lit("bb"), F.md5("url")).alias("hash_value"), F.lit(1.0).alias("calculated_time"))
    new = pages.where("page_id % 97 = 5").select(F.concat(F.lit("file:///n/"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("uri"), F.lit("cc").alias("hash_value"), F.lit(2.0).alias("calculated_time"))
    table.upsert(catalog.records(changed.unionByName(new)))
    return table.read().select("uri", "hash_value", "calculated_time")


def migrated(spark, sf_dir, base: str) -> tuple[DataFrame, DataFrame]:
    """(catalog, log) tables written by a migration of hash files, which are written first: an entry for each order, a file for each 64th of the customers."""
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("file:///o/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("uri"), F.substr(F.md5(F.col("o_orderkey").cast("string")), F.lit(1), F.lit(16)).alias("hash_value"), F.lit(8).alias("hash_size"), F.pmod("o_custkey", F.lit(64)).alias("folder"))
    hash_json.write_hash_json(o, f"{base}/json", by="folder")
    rows, log = hash_json.migrate(spark, f"{base}/json", 1000.0)
    table = catalog.CatalogTable(spark, f"{base}/catalog", 16)
    table.create(rows)
    log.write.mode("overwrite").parquet(f"{base}/log")
    return table.read(), spark.read.parquet(f"{base}/log")


@query("""SELECT 'file:///o/' || o_orderkey || '.jpg' AS uri, o_orderkey || '.jpg' AS filename, substr(md5(o_orderkey::VARCHAR), 1, 16) AS hash_value, 8::INT AS hash_size, 'url' AS source_type,
 (SELECT count(DISTINCT o_custkey % 64) FROM orders) AS n_files, (SELECT count(*) FROM orders) AS n_entries FROM orders""")
def hash_migration(spark, sf_dir):
    """Hash files migrated to a catalog and a log on disk; the log's totals are beside each row."""
    rows, log = migrated(spark, sf_dir, Scratch(spark, "migration").base)
    total = log.where("status = 'completed'").agg(F.count("*").alias("n_files"), F.sum("migrated_count").alias("n_entries")).first()
    return rows.select("uri", "filename", "hash_value", "hash_size", "source_type", F.lit(total.n_files).cast("long").alias("n_files"), F.lit(total.n_entries).cast("long").alias("n_entries"))


_PROFILES = """WITH d AS (SELECT doc_id, lang, string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS c FROM documents WHERE text <> ''),
p AS (SELECT doc_id, lang, unnest(c) AS a, generate_subscripts(c, 1) AS i FROM d), w AS (SELECT doc_id, lang, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, lang, a AS g FROM w UNION ALL SELECT doc_id, lang, a || b FROM w WHERE b IS NOT NULL UNION ALL SELECT doc_id, lang, a || b || c FROM w WHERE c IS NOT NULL),
o AS (SELECT doc_id, any_value(lang) AS lang, g, count(*) AS n FROM g GROUP BY doc_id, g),
k AS (SELECT * FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) AS r FROM o WHERE lang IS NOT NULL AND doc_id % 2 = 0 GROUP BY lang, g) WHERE r <= 300),
m AS (SELECT * FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) AS r FROM o) WHERE r <= 300),
z AS (SELECT m.doc_id, l.lang, sum(coalesce(abs(k.r - m.r), 300)) / (count(*) * 300.0::DOUBLE) AS far, count(*) AS grams FROM m CROSS JOIN (SELECT DISTINCT lang FROM k) l LEFT JOIN k ON k.lang = l.lang AND k.g = m.g GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY far, lang) AS place, lead(far) OVER (PARTITION BY doc_id ORDER BY far, lang) AS next FROM z),
b AS (SELECT doc_id, lang, far, CASE WHEN next IS NULL THEN 1.0::DOUBLE WHEN next = 0 THEN 0 ELSE (next - far) / next END AS margin, grams FROM f WHERE place = 1)
SELECT e.doc_id, b.lang, round(far, 9) AS distance, round(margin, 9) AS margin, coalesce(grams >= 20 AND margin >= 0.05, false) AS reliable FROM documents e LEFT JOIN b ON b.doc_id = e.doc_id"""


@query(_PROFILES)
def language_profiles(spark, sf_dir):
    """The language of every document by rank profiles of character n-grams, learned from those of even id."""
    docs = read(spark, sf_dir, "documents")
    known = Scratch(spark, "profiles").save(profiles.profiles(docs.where("doc_id % 2 = 0")))
    x = profiles.detect(docs, known)
    return x.withColumn("distance", F.round("distance", 9)).withColumn("margin", F.round("margin", 9))


@query()
def structure_vectors(spark, sf_dir):
    """Pictures of all documents as structure features, standardised and reduced to principal components, rounded."""
    x = structure.features(_pictures(spark, sf_dir)).where("features IS NOT NULL")
    x = Scratch(spark, "structure").save(x.select("doc_id", "features"))
    y = structure.transform(x, structure.fit(x, 8))
    return y.select("doc_id", F.transform("hash_vector", lambda v: F.round(v, 6)).alias("hash_vector"))
