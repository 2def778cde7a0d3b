"""Registered queries over column functions and small operators that no query of `queries` reaches, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.functions import hashing, ocr, rules, titles, uris
from siftmill.operators import catalog, grouping, joins, similarity
from siftmill.plans import cascade, workflows
from siftmill.queries import ORACLES, QUERIES, _fingerprints, _reference, query, read

__all__ = ["ORACLES", "QUERIES"]


@query("""SELECT p_partkey, p_name || CASE WHEN p_partkey % 20 = 0 THEN '{' || p_size || '@WD}' ELSE '{' || p_size || '@WD,' || p_partkey % 20 || '@PX}' END AS tagged,
 p_size::INT AS width, (p_partkey % 20)::INT AS pages, 0.0::DOUBLE AS clarity, p_name AS bare, (p_size * 100)::INT AS width_of_name, CASE WHEN p_partkey % 20 = 0 THEN 0 ELSE p_partkey % 20 END::INT AS pages_of_name FROM part""")
def name_metrics(spark, sf_dir):
    """Metric tags written into names, read back and taken off."""
    p = read(spark, sf_dir, "part").withColumn("tagged", F.concat("p_name", titles.metric_tag(F.col("p_size"), F.col("p_partkey") % 20, F.lit(0))))
    m = titles.metrics_of(F.col("tagged"))
    wide = F.concat("p_name", F.lit("["), (F.col("p_size") * 100).cast("string"), F.lit("px]"))
    paged = F.concat("p_name", F.lit("{"), (F.col("p_partkey") % 20).cast("string"), F.lit("@PX}"))
    return p.select(
        "p_partkey", "tagged", m["width"].alias("width"), m["pages"].alias("pages"), m["clarity"].alias("clarity"), titles.without_metric_tag(F.col("tagged")).alias("bare"),
        titles.width_in_name(wide).alias("width_of_name"), titles.pages_in_name(paged).alias("pages_of_name"),
    )


@query("""WITH p AS (SELECT page_id, '/d/f ' || page_id % 7 || '/a' || page_id || '.zip' AS a, 'in/p+' || page_id || '.jpg' AS i FROM pages)
SELECT page_id, 'archive:///' || a || '!' || i AS uri, a || '!' || i AS path, a AS archive, i AS inner_path, 'file:///' || a AS file_uri, a AS file_path, '/d/f ' || page_id % 7 AS folder,
 'a' || page_id || '.zip' AS name, 'f ' || page_id % 7 || '/a' || page_id || '.zip' AS below, '/d/f ' || page_id % 7 AS virtual, a AS unquoted FROM p""")
def path_round_trip(spark, sf_dir):
    """Paths made URIs and back, cut at archives, and taken apart."""
    archive = F.concat(F.lit("/d/f "), (F.col("page_id") % 7).cast("string"), F.lit("/a"), F.col("page_id").cast("string"), F.lit(".zip"))
    p = read(spark, sf_dir, "pages").select("page_id", archive.alias("a")).withColumn("full", F.concat("a", F.lit("!in/p+"), F.col("page_id").cast("string"), F.lit(".jpg")))
    p = p.withColumn("uri", uris.canonical(F.col("full"))).withColumn("m", uris.split_member(F.col("full"))).withColumn("file_uri", uris.canonical(F.col("a")))
    return p.select(
        "page_id", "uri", uris.original_path(F.col("uri")).alias("path"), F.col("m.archive").alias("archive"), F.col("m.inner").alias("inner_path"), "file_uri",
        uris.original_path(F.col("file_uri")).alias("file_path"), uris.dir_name(F.col("a")).alias("folder"), uris.base_name(F.col("a")).alias("name"),
        uris.relative_to(F.col("a"), F.lit("/d")).alias("below"), uris.resolve_virtual(F.concat(uris.dir_name(F.col("a")), F.lit(".folderzip"))).alias("virtual"),
        uris.strip_quotes(F.concat(F.lit(" \""), F.col("a"), F.lit("\" "))).alias("unquoted"),
    )


@query("""SELECT doc_id, substr(md5(concat_ws('_', source, n_chars, doc_id)), 1, 16) AS key, substr(md5(concat_ws('_', source, n_chars, doc_id, 10)), 1, 16) AS sized_key,
 (doc_id % 16)::VARCHAR AS hash_size, 1 - (doc_id % 65) / 64.0::DOUBLE AS similarity, 1 - least(doc_id % 5 / 3.0::DOUBLE, 1.0::DOUBLE) AS inverse FROM documents""")
def cache_keys(spark, sf_dir):
    """Keys of caches, hash parameters and rescaled distances."""
    d = read(spark, sf_dir, "documents")
    params = hashing.hash_params(F.concat(F.lit("hash_size="), (F.col("doc_id") % 16).cast("string"), F.lit(";hash_version=1")))
    return d.select(
        "doc_id", hashing.cache_key(F.col("source"), F.col("n_chars"), F.col("doc_id")).alias("key"), hashing.cache_key(F.col("source"), F.col("n_chars"), F.col("doc_id"), F.lit(10)).alias("sized_key"),
        params["hash_size"].alias("hash_size"), hashing.similarity(F.col("doc_id") % 65, 64).alias("similarity"), hashing.inverse_similarity((F.col("doc_id") % 5) / 3.0).alias("inverse"),
    )


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text || chr(10) || '[INFO] x' || chr(10) || ' ERRORS y', chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '^(\[|【)?(INFO|WARN|ERROR|DEBUG)\b')) AS l FROM documents)
SELECT doc_id, len(l)::INT AS n_lines, sha256(array_to_string(l, chr(10))) AS lines FROM l""")
def clean_text_lines(spark, sf_dir):
    """Lines of recognised text without blank ones and a recogniser's log."""
    d = read(spark, sf_dir, "documents").select("doc_id", ocr.clean_lines(F.concat("text", F.lit("\n[INFO] x\n ERRORS y"))).alias("l"))
    return d.select("doc_id", F.size("l").alias("n_lines"), F.sha2(F.array_join("l", "\n"), 256).alias("lines"))


@query("""WITH d AS (SELECT doc_id, (2 * doc_id * CASE WHEN doc_id % 3 = 0 THEN 1234567 WHEN doc_id % 3 = 1 THEN 777 ELSE 1 END + 1)::BIGINT AS d FROM documents)
SELECT doc_id, CASE WHEN d > 1048576 THEN printf('%.2f MB smaller', d / 1048576.0::DOUBLE) WHEN d > 1024 THEN printf('%.2f KB smaller', d / 1024.0::DOUBLE) ELSE d || ' bytes smaller' END AS reason FROM d""")
def size_reasons(spark, sf_dir):
    """How much smaller one file is than another, in words."""
    by = F.when(F.col("doc_id") % 3 == 0, 1234567).when(F.col("doc_id") % 3 == 1, 777).otherwise(1)
    return read(spark, sf_dir, "documents").select("doc_id", titles.size_difference(2 * F.col("doc_id") * by + 11, F.lit(10)).alias("reason"))


@query("""SELECT page_id, page_id % 3 = 0 AS excluded, page_id % 4 NOT IN (1, 2) AS wanted, page_id % 5 = 0 AS by_word, page_id % 5 < 2 AS by_part FROM pages""")
def member_exclusions(spark, sf_dir):
    """Archives with members of formats that are left alone, and folders that are."""
    n = F.col("page_id")
    members = F.array(F.lit("a.jpg"), F.when(n % 3 == 0, "b/C.WebM").otherwise("c.webm.txt"))
    folder = F.when(n % 4 == 1, "/a/trash/x").when(n % 4 == 2, "/a/multi-b").otherwise("/a/b")
    path = F.when(n % 5 == 0, "/x/My_Art-book.v1/z").when(n % 5 == 1, "/x/booklet/z").otherwise("/x/y")
    return read(spark, sf_dir, "pages").select(
        "page_id", rules.has_excluded_format(members).alias("excluded"), rules.is_wanted_dir(folder).alias("wanted"), rules.excluded_path(path, ["Book"], whole=True).alias("by_word"),
        rules.excluded_path(path, ["Book"]).alias("by_part"),
    )


@query("""SELECT count(DISTINCT l) FILTER (l <> -1) AS n_clusters, count(*) FILTER (l = -1) AS n_noise, count(*) AS n_items FROM (SELECT doc_id % 50 - 1 AS l FROM documents)""")
def cluster_counts(spark, sf_dir):
    return similarity.label_counts(read(spark, sf_dir, "documents").select((F.col("doc_id") % 50 - 1).alias("label")))


@query("""SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name || 'x', '[^A-Za-z0-9_ \\t-]', '', 'g'), ' +', '', 'g')) AS strict_key, lower(replace(p_name, ' ', '')) || '!x' AS key FROM part""")
def title_options(spark, sf_dir):
    """Titles with and without punctuation."""
    name = F.concat(F.lit("[a] "), F.col("p_name"), F.lit("! (b) x {c}.zip"))
    return read(spark, sf_dir, "part").select("p_partkey", titles.title_key(name, True).alias("strict_key"), titles.title_key(name).alias("key"))


@query("SELECT doc_id, lang FROM documents ORDER BY md5('7/' || doc_id), doc_id LIMIT 100")
def random_sample(spark, sf_dir):
    """A hundred documents, the same in every run."""
    return catalog.random_rows(read(spark, sf_dir, "documents"), 100, 7, "doc_id").select("doc_id", "lang")


@query("""SELECT o_orderkey, o_custkey AS a, (o_custkey * 7 % 100)::BIGINT AS b FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') AND o_custkey * 7 % 100 IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def valid_pairs(spark, sf_dir):
    """Cached pairs both ends of which are still there."""
    pairs = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("a"), (F.col("o_custkey") * 7 % 100).cast("long").alias("b"))
    return catalog.without_invalid(pairs, read(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("uri")), ("a", "b"))


@query("""WITH h AS (SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY sha256(text)) AS head FROM documents),
p AS (SELECT h.doc_id, CASE WHEN g.lang = h.lang THEN h.head ELSE h.doc_id END AS g FROM h JOIN documents g ON g.doc_id = h.head) SELECT doc_id AS item_id, g AS group_id FROM p""")
def two_stage(spark, sf_dir):
    """Copies of a text are one group only within a language: coarse groups first, then fine pairs in each."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", hashing.content_hash(F.col("text").cast("binary")).alias("h"))
    heads = d.where("h IS NOT NULL").groupBy("h").agg(F.min("id").alias("a"))
    pairs = d.join(heads, "h").where("id <> a").select("a", F.col("id").alias("b"))
    return grouping.two_stage_groups(d, d.select(F.col("id").alias("item_id"), F.col("lang").alias("group_id")), pairs)


@query("""SELECT user_id AS "group", count(DISTINCT event_type) = 1 AS mergeable FROM events GROUP BY 1""")
def mergeable_groups(spark, sf_dir):
    """Users whose events are all of one type, as archives can only be merged within one folder."""
    return joins.one_folder(read(spark, sf_dir, "events"), "event_type", "user_id")


@query("""SELECT page_id, arg_max(uri, (t, uri)) OVER w AS matched_uri FROM (SELECT page_id, url AS uri, page_id AS t, regexp_extract(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS f FROM pages) WINDOW w AS (PARTITION BY f)""")
def filename_reuse(spark, sf_dir):
    """The newest catalog row with the file name of each page."""
    rows = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("uri"))
    known = catalog.records(rows.select("uri", F.lit("ab").alias("hash_value"), F.col("page_id").cast("double").alias("calculated_time")))
    return catalog.filename_lookup(rows, known).select("page_id", "matched_uri")


@query("""SELECT user_id AS "group", event_id AS item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) r FROM events) WHERE r > 1""")
def filter_lists(spark, sf_dir):
    """Group filters by configuration: the newest stays, then the largest of what is left, which is that one."""
    x = read(spark, sf_dir, "events").select(F.col("user_id").alias("group_id"), F.col("event_id").alias("item_id"), F.col("ts").alias("mtime"), F.col("value").alias("size"))
    gone = cascade.group_filter([{"type": "time"}, {"type": "size", "params": {"size": "size"}}])(x)
    return x.join(gone.select("item_id"), "item_id").select(F.col("group_id").alias("group"), "item_id")


@query("""WITH n AS (SELECT DISTINCT p_name || ' ' || p_type AS id FROM part), h AS (SELECT id, ('0x' || substr(md5(id), 1, 13))::BIGINT AS v FROM n),
r AS (SELECT c_mktsegment || s AS uri, ('0x' || substr(md5(c_mktsegment || s), 1, 13))::BIGINT AS v FROM (SELECT DISTINCT c_mktsegment, l_linestatus || l_returnflag s FROM customer, (SELECT DISTINCT l_linestatus, l_returnflag FROM lineitem))),
m AS (SELECT id, uri, bit_count(xor(h.v, r.v))::INT AS d FROM h, r)
SELECT id, min(uri) AS ref_uri, d AS distance, CASE WHEN length(id) % 2 = 0 THEN '/lib/[' || length(id) || '] x' END AS folder FROM m WHERE d <= 18 AND d = (SELECT min(d) FROM m x WHERE x.id = m.id) GROUP BY id, d""")
def reference_folders(spark, sf_dir):
    """Items that a reference matches, each with the marked folder above it."""
    n = F.length("id")
    folder = F.when(n % 2 == 0, F.concat(F.lit("/lib/["), n.cast("string"), F.lit("] x"))).otherwise("/lib/plain")
    x = _fingerprints(spark, sf_dir).withColumn("uri", F.col("id")).withColumn("folder", folder).withColumn("path", F.concat("folder", F.lit("/in/"), "id"))
    return workflows.against_reference(x.drop("folder"), _reference(spark, sf_dir), x.select("folder").distinct(), 18, 52).select("id", "ref_uri", "distance", "folder")


@query("SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey ORDER BY 1, 2 LIMIT 50")
def first_pairs(spark, sf_dir):
    return similarity.first_pairs(read(spark, sf_dir, "customer"), 50, "c_custkey")


@query("""SELECT doc_id, contains(text, 'th') AS marked, contains(text, 'th') <> (doc_id % 2 = 0) AS differ FROM documents WHERE text IS NOT NULL""")
def watermark_pairs(spark, sf_dir):
    """Whether a document's lines hold a mark, and whether this differs from a partner's."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("lines", F.split("text", "\n"))
    partner = F.array(F.when(F.col("doc_id") % 2 == 0, "with th").otherwise("without"))
    own, other = rules.has_watermark(F.col("lines"), ["th"]), rules.has_watermark(partner, ["with th"])
    return d.select("doc_id", own.alias("marked"), (own != other).alias("differ"))
