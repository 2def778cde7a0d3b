"""Whole workflows, as compositions of operators. Nothing is moved or deleted: results are plans and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions import hashing, images, language, ocr, rules, titles, uris
from siftmill.operators import catalog, joins, metrics, ranking, similarity
from siftmill.plans import cascade
from siftmill.sources import archives


def cover_candidates(members: DataFrame, archive: str, order: Column, front: int = 3, back: int = 5, item: str = "item_id") -> DataFrame:
    """The first `front` and last `back` members of each archive, where covers and credits are."""
    return ranking.select_indices(members, archive, order, front=front, back=back, item=item)


def clean_covers(members: DataFrame, stage: cascade.Stage, archive: str, order: Column, front: int = 3, back: int = 5, item: str = "item_id") -> DataFrame:
    """(item_id, stage, reason): what a stage (reference hashes, watermarks) removes among cover candidates."""
    return stage(cover_candidates(members, archive, order, front, back, item))


def clean_archives(members: DataFrame, archive: str, stages: Sequence[cascade.Stage], readable: str | None = None, merge: bool = False, item: str = "item_id") -> DataFrame:
    """(archive, item_id, stage, reason): a cascade over the members of readable archives.

    Stages that group do so by `group_id`: within an archive, or over all archives with `merge`.
    """
    x = members if readable is None else members.where(F.col(readable))
    made, _ = cascade.cascade(x.withColumn("group_id", F.lit("all") if merge else F.col(archive)), stages, item)
    return members.select(F.col(archive).alias("archive"), F.col(item).alias("item_id")).join(made, "item_id")


def route_archives(
    archives: DataFrame, images: DataFrame, done: DataFrame, dimension_rules: list[rules.DimensionRule], excluded: list[str], threshold_count: int = 1
) -> DataFrame:
    """(name, path, rule, folder): archives that are not among `done` (by name, in any case) nor on excluded paths, by the rule most of their images match.

    `archives`: (name, path); `images`: (archive, width, height); `done`: (name).
    """
    todo = joins.not_there_yet(archives, done).where(~rules.excluded_path(F.col("path"), excluded))
    routed = metrics.dimension_router(images, "archive", "width", "height", dimension_rules, threshold_count).where("rule IS NOT NULL")
    return todo.join(routed.select(F.col("archive").alias("name"), "rule", "folder"), "name").select("name", "path", "rule", "folder")


def warm_up(items: DataFrame, known: DataFrame, fresh: Column, hash_size: int = 10) -> DataFrame:
    """Catalog rows of items (uri, calculated_time, columns that `fresh` reads) that have no hash yet; `fresh` computes it."""
    todo = items.join(known.where("hash_value IS NOT NULL AND hash_value <> ''").select(F.col("uri").alias("_u")), F.col("uri") == F.col("_u"), "left_anti")
    return catalog.records(todo.select("uri", fresh.alias("hash_value"), "calculated_time"), hash_size)


def against_reference(items: DataFrame, hashes: DataFrame, folders: DataFrame, threshold: int, bits: int) -> DataFrame:
    """(id, ref_uri, distance, folder): items (id, uri, path, chunks) matched with reference hashes (uri, chunks), with the marked folder each lies in."""
    m = similarity.reference_match(items, hashes, threshold, bits)
    return joins.nearest_folder(items.select("id", "path"), folders).join(m, "id").select("id", "ref_uri", "distance", "folder")


def language_names(items: DataFrame, blocks: str, name: str, item: str = "item_id") -> DataFrame:
    """(item_id, text, text_length, language, new_name) from recognised blocks of text."""
    text = ocr.aggregate_text(F.col(blocks))
    x = items.select(F.col(item).alias("item_id"), text.alias("text"), F.col(name).alias("_name")).withColumn("language", language.heuristic(F.col("text")))
    return x.select("item_id", "text", F.length(F.trim("text")).alias("text_length"), "language", titles.with_language_suffix(F.col("_name"), language.language_suffix(F.col("language"))).alias("new_name"))


def tidy_names(members: DataFrame, archive: str, name: str, digest: str, time: str, limit: float = 0.5, item: str = "item_id") -> DataFrame:
    """(archive, item_id, action, new_name): ads go (`ad`, unless they are more than `limit` of an archive's images), hash tags
    leave names, and names that then collide keep their earliest file, drop equal ones (`trash`) and number the others (`rename`)."""
    ad = rules.is_ad(F.col(name))
    gone = metrics.guarded_removals(members, archive, ad, limit).select(F.col(item).alias("_ad"))
    left = members.join(gone, F.col(item) == F.col("_ad"), "left_anti").withColumn("_new", titles.without_hash_tag(F.col(name))).withColumn("_key", F.concat_ws("!", archive, "_new"))
    acted = ranking.earliest_or_rename(left, "_key", time, digest, item)
    kept = left.join(acted.select(F.col("item_id").alias("_i"), "action", "n"), F.col(item) == F.col("_i"))
    new = F.when(F.col("action") == "trash", F.lit(None)).otherwise(titles.numbered(F.col("_new"), F.col("n")))
    kept = kept.select(F.col(archive).alias("archive"), F.col(item).alias("item_id"), "action", new.alias("new_name"))
    ads = members.join(gone, F.col(item) == F.col("_ad"), "left_semi").select(F.col(archive).alias("archive"), F.col(item).alias("item_id"), F.lit("ad").alias("action"), F.lit(None).cast("string").alias("new_name"))
    return kept.unionByName(ads)


def hash_size_benchmark(hashes: DataFrame, sizes: Sequence[int], suggest: float = 0.3) -> DataFrame:
    """(hash_size, n_pairs, avg_distance, ..., suggested_threshold) of all pairs of items, per hash size in one job.

    `hashes`: (id, hash_size, hash). Quadratic per size, as its result is about all pairs.
    """
    h = hashes.where(F.col("hash_size").isin(list(sizes)))
    a, b = (h.select(F.col("id").alias(c), F.col("hash_size").alias(f"s{c}"), F.col("hash").alias(f"h{c}")) for c in "ab")
    pairs = a.join(b, (F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b"))).select(F.col("sa").alias("hash_size"), hashing.hamming_any(F.col("ha"), F.col("hb"), 1024).alias("distance"))
    s = similarity.distance_stats(pairs, ("hash_size",))
    return s.withColumn("suggested_threshold", F.greatest(F.lit(1), F.floor(F.col("avg_distance") * suggest).cast("int")))


def archive_images(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """All measures (`images.measured`) of the images in ZIP files, from the archives' bytes: archive, inner, file_size, uri and a row for each member.

    Members that cannot be read or decoded are rows with an error, and an archive that cannot be read is one with null names.
    """
    listed = archives.members(files, path_col, content_col, with_content=True, pattern=r"(?i)\.(?:" + "|".join(uris.IMAGE_EXTENSIONS) + ")$")
    x = listed.select("archive", "inner", "file_size", uris.canonical(F.concat_ws("!", "archive", "inner")).alias("uri"), F.col("error").alias("read_error"), "content")
    x = images.measured(x)
    return x.withColumn("error", F.coalesce("read_error", "error")).drop("read_error")


def archive_metrics(files: DataFrame, sample: int = 3, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(archive, width, page_count, clarity): the upper median width and the mean sharpness above 0 of `sample` images by size, and the number of images.

    Only the sampled members are read and decoded. An archive without images, or one that cannot be read, has 0 for all; so has a measure that fails.
    """
    listed = archives.members(files, path_col, content_col)
    pages = listed.where(F.coalesce(uris.is_image(F.col("inner")), F.lit(False)))
    # by size, not by name: the largest, the middle one, and others of the largest third
    picks = ranking.sample_by_size(pages, "archive", "file_size", sample, "inner").groupBy("group").agg(F.collect_set("item_id").alias("_names"))
    few = files.join(picks, F.col(path_col) == F.col("group"))
    seen = images.measured(archives.members(few, path_col, content_col, with_content=True, names_col="_names").select("archive", "content"))
    m = seen.groupBy("archive").agg(metrics.upper_median("width").alias("w"), metrics.positive_mean(F.col("sharpness")).alias("c"))
    counts = listed.groupBy("archive").agg(F.count_if(F.coalesce(uris.is_image(F.col("inner")), F.lit(False))).alias("page_count"))
    every = files.select(F.col(path_col).alias("archive")).distinct().join(counts, "archive", "left").join(m, "archive", "left")
    return every.select("archive", F.coalesce("w", F.lit(0)).cast("int").alias("width"), F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce("c", F.lit(0.0)).alias("clarity"))


def compare_algorithms(scores: DataFrame, algorithms: Sequence[str], key: str = "pair_id") -> DataFrame:
    """(pair_id, algorithm, similarity_score): wide scores made long, for `metrics.score_stats` and `metrics.pivot_scores`."""
    return scores.unpivot([key], list(algorithms), "algorithm", "similarity_score")
