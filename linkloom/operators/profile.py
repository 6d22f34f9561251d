"""Profiles of the directory files and of the ground truth; pre-checks on true pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions import text as tx
from linkloom.sources.directories import RAW, lines_of, read_source

NEAR_MISSES = 400
SEED_ENTITIES = 60


def _share(flag: Column) -> Column:
    return F.round(F.avg(flag.cast("double")), 6)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row: data rows, bytes, bytes a row, projected GB in memory (two and a half times), fits, header_ok, rows of an odd field count, undecodable and non-ASCII rows."""
    lines = lines_of(spark, path)
    data, size = F.col("line") > 1, F.octet_length("value") + 1
    out = lines.agg(
        F.count_if(data).alias("n_rows"), F.sum(size).alias("bytes"), F.bool_or((F.col("line") == 1) & (F.col("value") == "\t".join(RAW))).alias("header_ok"),
        F.count_if(data & (F.size(F.split("value", "\t")) != len(RAW))).alias("odd_fields"), F.count_if(data & ~F.col("valid")).alias("undecodable"), F.count_if(data & tx.not_ascii(F.col("value"))).alias("non_ascii"),
    )
    projected = F.round(F.col("bytes") * 2.5 / 1e9, 6)
    return out.withColumn("bytes_per_row", F.round(F.col("bytes") / F.greatest("n_rows", F.lit(1)), 3)).withColumn("projected_gb", projected).withColumn("fits", projected < 2.0)


def first_rows(spark: SparkSession, path: str, most: int = 2, width: int = 60) -> DataFrame:
    """The first rows of a file, their fields cut to width characters."""
    rows = lines_of(spark, path).filter((F.col("line") > 1) & (F.col("line") <= most + 1))
    parts = F.split("value", "\t", len(RAW))
    return rows.select("line", *[F.left(F.coalesce(F.get(parts, F.lit(i)), F.lit("")), F.lit(width)).alias(c) for i, c in enumerate(RAW)])


def country_mix(rows: DataFrame, most: int = 12) -> DataFrame:
    """source, country, n of the most frequent labels of each source, and more: how many labels are left out."""
    sizes = rows.groupBy("source", F.trim("country").alias("country")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("source").orderBy(F.col("n").desc(), "country")
    ranked = sizes.withColumn("at", F.row_number().over(order)).withColumn("labels", F.count(F.lit(1)).over(Window.partitionBy("source")))
    return ranked.filter(F.col("at") <= most).select("source", "country", "n", F.greatest(F.col("labels") - most, F.lit(0)).alias("more"))


def new_labels(train: DataFrame, test: DataFrame) -> DataFrame:
    """Countries that only test has."""
    label = lambda df: df.select(F.trim("country").alias("country"))
    return label(test).distinct().join(label(train).distinct(), "country", "left_anti")


def missing_rates(rows: DataFrame) -> DataFrame:
    """source, n, no_name, no_address, no_country, and no_postal among rows with an address."""
    empty = lambda c: F.trim(F.col(c)) == ""
    no_code = F.count_if(~empty("business_address") & (tx.postal_like(F.col("business_address")) == ""))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), _share(empty("business_name")).alias("no_name"), _share(empty("business_address")).alias("no_address"), _share(empty("country")).alias("no_country"),
        F.round(F.try_divide(no_code, F.count_if(~empty("business_address"))), 6).alias("no_postal"),
    )


def truth_stats(entities: DataFrame) -> DataFrame:
    """group (all, matched), n, mean, median, most of the matches per entity."""
    tags = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("n_true") > 0, "matched")))).alias("group")
    return entities.select(tags, "n_true").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_true"), 6).alias("mean"), F.percentile("n_true", 0.5).alias("median"), F.max("n_true").alias("most"))


def truth_histogram(entities: DataFrame) -> DataFrame:
    """matches (0, 1, 2, 3-4, 5-10, 11+), n."""
    n = F.col("n_true")
    size = F.when(n <= 2, n.cast("string")).when(n <= 4, "3-4").when(n <= 10, "5-10").otherwise("11+")
    return entities.groupBy(size.alias("matches")).agg(F.count(F.lit(1)).alias("n"))


def truth_sources(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """mix, n of entities by the sources of their matches."""
    per = truth.groupBy("s1_id").agg(F.bool_or(F.col("other_id").startswith("S2-")).alias("two"), F.bool_or(F.col("other_id").startswith("S3-")).alias("three"))
    kind = F.when(F.col("two") & F.col("three"), "both").when(F.col("two"), "S2 only").when(F.col("three"), "S3 only").otherwise("none")
    return entities.join(per, "s1_id", "left").groupBy(kind.alias("mix")).agg(F.count(F.lit(1)).alias("n"))


def cross_links(truth: DataFrame) -> DataFrame:
    """other_id, claims, owners of matched ids that several entities claim."""
    return truth.groupBy("other_id").agg(F.count(F.lit(1)).alias("claims"), F.array_join(F.array_sort(F.collect_set("s1_id")), ",").alias("owners")).filter("claims > 1")


def sampled(df: DataFrame, n: int, *ids: str, seed: int = 42) -> DataFrame:
    """n rows, first by a hash of their ids; the same rows at each run."""
    return df.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), *ids))).orderBy("h", *ids).limit(n).drop("h")


def exact_matches(pairs: DataFrame, raw: DataFrame) -> DataFrame:
    """country (ALL for all), pairs, and the shares of equal names and addresses, raw and normalised, among pairs with both."""
    side = lambda p, key: raw.select(F.col("entity_id").alias(key), *[F.col(c).alias(p + c[9:]) for c in ("business_name", "business_address")], *([F.col("country")] if p == "a_" else []))
    df = pairs.join(side("a_", "s1_id"), "s1_id").join(side("b_", "other_id"), "other_id")
    for c in ("name", "address"):
        both = (F.trim(f"a_{c}") != "") & (F.trim(f"b_{c}") != "")
        df = df.withColumn(f"{c}_raw", F.when(both, (F.col(f"a_{c}") == F.col(f"b_{c}")).cast("int"))).withColumn(f"{c}_norm", F.when(both, (tx.profile_norm(F.col(f"a_{c}")) == tx.profile_norm(F.col(f"b_{c}"))).cast("int")))
    tag = F.explode(F.array(F.lit("ALL"), F.when(F.trim("country") == "", "(empty)").otherwise(F.trim("country")))).alias("country")
    flags = ["name_raw", "name_norm", "address_raw", "address_norm"]
    return df.select(tag, *flags).groupBy("country").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in flags])


def near_misses(truth: DataFrame, raw: DataFrame, entities: int = SEED_ENTITIES, most: int = NEAR_MISSES, seed: int = 42) -> DataFrame:
    """s1_id, other_id, reason: rows that share the postal code or the first name token of sampled matched entities and are no match.

    The seeds are few (entities), so their side of both joins is broadcast; most rows are kept, first by ids.
    """
    seeds = sampled(truth.select("s1_id").distinct(), entities, "s1_id", seed=seed)
    keyed = raw.select("entity_id", "source", tx.postal_like(F.col("business_address")).alias("postal"), F.get(F.split(tx.profile_norm(F.col("business_name")), " "), F.lit(0)).alias("token"))
    ours = F.broadcast(keyed.filter("source = 1").select(F.col("entity_id").alias("s1_id"), F.col("postal").alias("p"), F.col("token").alias("t")).join(F.broadcast(seeds), "s1_id"))
    theirs = keyed.filter("source > 1").select(F.col("entity_id").alias("other_id"), "postal", "token")
    by = lambda mine, other, reason: theirs.filter(F.col(other) != "").join(ours, F.col(mine) == F.col(other)).select("s1_id", "other_id", F.lit(reason).alias("reason"))
    met = by("p", "postal", "postal").union(by("t", "token", "token")).groupBy("s1_id", "other_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), " + ").alias("reason"))
    return met.join(truth.select("s1_id", "other_id"), ["s1_id", "other_id"], "left_anti").orderBy("s1_id", "other_id").limit(most)


def truth_and_files(truth: DataFrame, entities: DataFrame, raw: DataFrame) -> DataFrame:
    """issue, n: matched ids that no file has, S1 rows without a truth row, truth rows without an S1 row. entities: the truth's own rows."""
    ids = raw.select("entity_id")
    count = lambda df, issue: df.agg(F.lit(issue).alias("issue"), F.count(F.lit(1)).alias("n"))
    unseen = truth.select(F.col("other_id").alias("entity_id")).distinct().join(ids, "entity_id", "left_anti")
    listed = entities.select(F.col("s1_id").alias("entity_id")).distinct()
    s1 = raw.filter("source = 1").select("entity_id")
    return count(unseen, "matched id not in the files").union(count(s1.join(listed, "entity_id", "left_anti"), "S1 row without truth")).union(count(listed.join(s1, "entity_id", "left_anti"), "truth without S1 row"))


def country_consistency(truth: DataFrame, raw: DataFrame) -> DataFrame:
    """country of the S1 row, n, same: share of true pairs of one country."""
    pairs = _countries(truth, raw)
    return pairs.groupBy(F.col("a").alias("country")).agg(F.count(F.lit(1)).alias("n"), _share(F.col("a") == F.col("b")).alias("same"))


def _countries(truth: DataFrame, raw: DataFrame) -> DataFrame:
    return truth.join(raw.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("a")), "s1_id").join(raw.select(F.col("entity_id").alias("other_id"), F.col("country").alias("b")), "other_id")


def country_mismatches(truth: DataFrame, raw: DataFrame, most: int = 10) -> DataFrame:
    """The first true pairs, by ids, whose countries differ."""
    return _countries(truth, raw).filter("a <> b").orderBy("s1_id", "other_id").limit(most)


def country_cardinality(entities: DataFrame) -> DataFrame:
    """country, n, singleton_share, mean, median, most."""
    return entities.groupBy("country").agg(F.count(F.lit(1)).alias("n"), _share(F.col("n_true") == 0).alias("singleton_share"), F.round(F.avg("n_true"), 6).alias("mean"), F.percentile("n_true", 0.5).alias("median"), F.max("n_true").alias("most"))


def script_inventory(records: DataFrame) -> DataFrame:
    """source, name_script, n, share of the source's rows."""
    sizes = records.groupBy("source", "name_script").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


def translit_check(records: DataFrame) -> DataFrame:
    """name_script, n, rendered (names whose Latin rendering differs from the native form) and the first rendering of each other script."""
    other = records.filter("name_script <> 'latin'")
    return other.groupBy("name_script").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("name_translit") != F.col("name_sorted")).alias("rendered"), F.min("name_translit").alias("sample"))


def cross_script(truth: DataFrame, records: DataFrame) -> DataFrame:
    """One row: true pairs, those of two scripts, entities, those with a non-Latin match, those all of whose matches are non-Latin."""
    script = lambda key, name: records.select(F.col("entity_id").alias(key), F.col("name_script").alias(name))
    pairs = truth.join(script("s1_id", "a"), "s1_id").join(script("other_id", "b"), "other_id")
    per = pairs.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("x"), F.bool_or(F.col("b") != "latin").alias("some"), F.bool_and(F.col("b") != "latin").alias("all"))
    return per.agg(F.sum("n").alias("n_pairs"), F.sum("x").alias("cross"), F.count(F.lit(1)).alias("entities"), F.count_if("some").alias("with_non_latin"), F.count_if("all").alias("all_non_latin"))


def french(rows: DataFrame, most: int = 12) -> DataFrame:
    """The first rows, by source and number, whose country looks French."""
    return rows.filter(tx.looks_french(F.col("country"))).orderBy("source", "num").limit(most).select("source", "entity_id", F.left("business_name", F.lit(70)).alias("name"))


def read_all(spark: SparkSession, paths: dict[int, str], limit: int | None = None) -> DataFrame:
    """The rows of the source files, at most limit of each, with source and num."""
    parts = [read_source(spark, path, limit).withColumn("source", F.lit(source)) for source, path in sorted(paths.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("num", F.substring("entity_id", 4, 20).cast("long"))
