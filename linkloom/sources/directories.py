"""Readers and writers of the tab-separated directory files, and directories derived from a documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW = ("entity_id", "business_name", "business_address", "country")
GROUND_TRUTH = ("source1_entity_id", "matched_entity_ids")
CANDIDATES = ("source1_entity_id", "candidate_entity_ids")
_ID, _OTHER = r"^S[123]-[0-9]+$", r"^S[23]-[0-9]+$"
#: Added to an S3 number so that S2 and S3 numbers share one space.
S3_OFFSET = 1 << 31


def _numbered(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """value and its number, from 1 on, among the lines of a file that are kept (all of them if None).

    A folder of part files is one file, in the order of their names. Lines are numbered within each split, and offset by the
    counts of the splits before it (a row per split).
    """
    df = spark.read.text(path)
    df = df if keep is None else df.filter(keep)
    df = df.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))
    counts = df.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return df.join(counts, ["file", "block"]).select("value", (F.col("base") + F.col("mid") - F.col("first") + 1).alias("line"))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """value, valid (whether the line was proper UTF-8; it is repaired) and line, its place in the file from 1 on."""
    return _numbered(spark, path).select(F.make_valid_utf8("value").alias("value"), F.is_valid_utf8("value").alias("valid"), "line")


def _fields(value: Column, names: tuple[str, ...]) -> list[Column]:
    parts = F.split(value, "\t", len(names))
    return [F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(names)]


def read_source(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Rows of a source file: fields padded with "", tabs past the third stay in country, rows without a proper id dropped.

    Bytes that are no UTF-8 are replaced; limit counts proper rows.
    """
    df = spark.read.text(path).select(*_fields(F.make_valid_utf8("value"), RAW)).filter(F.col("entity_id").rlike(_ID))
    return df.limit(limit) if limit else df


def positions(spark: SparkSession, path: str) -> DataFrame:
    """entity_id and position (from 0) of the proper rows of a source file, in file order; no other column is kept."""
    entity = F.split("value", "\t", 2)[0]
    return _numbered(spark, path, entity.rlike(_ID)).select(entity.alias("entity_id"), (F.col("line") - 1).alias("position"))


def _ids(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """s1_id and its list of matched ids (empty for a singleton); ids that cannot be read are left out."""
    s1, others = _fields(F.make_valid_utf8("value"), GROUND_TRUTH)
    ids = F.filter(_ids(others), lambda x: x.rlike(_OTHER))
    return spark.read.text(path).select(F.trim(s1).alias("s1_id"), ids.alias("others")).filter(F.col("s1_id").rlike(r"^S1-[0-9]+$"))


def ground_truth_issues(spark: SparkSession, path: str) -> DataFrame:
    """issue, n of a ground-truth file: undecodable lines, column counts, empty and repeated entities, repeated and odd ids."""
    rows = lines_of(spark, path).filter(F.col("line") > 1)
    parts, (s1, others) = F.split("value", "\t"), _fields(F.col("value"), GROUND_TRUTH)
    rows = rows.select("valid", F.size(parts).alias("columns"), F.trim(s1).alias("s1"), _ids(others).alias("ids")).filter("columns > 0")
    again = rows.filter("s1 <> ''").groupBy("s1").agg((F.count(F.lit(1)) - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("n"))
    any_id = lambda test: F.size(F.filter("ids", test))
    flags = {
        "decode error": (~F.col("valid")).cast("long"),
        "wrong column count": (F.col("columns") != 2).cast("long"),
        "empty entity": (F.col("s1") == "").cast("long"),
        "repeated id": (F.size(F.array_distinct("ids")) < F.size("ids")).cast("long"),
        "source 1 id": any_id(lambda x: x.startswith("S1-")),
        "unknown prefix": any_id(lambda x: ~x.rlike("^S[123]-")),
    }
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in flags.items()])
    tall = F.explode(F.array(*[F.struct(F.lit(k).alias("issue"), F.col(f"`{k}`").cast("long").alias("n")) for k in flags])).alias("x")
    return sums.select(tall).select("x.issue", "x.n").union(again.select(F.lit("repeated entity"), F.col("n").cast("long")))


def merged_truth(truth: DataFrame) -> DataFrame:
    """s1_id and others, the lists of repeated entities joined into one."""
    return truth.groupBy("s1_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("others")))).alias("others"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct first fields of a file with a header."""
    return lines_of(spark, path).filter("line > 1").select(F.trim(_fields(F.col("value"), RAW)[0]).alias("entity_id")).distinct()


def encode_id(entity: Column) -> Column:
    """One number space for S2 and S3 ids; null for anything that is no id."""
    found = F.when(entity.rlike(_ID), entity)
    return F.substring(found, 4, 20).cast("long") + F.when(F.substring(found, 2, 1) == "3", S3_OFFSET).otherwise(0)


def decode_other(code: Column) -> Column:
    third = code >= S3_OFFSET
    return F.concat(F.when(third, "S3-").otherwise("S2-"), F.when(third, code - S3_OFFSET).otherwise(code).cast("string"))


def write_lines(df: DataFrame, column: str, path: str, order: list[Column], header: str | None = None) -> None:
    """A text file per range of order, the header (if any) as the first line of the first."""
    lines = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(column).alias("value"))
    if header is not None:
        lines = df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).union(lines)
    lines.write.text(path)


def write_source(rows: DataFrame, path: str, order: list[Column]) -> None:
    write_lines(rows.withColumn("line", F.concat_ws("\t", *RAW)), "line", path, order, "\t".join(RAW))


def write_lists(lists: DataFrame, path: str, names: tuple[str, str] = GROUND_TRUTH, order: list[Column] | None = None) -> None:
    """Tab-separated id lists with a header, a row per entity in the given order (by entity without one); an empty list is written as nothing."""
    line = F.concat_ws("\t", *[F.col(c) for c in lists.columns[:2]])
    write_lines(lists.withColumn("line", line), "line", path, order or [F.col(lists.columns[0])], "\t".join(names))


def raw_records(documents: DataFrame) -> DataFrame:
    """Three directories out of documents: source, ids, name, address and country by plain column arithmetic.

    Some names carry mojibake, accents, or words in Devanagari and Cyrillic; some names and addresses are empty.
    """
    toks = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    n, d = F.col("n_chars"), F.col("doc_id")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    suffix = pick(("", " Ltd", " Pvt Ltd", " Group"), n)
    place = pick((" Texas", " New York", " Karnataka", " Tamil Nadu", ""), n)
    code = F.when(n % 3 == 0, F.concat(F.lit(" "), (10000 + n % 500).cast("string"))).otherwise("")
    odd = F.when(d % 13 == 4, " Itâ€™s").when(d % 13 == 7, " नगर").when(d % 13 == 9, " Завод").when(d % 13 == 11, " & Söhne").otherwise("")
    source = (d % 3 + 1).cast("int")
    name = F.concat(F.array_join(F.slice(toks, 1, 6), " "), odd, suffix)
    address = F.concat((1 + n % 60).cast("string"), F.lit(" "), F.array_join(F.slice(toks, 7, 6), " "), F.lit(" Rd"), place, code)
    return documents.select(
        source.alias("source"),
        F.concat(F.lit("S"), source.cast("string"), F.lit("-"), d.cast("string")).alias("entity_id"),
        d.alias("num"),
        F.when(d % 29 == 5, "").otherwise(name).alias("business_name"),
        F.when(d % 31 == 7, "").otherwise(address).alias("business_address"),
        F.coalesce(F.trim("lang"), F.lit("")).alias("country"),
        n.alias("size"),
        F.md5(F.coalesce("text", F.lit(""))).alias("digest"),
    )


def derived_truth(raw: DataFrame) -> DataFrame:
    """s1_id, other_id: rows of equal text and country with the first such S1 row, and neighbours by number for some sizes."""
    s1, others = raw.filter("source = 1"), raw.filter("source > 1")
    first = s1.groupBy("country", "digest").agg(F.min("num").alias("num"))
    equal = others.join(first.withColumnRenamed("num", "owner"), ["country", "digest"]).select(F.concat(F.lit("S1-"), F.col("owner").cast("string")).alias("s1_id"), F.col("entity_id").alias("other_id"))
    steps = F.array_compact(F.array(F.when(F.col("size") % 2 == 0, 1), F.when(F.col("size") % 3 == 0, 2)))
    near = s1.select(F.col("entity_id").alias("s1_id"), "num", F.explode(steps).alias("step")).select("s1_id", (F.col("num") + F.col("step")).alias("num"))
    near = near.join(others.select("num", F.col("entity_id").alias("other_id")), "num").select("s1_id", "other_id")
    return equal.union(near).distinct()
