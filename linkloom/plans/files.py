"""The directories and the truth of a chain written as files, with the noise that such files have, for the readers to meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators import blocking, validate
from linkloom.sources import cache
from linkloom.sources import directories as d

from .chain import Chain


def source_files(c: Chain) -> dict[int, str]:
    """A file of each directory: some rows with a field too many, without a proper id, with their id alone, or with a byte that is no UTF-8."""
    out = {}
    for source in (1, 2, 3):
        rows, n = c.raw.filter(F.col("source") == source), F.col("num")
        fields = [F.when(n % 19 == 4, F.concat(F.lit("bad-"), n.cast("string"))).otherwise(F.col("entity_id")), F.col("business_name"), F.col("business_address"), F.col("country")]
        whole = F.concat_ws("\t", *[F.coalesce(f, F.lit("")) for f in fields])
        line = F.when(n % 23 == 5, fields[0]).when(n % 17 == 3, F.concat(whole, F.lit("\textra"))).otherwise(whole)
        odd = F.concat(F.col("entity_id").cast("binary"), F.expr("X'09FF'"), F.coalesce("business_name", F.lit("")).cast("binary")).cast("string")
        line = F.when((n % 37 == 6) & (n % 19 != 4) & (n % 23 != 5), odd).otherwise(line)
        out[source] = cache.fresh_path(c.spark, f"source{source}")
        d.write_lines(rows.withColumn("line", line), "line", out[source], [n], "\t".join(d.RAW))
    return out


def truth_file(c: Chain) -> str:
    """The truth as a file: some lists with an id twice, a source 1 id or an unknown prefix; some rows twice or with a third field."""
    lists = blocking.id_lists(c.entities.select("s1_id"), c.truth.withColumn("other_source", F.substring("other_id", 2, 1).cast("int")))
    n, ids = F.substring("s1_id", 4, 20).cast("long"), F.col("ids")
    add = lambda rest: F.concat_ws(",", F.when(ids != "", ids), F.lit(rest))
    noisy = F.when((n % 11 == 3) & (ids != ""), F.concat_ws(",", ids, F.split(ids, ",")[0])).when(n % 17 == 6, add(" S1-0")).when(n % 19 == 9, add("X9-1")).otherwise(ids)
    rows = lists.select("s1_id", n.alias("n"), F.concat_ws("\t", "s1_id", noisy, F.when(n % 23 == 12, F.lit("more"))).alias("line"), F.lit(0).alias("again"))
    twice = rows.filter("n % 13 = 6").select("s1_id", "n", F.concat("s1_id", F.lit("\tS2-1")).alias("line"), F.lit(1).alias("again"))
    path = cache.fresh_path(c.spark, "truth")
    d.write_lines(rows.union(twice), "line", path, [F.col("n"), F.col("again")], "\t".join(d.GROUND_TRUTH))
    return path


def result_files(c: Chain) -> tuple[str, str]:
    """The decided lists and the candidate lists as files, in the order of the S1 rows."""
    s1 = c.raw.filter("source = 1").select(F.col("entity_id").alias("s1_id"), F.col("num").alias("n"))
    paths = []
    for pairs, names in ((c.decided, d.GROUND_TRUTH), (c.topk, d.CANDIDATES)):
        path = cache.fresh_path(c.spark, names[1])
        d.write_lists(blocking.id_lists(s1, pairs).select("s1_id", "ids", "n"), path, names, [F.col("n")])
        paths.append(path)
    return paths[0], paths[1]


def lists_read_back(c: Chain, which: int) -> DataFrame:
    """s1_id, ids, line of a result file as written."""
    lines = d.lines_of(c.spark, result_files(c)[which]).filter("line > 1")
    parts: Column = F.split("value", "\t", 2)
    return lines.select(parts[0].alias("s1_id"), parts[1].alias("ids"), (F.col("line") - 2).alias("place"))


def noisy_results(c: Chain) -> tuple[str, str]:
    """Result files that break the rules: rows left out, repeated, without a tab or of unknown entities; odd, foreign and repeated ids."""
    s1 = c.raw.filter("source = 1").select(F.col("entity_id").alias("s1_id"), F.col("num").alias("n"))
    paths = []
    for pairs, names in ((c.decided, d.GROUND_TRUTH), (c.topk, d.CANDIDATES)):
        lists, n, ids = blocking.id_lists(s1, pairs), F.col("n"), F.col("ids")
        add = lambda rest: F.concat_ws(",", F.when(F.col("ids") != "", F.col("ids")), F.lit(rest))
        bare = F.lit(names == d.CANDIDATES) & (n % 30 == 12)
        noisy = F.when(bare, "").when(n % 21 == 3, add("S1-0")).when(n % 24 == 6, add("abc")).when(n % 27 == 9, add("S2-99999999")).when(n % 33 == 12, add("S3-2,S3-2")).otherwise(ids)
        line = F.when(n % 36 == 15, F.col("s1_id")).otherwise(F.concat("s1_id", F.lit("\t"), noisy))
        rows = lists.filter("n % 39 <> 18").select("n", line.alias("line"), F.lit(0).alias("again"))
        extra = lists.filter("n % 42 = 0").select("n", F.concat("s1_id", F.lit("\t")).alias("line"), F.lit(1).alias("again"))
        blank = lists.filter("n % 45 = 21").select("n", F.lit("").alias("line"), F.lit(2).alias("again"))
        strange = lists.filter("n % 48 = 24").select("n", F.concat(F.lit("S1-9"), "s1_id", F.lit("\t")).alias("line"), F.lit(3).alias("again"))
        path = cache.fresh_path(c.spark, f"noisy-{names[1]}")
        d.write_lines(rows.union(extra).union(blank).union(strange), "line", path, [F.col("n"), F.col("again")], "\t".join(names))
        paths.append(path)
    return paths[0], paths[1]


def findings(c: Chain) -> DataFrame:
    """The validator's findings on noisy_results."""
    matching, candidates = noisy_results(c)
    return validate.validate(c.spark, matching, candidates, c.raw.filter("source = 1").select("entity_id"), c.raw.filter("source > 1").select("entity_id"))
