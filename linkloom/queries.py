"""Registered queries of the linkage engine; their DuckDB forms are in plans.oracle, written on their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import similarity as sim
from linkloom.functions import text as tx
from linkloom.functions.lexicons import FAMILIES
from linkloom.operators import blocking, diagnose, evaluate, learning, linkage, profile
from linkloom.plans import files
from linkloom.plans.chain import Chain
from linkloom.plans.oracle import ORACLES as ORACLES
from linkloom.sources import cache
from linkloom.sources import directories as d

#: Caps of two families for the capped volume by family.
FAMILY_CAPS = {"sig": 20_000, "hnstate": 500}


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _truth_read(c: Chain) -> DataFrame:
    return d.read_ground_truth(c.spark, files.truth_file(c))


def _rows(c: Chain) -> DataFrame:
    return profile.read_all(c.spark, files.source_files(c))


def _each_source(c: Chain, of: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    parts = [of(c.spark, path).withColumn("source", F.lit(source)) for source, path in files.source_files(c).items()]
    return parts[0].union(parts[1]).union(parts[2])


def _positions(c: Chain) -> DataFrame:
    return _each_source(c, d.positions).drop("source")


def _text_functions(c: Chain) -> DataFrame:
    name, address = F.col("business_name"), F.col("business_address")
    return c.raw.select(
        "entity_id", tx.spaced(tx.folded(name)).alias("folded"), tx.profile_norm(name).alias("profiled"), tx.truncate_bytes(name, 16).alias("cut"),
        F.get(F.split(tx.profile_norm(name), " "), F.lit(0)).alias("first_token"), tx.postal_like(address).alias("postal"), tx.looks_french(F.col("country")).alias("french"), tx.not_ascii(F.coalesce(name, F.lit(""))).alias("odd"),
    )


def _ids(c: Chain) -> DataFrame:
    code = d.encode_id(F.col("entity_id"))
    return c.raw.filter("source > 1").select("entity_id", code.alias("code"), d.decode_other(code).alias("decoded"), d.encode_id(F.concat(F.lit("x"), "entity_id")).isNull().alias("refused"))


def _fuzzy(kind: str, table: str = "topk") -> Callable[[Chain], DataFrame]:
    def build(c: Chain) -> DataFrame:
        df = linkage.with_both(getattr(c, table).select("s1_id", "other_id"), c.records, ["name_sorted"])
        return df.select("s1_id", "other_id", F.round(sim.fuzzy((kind,), F.col("a_name_sorted"), F.col("b_name_sorted"))[kind], 6).alias("score"))

    return build


def _decided_features(c: Chain) -> DataFrame:
    pairs = c.decided.select("s1_id", "other_id")
    out = learning.feature_matrix(pairs, c.records, c.aggregates)
    return _rounded(out, *[n for n in out.columns if n not in ("s1_id", "other_id")])


def _recalls(c: Chain) -> DataFrame:
    return evaluate.segments(c.traced, c.records)


def _key_cache(c: Chain) -> DataFrame:
    kept = cache.ensure(c.spark, "keys-by-family", (c.input,), lambda: c.keys, ("family",))
    return kept.filter(F.col("family").isin("sig", "hnstate")).groupBy("family", "source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("payload").alias("payloads"))


def _pair_cache(c: Chain) -> DataFrame:
    parts = (c.input, c.limits.cap, c.limits.budget, c.limits.top_k)
    kept = cache.ensure(c.spark, "candidates", parts, lambda: c.topk.select("s1_id", "other_id", "other_source", "rnk"))
    return kept.groupBy("other_source").agg(F.count(F.lit(1)).alias("n"), F.max("rnk").alias("last"))


def _report_lines(c: Chain) -> DataFrame:
    path = cache.fresh_path(c.spark, "report")
    cache.write_report(blocking.family_report(c.buckets, c.kept, c.limits.cap).select("family", "other_source", "uncapped", "post_cap"), path, "families")
    return cache.read_report(c.spark, path).select(F.col("value").alias("line"))


def _decision_file(c: Chain) -> DataFrame:
    path, grid = cache.fresh_path(c.spark, "decision"), _grid(c)
    cache.write_decision(evaluate.best_decision(grid), grid, path)
    held = cache.read_decision(c.spark, path)
    return c.spark.createDataFrame([(held["pair_threshold"], held["entity_gate"], held["macro_f05"], len(held["grid_top"]))], "tau double, gate double, macro_f05 double, listed long")


def _grid(c: Chain) -> DataFrame:
    return evaluate.threshold_grid(c.entities, c.truth, c.topk, "pri")


def _old_list(c: Chain) -> DataFrame:
    """The candidates that the older order keeps within k."""
    return diagnose.old_and_new_ranks(c.pool).filter(F.col("old_rank") < c.limits.top_k)


def _stored(c: Chain) -> DataFrame:
    """The older scores as kept: the better of both, off by a little for one counterpart in 199."""
    off = F.when(F.substring("other_id", 4, 20).cast("long") % 199 == 0, 0.01).otherwise(0.0)
    return c.pool.select("s1_id", "other_id", (F.greatest("pri", "sec") + off).alias("score"))


def _model_lists(c: Chain) -> DataFrame:
    return blocking.id_lists(c.entities.select("s1_id"), c.predicted)


def _auc(c: Chain) -> DataFrame:
    true = c.truth.select("s1_id", "other_id", F.lit(1).alias("label"))
    return evaluate.roc_area(c.topk.join(true, ["s1_id", "other_id"], "left").fillna(0, ["label"]), "pri", "label")


def _model_auc(c: Chain) -> DataFrame:
    true, stop = c.truth.select("s1_id", "other_id", F.lit(1).alias("label")), c.split.filter("part = 'stop'").select("s1_id")
    return evaluate.roc_area(c.scores.join(stop, "s1_id", "left_semi").join(true, ["s1_id", "other_id"], "left").fillna(0, ["label"]), "score", "label")


QUERY = Callable[[Chain], DataFrame]
CHAINED: dict[str, QUERY] = {
    # files
    "source_scan": lambda c: _rows(c).select("source", "entity_id", "business_name", "business_address", "country"),
    "source_limit": lambda c: _each_source(c, lambda s, p: d.read_source(s, p, 25)).groupBy("source").agg(F.count(F.lit(1)).alias("n")),
    "ground_truth_scan": lambda c: _truth_read(c).select("s1_id", F.explode("others").alias("other_id")),
    "ground_truth_merged": lambda c: d.merged_truth(_truth_read(c)).select("s1_id", F.array_join("others", ",").alias("others")),
    "ground_truth_issues": lambda c: d.ground_truth_issues(c.spark, files.truth_file(c)),
    "id_positions": _positions,
    "id_set": lambda c: _each_source(c, d.read_ids).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("first")),
    "file_inventory": lambda c: _each_source(c, profile.file_inventory),
    "first_rows": lambda c: _each_source(c, profile.first_rows),
    "record_cache": lambda c: c.records.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name_sorted").alias("names")),
    "key_cache": _key_cache,
    "candidate_cache": _pair_cache,
    "candidate_file": lambda c: files.lists_read_back(c, 1),
    "matching_file": lambda c: files.lists_read_back(c, 0),
    "report_file": _report_lines,
    "decision_file": _decision_file,
    "validator_findings": files.findings,
    # records
    "text_functions": _text_functions,
    "id_codes": _ids,
    "records_norm": lambda c: c.records.select("entity_id", "name_core", "name_sorted", "name_suffixes", "name_nonascii"),
    "addr_parse": lambda c: c.records.select("entity_id", "addr_norm", "houseno", "postal", "state", "addr_nonascii"),
    "phonetic_key": lambda c: c.records.select("entity_id", "name_phon"),
    "initials": lambda c: c.records.select("entity_id", "name_initials"),
    "transliterated": lambda c: c.records.select("entity_id", "name_script", "name_translit"),
    "translit_check": lambda c: profile.translit_check(c.records),
    # blocking
    **{f"keys_{f}": lambda c, f=f: c.keys.filter(F.col("family") == f).select("source", "entity_id", "country", "payload") for f in FAMILIES},
    "bucket_counts": lambda c: c.buckets,
    "family_counts": lambda c: blocking.family_report(c.buckets, c.kept, c.limits.cap),
    "family_caps": lambda c: blocking.under_cap(c.buckets, c.limits.cap, FAMILY_CAPS).groupBy("family").agg(F.sum("pc").alias("volume"), F.count(F.lit(1)).alias("n_buckets")),
    "capped_join": lambda c: blocking.candidate_pairs(blocking.under_cap(c.buckets, c.limits.cap), c.keys).groupBy("other_source").agg(F.count(F.lit(1)).alias("n_pairs")),
    "budget_keep": lambda c: blocking.budget_keep(blocking.under_cap(c.buckets, c.limits.cap), c.limits.side_budget).select("family", "other_source", "country", "payload", "pc"),
    "trimmed_budgets": lambda c: blocking.trimmed_budgets(c.buckets, c.limits.cap, c.limits.full, c.limits.trim),
    "candidate_pairs": lambda c: c.pairs.select("s1_id", "other_id"),
    "cheap_score": lambda c: c.pool.select("s1_id", "other_id", F.round("pri", 6).alias("jaccard"), F.round("sec", 6).alias("containment"), F.round(F.greatest("pri", "sec"), 6).alias("score_v1")),
    "lex_rank": lambda c: _rounded(c.pool.select("s1_id", "other_id", "pri", "sec", F.least("rnk", F.lit(blocking.NO_RANK)).alias("rnk")), "pri", "sec"),
    "topk_candidates": lambda c: _rounded(c.topk.select("s1_id", "other_id", "pri", "sec", "rnk"), "pri", "sec"),
    "entity_aggs": lambda c: _rounded(c.aggregates, "e_max", "e_gap", "e_mean5"),
    "aggregate_lookup": lambda c: _rounded(learning.with_aggregates(c.entities.select("s1_id"), c.aggregates), "e_max", "e_gap", "e_mean5"),
    "decision_gate": lambda c: c.decided.select("s1_id", "other_id", F.round("pri", 6).alias("score")),
    "candidate_lists": lambda c: blocking.id_lists(c.entities.select("s1_id"), c.topk),
    "matching_lists": lambda c: blocking.id_lists(c.entities.select("s1_id"), c.decided),
    "blocking_stats": lambda c: blocking.blocking_report(c.pairs, c.records),
    # recall and decisions
    "pair_recall": lambda c: c.traced.agg(F.count(F.lit(1)).alias("n_true"), F.count_if("found").alias("n_found"), F.round(F.avg(F.col("found").cast("double")), 6).alias("recall")),
    "entity_recall": lambda c: evaluate.entity_share(c.traced, F.col("found")),
    "recall_by_country": lambda c: _recalls(c).groupBy("country").agg(F.count(F.lit(1)).alias("n_true"), F.round(F.avg(F.col("found").cast("double")), 6).alias("recall")),
    "recall_by_script": lambda c: _recalls(c).groupBy("name_script", "name_nonascii").agg(F.count(F.lit(1)).alias("n_true"), F.round(F.avg(F.col("found").cast("double")), 6).alias("recall")),
    "recall_at_k": lambda c: evaluate.recall_at(_recalls(c)),
    "recall_ceiling": lambda c: evaluate.entity_share(c.traced, F.col("rnk") < c.limits.top_k),
    "gate_check": lambda c: evaluate.gate_check(c.traced, c.records),
    "macro_f05": lambda c: evaluate.macro_f05(c.entities, c.truth, c.decided),
    "macro_f05_empty": lambda c: evaluate.macro_f05(c.entities, c.truth, c.decided.limit(0)),
    "threshold_grid": _grid,
    "best_decision": lambda c: evaluate.best_decision(_grid(c)),
    "auc": _auc,
    # losses
    "miss_decomposition": lambda c: diagnose.decomposition(c.traced, c.limits.top_k),
    "misses_anti_join": lambda c: c.truth.join(c.topk.select("s1_id", "other_id"), ["s1_id", "other_id"], "left_anti"),
    "negatives_anti_join": lambda c: c.topk.select("s1_id", "other_id").join(c.truth, ["s1_id", "other_id"], "left_anti"),
    "miss_categories": lambda c: c.categories.select("s1_id", "other_id", "category"),
    "miss_taxonomy": lambda c: diagnose.miss_taxonomy(c.categories),
    "miss_examples": lambda c: diagnose.examples(c.categories, c.raw),
    "old_versus_new": lambda c: diagnose.old_versus_new(c.traced, _old_list(c), c.limits.top_k),
    "trace_pairs": lambda c: c.trace,
    "trace_reasons": lambda c: diagnose.trace_reasons(c.trace),
    "cap_histogram": lambda c: diagnose.cap_histogram(c.trace),
    "nokey_matrix": lambda c: diagnose.nokey_matrix(c.trace, c.keys),
    "cap_curve": lambda c: diagnose.cap_curve(c.buckets, c.traced, c.trace, c.limits.curve, c.limits.full),
    "level_table": lambda c: diagnose.level_table(c.buckets, c.trace, c.limits.cap, c.limits.levels),
    "cap_plan": lambda c: diagnose.cap_plan(diagnose.level_table(c.buckets, c.trace, c.limits.cap, c.limits.levels), c.limits.cap, c.limits.levels, c.limits.plan_budget),
    "rank_old_vs_new": lambda c: diagnose.old_and_new_ranks(c.pool).select("s1_id", "other_id", F.col("rnk").alias("new_rank"), "old_rank", "ties"),
    "ranker_check": lambda c: diagnose.ranker_check(c.pool, _stored(c), diagnose.miss_categories(c.traced, c.records, 0), c.limits.top_k),
    "position_leak": lambda c: diagnose.position_leak(c.truth, _positions(c)),
    # profiles
    "script_inventory": lambda c: profile.script_inventory(c.records),
    "cross_script": lambda c: profile.cross_script(c.truth, c.records),
    "truth_stats": lambda c: profile.truth_stats(c.entities),
    "truth_histogram": lambda c: profile.truth_histogram(c.entities),
    "truth_sources": lambda c: profile.truth_sources(c.entities, c.truth),
    "cross_links": lambda c: profile.cross_links(c.truth),
    "truth_and_files": lambda c: profile.truth_and_files(d.merged_truth(_truth_read(c)).select("s1_id", F.explode("others").alias("other_id")), _truth_read(c), _rows(c)),
    "country_mix": lambda c: profile.country_mix(_rows(c)),
    "new_labels": lambda c: profile.new_labels(c.raw.filter("num % 97 <> 0 AND country <> 'de'"), _rows(c)),
    "missing_rates": lambda c: profile.missing_rates(_rows(c)),
    "french_rows": lambda c: profile.french(c.raw),
    "country_consistency": lambda c: profile.country_consistency(c.truth, c.raw),
    "country_mismatches": lambda c: profile.country_mismatches(c.truth, c.raw),
    "country_cardinality": lambda c: profile.country_cardinality(c.entities),
    "exact_match_rates": lambda c: profile.exact_matches(profile.sampled(c.truth, 50_000, "s1_id", "other_id"), c.raw),
    "sampled_pairs": lambda c: diagnose.examples(profile.sampled(c.truth, 20, "s1_id", "other_id").withColumn("category", F.lit("sample")), c.raw, 20),
    "near_miss": lambda c: profile.near_misses(c.truth, c.raw),
    "near_miss_reasons": lambda c: profile.near_misses(c.truth, c.raw).groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
    # features and the classifier
    "native_features": lambda c: linkage.native_features(c.topk.select("s1_id", "other_id"), c.records),
    "pair_features": _decided_features,
    **{f"fuzzy_{k}": _fuzzy(k) for k in ("jaro_winkler", "indel", "token_set")},
    "fuzzy_partial": _fuzzy("partial", "decided"),
    "stratified_split": lambda c: learning.stratified_split(c.entities),
    "learn_split": lambda c: c.split,
    "hard_negatives": lambda c: learning.hard_negatives(c.topk, c.truth),
    "training_rows": lambda c: learning.training_rows(c.split, c.topk, c.truth),
    "train_score": lambda c: c.scores.select("s1_id", "other_id", F.round("score", 6).alias("score")),
    "tuned_threshold": lambda c: evaluate.best_decision(c.val_grid),
    "model_auc": _model_auc,
    "predict_lists": _model_lists,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: (lambda spark, sf_dir, f=f: f(Chain(spark, sf_dir))) for n, f in CHAINED.items()}
