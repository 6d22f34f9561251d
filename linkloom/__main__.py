"""python -m linkloom COMMAND: the linkage engine over a folder of tab-separated files.

A dataset folder holds train/train_source{1,2,3}.tsv, train/train_ground_truth.tsv and the same for test without the truth.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import blocking, diagnose, evaluate, learning, profile, validate
from linkloom.plans.chain import Chain, Limits
from linkloom.sources import cache
from linkloom.sources import directories as d


def _tables(tables: dict[str, DataFrame], rows: int = 40) -> None:
    for name, table in tables.items():
        print(f"== {name}")
        table.show(rows, truncate=60)


def _lists(chain: Chain, pairs: DataFrame, path: str, names: tuple[str, str]) -> None:
    s1 = chain.raw.filter("source = 1").select(F.col("entity_id").alias("s1_id"), F.col("num").alias("n"))
    d.write_lists(blocking.id_lists(s1, pairs).select("s1_id", "ids", "n"), path, names, [F.col("n")])


def inspect(chain: Chain, _: argparse.Namespace) -> int:
    """Profiles of the files and of the truth."""
    files = {f"{s}": f"{chain.sf_dir}_source{s}.tsv" for s in (1, 2, 3)}
    _tables({f"file {s}": profile.file_inventory(chain.spark, path) for s, path in files.items()})
    _tables({
        "countries": profile.country_mix(chain.raw), "missing fields": profile.missing_rates(chain.raw), "scripts": profile.script_inventory(chain.records), "cross script": profile.cross_script(chain.truth, chain.records),
        "matches": profile.truth_stats(chain.entities), "histogram": profile.truth_histogram(chain.entities), "by country": profile.country_cardinality(chain.entities), "consistency": profile.country_consistency(chain.truth, chain.raw),
        "exact matches": profile.exact_matches(chain.truth, chain.raw), "near misses": profile.near_misses(chain.truth, chain.raw),
    })
    return 0


def block(chain: Chain, options: argparse.Namespace) -> int:
    """Candidates, their file, and what blocking loses."""
    _lists(chain, chain.topk, f"{options.out}/candidate_pairs.tsv", d.CANDIDATES)
    _tables({
        "families": blocking.family_report(chain.buckets, chain.kept, chain.limits.cap), "candidates": blocking.blocking_report(chain.pairs, chain.records),
        "recall": evaluate.recall_at(evaluate.segments(chain.traced, chain.records)), "gate": evaluate.gate_check(chain.traced, chain.records), "losses": diagnose.decomposition(chain.traced, chain.limits.top_k),
        "lost pairs": diagnose.miss_taxonomy(chain.categories), "why": diagnose.trace_reasons(chain.trace), "caps": diagnose.cap_curve(chain.buckets, chain.traced, chain.trace, chain.limits.curve, chain.limits.full),
    })
    return 0


def train(chain: Chain, options: argparse.Namespace) -> int:
    """The classifier and the decision tuned on the entities held out, written under out."""
    if chain.model is None:
        print("nothing to learn from: the truth has no pairs, or blocking no others")
        return 1
    chain.model.write().overwrite().save(f"{options.out}/model")
    cache.write_decision(evaluate.best_decision(chain.val_grid), chain.val_grid, cache.fresh_path(chain.spark, "decision") if options.dry else f"{options.out}/decision")
    _tables({"best": evaluate.best_decision(chain.val_grid)})
    return 0


def predict(chain: Chain, options: argparse.Namespace) -> int:
    """Both result files, by the classifier and the decision under out, and the validator's findings on them."""
    from pyspark.ml.classification import GBTClassificationModel

    held = cache.read_decision(chain.spark, f"{options.out}/decision")
    scored = learning.score(GBTClassificationModel.load(f"{options.out}/model"), chain.features).join(chain.topk.select("s1_id", "other_id", "other_source"), ["s1_id", "other_id"])
    _lists(chain, chain.topk, f"{options.out}/candidate_pairs.tsv", d.CANDIDATES)
    _lists(chain, blocking.decide(scored, "score", held["pair_threshold"], held["entity_gate"]), f"{options.out}/matching_results.tsv", d.GROUND_TRUTH)
    return check(chain, options)


def check(chain: Chain, options: argparse.Namespace) -> int:
    """The validator's findings; 1 if any is an error."""
    ids = chain.raw.select("entity_id", "source")
    findings = validate.validate(chain.spark, f"{options.out}/matching_results.tsv", f"{options.out}/candidate_pairs.tsv", ids.filter("source = 1"), ids.filter("source > 1") if options.check_ids else None)
    _tables({"findings": findings.filter("n > 0")})
    return 0 if validate.passed(findings) else 1


COMMANDS = {"inspect": inspect, "block": block, "train": train, "predict": predict, "validate": check}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="linkloom", description=__doc__)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("--dataset", required=True)
    parser.add_argument("--split", default="train", choices=("train", "test"))
    parser.add_argument("--out", required=True, help="folder of results, model and decision")
    parser.add_argument("--k", type=int, default=Limits.top_k)
    parser.add_argument("--per-key-cap", type=int, default=Limits.cap)
    parser.add_argument("--budget", type=int, default=Limits.budget)
    parser.add_argument("--limit", type=int, help="rows of each source file")
    parser.add_argument("--check-ids", action="store_true")
    parser.add_argument("--dry", action="store_true", help="train without keeping the decision")
    options = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("linkloom").getOrCreate()
    limits = Limits(cap=options.per_key_cap, budget=options.budget, top_k=options.k)
    return COMMANDS[options.command](Chain.of_files(spark, options.dataset, options.split, limits, options.limit), options)


if __name__ == "__main__":
    sys.exit(main())
