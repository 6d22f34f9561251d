"""Hand-derived values for normalisation, kernels and diagnoses, brute-force versions of the plans, files, and DuckDB forms."""

import glob
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkloom import queries
from linkloom.functions import similarity as sim
from linkloom.functions import text as tx
from linkloom.operators import blocking, diagnose, evaluate, learning, linkage, profile, validate
from linkloom.plans.chain import Chain, Limits
from linkloom.sources import cache
from linkloom.sources import directories as d
from tests.conftest import SF

NAMES = [
    ("Acme Widgets Pvt. Ltd.", "acme widgets", "acme widgets", "ltd pvt", "aw", "ACM WDGTS"),
    ("Société Générale & Fils SARL", "societe generale and fils sarl", "and fils generale sarl societe", "", "sgafs", "SCT SRL"),
    ("The Group Co", "the", "the", "co group", "t", "TH"),
    ("Holdings Ltd", "holdings ltd", "holdings ltd", "holdings ltd", "hl", "HLDNGS LTD"),
    ("", "", "", "", "", ""),
    (None, "", "", "", "", ""),
    ("कंपनी", "क पन", "क पन", "", "कप", ""),
    ("Itâ€™s Fine", "it s fine", "fine it s", "", "isf", "IT FN"),
]
ADDRESSES = [
    ("12-3 MG Rd, New Delhi 110001, India", "12 3 mg road new delhi 110001 india", "12-3", "110001", "delhi"),
    ("500 Main St, Hartford, CT 06103", "500 main street hartford court 06103", "500", "06103", ""),
    ("4 Rue de la Paix, Paris", "4 rue de la paix paris", "4", "", "de"),
    ("98765 Oak Ave", "98765 oak avenue", "", "98765", ""),
    ("7 Elm Dr, New York 10001-1234", "7 elm drive new york 10001 1234", "7", "100011234", "ny"),
]


def raw(spark, names, addresses):
    return spark.createDataFrame([(1, f"S1-{i}", i, n, a, "US") for i, (n, a) in enumerate(zip(names, addresses))], "source int, entity_id string, num long, business_name string, business_address string, country string")


def test_names(spark):
    got = linkage.normalise(raw(spark, [n[0] for n in NAMES], [""] * len(NAMES))).orderBy("num").collect()
    for row, want in zip(got, NAMES):
        assert (row["name_core"], row["name_sorted"], row["name_suffixes"], row["name_initials"]) == want[1:5], want
        assert row["name_phon"].strip() == want[5]
    assert got[6]["name_script"] == "devanagari" and got[0]["name_script"] == "latin"


def test_addresses(spark):
    got = linkage.normalise(raw(spark, ["x"] * len(ADDRESSES), [a[0] for a in ADDRESSES])).orderBy("num").collect()
    for row, want in zip(got, ADDRESSES):
        assert (row["addr_norm"], row["houseno"], row["postal"], row["state"]) == want[1:], want


def test_transliteration():
    assert [tx.romanise_one(s) for s in ("नगर", "कंपनी", "दिल्ली 12", "বাংলা", "latin")] == ["nagara", "kaMpanI", "dillI 12", "bAMlA", "latin"]


def test_keys_of_names_in_another_script(spark):
    """The rendering takes the place of the native name in sig, phon and ini and stands beside it in pfx and tok."""
    records = linkage.normalise(raw(spark, ["नगर सेवा Ltd", "Завод Волга"], ["5 Main Rd Texas", ""]))
    keys = {}
    for r in linkage.blocking_keys(records).collect():
        keys.setdefault((r["entity_id"], r["family"]), []).append(r["payload"])
    assert keys["S1-0", "sig"] == ["nagara seva"] and keys["S1-0", "phon"] == ["NGR SV"]
    assert sorted(keys["S1-0", "pfx"]) == sorted(["nagara seva seva", "नगर व स स"])
    assert {"nagara", "seva"} <= set(keys["S1-0", "tok"]) and "नगर" in keys["S1-0", "tok"]
    assert keys["S1-0", "combo"] == ["5|नगर"] and keys["S1-0", "hnstate"] == ["5|tx"]
    assert keys["S1-1", "sig"] == ["волга завод"] and len(keys["S1-1", "pfx"]) == 1
    plain = linkage.normalise(raw(spark, ["नगर"], [""]), transliterate=None).first()
    assert plain["name_translit"] == plain["name_sorted"] == "नगर"


def test_cheap_scores_of_another_script(spark):
    """A counterpart in another script is compared by its rendering too; an S1 name in another script is not."""
    records = linkage.normalise(raw(spark, ["Nagara One", "नगर One", "Nagara One"], [""] * 3))
    pairs = spark.createDataFrame([("S1-0", "S1-1"), ("S1-1", "S1-2")], "s1_id string, other_id string")
    got = {r["s1_id"]: (round(r["pri"], 3), round(r["sec"], 3)) for r in linkage.cheap_scores(pairs, records).collect()}
    assert got == {"S1-0": (1.0, 1.0), "S1-1": (0.333, 0.5)}


def test_text_functions(spark):
    df = spark.createDataFrame([("Œuvre ÉTÉ™ ﬁn & Co.", 8), ("aé日", 3), ("aé日", 6), ("", 4), (None, 4)], "s string, n int")
    got = [r[0] for r in df.select(tx.profile_norm(F.col("s"))).collect()]
    assert got == ["œuvre ététm fin and co", "aé日", "aé日", "", ""]
    assert [df.filter(F.col("n") == n).select(tx.truncate_bytes(F.col("s"), n)).first()[0] for n in (8, 3, 6)] == ["Œuvre ", "aé", "aé日"]
    codes = spark.createDataFrame([("S2-7",), ("S3-7",), ("x",), ("S4-1",), ("S2-",)], "i string").select(d.encode_id(F.col("i"))).collect()
    assert [r[0] for r in codes] == [7, 7 + (1 << 31), None, None, None]


def test_kernels():
    assert sim.jaro_winkler_one("abc", "abd") == pytest.approx(0.822222, abs=1e-6)
    assert sim.jaro_winkler_one("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert sim.indel_one("kitten", "sitting") == pytest.approx(2 * 4 / 13)
    assert sim.token_set_one("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0
    assert sim.partial_one("bear", "the bear sat") == 1.0 and sim.partial_one("", "") == 1.0 and sim.token_set_one("", "a") == 0.0


def test_partial_tries_no_less_than_all_windows():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 14))) for _ in range(2))
        x, y = sorted((a, b), key=len)
        want = float(not y) if not x else max(sim.indel_one(x, y[max(0, i) : i + len(x)]) for i in range(1 - len(x), len(y)))
        assert sim.partial_one(a, b) == pytest.approx(want), (a, b)


BUCKET = "family string, other_source int, country string, payload string, c1 long, c2 long, pc long"


def test_budget_overshoots_by_one_bucket(spark):
    buckets = spark.createDataFrame([("f", 2, "US", str(p), 1, p, p) for p in (1, 2, 3, 10)], BUCKET)
    for budget, want in ((2, [1, 2]), (3, [1, 2, 3])):
        kept = blocking.budget_keep(blocking.under_cap(buckets, 5), budget)
        assert sorted(r["pc"] for r in kept.collect()) == want
    assert sorted(r["pc"] for r in blocking.under_cap(buckets, 5, {"f": 2}).collect()) == [1, 2]


def test_budget_keep_equals_a_running_total(spark):
    rng = random.Random(3)
    rows = [(f, s, rng.choice(("US", "IN")), f"{i:03d}", 1, p, p) for f in "ab" for s in (2, 3) for i in range(60) for p in [rng.randint(1, 6)]]
    for budget in (0, 7, 50, 10_000):
        want = []
        for f in "ab":
            for s in (2, 3):
                total = 0
                for r in sorted((r for r in rows if r[:2] == (f, s)), key=lambda r: (r[6], r[2], r[3])):
                    want += [r] if total <= budget else []
                    total += r[6]
        assert sorted(tuple(r) for r in blocking.budget_keep(spark.createDataFrame(rows, BUCKET), budget).collect()) == sorted(want)


def test_trimmed_budgets(spark):
    buckets = spark.createDataFrame([("a", 2, "US", "x", 1, 30, 30), ("b", 3, "US", "y", 1, 70, 70), ("c", 2, "US", "z", 1, 1, 1)], BUCKET)
    got = lambda full: {r["family"]: r["budget"] for r in blocking.trimmed_budgets(buckets, 100, full, 50).collect()}
    assert got(101) == {"a": 30, "b": 70, "c": 1} and got(100) == {"a": 14, "b": 34, "c": 1}


def test_entity_aggregates(spark):
    rows = [("x", i, s) for i, s in enumerate((1.0, 0.8, 0.8, 0.5))] + [("y", 0, 0.6)]
    got = {r[0]: tuple(round(v, 6) for v in r[1:]) for r in blocking.entity_aggregates(spark.createDataFrame(rows, "s1_id string, rnk int, pri double")).collect()}
    assert got == {"x": (1.0, 0.2, 0.775, 3), "y": (0.6, 0.6, 0.6, 0)}


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_source_files(spark, tmp_path):
    path = write(tmp_path / "s.tsv", b"entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-00001\tA\tB\tUS\textra\nbad\tA\tB\tC\nS2-7\tonly\nS3-1\tx\xffy\t\t\n")
    rows = [tuple(r) for r in d.read_source(spark, path).collect()]
    assert rows == [("S1-00001", "A", "B", "US\textra"), ("S2-7", "only", "", ""), ("S3-1", "x�y", "", "")]
    assert d.read_source(spark, path, 2).count() == 2
    assert [tuple(r) for r in d.positions(spark, path).orderBy("position").collect()] == [("S1-00001", 0), ("S2-7", 1), ("S3-1", 2)]
    got = profile.file_inventory(spark, path).first()
    assert (got["n_rows"], got["header_ok"], got["odd_fields"], got["undecodable"], got["fits"]) == (4, True, 2, 1, True)
    truth = write(tmp_path / "g.tsv", "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2,,x\nS1-2\t\nS1-1\tS2-9,S2-9\nS1-3\tS1-4\tz\n\tS2-1\n")
    assert sorted((r[0], r[1]) for r in d.read_ground_truth(spark, truth).collect()) == [("S1-1", ["S2-1", "S3-2"]), ("S1-1", ["S2-9", "S2-9"]), ("S1-2", []), ("S1-3", [])]
    assert {r["s1_id"]: r["others"] for r in d.merged_truth(d.read_ground_truth(spark, truth)).collect()} == {"S1-1": ["S2-1", "S2-9", "S3-2"], "S1-2": [], "S1-3": []}
    issues = {r["issue"]: r["n"] for r in d.ground_truth_issues(spark, truth).collect()}
    assert issues == {"decode error": 0, "wrong column count": 1, "empty entity": 1, "repeated id": 1, "source 1 id": 1, "unknown prefix": 1, "repeated entity": 1}


def test_positions_over_many_splits(spark, tmp_path):
    path = write(tmp_path / "big.tsv", "h\n" + "".join(f"S2-{7 * i}\tname {i}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = d.positions(spark, path)
        assert got.count() == 20_000 and got.filter("CAST(substring(entity_id, 4) AS BIGINT) <> 7 * position").count() == 0
        assert d.lines_of(spark, path).agg(F.max("line"), F.count("line")).first()[:] == (20_001, 20_001)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lists_keep_their_order(spark, tmp_path):
    out = str(tmp_path / "out")
    lists = spark.createDataFrame([("S1-10", "S2-1,S3-2", 2), ("S1-9", "", 1), ("S1-2", "S2-5", 3)], "s1_id string, ids string, place int").repartition(3)
    d.write_lists(lists, out, d.CANDIDATES, [F.col("place")])
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{out}/part-*")))
    assert text == "source1_entity_id\tcandidate_entity_ids\nS1-9\t\nS1-10\tS2-1,S3-2\nS1-2\tS2-5\n"


HEADER = "source1_entity_id\tmatched_entity_ids\n"
CASES = [
    ("", "file empty", 1, ""),
    ("source1_entity_id,matched_entity_ids\n", "separated by commas", 1, ""),
    ("entity\tids\n", "wrong header", 1, ""),
    (HEADER + "S1-1\tS2-1\nS1-2\n\nS1-2\t\n", "row without a tab", 1, "3"),
    (HEADER + "S1-1\t\nS1-2\t\nS1-1\tS2-1\n", "repeated entity", 1, "S1-1"),
    (HEADER + "S1-1\tS2-1,S2-1\nS1-2\t\n", "repeated id in a list", 1, "S1-1"),
    (HEADER + "S1-1\tS1-2\nS1-2\t\n", "source 1 id in a list", 1, "S1-2"),
    (HEADER + "S1-1\t7,S2-1\nS1-2\tx\n", "id without a prefix", 2, "7, x"),
    (HEADER + "S1-1\tS2-4\nS1-2\t\n", "unknown id", 1, "S2-4"),
    (HEADER + "S1-1\t\n", "required entity missing", 1, "S1-2"),
    (HEADER + "S1-1\t\nS1-2\t\nS1-3\t\n", "entity not required", 1, "S1-3"),
    (HEADER.encode() + b"S1-1\tS2-1\nS1-2\t\xff\n", "not UTF-8", 1, "3"),
    (HEADER + "S1-1\tS2-1,S3-1\n\nS1-2\t\n", None, 0, ""),
]


@pytest.mark.parametrize("data,rule,n,examples", CASES, ids=[str(c[1]) for c in CASES])
def test_validator_rules(spark, tmp_path, data, rule, n, examples):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "entity_id string")
    path = write(tmp_path / "m.tsv", data)
    found = [(r["rule"], r["n"], r["examples"]) for r in validate.validate(spark, path, None, ids("S1-1", "S1-2"), ids("S2-1", "S3-1")).collect() if r["n"]]
    assert found == ([(rule, n, examples)] if rule not in (None, "not UTF-8") else [] if rule is None else [x for x in found if x[0] in ("not UTF-8", "id without a prefix")])
    if rule == "not UTF-8":
        assert ("not UTF-8", 1, "3") in found


def test_validator_of_two_files(spark, tmp_path):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "entity_id string")
    m = write(tmp_path / "m.tsv", HEADER + "S1-1\tS2-1\nS1-2\tS3-1\n")
    c = write(tmp_path / "c.tsv", HEADER.replace("matched", "candidate") + "S1-1\tS2-1,S3-1\nS1-2\tS2-1\n")
    got = lambda *a: [(r["file"], r["rule"], r["severity"], r["n"], r["examples"]) for r in validate.validate(spark, *a).collect() if r["n"]]
    assert got(m, c, ids("S1-1", "S1-2"), ids("S2-1", "S3-1")) == [("matched_entity_ids", "match that is no candidate", "warning", 1, "S1-2")]
    assert {x[1] for x in got(m, str(tmp_path / "none"), ids("S1-1", "S1-2"))} == {"ids not checked against the files", "file missing"}
    assert got(str(tmp_path / "none"), None, ids("S1-1"), ids("S2-1")) == [("matched_entity_ids", "file missing", "error", 1, "")]
    assert validate.passed(validate.validate(spark, m, c, ids("S1-1", "S1-2"))) and not validate.passed(validate.validate(spark, m, c, ids("S1-3")))


def records(spark, rows):
    columns = ("entity_id", "name_sorted", "houseno", "state", "name_script", "name_initials", "addr_norm")
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def test_every_miss_category(spark):
    a = lambda i, name="", hn="", st="", ini="", addr="", script="latin": (i, name, hn, st, script, ini, addr)
    pairs = {
        "EXACT_NAME": (a("S1-1", "x y"), a("S2-1", "x y", script="thai")),
        "HN_AND_STATE": (a("S1-2", "p", "5", "tx"), a("S2-2", "q", "5", "tx")),
        "TRANSITIVE": (a("S1-3", "other"), a("S2-3", "same kin")),
        "NONLATIN": (a("S1-4", "long word"), a("S2-4", "long नगर", script="devanagari")),
        "SHARED_TOKEN": (a("S1-5", "acme abc", ini="aa"), a("S2-5", "acme xyz", ini="ax")),
        "INITIALS": (a("S1-6", "ab cd ef", ini="ace"), a("S2-6", "ax cx ex", ini="ace")),
        "ADDRESS": (a("S1-7", "ab", addr="5 oakwood road"), a("S2-7", "cd", addr="9 oakwood st")),
        "NONE": (a("S1-8", "abc", "", "", "ab", "12 ab"), a("S2-8", "abd", "", "", "ab", "12 ab")),
    }
    more = [a("S3-3", "same kin"), a("S1-9", ""), a("S2-9", ""), a("S1-10", "", "7"), a("S2-10", "", "7")]
    table = records(spark, [r for p in pairs.values() for r in p] + more)
    lost = [(p[0][0], p[1][0], 90 if c == "NONE" else 65535, c == "NONE") for c, p in pairs.items()]
    lost += [("S1-3", "S3-3", 2, True), ("S1-9", "S2-9", 65535, False), ("S1-10", "S2-10", 65535, False)]
    got = {(r["s1_id"], r["other_id"]): r["category"] for r in diagnose.miss_categories(spark.createDataFrame(lost, "s1_id string, other_id string, rnk int, found boolean"), table, 80).collect()}
    assert got == {(p[0][0], p[1][0]): c for c, p in pairs.items()} | {("S1-9", "S2-9"): "NONE", ("S1-10", "S2-10"): "ADDRESS"}


def test_trace_reasons_and_edges(spark):
    key = "source int, entity_id string, country string, family string, payload string"
    keys = spark.createDataFrame([(1, "S1-1", "US", "tok", "a"), (2, "S2-1", "US", "tok", "a"), (1, "S1-1", "US", "hn", "5"), (2, "S2-1", "US", "hn", "5"), (1, "S1-2", "US", "tok", "b"), (3, "S3-2", "US", "tok", "b"),
        (1, "S1-3", "US", "tok", "c"), (2, "S2-3", "IN", "tok", "c"), (1, "S1-4", "US", "hn", "9")], key)
    buckets = spark.createDataFrame([("tok", 2, "US", "a", 1, 1, 9000), ("hn", 2, "US", "5", 1, 1, 20000), ("tok", 3, "US", "b", 1, 1, 5000)], BUCKET)
    pairs = spark.createDataFrame([("S1-1", "S2-1", False), ("S1-2", "S3-2", False), ("S1-3", "S2-3", False), ("S1-4", "S2-9", False), ("S1-5", "S2-5", True)], "s1_id string, other_id string, found boolean")
    trace = diagnose.traces(pairs, keys, buckets, 5000)
    got = {r["s1_id"]: (r["reason"], r["min_pc"], r["best_family"]) for r in trace.collect()}
    assert got == {"S1-1": ("CAP", 9000, "tok"), "S1-2": ("BUG", 5000, "tok"), "S1-3": ("NOKEY", None, None), "S1-4": ("NOKEY", None, None)}
    assert [tuple(r) for r in diagnose.cap_histogram(trace).collect()] == [(5000, 20000, 1)]
    many = spark.createDataFrame([("CAP", p) for p in (5001, 20000, 20001, 500000, 500001)], "reason string, min_pc long")
    assert sorted((r["low"], r["high"], r["n"]) for r in diagnose.cap_histogram(many).collect() if r["high"]) == [(5000, 20000, 2), (20000, 50000, 1), (100000, 500000, 1)]
    matrix = {(r["family"], r["emission"]): r["n"] for r in diagnose.nokey_matrix(trace, keys).collect()}
    assert matrix["tok", "both"] == 1 and matrix["hn", "s1 only"] == 1 and matrix["tok", "neither"] == 1 and matrix["sig", "neither"] == 2
    curve = {r["cap"]: (r["volume"], r["over"], r["coverage"], r["saved"]) for r in diagnose.cap_curve(buckets, pairs, trace, (5000, 10000), 6000).collect()}
    assert curve == {5000: (5000, False, 0.2, 0), 10000: (14000, True, 0.4, 1)}


def test_greedy_plan():
    """Of the levels of all families the best ratio of saved to added pairs goes first, while the budget lasts."""
    table = {("tok", 10): (100, 0), ("tok", 20): (200, 50), ("tok", 40): (300, 60), ("hn", 10): (10, 0), ("hn", 20): (400, 100), ("hn", 40): (400, 100)}
    assert diagnose.greedy_plan(table, 10, (20, 40), 10_000) == {"tok": 40, "hn": 20}
    assert diagnose.greedy_plan(table, 10, (20, 40), 350) == {"tok": 40, "hn": 10}
    assert diagnose.greedy_plan(table, 10, (20, 40), 100) == {"tok": 10, "hn": 10}


def test_f05_worked_example(spark):
    df = spark.createDataFrame([(2, 3, 2), (0, 0, 0), (0, 1, 0), (0, 0, 1), (0, 2, 3)], "tp long, nh long, nt long")
    assert [r[0] for r in df.select(F.round(evaluate.f05(F.col("tp"), F.col("nh"), F.col("nt")), 3)).collect()] == [0.714, 1.0, 0.0, 0.0, 0.0]


def naive_f05(tp, nh, nt):
    if not nh and not nt:
        return 1.0
    return 1.25 * tp / (nh + 0.25 * nt) if tp else 0.0


def test_grid_and_best_decision_against_brute_force(spark):
    rng = random.Random(5)
    entities = [(f"S1-{i}", "US", 0) for i in range(30)]
    truth = {(f"S1-{rng.randrange(30)}", f"S2-{j}") for j in range(25)}
    scored = [(f"S1-{rng.randrange(20)}", f"S2-{j}", round(rng.random(), 2)) for j in range(150)]
    count = Counter(s for s, _ in truth)
    e = spark.createDataFrame([(s, c, count[s]) for s, c, _ in entities], "s1_id string, country string, n_true long")
    t, sc = spark.createDataFrame(sorted(truth), "s1_id string, other_id string"), spark.createDataFrame(scored, "s1_id string, other_id string, score double")
    want = {}
    for tau in evaluate.TAUS:
        for gate in (None, *evaluate.GATES):
            best = {}
            for s, _, v in scored:
                best[s] = max(best.get(s, 0), v)
            taken = {(s, o) for s, o, v in scored if v >= tau and (gate is None or best[s] >= gate)}
            nh, tp = Counter(s for s, _ in taken), Counter(s for s, _ in taken & truth)
            f = sum(naive_f05(tp[s], nh[s], count[s]) for s, _, _ in entities) / 30
            want[tau, gate] = (round(f, 6), round(len(taken & truth) / len(taken), 6) if taken else 1.0, round(len(taken & truth) / len(truth), 6))
    grid = evaluate.threshold_grid(e, t, sc, "score")
    assert {(r["tau"], r["gate"]): (r["macro_f05"], r["precision"], r["recall"]) for r in grid.collect()} == want
    first = min(want, key=lambda k: (-want[k][0], -want[k][1], k[0], k[1] is not None, k[1] or 0))
    best = evaluate.best_decision(grid).first()
    assert (best["tau"], best["gate"]) == first
    path = cache.fresh_path(spark, "decision")
    cache.write_decision(evaluate.best_decision(grid), grid, path)
    held = cache.read_decision(spark, path)
    assert (held["pair_threshold"], held["entity_gate"], len(held["grid_top"])) == (*first, 25)


def test_roc_area(spark):
    rng = random.Random(8)
    rows = [(round(rng.random(), 1), rng.randint(0, 1)) for _ in range(80)]
    yes, no = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / len(yes) / len(no)
    assert evaluate.roc_area(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()[0] == pytest.approx(want, abs=1e-6)
    assert evaluate.roc_area(spark.createDataFrame([(0.5, 1)], "s double, y int"), "s", "y").first()[0] is None


def test_recall_and_macro_of_nothing(spark):
    entities = spark.createDataFrame([("S1-1", "US", 0), ("S1-2", "US", 2)], "s1_id string, country string, n_true long")
    pairs = spark.createDataFrame([], "s1_id string, other_id string")
    assert evaluate.macro_f05(entities, pairs, pairs).first()[:] == (2, 0.5, 1.0, 0.0)
    assert evaluate.macro_f05(entities.filter("n_true = 0"), pairs, pairs).first()[:] == (1, 1.0, 1.0, 1.0)


def test_splits_are_exact(spark):
    rows = [(f"S1-{i}", ("US", "IN")[i % 3 == 0], i % 7) for i in range(500)] + [("S1-900", "FR", 1)]
    split = learning.stratified_split(spark.createDataFrame(rows, "s1_id string, country string, n_true long"))
    size, val = Counter(), Counter()
    for r in split.collect():
        size[r["stratum"]] += 1
        val[r["stratum"]] += r["part"] == "val"
    assert sum(size.values()) == 501 and all(val[s] == max(1, round(0.1 * size[s])) for s in size)
    parts = Counter(r["part"] for r in learning.learn_split(split).collect())
    fit = 501 - sum(val.values())
    assert parts == {"val": sum(val.values()), "stop": round(0.15 * fit), "learn": fit - round(0.15 * fit)}


def test_training_rows_hold_pairs_that_blocking_missed(spark):
    split = spark.createDataFrame([("a", "learn"), ("b", "stop"), ("c", "val"), ("d", "learn")], "s1_id string, part string")
    candidates = spark.createDataFrame([("a", f"n{i}") for i in range(9)] + [("a", "yes"), ("b", "yes"), ("b", "no"), ("c", "no")], "s1_id string, other_id string")
    truth = spark.createDataFrame([("a", "yes"), ("a", "missed"), ("b", "yes"), ("b", "missed"), ("d", "missed")], "s1_id string, other_id string")
    got = [tuple(r) for r in learning.training_rows(split, candidates, truth).collect()]
    learn = [r for r in got if r[3] == "learn"]
    assert {r[:2] for r in learn if r[2]} == {("a", "yes"), ("a", "missed"), ("d", "missed")} and sum(not r[2] for r in learn) == 6
    assert {r for r in got if r[3] != "learn"} == {("b", "yes", 1.0, "stop"), ("b", "no", 0.0, "stop"), ("c", "no", 0.0, "val")}


def test_training_scoring_and_decision(spark):
    """On features that tell, trees score true pairs higher; the tuned decision takes what the scores say."""
    rng = random.Random(6)
    rows, features = [], []
    for i in range(240):
        for j in range(4):
            label = float(j == 0 and i % 3 > 0)
            rows.append((f"S1-{i}", f"S2-{i}x{j}", label, ("learn", "learn", "stop", "val")[i % 4]))
            features.append((f"S1-{i}", f"S2-{i}x{j}", label * 0.6 + rng.random() * 0.4, rng.random()))
    r, f = spark.createDataFrame(rows, "s1_id string, other_id string, label double, part string"), spark.createDataFrame(features, "s1_id string, other_id string, f1 double, f2 double")
    model = learning.train(r, f, trees=8)
    scored = learning.score(model, f).join(r, ["s1_id", "other_id"]).withColumn("other_source", F.lit(2))
    assert evaluate.roc_area(scored, "score", "label").first()[0] > 0.97
    decided = {(x["s1_id"], x["other_id"]) for x in blocking.decide(scored, "score", 0.5, 0.6).collect()}
    all_scores, best = {(x["s1_id"], x["other_id"]): x["score"] for x in scored.collect()}, {}
    for (s, _), v in all_scores.items():
        best[s] = max(best.get(s, 0), v)
    assert decided == {k for k, v in all_scores.items() if v >= 0.5 and best[k[0]] >= 0.6} and decided
    assert learning.train(r.filter("label = 0"), f) is None
    assert {x["score"] for x in learning.score(None, f).collect()} == {0.0}


def test_position_leak_turns_red(spark):
    at = spark.createDataFrame([(f"S{s}-{i}", i) for s in (1, 2) for i in range(200)], "entity_id string, position long")
    same = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(200)], "s1_id string, other_id string")
    got = diagnose.position_leak(same, at).first()
    assert (got["corr"], got["exact"], got["near"], got["red"]) == (1.0, 1.0, 1.0, True) and got["gap"] == 0.0 and got["gap_shuffled"] > 0.1


def test_kept_tables_are_built_once(spark):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    name = cache.fresh_path(spark, "name")
    for parts in ((name, 1), (name, 1), (name, 2)):
        assert cache.ensure(spark, "kept", parts, build).count() == 3
    assert len(built) == 2


def test_reports_are_lines(spark):
    path = cache.fresh_path(spark, "report")
    cache.write_report(spark.createDataFrame([("b", 2), ("a", None)], "name string, n int"), path, "title")
    assert [r["value"] for r in cache.read_report(spark, path).collect()] == ["title", "name=a  n=", "name=b  n=2"]


def test_pairs_equal_brute_force(spark):
    chain = Chain(spark, SF, Limits(cap=60, top_k=5))
    buckets = {}
    for k in chain.keys.collect():
        buckets.setdefault((k["family"], k["country"], k["payload"]), {1: [], 2: [], 3: []})[k["source"]].append(k["entity_id"])
    want = {(a, b) for sides in buckets.values() for s in (2, 3) if len(sides[1]) * len(sides[s]) <= 60 for a in sides[1] for b in sides[s]}
    assert {(r["s1_id"], r["other_id"]) for r in chain.pairs.collect()} == want
    assert chain.topk.groupBy("s1_id").count().agg(F.max("count")).first()[0] <= 5


def test_commands_end_to_end(spark, tmp_path, capsys):
    """Train on one folder of files, predict on another: the lists hold what the names tell, and the validator passes them."""
    from linkloom.__main__ import main

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    true = {}
    for split in ("train", "test"):
        files = {1: [], 2: [], 3: []}
        for i in range(150):
            name, street = f"{word()} {word()} {word()}", f"{rng.randint(1, 99)} {word()} St, {word()}"
            files[1].append((f"S1-{i}", f"{name} Ltd", street, "US"))
            for s in (2, 3):
                if i % (s + 1):
                    files[s].append((f"S{s}-{i + 500}", name.replace("a", "e", i % 2).title(), street.replace("St", "Street"), "US"))
                    true.setdefault((split, f"S1-{i}"), []).append(f"S{s}-{i + 500}")
                files[s].append((f"S{s}-{i + 2000}", f"{name.split()[0]} {word()}", f"{rng.randint(1, 99)} {word()} Rd", "US"))
        (tmp_path / split).mkdir()
        for s, rows in files.items():
            (tmp_path / split / f"{split}_source{s}.tsv").write_text("\t".join(d.RAW) + "\n" + "".join("\t".join(r) + "\n" for r in rows))
    lines = "".join(f"S1-{i}\t{','.join(true.get(('train', f'S1-{i}'), []))}\n" for i in range(150))
    (tmp_path / "train" / "train_ground_truth.tsv").write_text("\t".join(d.GROUND_TRUTH) + "\n" + lines)
    base = ["--dataset", str(tmp_path), "--out", str(tmp_path / "out")]
    assert main(["inspect", *base], spark) == 0 and main(["block", *base, "--limit", "50"], spark) == 0
    import shutil

    shutil.rmtree(tmp_path / "out")
    assert main(["train", *base], spark) == 0
    assert main(["predict", *base, "--split", "test", "--check-ids"], spark) == 0
    got = {}
    for f in sorted(glob.glob(f"{tmp_path}/out/matching_results.tsv/part-*")):
        for line in open(f).read().splitlines():
            s1, _, ids = line.partition("\t")
            got[s1] = [x for x in ids.split(",") if x]
    assert got.pop("source1_entity_id") and list(got) == [f"S1-{i}" for i in range(150)]
    pairs, want = {(s, x) for s, ids in got.items() for x in ids}, {(k, x) for (split, k), ids in true.items() if split == "test" for x in ids}
    assert len(pairs & want) >= 0.9 * len(want) and len(pairs & want) >= 0.9 * len(pairs)
    shutil.rmtree(tmp_path / "out" / "matching_results.tsv")
    assert main(["validate", *base, "--split", "test"], spark) == 1


CHECKED = ["source_scan", "validator_findings", "records_norm", "transliterated", "family_counts", "topk_candidates", "recall_at_k", "threshold_grid", "miss_taxonomy", "trace_pairs", "level_table", "pair_features", "near_miss", "learn_split"]


@pytest.mark.parametrize("name", CHECKED)
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    text = lambda v: str(v) if isinstance(v, (bool, str, type(None))) else f"{float(v):.5f}"
    got = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    rel = con.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == columns
    assert got == sorted(tuple(text(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall())


def test_every_query_is_registered_and_entry_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_partial_similarity_looks_up_the_shorter_string_once(monkeypatch):
    """The windows share one table of the shorter string's characters; the result is the best of all windows."""
    import random

    from linkloom.functions import similarity as sim

    rng, made = random.Random(4), []
    whole = getattr(sim, "char_places", None)
    monkeypatch.setattr(sim, "char_places", lambda a: made.append(a) or whole(a))
    for _ in range(200):
        a, b = ("".join(rng.choices("abc é", k=rng.randint(1, 9))) for _ in range(2))
        made.clear()
        found, calls = sim.partial_one(a, b), len(made)
        short, long = sorted((a, b), key=len)
        windows = [long[max(0, i) : i + len(short)] for i in range(1 - len(short), len(long))]
        assert calls <= 1 and found == max(1.0 * (a in b or b in a), *(sim.indel_one(short, w) for w in windows))


def test_batched_string_distances_equal_those_of_single_pairs():
    """Lengths around a machine word, beyond a grid and none at all; scripts; edits; a string that ends in NUL."""
    import random

    from linkloom.functions import kernels
    from linkloom.functions import similarity as sim

    rng, a, b = random.Random(3), ["a\0", "\0", "ab"], ["a", "", "ab\0"]
    for k in range(1500):
        alphabet, sizes = rng.choice(["ab", "abc é", "abcdefgh ij", "नगर ab Завод"]), [0, 1, 2, 5, 9, 30, 63, 64, 65, 90, 520] if k % 20 == 0 else [0, 1, 2, 3, 5, 9, 30]
        x, y = ("".join(rng.choices(alphabet, k=rng.choice(sizes))) for _ in "ab")
        if k % 3 == 0 and x:
            cut = rng.randrange(len(x))
            y = x[:cut] + rng.choice(["", "x", "a b"]) + x[cut + rng.randint(0, 2) :]
        a.append(x)
        b.append(y)
    for kind, kernel in sim.KERNELS.items():
        assert kernels.scores((kind,), a, b)[kind].tolist() == [kernel(x, y) for x, y in zip(a, b)], kind
        assert kernels.scores((kind,), [], [])[kind].tolist() == []


def test_feature_matrix_looks_each_pair_up_once(spark):
    from linkloom.operators import learning, linkage
    from linkloom.plans.chain import Chain

    c = Chain(spark, SF)
    pairs = c.topk.select("s1_id", "other_id").limit(200)
    matrix = learning.feature_matrix(pairs, c.records, c.aggregates)
    plan = matrix._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.strip(" :+-").startswith("Join") for line in plan.splitlines()) == 3  # both sides' records, and the aggregates
    keys = ["s1_id", "other_id"]
    apart = linkage.fuzzy_features(pairs, c.records).join(linkage.native_features(pairs, c.records), keys)
    assert sorted(map(tuple, matrix.select(*apart.columns).collect())) == sorted(map(tuple, apart.collect()))


def test_training_reads_the_features_once(spark):
    from pyspark.sql import functions as F

    from linkloom.operators import learning

    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([(f"S1-{i}", f"S2-{i}", float(i % 2), "learn") for i in range(100)], "s1_id string, other_id string, label double, part string")
    features = rows.select("s1_id", "other_id", F.udf(counted, "double").asNondeterministic()("label").alias("f1"))
    assert learning.train(rows, features, trees=2).getNumTrees == 2
    assert seen.value == 100


def test_a_kept_table_is_followed_by_a_release(spark, monkeypatch):
    """Plans and shuffle files of a table that has been written do not stay until the driver's memory is full."""
    from linkloom.sources import cache

    calls = []
    monkeypatch.setattr(cache, "release", lambda s: calls.append(s))
    for _ in range(2):
        assert cache.ensure(spark, "released", (str(id(calls)),), lambda: spark.range(3)).count() == 3
    assert len(calls) == 1
