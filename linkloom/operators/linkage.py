"""Normalised records, blocking keys, capped joins, scores and pair features as DataFrame transformations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import similarity as sim
from linkloom.functions import text as tx
from linkloom.functions.lexicons import ADDRESS_STOP, FAMILIES, NAME_STOP


def _name_parts(raw: Column) -> tuple[Column, Column]:
    toks = tx.tokens(tx.spaced(tx.folded(raw)))
    return toks, tx.core_tokens(toks)


def normalise(raw: DataFrame, transliterate: Callable[[Column, Column], Column] | None = tx.transliterate) -> DataFrame:
    """Name and address parts of raw records.

    transliterate(name, script) renders a name in Latin, or gives null; its rendering is normalised anew, and the native
    form stands where there is none. Without a function all names keep their native form.
    """
    df = raw.withColumn("name_script", tx.script(F.coalesce("business_name", F.lit(""))))
    rendered = transliterate(F.col("business_name"), F.col("name_script")) if transliterate else F.lit(None).cast("string")
    df = df.withColumn("rendered", rendered).withColumn("work", tx.folded(F.col("business_address")))
    df = df.withColumn("toks", _name_parts(F.col("business_name"))[0]).withColumn("core", tx.core_tokens(F.col("toks")))
    df = df.withColumn("latin", F.when(F.col("rendered").isNotNull(), F.array_join(F.array_sort(_name_parts(F.col("rendered"))[1]), " ")))
    df = df.withColumn("atoks", tx.expand_streets(tx.tokens(tx.spaced(F.col("work"))))).withColumn("postal", tx.postal(F.col("work")))
    sorted_name = F.array_join(F.array_sort("core"), " ")
    return df.select(
        "source", "entity_id", "num", "country",
        F.array_join("core", " ").alias("name_core"), sorted_name.alias("name_sorted"), F.array_join(tx.suffix_tokens(F.col("toks")), " ").alias("name_suffixes"),
        tx.initials(F.col("core")).alias("name_initials"), tx.phon_name(F.col("core")).alias("name_phon"), "name_script",
        F.coalesce(F.when(F.col("latin") != "", F.col("latin")), sorted_name).alias("name_translit"),
        F.array_join("atoks", " ").alias("addr_norm"), tx.house_number(F.col("work"), F.col("postal")).alias("houseno"), "postal", tx.state(F.col("atoks")).alias("state"),
        tx.not_ascii(F.coalesce("business_name", F.lit(""))).alias("name_nonascii"), tx.not_ascii(F.coalesce("business_address", F.lit(""))).alias("addr_nonascii"),
    )


def blocking_keys(records: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """source, entity_id, country, family, payload: a row per key, duplicates kept; all families in one pass.

    A name in another script whose Latin rendering differs gives its signature, phonetic key and initials from the
    rendering, and prefix and token keys from both.
    """
    core, addr, order = tx.tokens(F.col("name_core")), tx.tokens(F.col("addr_norm")), tx.tokens(F.col("name_sorted"))
    none = F.array().cast("array<string>")
    foreign = (F.col("name_script") != "latin") & (F.col("name_translit") != F.col("name_sorted"))
    latin = F.when(foreign, tx.tokens(F.col("name_translit"))).otherwise(none)
    spoken = F.when(foreign, latin).otherwise(core)
    one = lambda cond, c: F.when(cond, F.array(c)).otherwise(none)
    absent = lambda stop: lambda t: ~F.array_contains(tx.literal_array(stop), t)
    ends = lambda t: F.array_join(F.concat(F.slice(t, 1, 3), F.slice(t, -1, 1)), " ")
    hn, first_letters = F.col("houseno"), tx.initials(spoken)
    pairs = F.transform(F.when(F.size(addr) > 1, F.sequence(F.lit(1), F.size(addr) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat_ws(" ", F.get(addr, i - 1), F.get(addr, i)))
    payloads = {
        "sig": F.array(F.col("name_translit")),
        "pfx": F.concat(F.array(ends(order)), one(F.size(latin) > 0, ends(latin))),
        "tok": F.filter(F.concat(core, latin), lambda t: (F.length(t) >= 3) & absent(NAME_STOP)(t)),
        "phon": F.array(tx.phon_name(spoken)),
        "ini": one((F.size(spoken) >= 3) & (F.length(first_letters) >= 3), first_letters),
        "hn": one(hn != "", hn),
        "atok": F.filter(addr, lambda t: (F.length(t) >= 4) & t.rlike(r"^\p{L}+$") & absent(ADDRESS_STOP)(t)),
        "combo": one((hn != "") & (F.size(core) > 0), F.concat_ws("|", hn, F.get(core, F.lit(0)))),
        "hnstate": one((hn != "") & (F.col("state") != ""), F.concat_ws("|", hn, F.col("state"))),
        "atok2": pairs,
    }
    tagged = lambda f: F.transform(payloads[f], lambda p: F.struct(F.lit(f).alias("family"), p.alias("payload")))
    every = F.flatten(F.array(*map(tagged, families)))
    named = records.filter("name_sorted <> ''")
    return named.select("source", "entity_id", "country", F.explode(every).alias("k")).select("source", "entity_id", "country", "k.family", "k.payload")


def with_both(pairs: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """pairs(s1_id, other_id) with columns of both sides, as a_... and b_..."""
    a = records.select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = records.select(F.col("entity_id").alias("other_id"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return pairs.join(a, "s1_id").join(b, "other_id")


def cheap_scores(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """pri (token Jaccard) and sec (containment) on sorted names, each raised by the transliterated name for a non-Latin counterpart."""
    df = with_both(pairs, records, ["name_sorted", "name_translit", "name_script"])
    # each name is split once for a pair, and common tokens are counted once
    df = df.withColumns({k: F.array_distinct(tx.tokens(F.col(c))) for k, c in (("x", "a_name_sorted"), ("y", "b_name_sorted"), ("t", "b_name_translit"))})
    df = df.withColumns({k: F.size(F.array_intersect("x", k)) for k in ("y", "t")} | {"y_": F.col("y"), "t_": F.col("t")})
    foreign = F.col("b_name_script") != "latin"
    plain, rendered = (sim.shares(F.col("x"), F.col(f"{k}_"), F.col(k)) for k in ("y", "t"))
    pri, sec = (F.when(foreign, F.greatest(p, r)).otherwise(p) for p, r in zip(plain, rendered))
    return df.select(*pairs.columns, pri.alias("pri"), sec.alias("sec"))


FEATURE_COLUMNS = ["name_core", "name_sorted", "name_translit", "name_suffixes", "name_initials", "name_phon", "name_script", "name_nonascii", "addr_norm", "houseno", "postal", "state"]


def _with_tokens(df: DataFrame) -> DataFrame:
    """df with both sides' columns, their tokens (each side split once), and how many are common."""
    parts = {"core": "name_core", "addr": "addr_norm", "suf": "name_suffixes"}
    df = df.withColumns({f"{side}_{k}": tx.tokens(F.col(f"{side}_{c}")) for k, c in parts.items() for side in "ab"})
    df = df.withColumns({f"{side}_{k}_set": F.array_distinct(f"{side}_{k}") for k in parts for side in "ab"})
    return df.withColumns({f"{k}_common": F.size(F.array_intersect(f"a_{k}_set", f"b_{k}_set")) for k in parts})


def _native() -> dict[str, Column]:
    """The pair features that need no string-distance kernel, over the columns of _with_tokens."""
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    num = lambda c: c.cast("double")
    core_a, core_b, addr_a, addr_b, suf_a, suf_b = a("core"), b("core"), a("addr"), b("addr"), a("suf"), b("suf")
    both = (F.size(core_a) > 0) & (F.size(core_b) > 0)
    longest = F.greatest(F.size(core_a), F.size(core_b))
    la, lb = F.length(a("name_sorted")), F.length(b("name_sorted"))
    share = lambda x, y: F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.filter(x, lambda t: F.array_contains(y, t))) / F.size(x))
    (jc, cc), (ja, ca), (js, _) = (sim.shares(a(f"{k}_set"), b(f"{k}_set"), F.col(f"{k}_common")) for k in ("core", "addr", "suf"))
    out = {
        "jacc_core": jc, "contain_core": cc,
        "first_eq": num(both & (F.get(core_a, F.lit(0)) == F.get(core_b, F.lit(0)))), "last_eq": num(both & (F.try_element_at(core_a, F.lit(-1)) == F.try_element_at(core_b, F.lit(-1)))),
        "phon_eq": num((a("name_phon") != "") & (a("name_phon") == b("name_phon"))), "ini_eq": num((F.length(a("name_initials")) >= 3) & (a("name_initials") == b("name_initials"))),
        "suff_jacc": F.when((F.size(suf_a) == 0) & (F.size(suf_b) == 0), 1.0).otherwise(js),
        "ntok_diff": F.when(both, F.abs(F.size(core_a) - F.size(core_b)) / longest).otherwise(0.0), "nchar_diff": F.abs(la - lb) / F.greatest(la, lb, F.lit(1)),
        "addr_jacc": ja, "addr_contain": ca,
    }
    for c in ("houseno", "postal", "state"):
        here, there = a(c) != "", b(c) != ""
        out |= {f"{c}_both": num(here & there), f"{c}_eq": num(here & there & (a(c) == b(c))), f"{c}_xor": num(here != there)}
    out |= {
        "name_in_addr": share(core_a, addr_b), "addr_in_name": share(core_b, addr_a), "prod_jacc": jc * ja, "min_jacc": F.least(jc, ja), "other_nonascii": num(b("name_nonascii")),
        "cross_script": num(a("name_script") != b("name_script")), "suff_count_diff": num(F.abs(F.size(suf_a) - F.size(suf_b))),
    }
    return {k: F.round(c, 6) for k, c in out.items()}


def _with_fuzzy(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """df with both sides' columns and the string distances, and the nine features made of them.

    Of most records the rendered name is the name itself; those pairs are not compared again.
    """
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    rendered = F.when(b("name_translit") != b("name_sorted"), b("name_translit"))
    df = df.withColumn("n", sim.fuzzy(("jaro_winkler", "partial", "indel"), a("name_sorted"), b("name_sorted"))).withColumn("c", sim.fuzzy(("token_set",), a("name_core"), b("name_core")))
    df = df.withColumn("t", sim.fuzzy(("jaro_winkler",), a("name_sorted"), rendered)).withColumn("d", sim.fuzzy(("token_set", "indel", "partial"), a("addr_norm"), b("addr_norm")))
    out = {
        "jw_sorted": "n.jaro_winkler", "tsr_core": "c.token_set", "pr_sorted": "n.partial", "ratio_sorted": "n.indel", "indel_sorted": "n.indel", "jw_translit": "t.jaro_winkler",
        "tsr_addr": "d.token_set", "indel_addr": "d.indel", "pr_addr": "d.partial",
    }
    found = {k: F.col(c) for k, c in out.items()}
    return df, found | {"jw_translit": F.when(rendered.isNull(), F.col("n.jaro_winkler")).otherwise(F.col("t.jaro_winkler"))}


def native_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """The pair features that need no string-distance kernel."""
    return _with_tokens(with_both(pairs, records, FEATURE_COLUMNS)).select("s1_id", "other_id", *[c.alias(k) for k, c in _native().items()])


def fuzzy_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """The nine string-distance features."""
    df, out = _with_fuzzy(with_both(pairs, records, ["name_core", "name_sorted", "name_translit", "addr_norm"]))
    return df.select("s1_id", "other_id", *[c.alias(k) for k, c in out.items()])


def all_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """The string-distance features and the others, each pair looked up in the records once."""
    df, out = _with_fuzzy(with_both(pairs, records, FEATURE_COLUMNS))
    return _with_tokens(df).select("s1_id", "other_id", *[c.alias(k) for k, c in (out | _native()).items()])
