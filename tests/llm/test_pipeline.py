"""The pipeline's stages on odd rows, and a run of all five against brute-force versions."""

import random
from collections import Counter

import pytest

import corpus_pipeline as p
from tests.conftest import SF
from tests.llm.test_operators import crc, library, shingles

DOC = "doc_id long, text string, lang string, source string, n_chars long, rank int"


def good(seed, lines=12):
    """A text of sentences of invented words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("dlmnrst") for _ in range(rng.randint(2, 4)))
    return "\n".join(" ".join(word() for _ in range(14)).capitalize() + "." for _ in range(lines))


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A data folder with labels only."""
    out = str(tmp_path_factory.mktemp("tables"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


def docs_of(spark, given):
    return spark.createDataFrame([(i, t, "en", s, 1, 5) for i, t, s in given], DOC).repartition(3)


def shown(df):
    return sorted(((str(r["doc_id"]), r["text"], r["source"]) for r in df.collect()), key=str)


def test_stages_return_the_columns_of_documents(spark, folder):
    empty = spark.createDataFrame([], DOC)
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, empty, folder).columns == list(p.COLUMNS), name
        assert stage(spark, empty, folder).count() == 0
    assert p.packing(spark, empty, folder).count() == 0


def test_quality_judges_rows(spark, folder):
    a, b = good(1), good(2)
    given = [(None, "short", "s"), (7, "short", "s"), (7, a, "s"), (None, b, None), (7, a, "s"), (8, None, "s"), (9, "", "s")]
    assert shown(p.quality_rules(spark, docs_of(spark, given), folder)) == sorted([("7", a, "s"), ("7", a, "s"), ("None", b, None)], key=str)


def test_exact_dedup_keeps_one_row_of_each_text(spark, folder):
    given = [(1, "aa", "s"), (2, "aa", "s"), (1, "bb", "s"), (5, "cc", "s"), (5, "cc", "s"), (None, "dd", "s"), (None, "dd", "s"), (3, None, "s"), (2, "", "s"), (4, "z " * 50_000, "s")]
    want = [("2", "aa", "s"), ("1", "bb", "s"), ("5", "cc", "s"), ("None", "dd", "s"), ("3", None, "s"), ("4", "z " * 50_000, "s")]
    assert shown(p.exact_dedup(spark, docs_of(spark, given), folder)) == sorted(want, key=str)


def test_near_dedup_keeps_one_row_of_each_group(spark, folder):
    base = good(3)
    near, other = base + " end", good(4)
    given = [(5, base, "s"), (5, other, "s"), (3, near, "s"), (None, base + " x", "s"), (9, other, "s"), (9, other, "s"), (1, None, "s"), (1, "", "s"), (2, "w " * 50_000, "s")]
    want = [("3", near, "s"), ("5", other, "s"), ("1", None, "s"), ("1", "", "s"), ("2", "w " * 50_000, "s")]
    assert shown(p.near_dedup(spark, docs_of(spark, given), folder)) == sorted(want, key=str)


def test_mixing_counts_rows(spark, folder):
    """Rows that share an id but not a text have copies of their own; nothing with words of a capped source is lost."""
    given = [(1, "a b c", "s"), (1, "d e", "s"), (None, "f g", "s"), (2, "h i", "t"), (2, "h i", "t"), (3, None, "t"), (4, "j " * 40_000, "u")]
    out = Counter(r["text"] for r in p.mix_sources(spark, docs_of(spark, given), folder).collect())
    assert out["a b c"] == 3 and out["d e"] == 3 and out["f g"] == 3 and out["h i"] == 6 and None not in out and 0 <= out["j " * 40_000] <= 3


def test_packing_takes_each_row_as_a_document(spark, folder):
    given = [(1, "a b", "s"), (1, "a b", "s"), (1, "c", "s"), (None, "d", "s"), (2, None, "s")]
    out = p.packing(spark, docs_of(spark, given), folder).collect()
    assert sorted(r["ids_crc32"] for r in out) == sorted(crc(x) for x in library([t for _, t, _ in given], 1))
    assert sorted(r["offset"] for r in out)[0] == 0 and len({(r["sequence_id"], r["offset"]) for r in out}) == 5


def test_run_against_brute_force(spark, tmp_path):
    """All five stages over the smallest tables with more copies, near copies and clashing ids."""
    from linkloom.llm import quality_crf as q

    rng = random.Random(4)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    base = [tuple(r) for r in table.collect()]
    more = [(i + 1, t, g, s, n) for i, t, g, s, n in base[:20]] + [(None, t, g, s, n) for _, t, g, s, n in base[20:30]]
    for i, t, g, s, n in base[30:60]:
        words = (t or "").split(" ")
        if len(words) > 60:
            words[rng.randrange(len(words))] = "changed"
        more.append((i, " ".join(words), g, s, n))
    given = base + more + more[:5]
    folder = str(tmp_path)
    spark.createDataFrame(given, table.schema).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    model = q.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good_rows = [r for r in given if q.judge(r[1], model)[6]]
    assert sorted(map(str, rows(p.quality_rules(spark, docs, folder)))) == sorted(map(str, good_rows))

    order = lambda r: (r[0] is not None, r[0] or 0, str(r))
    unique = {}
    for r in good_rows:
        if r[1] not in unique or order(unique[r[1]]) < order(r):
            unique[r[1]] = r
    got = rows(p.exact_dedup(spark, spark.createDataFrame(good_rows, table.schema), folder))
    assert sorted((str(r[0]), r[1]) for r in got) == sorted((str(r[0]), r[1]) for r in unique.values())

    sets = [shingles(r[1], 5) for r in got]
    root = list(range(len(got)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(got)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * (x := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - x):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(got):
        groups.setdefault(find(i), []).append(r)
    least = {min((r[0] is None, r[0] or 0) for r in g): g for g in groups.values()}
    kept = rows(p.near_dedup(spark, spark.createDataFrame(got, table.schema), folder))
    assert len(kept) == len(groups) < len(got)
    for g in groups.values():
        mine = [r for r in kept if r in g]
        assert len(mine) == 1 and (mine[0][0] is None, mine[0][0] or 0) == min((r[0] is None, r[0] or 0) for r in g)
    assert least

    mixed = rows(p.mix_sources(spark, spark.createDataFrame(kept, table.schema), folder))
    copies = Counter(mixed)
    assert set(copies) <= set(kept) and max(copies.values()) <= 3
    size, taken = Counter(), Counter()
    for r in kept:
        size[r[3]] += len((r[1] or "").encode().split())
    for r in mixed:
        taken[r[3]] += len((r[1] or "").encode().split())
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight, target, left, free = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, sum(size.values()), set(names)
    while over := {s for s in free if weight[s] * left / sum(weight[x] for x in free) > 3 * size[s]}:
        target |= {s: 3 * size[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    target |= {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
    smallest = {s: min(len((r[1] or "").encode().split()) for r in kept if r[3] == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= smallest[s] for s in names)

    packed = p.packing(spark, spark.createDataFrame(mixed, table.schema), folder).collect()
    ids = library([r[1] for r in mixed], 1)
    assert sum(r["length"] for r in packed) == sum(map(len, ids))
    have, want = Counter(), Counter()
    for r in packed:
        have[str(r["doc_id"]), r["doc_tokens"]] += r["length"]
    for r, x in zip(mixed, ids):
        want[str(r[0]), len(x)] += len(x)
    assert have == want

    result = p.run(spark, folder).collect()
    assert sum(r["length"] for r in result) == sum(map(len, ids)) and sorted((str(r["doc_id"]), r["length"]) for r in result if r["length"] == 2048) == sorted((str(r["doc_id"]), r["length"]) for r in packed if r["length"] == 2048)
