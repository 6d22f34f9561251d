"""Each operator against a brute-force version, on the smallest tables plus rows of odd cases."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import pytest

from tests.conftest import SF

DOC = "doc_id long, text string, lang string, source string, n_chars long, rank int, rows string"
LONG = "word " * 3000 + "end"
ODD = [
    (9000, None, None, None, None, 1, "x"),
    (9001, "", "en", None, 0, 1, "x"),
    (9002, " \n\t ", "en", "src0", 4, 1, "x"),
    (9003, "One two three", "en", "", 13, 1, "x"),
    (9004, "one TWO three", "fr", "src0", 13, 1, "x"),
    (9005, LONG, "en", "src0", len(LONG), 1, "x"),
    (9005, LONG, "en", "src0", len(LONG), 1, "x"),
    (9006, "日本語 テキスト。 \U0001F600 <|endoftext|> x", None, "src1", 9, 1, "x"),
    (9007, "a  b\n\n c\r\nd e 12 '' don't\x1c", "en", "src1", 9, 1, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    base = spark.read.parquet(f"{SF}/documents.parquet").withColumn("rank", F.lit(1)).withColumn("rows", F.lit("x"))
    return base.union(spark.createDataFrame(ODD, DOC)).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def rows(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return (text or "").encode().split()


def test_quality(spark, docs, empty):
    from linkloom.llm import quality_crf as q

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = q.train(docs, labels, sample=60)
    texts = {(r["doc_id"], r["text"]) for r in rows(docs)}
    by_id = dict(texts)
    out = rows(q.quality_lines(docs, model))
    assert len(out) == docs.count()
    for r in out:
        text = by_id[r["doc_id"]] or ""
        w = words(text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines, dup, seen = text.split("\n"), 0, set()
        for line in lines:
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        assert r["n_words"] == len(w) and r["n_repeat_words"] == len(covered) and r["n_dup_lines"] == dup
        assert r["word_chars"] == sum(len(x.decode()) for x in w) and r["n_symbols"] == sum(c in q.SYMBOLS for c in text)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert q.quality_lines(empty, model).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in rows(q.quality_lines(docs, None)))


def test_viterbi_finds_the_best_path():
    from itertools import product

    from linkloom.llm.quality_crf import viterbi

    rng = random.Random(5)
    for _ in range(40):
        e = [rng.uniform(-2, 2) for _ in range(rng.randint(1, 7))]
        t = [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
        worth = lambda p: sum(x * s for x, s in zip(e, p)) + sum(t[a][b] for a, b in zip(p, p[1:]))
        assert worth(viterbi(e, t)) == pytest.approx(max(map(worth, product((0, 1), repeat=len(e)))))


def test_warc(spark):
    from linkloom.llm import warc_zstd as w

    page = "page_id long, url string, html string, text string"
    given = [(1, "http://a/x", "<p>é</p>", "t"), (2, None, None, "t"), (3, "http://a/ y", "", "t"), (4, "u", "<p>é</p>", "t"), (5, "u", "x" * 300_000, "t"), (7, "u", "z", "t"), (7, "u", "z", "t"), (6, "u", "<p>é</p>", "t")]
    df = spark.createDataFrame(given, page).repartition(3)
    out = rows(w.warc_round_trip(df))
    assert len(out) == len(given)
    first = {}
    for i, _, h, _ in sorted(given, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    html = {i: h or "" for i, _, h, _ in given}
    for r in out:
        data = html[r["page_id"]].encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        own = first[html[r["page_id"]]] == r["page_id"]
        assert r["record_type"] == ("response" if own else "revisit") and r["refers_to"] == (None if own else first[html[r["page_id"]]])
    assert w.warc_round_trip(spark.createDataFrame([], page)).count() == 0
    assert all(r["record_type"] == "response" for r in rows(w.warc_round_trip(df, least=10)))


def test_warc_reader_rejects_damage():
    import zstandard

    from linkloom.llm import warc_zstd as w

    d = w.train_dictionary([b"abc"])
    pack = lambda x: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d)).compress(x)
    good = w.record(1, "u", b"payload", None)
    assert next(w.read_archive(w.dictionary_frame(d) + pack(good)))["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"payload", b"payloaX"), good.replace(b"WARC/1.1", b"WARX/1.1"), good.replace(b"WARC-Date: 1970-01-01T00:00:00Z\r\n", b"")):
        with pytest.raises(ValueError):
            list(w.read_archive(w.dictionary_frame(d) + pack(bad)))
    for bad in (pack(good), (w.dictionary_frame(d) + pack(good))[:-3], b""):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(w.read_archive(bad))


def test_exact_dedup(docs, empty):
    from linkloom.llm.extendible_dedup import exact_dedup

    given = rows(docs)
    keep, size = {}, Counter(r["text"] or "" for r in given)
    for r in given:
        keep[r["text"] or ""] = max(keep.get(r["text"] or "", -1), r["doc_id"])
    by_id = {r["doc_id"]: r["text"] or "" for r in given}
    out = rows(exact_dedup(docs, capacity=8, max_depth=6))
    assert len(out) == len(given)
    for r in out:
        text = by_id[r["doc_id"]]
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (keep[text], size[text], hashlib.sha256(text.encode()).hexdigest())
        assert r["kept"] == (r["doc_id"] == keep[text])
    assert exact_dedup(empty).count() == 0


def test_directory_splits_and_doubles():
    from linkloom.llm.extendible_dedup import grow_directory

    depth, slots, local = grow_directory({s: 1 for s in range(64)}, 8, 6)
    assert depth == 3 and len(set(slots)) == 8 and set(local.values()) == {3}
    depth, slots, local = grow_directory({0: 100, 63: 1}, 8, 6)
    assert depth == 6 and len(slots) == 64 and local[slots[63]] == 1


def test_host_suffix(spark):
    from linkloom.llm import host_suffix as h

    line = "Read more great stories on our lovely site every single day"
    pages = [
        (1, "http://a.example/1", f"<html><head><title>T</title><script>var a='</p>'</script></head><nav>menu</nav><article><h1>A &amp; B</h1><p>One  two<b>x</b>\n<p>three<aside>no</aside><!-- c --></article><footer>f</footer>"),
        (2, "http://b.example/1", f"<body><p>{line}</p><p>Only here is this text about apples and pears.</p></body>"),
        (3, "http://b.example/2", f"<body><p>{line}</p><p>Quite another text about plums and cherries today.</p></body>"),
        (4, None, None),
        (5, "http://c.example/", "<main>m<div class='comments'><article>c</article></div> <form>f</form>&lt;tag&gt;&eacute;</main>"),
        (6, "http://c.example/", "no markup &amp at all <b"),
    ]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text int")
    out = {r["page_id"]: r for r in rows(h.extract(df))}
    assert out[1]["text"] == "A & B One twox three"
    assert out[2]["text"] == "Only here is this text about apples and pears." and line not in out[3]["text"]
    assert out[4]["text"] == "" and out[5]["text"] == "m <tag>é" and out[6]["text"].startswith("no markup & at all")
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert h.extract(df.limit(0)).count() == 0


def test_entropy_mix(docs, empty):
    from linkloom.llm.entropy_mix import entropy_mix

    given = rows(docs)
    out = rows(entropy_mix(docs))
    assert sorted((r["doc_id"], r["size"]) for r in out) == sorted((r["doc_id"], len(words(r["text"]))) for r in given)
    assert out == rows(entropy_mix(docs.repartition(2))) or sorted(map(str, out)) == sorted(map(str, rows(entropy_mix(docs.repartition(2)))))
    sizes = Counter()
    for r in given:
        sizes[r["source"]] += len(words(r["text"]))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, sum(sizes.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: weight[s] * level for s in free}
    by_id = {r["doc_id"]: r["source"] for r in given}
    taken, biggest = Counter(), Counter()
    for r in out:
        s = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.05 * target[s] + 30, (s, taken[s], target[s], sizes[s])
    assert entropy_mix(empty).count() == 0


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def test_minhash(spark, docs, empty):
    from linkloom.llm.circulant_minhash import near_dedup

    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    more = []
    for i in range(12):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 10**6)}"
        more.append((9100 + i, " ".join(w), "en", "s", 1, 1, "x"))
    docs = docs.union(spark.createDataFrame(more, DOC))
    given = {r["doc_id"]: r["text"] for r in rows(docs)}
    sets = {i: shingles(t, 4) for i, t in given.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * (x := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - x):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    out = rows(near_dedup(docs, shingle=4))
    assert len(out) == docs.count()
    for r in out:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"])), r
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_dedup(empty).count() == 0


def library(texts, end):
    from tokenizers import Tokenizer

    from linkloom.llm.tokens import vocabulary

    t = Tokenizer.from_file(vocabulary())
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def crc(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, empty):
    from linkloom.llm.cutting_stock import pack

    given = {r["doc_id"]: r["text"] for r in rows(docs)}
    ids = dict(zip(given, library(given.values(), 1)))
    out = rows(pack(docs))
    count = Counter(r["doc_id"] for r in rows(docs))
    spans, filled = Counter(), {}
    for r in out:
        mine = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(mine) and r["ids_crc32"] == crc(mine[r["start"] : r["start"] + r["length"]])
        spans[r["doc_id"]] += r["length"]
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert spans == {i: len(ids[i]) * count[i] for i in ids}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(spans.values())
    assert len(filled) * 2048 - total <= 0.005 * total + 2048
    assert sorted(filled) == list(range(len(filled)))
    assert pack(empty).count() == 0


def test_ids_file(docs, empty):
    from linkloom.llm.bitplane_ids import ids_round_trip

    given = sorted(((r["doc_id"], r["text"]) for r in rows(docs)), key=lambda r: r[0])
    ids = library([t for _, t in given], 2)
    for bits in (True, False):
        out = sorted(rows(ids_round_trip(docs, bits=bits, block=1000, shards=3)), key=lambda r: r["start"])
        at = 0
        for (i, _), mine, r in zip(given, ids, out, strict=True):
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(mine), crc(mine))
            at += len(mine)
    assert ids_round_trip(empty).count() == 0


def test_language(docs, empty):
    from linkloom.llm.langid_unigram import identify

    given = {r["doc_id"]: r for r in rows(docs)}
    out = rows(identify(docs, sample=60))
    assert len(out) == docs.count()
    right = total = 0
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        text = given[r["doc_id"]]["text"] or ""
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text))
        if r["held_out"] and r["doc_id"] < 9000:
            total += 1
            right += r["lang_pred"] == given[r["doc_id"]]["lang"]
    assert right >= 0.9 * total
    assert identify(empty).count() == 0


def segmentations(word, table, prob, lang):
    """The sum over all segmentations, by the definition."""
    best = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            found = table.get(word[start:end], 0 if end - start == 1 else None)
            if found is not None:
                best[end] += best[start] * prob[found, lang]
    return best[-1]


def test_forward_sums_all_segmentations():
    import numpy as np

    from linkloom.llm import langid_unigram as l

    table = {p: i + 1 for i, p in enumerate(["a", "b", "ab", "ba", "aba", "abababababab", "\u2581a", "\u2581"])}
    prob = np.random.default_rng(1).uniform(0, 1, (len(table) + 1, 2))
    names = ["a", "ab", "abab", "babaab", "aXb", "ab" * 10, "b" * 40]
    first, lengths, *arcs = l.Table(table).arcs(["\u2581" + n for n in names])
    got = l.forward(first, lengths, *arcs, prob)[first + lengths]
    want = [[segmentations("\u2581" + w, table, prob, k) for k in range(2)] for w in names]
    assert np.allclose(got, want)
    for n in names:
        assert np.allclose(np.exp(l.long_word("\u2581" + n, table, 12, prob)), [segmentations("\u2581" + n, table, prob, k) for k in range(2)])


def test_long_words_and_every_piece_count():
    """Words over LONG letters, and pieces of any length, are summed whole; a worker's cache may turn over."""
    import numpy as np

    from linkloom.llm import langid_unigram as l

    table = l.pieces()
    assert max(map(len, table)) > 12
    rng = np.random.default_rng(2)
    prob = rng.uniform(1e-6, 1e-3, (max(table.values()) + 1, 3))
    longest = max(table, key=len).replace("\u2581", "")
    words = [longest, "straße", "日本語", longest * 5, "x" * 200, "internationalization"]
    scorer = l.Scorer(prob, table)
    scorer.limit = 4
    got = scorer.score([words, [], [longest]])
    want = sum(np.log([segmentations("\u2581" + w, table, prob, k) for k in range(3)]) for w in words)
    assert np.allclose(got[0], want) and not got[1].any()
    assert np.isfinite(scorer.score([["abc" * 50_000]])).all()


def test_more_than_500_languages(spark):
    from linkloom.llm.langid_unigram import train

    rows = [(4 * i + k, f"wort{i} wort{i}", f"l{i:04d}") for i in range(600) for k in range(2)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=2)
    assert len(model["langs"]) == 600


def test_compact_windows(spark, docs, empty):
    from linkloom.llm import compact_windows as c

    rng = random.Random(4)
    fresh = lambda n: [f"z{rng.randint(0, 10**7)}" for _ in range(n)]
    passage, edited = fresh(80), fresh(120)
    near = list(edited)
    near[60] = "changed"
    texts = [fresh(100) + passage + fresh(50), passage + fresh(20), fresh(7) + passage, fresh(400), fresh(30) + edited, near + fresh(90), fresh(40) + passage[:30]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {(r["doc_id"], r["class_id"]): r for r in rows(c.repeated_passages(df))}
    assert set(out) == {(0, 0), (1, 0), (2, 0), (4, 4), (5, 4)}
    assert [(out[i, 0]["start_word"], out[i, 0]["n_words"]) for i in range(3)] == [(100, 80), (0, 80), (7, 80)]
    assert out[5, 4]["n_words"] == 120 and out[5, 4]["matched_words"] == 119
    assert c.repeated_passages(empty).count() == 0
    assert c.repeated_passages(docs).count() > 0


def test_encoder_turns_generations_over(monkeypatch):
    """Whatever the chunks and however few units a worker keeps, ids equal the library's."""
    from linkloom.llm import tokens as t

    monkeypatch.setattr(t, "CACHED", 40)
    monkeypatch.setattr(t, "CHUNK", 60)
    rng = random.Random(3)
    pool = ["der", "été,", "naïve", "It's", "3.14", "ok!!", "Straße", "日本語", "<|endoftext|>", "end.", "x;", "\U0001f600", "été", "end"]
    texts = [None, "", " ", "\n", "a\tb", "a  b", "a \nb", "l" * 500, "a <|endoftext|> b", "a<|endoftext|>b c", "<|endoftext|>"]
    texts += [rng.choice([" ", "\n"]).join(rng.choice(pool) + rng.choice(["", "", str(k)]) for k in range(rng.randint(1, 30))) for _ in range(200)]
    encoder = t.Encoder(t.vocabulary())
    assert list(encoder.encode_batch(texts)) == list(encoder.encode_batch(texts)) == [e.tobytes() for e in ids_of(encoder.library, texts)]
    assert list(encoder.encode_batch([])) == []


def test_special_strings_become_their_ids():
    from linkloom.llm import tokens as t

    got = [list(memoryview(x).cast("I")) for x in t.Encoder(t.vocabulary()).encode_batch(["a <|endoftext|> b", "a < |endoftext|> b"])]
    assert got[0] == [64, 220, 50256, 275] and got == [e[:-1] for e in library(["a <|endoftext|> b", "a < |endoftext|> b"], 0)]


def ids_of(tokenizer, texts):
    import numpy as np

    return [np.array(tokenizer.encode(x or "", add_special_tokens=False).ids, "<u4") for x in texts]


def test_compact_windows_recall(spark):
    """Of the documents holding 51 words in a row that another holds, at least 0.99 are reported."""
    from linkloom.llm import compact_windows as c

    df = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    holders = {}
    for r in rows(df):
        w = [x.lower() for x in words(r["text"] or "")]
        for a in range(len(w) - 50):
            holders.setdefault(hash(tuple(w[a : a + 51])), set()).add(r["doc_id"])
    expected = {i for s in holders.values() if len(s) > 1 for i in s}
    found = {r["doc_id"] for r in rows(c.repeated_passages(df))}
    assert len(expected) > 50 and len(expected & found) >= 0.99 * len(expected)


def test_components_of_a_shuffled_chain(spark):
    """A chain of 500 vertices in random order is one component; too few rounds are an error, not a part of the answer."""
    from linkloom.llm.components import components

    rng = random.Random(6)
    chain, star = rng.sample(range(1, 10_000), 500), range(20_000, 20_040)
    edges = spark.createDataFrame([*zip(chain, chain[1:]), *((20_039, i) for i in star[:-1])], "a long, b long")
    out = {r["v"]: r["component"] for r in rows(components(edges))}
    assert out == {**dict.fromkeys(chain, min(chain)), **dict.fromkeys(star, 20_000)}
    with pytest.raises(RuntimeError):
        components(edges, rounds=3)


def test_compact_windows_behind_a_poor_hub(spark):
    """Exact passages of 51 words are found though a smaller document holds every one of their shingles apart."""
    from linkloom.llm import compact_windows as c

    rng = random.Random(7)
    fresh = lambda n: [f"y{rng.randint(0, 10**7)}" for _ in range(n)]
    passage, twice = fresh(51), fresh(51)
    hub = [w for k in range(47) for w in fresh(40) + passage[k : k + 5] + fresh(40)]
    texts = [hub, fresh(60) + passage + fresh(60), fresh(45) + passage + fresh(80), fresh(5) + twice + fresh(70) + twice, fresh(60) + twice + fresh(9)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {(r["doc_id"], r["class_id"], r["start_word"], r["n_words"]) for r in rows(c.repeated_passages(df))}
    assert out == {(1, 1, 60, 51), (2, 1, 45, 51), (3, 3, 5, 51), (3, 3, 126, 51), (4, 3, 60, 51)}


def test_passages_reach_past_edits():
    """With an anchor on one side of an edit alone, the whole passage of 51 to 70 words is found."""
    import numpy as np

    from linkloom.llm.compact_windows import passages

    rng = np.random.default_rng(8)
    fresh = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    for n in (52, 60, 70):
        for edits in ([n // 2], [n // 3, 2 * n // 3]):
            for change in ("substitute", "insert", "delete"):
                for anchor in (0, n - 1):
                    p = fresh(n)
                    q = np.concatenate([x for k in range(n) for x in ([p[k : k + 1]] if k not in edits else {"substitute": [fresh(1)], "insert": [fresh(1), p[k : k + 1]], "delete": []}[change])])
                    if len(q) <= 50:
                        continue
                    a, b = np.concatenate([fresh(30), p, fresh(30)]), np.concatenate([fresh(20), q, fresh(40)])
                    at = [(30, 20)] if not anchor else [(29 + n, 19 + len(q))]
                    assert [(x[0], x[1], x[2], x[3]) for x in passages(a, b, at, 50, 80)] == [(30, n, 20, len(q))], (n, edits, change, anchor)


def test_articles_in_forms_and_hinted_wrappers():
    from linkloom.llm.host_suffix import blocks, main_text

    text = lambda page: main_text(blocks(page))
    inner = "<p>Own text.</p><form>f</form>"
    assert text(f"<body><form id='aspnetForm'><nav>n</nav><article>{inner}</article><p>x</p></form>") == "Own text."
    assert text(f"<article class='post no-sidebar'>{inner}</article>") == "Own text."
    for wrapper in ("class='content has-sidebar'", "class='entry comments-open'", "class='page search' id='w'", "role='form'"):
        assert text(f"<div {wrapper}>x<article>{inner}</article></div>") == "Own text.", wrapper
        assert text(f"<div {wrapper}><form>x<div role='main'>{inner}</div></form></div>") == "Own text.", wrapper
    for closed in ("div class='comments'", "ol class='comment-list'", "div id='comments' class='comments-area'", "nav", "footer", "aside", "div class='sidebar'", "div hidden"):
        assert text(f"<article>Own text.</article><{closed}><form><article>x</article></form></{closed.split()[0]}>") == "Own text.", closed
    assert text("<article>Own text.</article><article class='comment'>x</article>") == "Own text."


ROWS = "doc_id long, text string, lang string, source string, n_chars long, rank int"
CLASH = [(1, "aa"), (2, "aa"), (1, "bb"), (5, "cc"), (5, "cc"), (None, "dd"), (None, "dd"), (3, "dd"), (None, "ee"), (7, None), (8, ""), (9, "ff " * 40_000)]


def clash(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2) for i, t in CLASH], ROWS).repartition(3)


def test_exact_dedup_heavy_groups_and_odd_ids(spark):
    """Probes of heavy groups and others, null ids, one id with two texts: results as by the definition."""
    from linkloom.llm import extendible_dedup as x

    docs = clash(spark).union(spark.createDataFrame([(100 + i, "hot text", "en", "s", 1, 2) for i in range(300)], ROWS))
    given = [(r["doc_id"], r["text"] or "") for r in rows(docs)]
    size, keep = Counter(t for _, t in given), {}
    for i, t in given:
        keep[t] = max((j for j in (keep.get(t), i) if j is not None), default=None)
    want = sorted((str(i), str(keep[t]), size[t], i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in given)
    for least in (1, 1000):
        got = rows(x.exact_dedup(docs, capacity=1, max_depth=3, heavy_share=10, least=least))
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    got = rows(x.survivors(docs, ("text", "doc_id", "lang", "source", "n_chars")))
    assert sorted((r["text"] or "", str(r["doc_id"])) for r in got) == sorted((t, str(keep[t])) for t in size)


def test_exact_dedup_index_is_chained(spark):
    from linkloom.llm import extendible_dedup as x

    index = x.Index(clash(spark), capacity=1, max_depth=4)
    chains = rows(x.build_index(index))
    assert {r["text"]: r["group_size"] for r in chains} == {"aa": 2, "cc": 2, "dd": 3, "": 2} and {r["link"] for r in chains} == {1}
    assert index.depth > 0 and len({r["bucket"] for r in chains}) > 1


def test_repeated_rows_spread_over_blocks(spark):
    """A row repeated 5000 times keeps the targets, and no block gathers more than about BLOCK of them."""
    from pyspark.sql import functions as F

    from linkloom.llm import entropy_mix as m

    docs = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("a").alias("source"))
    docs = docs.union(spark.createDataFrame([(8, "x " * 200, "b"), (None, None, None), (9, "y", None)], "doc_id long, text string, source string"))
    out = rows(m.entropy_mix(docs))
    taken = Counter()
    for r in out:
        taken[r["source_size"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert len(out) == 5003 and abs(taken[15000] - 15201 + 600 + 3) <= 10 and taken[200] == 600
    plans = []
    real = m.F.collect_list
    m.F.collect_list = lambda c: plans.append(c) or real(c)
    try:
        placed = m.entropy_mix(docs, block=100)
    finally:
        m.F.collect_list = real
    assert plans and placed.count() == 5003


def test_targets_of_many_sources(spark):
    from linkloom.llm.entropy_mix import source_targets

    rng = random.Random(9)
    given = [(f"k{i}", None if i == 0 else f"é{i}" if i % 2 else f"s{i}", rng.choice([0, 1, 50, 10_000]), 3) for i in range(300)]
    got = {r["sk"]: r["target"] for r in rows(source_targets(spark.createDataFrame(given, "sk string, source string, source_size long, docs long")))}
    order = sorted(given, key=lambda r: (r[1] is None, (r[1] or "").encode()))
    weight, size = {r[0]: (5, 2, 1)[i % 3] for i, r in enumerate(order)}, {r[0]: r[2] for r in given}
    want, free = {}, {k for k in size if size[k]}
    left = sum(size.values())
    while True:
        level = left / sum(weight[k] for k in free)
        over = {k for k in free if weight[k] * level > 3 * size[k]}
        if not over:
            break
        want |= {k: 3 * size[k] for k in over}
        left -= sum(3 * size[k] for k in over)
        free -= over
    want |= {k: weight[k] * level for k in free}
    assert all(got[k] == pytest.approx(want.get(k, 0), abs=1e-6) for k in size)


def test_near_dedup_of_odd_ids(spark):
    """Rows that share an id, or have none, are documents of their own."""
    from linkloom.llm import circulant_minhash as c

    base = " ".join(f"w{i}" for i in range(60))
    given = [(1, base), (1, "quite another text than that"), (4, base + " x"), (None, base + " y"), (None, "alone here"), (6, None), (6, ""), (2, "quite another text than that"), (2, "quite another text than that")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 2) for i, t in given], ROWS).repartition(3)
    got = {(str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows(c.near_dedup(docs, shingle=4))}
    assert got == {("1", 57, "1"), ("4", 58, "1"), ("None", 58, "1"), ("1", 2, "1"), ("2", 2, "1"), ("None", 1, "None"), ("6", 0, "6")}
    kept = rows(c.survivors(docs, ("doc_id", "text", "lang", "source", "n_chars"), shingle=4))
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:5]) for r in kept) == [("1", "quite"), ("1", "w0 w1"), ("6", ""), ("6", ""), ("None", "alone")]


def test_templates_under_the_threshold_are_not_all_paired(spark, monkeypatch):
    """400 documents that share a core at similarity 0.763 give a bounded number of pairs per document (two per band at most), not one for each pair of documents."""
    from linkloom.llm import circulant_minhash as c

    core = [f"c{i}" for i in range(229)]
    texts = [" ".join(core + [f"u{d}x{i}" for i in range(34)]) for d in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes, real = [], c.materialize
    monkeypatch.setattr(c, "materialize", lambda df, label: (lambda out: sizes.append(out.count()) or out if label == "pairs" else out)(real(df, label)))
    out = rows(c.near_dedup(docs))
    assert all(r["kept"] for r in out) and sum(sizes) <= 12 * 400 and sizes[2] == 0, sizes


def test_words_of_one_pattern_differ():
    """Strings whose polynomial hashes agree modulo 2**64 whatever the base."""
    from linkloom.llm.shingles import word_hashes

    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    for n in (16, 64, 1024):
        got = word_hashes(f"{a[:n]} {b[:n]} {a[:n]}".encode())[0]
        assert got[0] != got[1] and got[0] == got[2]


def test_archives_roll_and_null_ids(spark):
    import glob

    from linkloom.llm import common
    from linkloom.llm import warc_zstd as w

    rng = random.Random(2)
    given = [(i, f"http://h/{i}", " ".join(str(rng.random()) for _ in range(60)), 1) for i in range(60)] + [(None, "u", "same", 1), (70, "u", "same", 1), (71, "u", "same", 1)]
    df = spark.createDataFrame(given, "page_id long, url string, html string, rank int").coalesce(2)
    path = common.fresh_path(spark, "rolled")
    w.write_archives(df, path, limit=3_000)
    files = [f for f in glob.glob(path.removeprefix("file://") + "/part-*")]
    assert len(files) > 8 and all(next(w.read_archive(open(f, "rb").read())) for f in files)
    out = {(r["page_id"], r["record_type"], r["refers_to"]) for r in rows(w.read_archives(spark, path))}
    assert len(out) == 63 and {(None, "revisit", 70), (70, "response", None), (71, "revisit", 70)} <= out


def test_one_repeated_word_is_quick():
    import time

    import numpy as np

    from linkloom.llm.compact_windows import passages, windows

    began = time.time()
    values = np.full(320_000, 9, np.uint64)
    assert len(windows(values, np.zeros(len(values), np.int64), 40)[0]) == 1
    same = np.full(80_000, 7, np.uint32)
    assert passages(same, same, [(0, 0), (5, 9), (40, 3)], 50, 80)
    assert time.time() - began < 1


def test_windows_are_cartesian_nodes():
    import numpy as np

    from linkloom.llm.compact_windows import windows

    rng = np.random.default_rng(5)
    owner, values = np.repeat([0, 1, 2, 3], [300, 5, 80, 7]), rng.integers(0, 1 << 63, 392, dtype=np.uint64)
    want = set()
    for o in range(4):
        at = np.flatnonzero(owner == o)
        stack = [(int(at[0]), int(at[-1]) + 1)]
        while stack:
            a, b = stack.pop()
            if b - a >= 10:
                c = a + int(values[a:b].argmin())
                want.add((c, min(c - a, 9), min(b - 1 - c, 9)))
                stack += [(a, c), (c + 1, b)]
    assert set(zip(*[x.tolist() for x in windows(values, owner, 10)])) == want


def test_passages_of_repeated_ids_and_nulls(spark):
    from linkloom.llm import compact_windows as c

    rng = random.Random(11)
    fresh = lambda n: [f"q{rng.randint(0, 10**7)}" for _ in range(n)]
    shared = fresh(60)
    texts = [(1, fresh(20) + shared), (1, ["a"]), (2, shared + fresh(9)), (2, shared + fresh(9)), (None, shared), (4, [])]
    df = spark.createDataFrame([(i, " ".join(t), 3) for i, t in texts] + [(5, None, 3)], "doc_id long, text string, rank int")
    out = {(r["doc_id"], r["class_id"], r["n_words"]) for r in rows(c.repeated_passages(df))}
    assert out == {(1, 1, 60), (2, 1, 60)}


def test_suffix_array_against_brute_force():
    """Covered tokens of small hosts, in one part and in several, as found by comparing all substrings."""
    import numpy as np

    from linkloom.llm import host_suffix as h

    rng = np.random.default_rng(3)
    for depth in (3, 4, 8):
        for _ in range(12):
            pages = {i: rng.integers(0, 3 if depth < 8 else 2, rng.integers(0, 40)).astype(np.uint64) for i in range(5)}
            want = {}
            for i, t in pages.items():
                mask = np.zeros(len(t), bool)
                for a in range(len(t) - depth + 1):
                    if any((t[a : a + depth] == u[b : b + depth]).all() for j, u in pages.items() if j != i for b in range(len(u) - depth + 1)):
                        mask[a : a + depth] = True
                want[i] = mask
            found, _ = h.part_rows(pages, depth, False)
            for i, t in pages.items():
                mask = np.zeros(len(t), bool)
                spans = found[i][0]
                for a, b in zip(spans[::2], spans[1::2]):
                    mask[a:b] = True
                assert (mask == want[i]).all()


def test_suffix_array_finds_the_sites_blocks():
    """Blocks of main zones, of any length, against a count of whole blocks: of unlike blocks the array takes those that most pages have."""
    import numpy as np

    from linkloom.llm import host_suffix as h

    rng = np.random.default_rng(5)
    known = [rng.integers(0, 1 << 40, n).astype(np.uint64) for n in (1, 2, 5, 6, 7, 8, 9, 15, 16, 40)]
    for depth in (3, 8):
        for _ in range(10):
            pages = [[int(k) for k in np.flatnonzero(rng.random(len(known)) < 0.5)] for _ in range(9)]
            own = [[(k, known[k]) for k in page] + [(100 + i, rng.integers(0, 1 << 40, 12).astype(np.uint64))] for i, page in enumerate(pages)]
            assert h.site_lines(own, depth) == {k for k in range(len(known)) if 2 * sum(k in page for page in pages) > len(pages)}
    part = [[(1, known[7]), (2, known[7][3:])], [(1, known[7])], [(3, known[7][:-1])]]  # the end of a block is not the block; its beginning is told apart by the count of whole blocks that follows
    assert h.site_lines(part, 8) == {1, 3} and h.site_lines([[], []], 8) == set() and h.site_lines([], 8) == set()


def test_array_alone_removes_boilerplate(spark):
    """Without marks the array decides, however a host is dealt to parts; inside articles it takes what most of a host's pages have."""
    from linkloom.llm import host_suffix as h

    line, notice = "Read more great stories on our lovely site every single day", "This site is kindly hosted by friends"
    plain = [(i, f"http://p.example/{i}", f"<body><p>Own words number {i} of page {i}.</p><p>{line}</p><p>{i} tails tell about {i} apples.</p></body>") for i in range(9)]
    marked = [(20 + i, f"http://m.example/{i}", f"<article><p>Article {i} has its text.</p><p>{notice}</p>{'<p>Shared by two.</p>' if i < 2 else ''}</article>") for i in range(9)]
    few = [(40 + i, f"http://f.example/{i}", f"<article><p>Short {i}.</p><p>{notice}</p></article>") for i in range(3)]
    alone = [(60, "http://m.example/x", f"<article><p>{notice}</p></article>")]
    df = spark.createDataFrame([(*p, 1) for p in plain + marked + few + alone], "page_id long, url string, html string, rank int").repartition(4)
    for part_tokens in (1 << 18, 40):
        out = {r["page_id"]: r["text"] for r in rows(h.extract(df, part_tokens=part_tokens))}
        for i in range(9):
            assert out[i] == f"Own words number {i} of page {i}. {i} tails tell about {i} apples.", part_tokens
            assert out[20 + i] == f"Article {i} has its text." + (" Shared by two." if i < 2 else "")
        assert all(out[40 + i] == f"Short {i}. {notice}" for i in range(3)) and out[60] == notice


def test_pages_that_share_an_id(spark):
    from linkloom.llm import host_suffix as h

    line = "the very same line of words on every page here"
    given = [(1, "http://a/1", f"<p>{line}</p><p>one</p>", 1), (1, "http://a/2", f"<p>{line}</p><p>two</p>", 1), (None, None, "<p>x</p>", 1), (None, None, None, 1), (3, "http://a/1", f"<p>{line}</p><p>one</p>", 1)]
    out = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in rows(h.extract(spark.createDataFrame(given, "page_id long, url string, html string, rank int"))))
    assert out == [("1", "one", 3), ("1", "two", 3), ("3", "one", 3), ("None", "", 0), ("None", "x", 1)]


def test_packing_fills_gaps_and_keeps_null_ids(spark):
    """Lengths that cannot share a sequence whole are cut, so little is padded; each id lies in one piece."""
    from linkloom.llm.cutting_stock import pack

    rng = random.Random(12)
    texts = [" ".join(rng.choice(("a", "the", "of")) for _ in range(rng.randint(1100, 1500))) for _ in range(60)]
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string").repartition(5)
    out = rows(pack(docs))
    filled = Counter()
    for r in out:
        filled[r["sequence_id"]] += r["length"]
    total = sum(len(x) for x in library(texts, 1)) + 2
    assert sum(filled.values()) == total and max(filled.values()) <= 2048 and len(filled) * 2048 - total <= 2048 + 0.005 * total
    assert sorted((r["ids_crc32"], r["length"]) for r in out if r["doc_id"] in (900, 901)) == [(crc([1]), 1)] * 2
    assert sum(r["length"] for r in out if r["doc_id"] is None) == len(library([texts[3]], 1)[0])


def test_windows_that_meet_have_a_hub_that_meets_both(spark):
    """Of windows of one hash any two that overlap far enough are paired with one hub, though the hash's smallest document meets neither."""
    from linkloom.llm.compact_windows import _window_pairs

    rng, window = random.Random(8), 6
    given = [(1, 1, 50, 0, 5), (1, 2, 60, 5, 1), (1, 3, 70, 5, 0)]
    for key in range(2, 40):
        for _ in range(rng.randint(2, 12)):
            left = rng.randint(0, window - 1)
            given.append((key, rng.randint(1, 8), rng.randint(10, 90), left, rng.randint(window - 1 - left, window - 1)))
    live = spark.createDataFrame([(k, v, p << 16 | x << 8 | y) for k, v, p, x, y in given], "key long, v long, place long").repartition(4)
    out = {(r["v"], r["hub"], r["p"], r["q"]) for r in rows(_window_pairs(live, window))}
    meets = lambda a, b: a[0] == b[0] and min(a[3], b[3]) + min(a[4], b[4]) + 1 >= window
    met = {(a[1], b[1], a[2], b[2]) for a in given for b in given if a[1] != b[1] and meets(a, b)}
    assert (3, 2, 70, 60) in out and out <= met
    linked = {(v, h) for v, h, _, _ in out}
    for a, b in ((a, b) for a in given for b in given if a[1] < b[1] and meets(a, b)):
        assert any(all(x[1] == h or (x[1], h) in linked for x in (a, b)) for h in range(1, 9)), (a, b)


def test_recall_of_edited_passages(spark):
    """Of passages of 52 to 70 words planted in two documents each, one copy with one or two words changed, at least 0.9 are linked."""
    from linkloom.llm import compact_windows as c

    rng = random.Random(21)
    vocabulary = [f"t{i}" for i in range(3_000)]
    fresh = lambda n: rng.choices(vocabulary, k=n)
    texts, n = [], 300
    for k in range(n):
        passage = fresh(rng.randint(52, 70))
        edited = list(passage)
        for at in rng.sample(range(1, len(passage) - 1), rng.randint(1, 2)):
            edited[at] = "changed"
        for body in (passage, edited):
            texts.append((len(texts), " ".join(fresh(rng.randint(10, 80)) + body + fresh(rng.randint(10, 80)))))
    out = {(r["class_id"], r["doc_id"]) for r in rows(c.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)))}
    found = sum((2 * k, 2 * k + 1) in out for k in range(n))
    assert found >= 0.9 * n, found
    assert all(b in (a, a + 1) for a, b in out)


def test_passage_tables_that_nothing_reads_again_are_deleted(spark):
    from pathlib import Path

    from linkloom.llm import common, compact_windows

    root = Path(common.shared_dir(spark).removeprefix("file:"))
    labels = ("shared-keys", "shared-windows", "half-groups", "shared-halves", "run-anchors", "runs")
    left = lambda: {p.name for label in labels for p in root.glob(f"{label}-*")}
    before, text = left(), " ".join(f"w{i}" for i in range(90))
    found = compact_windows.repeated_passages(spark.createDataFrame([(1, text), (2, "x " + text)], "doc_id long, text string"))
    assert found.count() == 2 and left() == before


def test_pairs_that_share_one_short_run_by_chance_move_no_texts(spark, monkeypatch):
    """Texts of pairs whose only common run cannot grow are not moved; edited passages still are, and windows of a key move once."""
    from linkloom.llm import compact_windows as c

    rng, kept, hopeful = random.Random(31), [], c._hopeful

    def spied(met, *more):
        out = hopeful(met, *more)
        kept.append((met.count(), {(r["v"], r["hub"]) for r in rows(out)}))
        return out

    monkeypatch.setattr(c, "_hopeful", spied)
    fresh = lambda n: [f"h{rng.randint(0, 10**7)}" for _ in range(n)]
    passage = fresh(60)
    edited = passage[:27] + ["changed"] + passage[28:]
    texts = [fresh(60) + short + fresh(60) for short in (fresh(6) for _ in range(100)) for _ in range(2)] + [fresh(30) + passage + fresh(8), edited + fresh(30)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {(r["doc_id"], r["class_id"], r["start_word"], r["n_words"], r["matched_words"]) for r in rows(c.repeated_passages(df))}
    assert out == {(200, 200, 30, 60, 60), (201, 200, 0, 60, 59)}
    met, left = kept[0]
    assert met > 5 and left == {(201, 200)}

    live = spark.createDataFrame([(1, 1, 50 << 16 | 3 << 8 | 3), (1, 2, 50 << 16 | 3 << 8 | 3)], "key long, v long, place long")
    assert c._window_pairs(live, 6)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_what_is_left_out_before_texts_move_has_no_passage():
    """Over few words, where runs by chance are common, a pair that goes_on leaves out has no passage by its whole texts."""
    import numpy as np

    from linkloom.llm.compact_windows import goes_on, passages, surroundings

    rng = np.random.default_rng(17)
    out = kept = 0
    for round in range(3_000):
        a, b = (rng.integers(0, (3, 12, 70_000)[round % 3], rng.integers(20, 120)).astype(np.uint32) for _ in range(2))
        p, q = int(rng.integers(0, len(a) - 5)), int(rng.integers(0, len(b) - 5))
        n = int(rng.integers(5, 60))
        back = min(p, q, int(rng.integers(0, 40)))
        n = min(n + back, len(a) - p + back, len(b) - q + back)
        run = a[p - back : p - back + n].copy()
        if round % 5:
            edits = rng.integers(0, n, rng.integers(1, 8))
            run[edits[(edits < back) | (edits >= back + 5)]] += 1
        if round % 7 == 0 and n > back + 12:  # a word is missing
            run[back + 6 : -1] = run[back + 7 :].copy()
        b[q - back : q - back + n] = run
        if not goes_on(surroundings(a, np.array([p]), 1, 5), surroundings(b, np.array([q]), 2, 5), 5)[0]:
            out += 1
            assert not passages(a, b, [(p, q)], 11, 80), (round, p, q)
        else:
            kept += 1
    assert out > 150 and kept > 300


def test_edited_passages_behind_a_hub_that_shares_none(spark):
    """Near-duplicate passages without 51 equal words in a row are found though the smallest documents hold their shingles apart."""
    from linkloom.llm import compact_windows as c

    rng = random.Random(41)
    fresh = lambda n: [f"u{rng.randint(0, 10**7)}" for _ in range(n)]
    passage = fresh(70)
    edited = passage[:35] + ["changed"] + passage[36:]
    hubs = [[w for k in range(66) for w in fresh(45) + passage[k : k + 5] + fresh(45)] for _ in range(14)]
    texts = [*hubs, fresh(60) + passage + fresh(60), fresh(45) + edited + fresh(80)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {(r["doc_id"], r["class_id"], r["start_word"], r["n_words"], r["matched_words"]) for r in rows(c.repeated_passages(df))}
    assert out == {(14, 14, 60, 70, 70), (15, 14, 45, 70, 69)}


def test_unsettled_windows_against_all_pairs(monkeypatch):
    """Of the windows of a hash, the pairs with an open one that passages() links are all found; many that it does not are not compared."""
    import numpy as np

    from linkloom.llm import unsettled as u
    from linkloom.llm.compact_windows import passages

    monkeypatch.setattr(u, "FEW", 3)
    monkeypatch.setattr(u, "PAIRS", 500)
    rng = np.random.default_rng(5)
    linked = given = kept = 0
    for round in range(12):
        n, line = 60, rng.integers(0, 1 << 32, 140).astype(np.uint32)
        at, middle = 130, rng.integers(0, 40)
        texts = rng.integers(0, 1 << 32, (n, 300)).astype(np.uint32)
        for i in range(n):
            base, width = (texts[i // 4 * 4], 90) if round % 3 else (line, rng.integers(5, 60))
            back = min(int(middle), width - 5)
            run = (base[at - back : at - back + width] if round % 3 else line[40 - back : 40 - back + width]).copy()
            edits = rng.integers(0, width, rng.integers(0, 7))
            run[edits[(edits < back) | (edits >= back + 5)]] += 1
            if i % 3 == 0 and width > back + 20:
                run[back + 9 : -1] = run[back + 10 :].copy()
            texts[i, at - back : at - back + width] = run
            texts[i, at : at + 5] = line[40:45]
        around = np.concatenate([u.contexts(t, np.array([at]), i, 5) for i, t in enumerate(texts)])
        open_, reach = rng.random(n) < 0.5, np.full(n, 39)
        i, j = u.unsettled_pairs(np.zeros(n, np.int64), np.arange(n), reach, reach, open_, around, 40, 50)
        found = set(zip(i.tolist(), j.tolist()))
        for a in range(n):
            for b in range(a + 1, n):
                if open_[a] | open_[b]:
                    given += 1
                    if passages(texts[a], texts[b], [(at, at)], 50, 80):
                        linked += 1
                        assert (a, b) in found, (round, a, b)
        kept += len(found)
    assert linked > 100 and kept < given / 2, (linked, kept, given)


def test_unsettled_windows_make_few_pairs():
    """A line in many documents, with a short equal run some words on, makes no pairs; a passage of n documents n - 1, which link all."""
    import numpy as np

    from linkloom.llm import unsettled as u

    rng, n, at = np.random.default_rng(9), 60, 100
    for line in (True, False):
        texts = rng.integers(0, 1 << 32, (n, 260)).astype(np.uint32)
        texts[:, at - 2 : at + 7] = texts[0, at - 2 : at + 7]
        if line:
            texts[:, at + 15 : at + 18] = texts[0, at + 15 : at + 18]
        else:
            texts[:, at - 20 : at + 45] = texts[0, at - 20 : at + 45]
            for i in range(n):  # no run of 51 equal words
                texts[i, at + 8 + i % 10] += 1 + i
        around = np.concatenate([u.contexts(t, np.array([at]), i, 5) for i, t in enumerate(texts)])
        reach, given = np.full(n, 39), (np.zeros(n, np.int64), np.arange(n))
        every = u.unsettled_pairs(*given, reach, reach, np.ones(n, bool), around, 40, 50)
        assert len(every[0]) == (0 if line else n * (n - 1) // 2)
        i, j = u.unsettled_pairs(*given, reach, reach, np.ones(n, bool), around, 40, 50, linked=True)
        label = list(range(n))
        for a, b in zip(i.tolist(), j.tolist()):
            label = [label[a] if x == label[b] else x for x in label]
        assert len(i) == (0 if line else n - 1) and len(set(label)) == (n if line else 1)

    # many short texts of which a line stands at the start: what lies before it is not alike
    texts = rng.integers(0, 1 << 32, (600, 90)).astype(np.uint32)
    around = np.concatenate([u.contexts(t, np.array([1]), i, 5) for i, t in enumerate(texts)])
    cut = (around[:, : u.CONTEXT - 1] & 0xFF).astype(np.int64)
    fives = sum(cut[:, k : cut.shape[1] - 4 + k] << 8 * k for k in range(5))
    assert len(np.unique(fives)) > 0.99 * fives.size
