"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is the sum, over all its
segmentations into pieces, of the product of their probabilities (a forward algorithm); a text's is the product over its
words. Piece probabilities are fitted by expectation-maximisation (forward-backward over the same lattice) on about SAMPLE
documents of each language, the documented bound (of texts up to SAMPLE_CHARS characters, and in them words up to LONG
letters); priors count all training documents. The vocabulary is never trained.

Words are runs of letters of the lower-cased text, with the vocabulary's word mark in front. All words of a text count, at
their whole length, and all pieces of the vocabulary. A lattice is a list of arcs (start, end, piece) over the characters of
many words at once; pieces are found by a hash of the characters, which grows by one character at a time and only where it
is still the beginning of some piece. Words over LONG letters are summed on their own, rescaled as they go.

Defined cases: null text, or text without a letter, is `und` with score 0; with no training rows every text is `und`; a tie
goes to the first language by code point; repeated rows get equal results; other columns than those named are not read, and
no prediction looks at lang, source or doc_id. The model holds a row of probabilities per piece and language, so its size
grows with the number of languages, not with the rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, sliced

SAMPLE = 300
SAMPLE_CHARS = 200_000
#: Words with more characters than this are not kept and not summed together with others.
LONG = 48
EM_ROUNDS = 3
#: Words whose likelihoods a worker keeps at most, and the bytes that these may take.
CACHED, CACHE_BYTES = 1_000_000, 128 << 20
_CHUNK = 20_000
_MARK = "\u2581"
_FLOOR = 1e-7
_LETTERS = re.compile(r"[^\W\d_]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 20


def words_of(text: str | None) -> list[str]:
    found = _LETTERS.findall((text or "").lower())
    if found and not any(map(str.isalpha, found)) and not any(c.isalpha() for w in found for c in w):
        return []
    return found


@lru_cache(1)
def pieces(path: str | None = None) -> dict[str, int]:
    """The vocabulary's pieces, lower-cased, numbered from 1; 0 is any other single character."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: i + 1 for i, p in enumerate(dict.fromkeys(n.lower() for n in names if n))}


class Table:
    """Pieces and their beginnings in an open-addressed table keyed by a hash of their characters."""

    def __init__(self, table: dict[str, int]):
        self.longest = max(map(len, table), default=1)
        marks: dict[int, int] = {}  # hash -> piece, or -1 for a mere beginning
        for piece, number in table.items():
            h = 0
            for k, c in enumerate(piece):
                h = (h * int(_PRIME) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                if k + 1 == len(piece):
                    if marks.get(h, -1) not in (-1, number):
                        raise ValueError("two pieces share a hash")
                    marks[h] = number
                else:
                    marks.setdefault(h, -1)
        bits = max(_SLOT_BITS, (4 * len(marks)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.found = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int32)
        for h, number in marks.items():
            slot = ((h * int(_PRIME)) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
            while self.found[slot] != -2:
                slot = (slot + 1) & ((1 << bits) - 1)
            self.keys[slot], self.found[slot] = h, number
        self.mask = (1 << bits) - 1

    def look(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash; -1 for a beginning, -2 for neither."""
        slot = ((h * _PRIME) >> self.shift).astype(np.int64)
        out = self.found[slot]
        open_ = np.flatnonzero((out != -2) & (self.keys[slot] != h))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            out[open_] = self.found[slot[open_]]
            open_ = open_[(out[open_] != -2) & (self.keys[slot[open_]] != h[open_])]
        return out

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """first, lengths of the words in a run of nodes (one more than characters each); start node, end node, piece of all arcs."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        owner = np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths)
        left = ends[owner] - np.arange(len(text))  # characters to the end of the word
        node = np.arange(len(text)) + owner
        first = np.concatenate((np.zeros(1, np.int64), ends + np.arange(1, len(words) + 1)))[:-1]
        at, h = np.arange(len(text)), np.zeros(len(text), np.uint64)
        starts, stops, found = [], [], []
        for k in range(1, self.longest + 1):
            h = h * _PRIME + text[at + k - 1]
            hit = self.look(h)
            if k == 1:
                starts.append(node), stops.append(node + 1), found.append(np.maximum(hit, 0))
            else:
                whole = hit > 0
                starts.append(node[at[whole]]), stops.append(node[at[whole]] + k), found.append(hit[whole])
            more = (hit != -2) & (left[at] > k)
            at, h = at[more], h[more]
            if not len(at):
                break
        return first, lengths, np.concatenate(starts), np.concatenate(stops), np.concatenate(found)


def forward(first: np.ndarray, lengths: np.ndarray, start: np.ndarray, stop: np.ndarray, piece: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """alpha[node, language]: the summed probability of all segmentations of what lies before a node in its word."""
    owner = np.repeat(np.arange(len(first)), lengths + 1)
    alpha = np.zeros((len(owner), prob.shape[1]))
    alpha[first] = 1
    depth = stop - first[owner[stop]]
    order = np.lexsort((stop, depth))
    start, stop, piece = start[order], stop[order], piece[order]
    edges = np.searchsorted(depth[order], np.arange(1, int(lengths.max(initial=0)) + 2))
    for a, b in zip(edges[:-1], edges[1:]):
        to = stop[a:b]
        new = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        alpha[to[new]] = np.add.reduceat(alpha[start[a:b]] * prob[piece[a:b]], new, axis=0)
    return alpha


def long_word(word: str, table: dict[str, int], longest: int, prob: np.ndarray) -> np.ndarray:
    """Log-likelihood of a word of any length by language, with the last nodes' sums rescaled at each step."""
    kept, scale = [np.ones(prob.shape[1])], np.zeros(prob.shape[1])
    for end in range(1, len(word) + 1):
        total = kept[-1] * prob[table.get(word[end - 1], 0)]
        for k in range(2, min(longest, end) + 1):
            found = table.get(word[end - k : end])
            if found is not None:
                total = total + kept[-k] * prob[found]
        kept = [*kept[-longest:], total]
        if total.min() < 1e-100:
            high = np.maximum(np.max(kept, axis=0), 1e-300)
            kept = [x / high for x in kept]
            scale = scale + np.log(high)
    return np.log(np.maximum(kept[-1], 1e-300)) + scale


def fit(counts: dict[str, Counter], table: dict[str, int], rounds: int = EM_ROUNDS) -> np.ndarray:
    """prob[piece, language] for languages in the order of counts, by forward-backward over words of at most LONG characters."""
    size, finder = max(table.values(), default=0) + 1, Table(table)
    out = np.zeros((size, len(counts)))
    for column, counter in enumerate(counts.values()):
        words = sorted(_MARK + w for w in counter if len(w) < LONG)
        lattices = [(finder.arcs(part), np.array([counter[w[1:]] for w in part], float)) for part in (words[a : a + _CHUNK] for a in range(0, len(words), _CHUNK))]
        prob = np.full((size, 1), 1 / size)
        for _ in range(rounds if words else 0):
            seen = np.zeros(size)
            for (first, lengths, start, stop, piece), n in lattices:
                alpha = forward(first, lengths, start, stop, piece, prob)[:, 0]
                # the same sums from the other end: nodes are renumbered from each word's last
                last = first + lengths
                owner = np.repeat(np.arange(len(first)), lengths + 1)
                turn = first[owner] + last[owner] - np.arange(len(owner))
                beta = forward(first, lengths, turn[stop], turn[start], piece, prob)[:, 0][turn]
                share = n / alpha[last]
                seen += np.bincount(piece, share[owner[start]] * alpha[start] * prob[piece, 0] * beta[stop], size)
            prob[:, 0] = np.maximum((seen + 0.01) / (seen + 0.01).sum(), _FLOOR)
        out[:, column] = prob[:, 0]
    out[0] = _FLOOR
    return out


class Scorer:
    """Sums of log-likelihoods per language, with the words met so far kept."""

    def __init__(self, prob: np.ndarray, table: dict[str, int]):
        self.prob, self.table, self.finder = prob, table, Table(table)
        self.limit = max(_CHUNK, min(CACHED, CACHE_BYTES // (8 * prob.shape[1])))
        self.row: dict[str, int] = {}
        self.logs = np.zeros((_CHUNK, prob.shape[1]))

    def learn(self, new: list[str]) -> None:
        for a in range(0, len(new), _CHUNK):
            part = new[a : a + _CHUNK]
            first, lengths, *arcs = self.finder.arcs([_MARK + w for w in part])
            alpha = forward(first, lengths, *arcs, self.prob)[first + lengths]
            at = len(self.row)
            if at + len(part) > len(self.logs):
                self.logs = np.concatenate((self.logs, np.zeros_like(self.logs), np.zeros((len(part), self.logs.shape[1]))))
            self.logs[at : at + len(part)] = np.log(np.maximum(alpha, 1e-300))
            self.row.update(zip(part, range(at, at + len(part))))

    def score(self, texts: list[list[str]]) -> np.ndarray:
        """A row of sums for each list of words; about limit / 4 words are looked up at once."""
        total = np.zeros((len(texts), self.prob.shape[1]))
        held, owner, size = [], [], 0
        for i, words in enumerate(texts):
            for a in range(0, len(words), max(1, self.limit // 4)):
                part = words[a : a + max(1, self.limit // 4)]
                if held and size + len(part) > self.limit // 4:
                    self._add(total, held, owner)
                    held, owner, size = [], [], 0
                held.append(part)
                owner.append(i)
                size += len(part)
        if held:
            self._add(total, held, owner)
        return total

    def _add(self, total: np.ndarray, held: list[list[str]], owner: list[int]) -> None:
        import pyarrow as pa

        units = pa.array([w for words in held for w in words], pa.string()).dictionary_encode()
        names, at = units.dictionary.to_pylist(), units.indices.to_numpy()
        known = list(map(self.row.get, names))
        if None in known:
            new = [w for w, k in zip(names, known) if k is None and len(w) < LONG]
            if len(self.row) + len(new) > self.limit:
                self.row.clear()
                new = [w for w in names if len(w) < LONG]
            self.learn(new)
            known = list(map(self.row.get, names))
        logs = np.empty((len(names), total.shape[1]))
        short = np.array([k is not None for k in known])
        logs[short] = self.logs[[k for k in known if k is not None]]
        for i in np.flatnonzero(~short):
            logs[i] = long_word(_MARK + names[i], self.table, self.finder.longest, self.prob)
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        full = sizes > 0
        np.add.at(total, np.array(owner)[full], np.add.reduceat(logs[at], (np.cumsum(sizes) - sizes)[full], axis=0))


_latest: list = [None, None]


def scorer_of(model: dict) -> Scorer:
    """The model's scorer; a worker keeps the last one, with the words it has met, from task to task."""
    if _latest[0] != model["name"]:
        _latest[:] = [model["name"], Scorer(model["prob"], pieces(model["path"]))]
    return _latest[1]


def train(docs: DataFrame, sample: int = SAMPLE, path: str | None = None) -> dict | None:
    """Languages, priors and piece probabilities from docs(doc_id, text, lang); None without training rows."""
    usable = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return None
    share = docs.sparkSession.createDataFrame([(k, min(1.0, sample / n)) for k, n in sizes.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) / 1e6
    chosen = usable.filter(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(share), "lang").filter(draw < F.col("share")).select("lang", "text").collect()
    counts: dict[str, Counter] = {k: Counter() for k in sorted(sizes)}
    for r in chosen:
        counts[r["lang"]].update(words_of(r["text"]))
    counts = {k: c for k, c in counts.items() if c}
    if not counts:
        return None
    prior = np.array([sizes[k] for k in counts], float)
    return {"langs": list(counts), "prior": np.log(prior / prior.sum()), "prob": fit(counts, pieces(path)), "path": path, "name": uuid.uuid4().hex}


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score for docs(doc_id, text)."""
    import pyarrow as pa

    names = ["doc_id", "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model and scorer_of(model)
        for batch in sliced(batches):
            texts = [words_of(t) if scorer else [] for t in batch.column(1).to_pylist()]
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            spoken = [i for i, words in enumerate(texts) if words]
            if spoken:
                log = scorer.score([texts[i] for i in spoken]) + model["prior"]
                best = log.argmax(1)
                scores[spoken] = 1 / np.exp(np.clip(log - log.max(1, keepdims=True), -700, 0)).sum(1)
                for i, k in zip(spoken, best):
                    langs[i] = model["langs"][k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, **options) -> DataFrame:
    """Train on documents whose crc32 of the id as text, modulo 4, is not 2; predict for every document."""
    held = lambda c: F.crc32(c.cast("string").cast("binary")) % 4 == 2
    model = train(docs.filter(~held(F.col("doc_id"))), **options)
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(held(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
