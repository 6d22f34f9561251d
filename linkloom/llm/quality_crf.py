"""Quality rules by line labelling: a linear-chain CRF marks each line content or boilerplate; content share decides.

The CRF has two states. A line's emission score is linear in LINE_FEATURES; transitions are a 2x2 table. Weights are
fitted by gradient ascent on the conditional likelihood, computed by forward-backward, over at most SAMPLE documents of
each quality label with texts up to SAMPLE_CHARS characters (the documented bounds); a labelled document lends its label to its lines. Decoding is Viterbi over all
lines of the whole text. A document is kept when lines marked content hold at least MIN_SHARE of its words.

Base counts, all over the whole text: words are runs without ASCII white space; n_repeat_words counts the words that lie in
a 3-word window found at least twice in the text.

Defined cases: null or empty text has no words and fails the base rule; with no labelled documents of both kinds the CRF
has nothing to learn and every document that passes the base rule is kept; repeated rows get equal results; lines without
a word take part in no count of content; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, sliced

SAMPLE = 600
SAMPLE_CHARS = 200_000
MIN_SHARE = 0.5
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
LINE_FEATURES = ("bias", "upper", "symbols", "exclaim", "pipes", "distinct", "word_length", "short", "ends_sentence", "seen_before", "digits")
_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_SYMBOL_BYTES = SYMBOLS.encode()
_SPACES = " \t\n\x0b\x0c\r"
_ROW = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long, content_share double, n_lines long"


def repeat_words(words: list[bytes]) -> int:
    """Words covered by a 3-word window that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(number) + ids[2:]
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def line_rows(text: str) -> tuple[list[tuple], list[int], int]:
    """Features of each line that has a word, words of each, and how many of them equal an earlier line."""
    rows, sizes, seen, dup = [], [], set(), 0
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        again = line in seen
        seen.add(line)
        dup += again
        size = len(line)
        up, low = size - len(line.translate(None, _UPPER)), size - len(line.translate(None, _LOWER))
        symbols, digits = size - len(line.translate(None, _SYMBOL_BYTES)), size - len(line.translate(None, _DIGIT))
        last = words[-1][-1:]
        rows.append((1.0, up / (up + low + 1), min(symbols / n, 3.0), min(line.count(b"!") / n, 2.0), min(line.count(b"|") / n, 1.0), len(set(words)) / n if n > 8 else 1.0, min((size - n) / n, 20.0) / 10, float(n < 4), float(last in (b".", b"?", b"!")), float(again), digits / (size + 1)))
        sizes.append(n)
    return rows, sizes, dup


def fit(samples: list[tuple[str, int]], steps: int = 150, width: int = 48) -> dict | None:
    """Maximum-likelihood weights from (text, label) samples; None unless both labels occur.

    For fitting alone, a text's lines are cut into runs of width lines.
    """
    runs = []
    for text, label in samples:
        rows, _, _ = line_rows(text or "")
        runs += [(rows[i : i + width], int(label)) for i in range(0, len(rows), width)]
    if len({label for _, label in runs}) < 2:
        return None
    n, f = len(runs), len(LINE_FEATURES)
    x, mask, y = np.zeros((n, width, f)), np.zeros((n, width), bool), np.array([label for _, label in runs])
    for i, (rows, _) in enumerate(runs):
        x[i, : len(rows)] = rows
        mask[i, : len(rows)] = True
    weight = np.where(y == 1, 0.5 / max(1, mask[y == 1].sum()), 0.5 / max(1, mask[y == 0].sum()))[:, None]
    used = mask.any(0).sum()
    w, t = np.zeros(f), np.zeros((2, 2))
    moment = [np.zeros(f), np.zeros(f), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        emit = np.stack([np.zeros((n, width)), x @ w], -1)
        alpha, beta = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        alpha[:, 0] = emit[:, 0]
        for k in range(1, used):
            step_in = np.logaddexp(alpha[:, k - 1, 0, None] + t[0], alpha[:, k - 1, 1, None] + t[1]) + emit[:, k]
            alpha[:, k] = np.where(mask[:, k, None], step_in, alpha[:, k - 1])
        for k in range(used - 2, -1, -1):
            ahead = emit[:, k + 1] + beta[:, k + 1]
            back = np.logaddexp(t[:, 0] + ahead[:, 0, None], t[:, 1] + ahead[:, 1, None])
            beta[:, k] = np.where(mask[:, k + 1, None], back, 0.0)
        total = np.logaddexp(alpha[:, used - 1, 0], alpha[:, used - 1, 1])
        state = np.exp(np.clip(alpha + beta - total[:, None, None], -60, 0))
        slope_w = np.einsum("nk,nkf->f", weight * mask * (y[:, None] - state[..., 1]), x) - 1e-4 * w
        pairs = mask[:, 1:used] & mask[:, : used - 1]
        slope_t = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                p = np.exp(np.clip(alpha[:, : used - 1, a] + t[a, b] + emit[:, 1:used, b] + beta[:, 1:used, b] - total[:, None], -60, 0))
                slope_t[a, b] = (weight * pairs * (((y == a) & (a == b))[:, None] - p)).sum() - 1e-3 * t[a, b]
        for i, (value, slope) in enumerate(((w, slope_w), (t, slope_t))):
            moment[2 * i] = 0.9 * moment[2 * i] + 0.1 * slope
            moment[2 * i + 1] = 0.99 * moment[2 * i + 1] + 0.01 * slope**2
            value += 0.1 * (moment[2 * i] / (1 - 0.9**step)) / (np.sqrt(moment[2 * i + 1] / (1 - 0.99**step)) + 1e-9)
    return {"weights": w.tolist(), "transitions": t.tolist()}


def viterbi(emission: list[float], t: list[list[float]]) -> list[int]:
    """Best state sequence; state 0 scores 0 at each line and state 1 scores emission. A tie goes to content (1)."""
    s0, s1, back = 0.0, emission[0], []
    for e in emission[1:]:
        from0, from1 = s1 + t[1][0] >= s0 + t[0][0], s1 + t[1][1] >= s0 + t[0][1]
        back.append((from0, from1))
        s0, s1 = (s1 + t[1][0] if from0 else s0 + t[0][0]), (s1 + t[1][1] if from1 else s0 + t[0][1]) + e
    state = int(s1 >= s0)
    path = [state]
    for step in reversed(back):
        state = int(step[state])
        path.append(state)
    return path[::-1]


def judge(text: str | None, model: dict | None, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> tuple:
    """The result row of one text, without its id."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    rows, sizes, dup = line_rows(text)
    repeated = repeat_words(words)
    failed = n < min_words or 100 * repeated > 50 * n
    content = n
    if model and rows:
        emission = (np.asarray(rows) @ np.asarray(model["weights"])).tolist()
        content = sum(size for size, state in zip(sizes, viterbi(emission, model["transitions"])) if state)
    share = content / n if n else 0.0
    return n, len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated, failed, not failed and share >= min_share, content, share, len(rows)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Fit on at most sample documents of each quality label, chosen by a hash of their ids."""
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = [labels.filter(F.col("quality") == q).select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(*order).limit(sample) for q in (0, 1)]
    both = chosen[0].unionByName(chosen[1])  # at most 2 * sample rows, so a broadcast is bounded
    fitting = docs.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS)
    rows = fitting.join(F.broadcast(both), "doc_id").dropDuplicates(["doc_id", "text"]).collect()
    return fit([(r["text"], r["quality"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))])


def kept_rows(docs: DataFrame, columns: tuple[str, ...], model: dict | None, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of docs that are kept, with these columns (text among them); each row is judged by itself, whatever its id."""
    import pyarrow as pa

    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array([judge(text, model, min_words, min_share)[6] for text in batch.column(at).to_pylist()], pa.bool_()))

    docs = docs.select(*columns)
    return map_batches(docs, run, docs.schema)


def quality_lines(docs: DataFrame, model: dict | None, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """Counts, verdict and content share of every document."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_ROW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [(i, *judge(text, model, min_words, min_share)) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = list(zip(*rows)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, _ROW)
