"""Main text of web pages: a suffix array of each host's page token streams, and structural marks as evidence.

A page is scanned into blocks, each in one of four zones: dropped (head, scripts, styles, comments and the like), boilerplate
(nav, footer, aside, forms, and elements whose class, id or role says menu, advert, notice, comments...), main (inside article
or main, outside such marks) and plain. An article or main opens a main zone even in a form or in a wrapper with a hinted
name, but not in comments, nav, footer, aside, menus and hidden parts.

The token streams of a host's pages (all blocks outside main zones) are concatenated, each page closed by a separator of its
own, and sorted into a suffix array by prefix doubling; a run of suffixes equal to some depth that spans two distinct pages
is a repeated substring, and doubling goes on until no run does. All tokens that lie in a repeat of DEPTH tokens or more are
covered. A host whose streams exceed PART_TOKENS is dealt to several tasks by pages, each with an array of its own; what
is repeated between them alone is found by the DEPTH-token windows of each part (a repeat of DEPTH tokens or more is a chain of
repeated windows), so the parts' number does not change the result. The blocks of main zones, between marks, make a second array
of every host's part, which counts the pages of each run of DEPTH tokens: a block all of whose runs are on more than half of a
part's pages, and which is found whole on more than half of the host's distinct pages, of SITE_PAGES at least, is the site's
and not the page's.

Decision. Covered tokens and the site's blocks are removed. Of the unique runs that are left, those of main zones are the
text; on a page without a main zone those of plain blocks are. Blocks marked as boilerplate never are. A main zone's other
blocks stay whole, whatever they share with other pages, and if all blocks of a page's main zones are the site's, they stay.

Defined cases: null or empty html gives empty text; pages equal in all bytes count as one page for repeats; repeated rows get
equal results, and rows that share an id but not their html each get their own; an empty table gives an empty result; a null
url is a host of its own; other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_small, map_batches, materialize, sliced, with_ids
from .shingles import word_hashes

DEPTH = 8
#: Tokens of a host's streams that one suffix array is built over (a longer page is an array of its own).
PART_TOKENS = 1 << 18
SITE_PAGES = 8
PAGES_PER_BATCH = 200
_SEED = np.uint64(0x9E3779B97F4A7C15)
#: Marks around the blocks of main zones.
_OPEN, _SHUT = np.array([0x2545F4914F6CDD1D], np.uint64), np.array([0x5851F42D4C957F2D], np.uint64)
#: SOFT is boilerplate in which an article or main may still open a main zone; blocks() gives it as BOILER.
PLAIN, MAIN, BOILER, DROP, SOFT = range(5)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>", re.S)
_DROPPED = frozenset("head script style noscript template iframe svg canvas object embed audio video map math textarea select option datalist".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_MARKED = frozenset("nav footer aside form menu dialog button fieldset".split())
_SOFT = frozenset(("form", "fieldset"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|popup|modal|newsletter|subscribe|sidebar|menu|nav|navbar|navigation|breadcrumbs?"
    r"|footer|masthead|share|sharing|social|comments?|commentlist|disqus|repl(?:y|ies)|respond|related|recommended|login|signup|search|widget|toolbar|pagination|pager)(?:[\s_-]|$)",
    re.I,
)
#: Names of comment, nav, footer and aside zones, whole: inside these no article is the page's own.
_CLOSED = re.compile(
    r"(?:^|\s)(?:comments?|comment-?list|comments?[-_](?:list|area|section|wrap\w*|thread|body|content|form)|disqus(?:[-_]thread)?|repl(?:y|ies)|respond"
    r"|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|footer|sidebar|related|recommended)(?:\s|$)",
    re.I,
)
_WHOLE = re.compile(_HINT.pattern.replace(r"[\s_-]", r"\s"), re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())


def _zone(tag: str, attributes: str, outer: int) -> int:
    own = tag in ("article", "main")
    if outer == DROP or tag in _DROPPED:
        return DROP
    if outer == BOILER or tag in _MARKED and tag not in _SOFT or tag == "header" and outer != MAIN:
        return BOILER
    zone = SOFT if tag in _SOFT else MAIN if own else outer
    if attributes and tag != "body" and tag != "html":
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return BOILER
            if name == "role" and value.lower() in _ROLES:
                if value.lower() != "form":
                    return BOILER
                zone = SOFT
            if name == "role" and value.lower() in ("main", "article"):
                own, zone = True, MAIN
        for name, value in _ATTRIBUTE.findall(attributes):
            if name.lower() in ("class", "id"):
                value = value.strip("\"'")
                if _CLOSED.search(value) or own and _WHOLE.search(value):
                    return BOILER
                if not own and _HINT.search(value):
                    zone = SOFT
    return zone


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each block with text, in page order; references decoded, white space made single."""
    page, out, held, at = page or "", [], [], 0
    stack: list[tuple[str, int]] = []
    zone = held_zone = PLAIN

    def close() -> None:
        text = " ".join(entities.unescape("".join(held)).split()) if held else ""
        if text:
            out.append((BOILER if held_zone == SOFT else held_zone, text))
        held.clear()

    while at < len(page):
        tag = _TAG.search(page, at)
        end = tag.start() if tag else len(page)
        if end > at and zone != DROP:
            if held and held_zone != zone:
                close()
            held_zone = zone
            held.append(page[at:end])
        if not tag:
            break
        at = tag.end()
        name = tag[2]
        if not name:
            continue
        name = name.lower()
        if name not in _INLINE:
            close()
        if tag[1]:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
                zone = stack[-1][1] if stack else PLAIN
        elif name not in _VOID and not tag[3].endswith("/"):
            if name in _RAW:
                found = re.compile(f"</{name}\\b[^>]*>", re.I).search(page, at)
                inner, at = (page[at : found.start()], found.end()) if found else (page[at:], len(page))
                if name == "title" and zone == PLAIN and not stack:
                    out.append((BOILER, " ".join(entities.unescape(inner).split())))
                continue
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                stack.pop()
                zone = stack[-1][1] if stack else PLAIN
            elif name == "p" and any(n == "p" for n, _ in stack[-6:]) and all(n == "p" or n in _INLINE for n, _ in stack[-[n for n, _ in stack[::-1]].index("p") - 1 :]):
                while stack.pop()[0] != "p":
                    pass
                zone = stack[-1][1] if stack else PLAIN
            zone = _zone(name, tag[3], zone)
            stack.append((name, zone))
    close()
    return out


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-zA-Z][\w+.-]*://", "", url or "").split("/")[0].split("?")[0].split("#")[0].rpartition("@")[2].lower()


def _outside(found: list[tuple[int, str]]) -> list[str]:
    return [t for z, text in found if z in (PLAIN, BOILER) for t in text.split()]


def is_open(found: list[tuple[int, str]]) -> bool:
    """No main zone, so that unique runs of plain blocks are the text."""
    return not any(z == MAIN for z, _ in found)


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def main_text(found: list[tuple[int, str]], spans: list[tuple[int, int]] = (), site: set[int] = frozenset()) -> str:
    """The kept text; spans are covered (start, end) of the page's outside tokens, site the hashes of blocks that are the site's."""
    if not is_open(found):
        main = [text for z, text in found if z == MAIN]
        own = [text for text in main if text_hash(text) not in site] if site else main
        return " ".join(own or main)
    tokens = [t for z, text in found if z == PLAIN or z == BOILER for t in text.split()]
    free = np.ones(len(tokens), bool)
    for a, b in spans:
        free[a:b] = False
    kept, at = [], 0
    for z, text in found:
        n = len(text.split()) if z in (PLAIN, BOILER) else 0
        if z == PLAIN:
            kept += [tokens[k] for k in range(at, at + n) if free[k]]
        at += n
    return " ".join(kept)


def suffix_array(ids: np.ndarray, owner: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, covered, holders) of a concatenation of streams: the suffixes in order of their tokens as far as two owners share
    them, whether each token lies in a substring of depth tokens or more that suffixes of two owners begin with, and how many
    owners have a suffix with the first depth tokens of each suffix.

    Streams must be closed by ids that occur once, so that no repeat runs over the end of one.
    """
    n = len(ids)
    rank, slots, length = np.unique(ids, return_inverse=True)[1].astype(np.int64), np.arange(n), 1
    order, turn, holders = np.argsort(rank, kind="stable"), np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
    # a suffix's rank is the slot in order where its group begins; slots are those of groups still to be told apart
    rank[order] = _firsts(rank[order], slots)
    while n:
        if length >= depth:
            ranked, held = rank[order[slots]], owner[order[slots]]
            first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            if length == depth:
                holders = np.bincount(np.unique(rank * (owner.max() + 1) + owner) // (owner.max() + 1), minlength=n)[rank]
            shared = np.minimum.reduceat(held, first) != np.maximum.reduceat(held, first)
            if not shared.any():
                break
            slots = slots[np.repeat(shared, np.diff(np.append(first, len(slots))))]
            np.add.at(turn, order[slots], 1)
            np.add.at(turn, np.minimum(order[slots] + length, n), -1)
        step = min(length, depth - length) if length < depth else length  # depth itself is met, then its doubles
        at = order[slots]
        key = rank[at] * (n + 1) + np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1) + 1
        by = np.argsort(key, kind="stable")
        order[slots] = at = at[by]
        rank[at] = _firsts(key[by], slots)
        length += step
    return order, np.cumsum(turn[:-1]) > 0, holders


def _firsts(ranked: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """For each of the sorted values the slot of the first that equals it."""
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(ranked)]
    return slots[np.maximum.accumulate(np.where(new, np.arange(len(ranked)), 0))]


def window_hashes(tokens: np.ndarray, depth: int) -> np.ndarray:
    """A hash of each run of depth tokens."""
    n = max(0, len(tokens) - depth + 1)
    out = np.zeros(n, np.uint64)
    for k in range(depth):
        out = (out ^ tokens[k : k + n]) * _SEED
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _spans(mask: np.ndarray) -> list[int]:
    """start, end, start, end... of the runs of a mask."""
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))).tolist()


def _closed(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, owner and first of the streams one after another, each closed by an id of its own."""
    sizes = np.array([len(t) for t in streams], np.int64)
    known, number = np.unique(np.concatenate(streams) if streams else np.empty(0, np.uint64), return_inverse=True)
    first = np.cumsum(sizes + 1) - sizes - 1
    ids = np.empty(int((sizes + 1).sum()), np.int64)
    closing = np.zeros(len(ids), bool)
    closing[first + sizes] = True
    ids[~closing] = number
    ids[closing] = len(known) + np.arange(len(streams))
    return ids, np.repeat(np.arange(len(streams)), sizes + 1), first


def site_lines(pages: list[list[tuple[int, np.ndarray]]], depth: int) -> set[int]:
    """Hashes of main blocks, given as (hash, tokens) by page, all of whose runs of depth tokens are on more than half of the pages.

    A block runs from an opening mark to a closing one, which is repeated up to depth, so a shorter block is one run.
    """
    streams, at = [], []
    for own in pages:
        parts, size = [np.empty(0, np.uint64)], 0
        for line, tokens in own:
            parts += [_OPEN, tokens, np.repeat(_SHUT, max(1, depth - 1 - len(tokens)))]
            at.append((len(streams), size, line, max(1, len(tokens) + 2 - depth)))
            size += 1 + len(tokens) + len(parts[-1])
        streams.append(np.concatenate(parts))
    if not at:
        return set()
    ids, owner, first = _closed(streams)
    rare = np.concatenate(([0], np.cumsum(2 * suffix_array(ids, owner, depth)[2] <= len(pages))))
    page, place, line, runs = (np.array(c, np.int64) for c in zip(*at))
    place += first[page]
    return set(line[rare[place + runs] == rare[place]].tolist())


def part_rows(pages: dict[int, np.ndarray], depth: int, several: bool) -> tuple[dict[int, tuple[list[int], list[int], list[int]]], list[int]]:
    """For one host's part: page -> (spans, uncovered windows, their places), and the part's distinct windows if it has several parts."""
    names, streams = list(pages), list(pages.values())
    ids, owner, first = _closed(streams)
    covered = suffix_array(ids, owner, depth)[1] if len(ids) else np.empty(0, bool)
    out, windows = {}, set()
    for name, tokens, a in zip(names, streams, first):
        mask = covered[a : a + len(tokens)]
        open_, at = [], []
        if several:
            found = window_hashes(tokens, depth)
            windows.update(found.tolist())
            inside = np.concatenate(([0], np.cumsum(mask)))
            free = np.flatnonzero(inside[depth:] - inside[:-depth] < depth) if len(found) else np.empty(0, np.int64)
            open_, at = found[free].tolist(), free.tolist()
        out[name] = (_spans(mask), open_, at)
    return out, sorted(windows)


def covered_spans(pages: DataFrame, depth: int = DEPTH, part_tokens: int = PART_TOKENS, site_pages: int = SITE_PAGES) -> tuple[DataFrame, DataFrame]:
    """(u, page, spans, at) of pages without a main zone that have covered tokens, and (u, page, site) of pages with blocks that are the site's.

    u and page are hashes of url and html; spans are covered (start, end, ...), at begins of further covered windows.
    """
    import pyarrow as pa
    import zstandard

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor()
        for batch in sliced(batches, PAGES_PER_BATCH):
            host, tokens, sizes, lines, opened = [], [], [], [], []
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = blocks(page)
                # a line of all outside tokens, then one of each main block; a token has no white space
                stream = [" ".join(_outside(found)), *(text for z, text in found if z == MAIN)]
                host.append(text_hash(host_of(url) if url is not None else "\0"))
                tokens.append(pack.compress("\n".join(stream).encode("utf-8", "surrogatepass")))
                sizes.append(sum(text.count(" ") + 1 for text in stream))
                lines.append(sorted({text_hash(text) for text in stream[1:]}))
                opened.append(is_open(found))
            made = [pa.array(host, pa.int64()), pa.array(tokens, pa.binary()), pa.array(sizes, pa.int64()), pa.array(lines, pa.list_(pa.int64())), pa.array(opened, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*made, batch.column(2), batch.column(3)], ["host", "tokens", "size", "lines", "opened", "u", "page"])

    read = pages.select("url", "html", F.xxhash64("url").alias("u"), F.xxhash64("html").alias("page"))
    stream = materialize(map_batches(read, streams, "host long, tokens binary, size long, lines array<long>, opened boolean, u long, page long"), "streams")
    sizes = stream.groupBy("host").agg(F.sum("size").alias("tokens_"), F.max("opened").alias("any"))
    sizes = materialize(sizes.select("host", F.greatest(F.lit(1), F.ceil(F.col("tokens_") / part_tokens)).alias("parts"), "any"), "host-parts")
    dealt = with_ids(stream.drop("lines"), sizes, "host", "inner").withColumn("part", F.pmod(F.xxhash64("page"), F.col("parts")))
    dealt = dealt.repartition("host", "part").sortWithinPartitions("host", "part", "page", "u")
    kinds = "host long, part long, u long, page long, spans array<int>, windows array<long>, at array<int>, site array<long>"

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        names = [c.split()[0] for c in kinds.split(", ")]
        now, held, main, asked, unpack = None, {}, {}, [], zstandard.ZstdDecompressor()

        def close() -> Iterator[pa.RecordBatch]:
            host, part, parts, open_ = now
            found, windows = part_rows(held, depth, open_ and parts > 1)
            rows = [(host, part, u, page, *found[page], None) for u, page in dict.fromkeys(asked) if found[page][0] or found[page][1]]
            lines = site_lines(list(main.values()), depth)
            if windows or lines:
                rows.append((host, part, None, None, None, windows, None, sorted(lines)))
            for a in range(0, len(rows), PAGES_PER_BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + PAGES_PER_BATCH]), types)], names)

        for batch in sliced(batches):
            for host, part, parts, open_, u, page, tokens, opened in zip(*[c.to_pylist() for c in batch.columns]):
                if now != (host, part, parts, open_):
                    if now:
                        yield from close()
                    now, held, main, asked = (host, part, parts, open_), {}, {}, []
                if page not in held:
                    outside, *texts = unpack.decompress(tokens).split(b"\n")
                    held[page] = word_hashes(outside)[0]
                    main[page] = [(xxhash.xxh64_intdigest(text) - (1 << 63), word_hashes(text)[0]) for text in texts]
                if opened:
                    asked.append((u, page))
        if now:
            yield from close()

    found = materialize(map_batches(dealt.select("host", "part", "parts", "any", "u", "page", "tokens", "opened"), arrays, kinds), "suffix-repeats")
    ours = found.filter("page IS NOT NULL")
    between = found.filter("page IS NULL").select("host", "part", F.explode("windows").alias("w")).groupBy("host", "w").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("host", "w")
    met = ours.select("host", "u", "page", F.explode(F.arrays_zip("windows", "at")).alias("z")).select("host", "u", "page", F.col("z.windows").alias("w"), F.col("z.at").alias("k"))
    met = met.join(between, ["host", "w"]).groupBy("u", "page").agg(F.collect_set("k").alias("at"))
    # a block that most of a host's pages have is on most pages of one part at least; of those that a part gives, all pages are counted
    given = materialize(found.select("host", F.explode("site").alias("line")).distinct(), "site-candidates")
    single = stream.select("host", "page").distinct()
    hosts = single.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= site_pages)
    held_by = with_ids(stream.select("host", "u", "page", F.explode("lines").alias("line")), given, ["host", "line"], "inner")
    common = held_by.select("host", "line", "page").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    common = materialize(common.join(hosts, "host").filter("2 * n > pages").select("host", "line"), "site-blocks")
    site = held_by.join(common, ["host", "line"]).groupBy("u", "page").agg(F.collect_set("line").alias("site"))

    spans = ours.select("u", "page", "spans").dropDuplicates(["u", "page"]).join(met, ["u", "page"], "left")
    return materialize(spans.filter("size(spans) > 0 OR at IS NOT NULL"), "covered"), materialize(site, "site-pages")


def extract(pages: DataFrame, depth: int = DEPTH, part_tokens: int = PART_TOKENS, site_pages: int = SITE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars; a row per input row."""
    import pyarrow as pa

    spans, site = covered_spans(pages, depth, part_tokens, site_pages)
    pages = pages.select(F.col("page_id").cast("long"), "url", "html", F.xxhash64("url").alias("u"), F.xxhash64("html").alias("page"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, PAGES_PER_BATCH):
            ids, urls, htmls, spans_, at, site_ = [c.to_pylist() for c in batch.columns]
            texts = []
            for page, s, k, lines in zip(htmls, spans_, at, site_):
                s = s or []
                texts.append(main_text(blocks(page), [*zip(s[::2], s[1::2]), *((a, a + depth) for a in k or ())], set(lines or ())))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    key, none = ["u", "page"], lambda kind: F.lit(None).cast(f"array<{kind}>")
    touched = materialize(spans.select(*key).union(site.select(*key)).distinct(), "touched")
    rest = with_ids(pages, touched, key, "left_anti").withColumns({"spans": none("int"), "at": none("int"), "site": none("long")})
    if not is_small(touched, 0):
        rest = rest.union(with_ids(pages, touched, key, "left_semi").join(spans, key, "left").join(site, key, "left").select(*rest.columns))
    shown = rest.select("page_id", "url", "html", "spans", "at", "site")
    return map_batches(shown, finish, "page_id long, url string, text string, n_chars long")
