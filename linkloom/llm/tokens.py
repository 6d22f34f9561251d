"""Token ids of whole texts from a public byte-level BPE vocabulary, by the tokenizers library.

The library's own pre-tokeniser never merges across the pieces of its pattern, and in a text whose white space is single
spaces and single line ends a piece never spans the place before a space or on either side of a line end. Such a text is
cut there by Arrow, which also finds the distinct units of a chunk of texts; each is encoded by the library once per worker
and kept. Units are kept in two generations of half of CACHED each, which bounds memory: a full one replaces the older one,
and a unit found in the older one moves on. A text with any other white space, or with the string of one of the vocabulary's
added tokens (which the library turns into that token), is encoded whole by the library.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units a worker keeps at most, but for those of one chunk (about 250 bytes each), unless it is asked for another number.
CACHED = 800_000
#: Characters of the texts that are cut at once; a longer text is a chunk of its own.
CHUNK = 4 << 20
TEXTS = 4_000
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]
_ODD = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0\u1680\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")
_MARKS = frozenset(",.!?;:")
#: What stands for a byte in the vocabulary's strings: itself where printable, else the next code point from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALIAS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def single_spaced(text: str) -> bool:
    """Whether all white space is single spaces and line ends between other characters."""
    return not (_ODD.search(text) or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cached: int | None = None):
        import os

        self.cached = cached or CACHED

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.model = self.library.model
        self.marks = {m: self._single(m) for m in _MARKS}

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; about CHUNK characters of whole texts are worked on at once."""
        held, size = [], 0
        for text in texts:
            if held and size + len(text or "") > CHUNK:
                yield from self._encode_chunk(held)
                held, size = [], 0
            held.append(text or "")
            size += len(held[-1])
        yield from self._encode_chunk(held)

    def _encode_chunk(self, texts: list[str]) -> list[bytes]:
        plain = [bool(t) and single_spaced(t) and not (self.added and self.added.search(t)) for t in texts]
        out = [b""] * len(texts)
        odd = [i for i, t in enumerate(texts) if t and not plain[i]]
        for i, ids in zip(odd, self._plain([texts[i] for i in odd])):
            out[i] = ids
        members = [i for i, p in enumerate(plain) if p]
        if members:
            cut = pa.array([texts[i] for i in members], pa.large_string())
            cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(cut, " ", "\0 "), "\n", "\0\n\0"), "\0")
            units = cut.flatten().dictionary_encode()
            place, bounds = units.indices.to_numpy(), cut.offsets.to_numpy()
            known = self._ids(units.dictionary.to_numpy(zero_copy_only=False).tolist())
            lengths = np.fromiter(map(len, known), np.int64, len(known)) >> 2
            starts = np.cumsum(lengths) - lengths
            n = lengths[place]
            ends = np.cumsum(n)
            ids = np.frombuffer(b"".join(known), "<u4")[np.repeat(starts[place] - ends + n, n) + np.arange(int(ends[-1]))].tobytes()
            edges = np.concatenate((np.zeros(1, np.int64), ends))[bounds] * 4
            for i, x, y in zip(members, edges[:-1].tolist(), edges[1:].tolist()):
                out[i] = ids[x:y]
        return out

    def _ids(self, units: list[str]) -> list[bytes]:
        if len(self.kept) + len(units) > self.cached // 2:
            self.old, self.kept = self.kept, {}
        found = list(map(self.kept.get, units))
        if None in found:
            at = [i for i, ids in enumerate(found) if ids is None]
            for i, ids in zip(at, self._learn([units[i] for i in at])):
                found[i] = ids
        return found

    def _learn(self, missing: list[str]) -> list[bytes]:
        """The ids of units that are not among the kept ones, which they join; those of the older generation move on."""
        kept, old, single, marks, rest = self.kept, self.old, self._single, self.marks, []
        out = list(map(old.get, missing))
        for i, unit in enumerate(missing):
            if out[i] is None:
                word = unit[1:] if unit[0] == " " else unit
                if word.isalpha():
                    out[i] = single(unit)
                elif word[-1:] in marks and word[:-1].isalpha():
                    base = unit[:-1]
                    out[i] = (kept.get(base) or old.get(base) or single(base)) + marks[word[-1]]
                else:
                    rest.append(i)
        for i, ids in zip(rest, self._plain([missing[i] for i in rest])):
            out[i] = ids
        kept.update(zip(missing, out))
        return out

    def _single(self, piece: str) -> bytes:
        """Ids of what the pre-tokeniser leaves whole: letters, with a space before them or not, or one mark."""
        if piece.isascii():
            shown = "\u0120" + piece[1:] if piece[0] == " " else piece
        else:
            shown = "".join(map(_ALIAS.__getitem__, piece.encode()))
        found = self.model.tokenize(shown)
        if len(found) == 1:
            return _PACK[1](found[0].id)
        return _PACK[len(found)](*[t.id for t in found]) if len(found) < len(_PACK) else np.array([t.id for t in found], "<u4").tobytes()

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(1)
def encoder(path: str, cached: int | None = None) -> Encoder:
    return Encoder(path, cached)
