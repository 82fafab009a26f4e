"""Ids of whole texts by a public tokenizer of the `tokenizers` library, with a bounded memory of words.

White space always separates tokens of the word BPE, so a text's ids are those of its
space-separated chunks in a row. Texts are cut together, a few megabytes at once, and each
different chunk of them is looked up once. Each Python worker keeps the ids of chunks that it
has seen, in two generations of bounded size; only new chunks go to the library.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np

from panelmill.llm.common import text_bytes

VOCABULARY = "word_bpe_49k.json"
KEPT = 300_000  # chunks in a generation
LONGEST = 64  # bytes of a chunk that is kept
TOGETHER = 1 << 21  # bytes of texts that are cut at once
GROUP = 1 << 16  # bytes of new chunks that go to the library at once
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_PLAIN = re.compile(rb"[!-~]+")  # printable ASCII
_LETTERS = re.compile(rb"(?:[a-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+")  # a-z and the letters of Latin-1, one piece
_SPACE, _STOP, _LOWER = (np.isin(np.arange(256), list(c)) for c in (b" \t\n\x0b\x0c\r", b",.", bytes(range(97, 123))))
#: Bytes as the vocabulary writes them: those that are not printable in Latin-1 are moved up.
_SHOWN = "".join(map(chr, [*range(127), *range(289, 323), *range(161, 173), 323, *range(174, 256)]))


def _starts(data: np.ndarray, spaces: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the chunks of texts begin: after white space, and at a stop between a letter and white space."""
    first = ~spaces
    first[1:] &= spaces[:-1]
    own = ends[ends < len(data)]  # texts do not run into each other
    first[own] = ~spaces[own]
    stops = np.flatnonzero(_STOP[data[1:-1]] & spaces[2:]) + 1
    first[stops[_LOWER[data[stops - 1]]]] = True
    return np.flatnonzero(first)


def _groups(chunks: list[bytes]) -> Iterator[list[bytes]]:
    """The chunks in groups of `GROUP` bytes, or one that is longer."""
    ends, at = np.cumsum([0, *map(len, chunks)]), 0
    while at < len(chunks):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + GROUP, side="right")) - 1)
        yield chunks[at:to]
        at = to


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)  # the same merges over pieces that are cut already
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size = self.whole.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(size, bool)  # ids that end a piece
        for token, number in self.whole.get_vocab(with_added_tokens=False).items():
            self.ends[number] = token.endswith("</w>")
        self.chunks: list[dict[bytes, bytes]] = [{}, {}]

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The ids of a UTF-8 text; none for a null one."""
        import pyarrow as pa

        return self.texts(pa.array([text], pa.binary()))[0]

    def texts(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow array of texts in a row, and where those of each text begin (their end last)."""
        import pyarrow as pa

        data, ends = text_bytes(column)
        raw = data.tobytes()
        text = bytearray(raw.lower())  # the library lowers all but its special tokens; fewer chunks differ
        if b"<|" in raw:
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if raw.find(b"<|", a, b) >= 0:
                    text[a:b] = raw[a:b]
        data = np.frombuffer(text, np.uint8)
        spaces = _SPACE[data]
        at, inside = _starts(data, spaces, ends), ~spaces
        offsets = np.append(np.cumsum(inside)[at] - 1, inside.sum())
        chunks = pa.Array.from_buffers(pa.large_binary(), len(at), [
            None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        parts, chunk = self._ids(chunks.dictionary.to_pylist()), chunks.indices.to_numpy()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        n = sizes[chunk]
        upto = np.concatenate([[0], np.cumsum(n)])
        places = np.repeat((np.cumsum(sizes) - sizes)[chunk] - upto[:-1], n)
        places += np.arange(len(places))
        return np.frombuffer(b"".join(parts), np.uint32)[places], upto[np.searchsorted(at, ends)]

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of different chunks."""
        parts = list(map(self.chunks[0].get, chunks))
        if None in parts:
            known = self._learn([c for c, p in zip(chunks, parts) if p is None])
            parts = [known[c] if p is None else p for c, p in zip(chunks, parts)]
        return parts

    def _learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        if len(self.chunks[0]) > KEPT:
            self.chunks = [{}, self.chunks[0]]
        before = self.chunks[1]
        known = {c: before[c] for c in missing if c in before} if before else {}
        letters, plain, other = [], [], []
        for c in missing:
            if c not in known:
                (letters if c.isalpha() or _LETTERS.fullmatch(c) else
                 plain if _PLAIN.fullmatch(c) and b"<|" not in c else other).append(c)
        cut = [_PIECES.findall(c.lower()) for c in plain]
        pieces = {p for p in chain.from_iterable(cut) if p not in known}
        for p in pieces:
            if (ids := self.chunks[0].get(p) or before.get(p)) is not None:
                known[p] = ids
        for group in _groups(list({*letters, *(p for p in pieces if p not in known)})):
            known |= self._by_pieces(group)
        known |= {c: b"".join(map(known.__getitem__, own)) for c, own in zip(plain, cut)}
        for group in _groups(other):
            known |= self._by_chunk(group)
        self.chunks[0].update((c, ids) for c, ids in known.items() if len(c) <= LONGEST)
        return known

    def _by_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Chunks that are one piece of the tokenizer's pattern: merged without its search."""
        text = b" ".join(pieces).decode().lower()
        if not text.isascii():
            text = codecs.charmap_decode(text.encode(), "strict", _SHOWN)[0]
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces):
            return self._by_chunk(pieces)
        data, stops = ids.tobytes(), (stops * 4).tolist()
        return {p: data[a:b] for p, a, b in zip(pieces, [0, *stops], stops)}

    def _by_chunk(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Anything else: encoded whole by the library, dealt to the chunks by offsets."""
        texts = [c.decode() for c in chunks]
        encoded = self.whole.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(encoded.ids, np.uint32).tobytes()
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        places = np.fromiter((a for a, _ in encoded.offsets), np.int64, len(encoded.offsets))
        bounds = (np.searchsorted(places, starts) * 4).tolist()
        return {c: ids[bounds[i]:bounds[i + 1]] for i, c in enumerate(chunks)}


@cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    return Encoder(path)


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
