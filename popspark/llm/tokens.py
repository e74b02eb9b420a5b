"""Token ids of whole texts by a tokenizer file that lower-cases words and drops white space, inside a task."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once, so that memory does not grow with a batch or a text.
SLICE = 8 << 20
#: When the cache of a worker holds more runs than this, or as many bytes of them as 16 each, it starts anew.
WORDS = 1_000_000
#: White space as spaces, byte by byte.
SPACED = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SIGNS = r"!-&(-/:;=?-@\[-`{-~"
PLAIN = rf"^(?P<w>[{LETTERS}]*)(?P<p>[{SIGNS}]*)$"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable letter: the printable bytes as themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _spaced(texts: pa.StringArray) -> pa.StringArray:
    """Texts without nulls, with a space for each white space."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = data[ends[0] : ends[-1]].to_pybytes().translate(SPACED) if data else b""
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(data))


def _strung(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of flat, one behind the other, and where each begins and the last ends."""
    stops = np.concatenate([[0], np.cumsum(length)])
    kind = np.int32 if max(len(flat), stops[-1]) < 1 << 31 else np.int64
    return flat[np.repeat((begin - stops[:-1]).astype(kind), length) + np.arange(stops[-1], dtype=kind)], stops


class WordTokens:
    """Each white-space chunk of a text has ids of its own, and so has each run of letters or signs in it: runs are looked up in a cache and tokenized once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = _byte_letters()
        self.to_bytes = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self._reset()

    def _reset(self) -> None:
        self.known = pa.array([""], pa.string())
        self.flat = np.empty(1 << 20, np.uint32)
        self.begin = np.zeros(1 << 18, np.int64)
        self.length = np.zeros(1 << 18, np.int64)
        self.used = 0

    def _learn(self, keys: pa.Array, ids: list[list[int]]) -> None:
        n = len(self.known)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(keys) > len(self.begin):
            self.begin = np.concatenate([self.begin, np.empty_like(self.begin)])
            self.length = np.concatenate([self.length, np.empty_like(self.length)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.begin[n : n + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(keys)] = lengths
        self.used += total
        self.known = pa.concat_arrays([self.known, keys])

    def _runs(self, runs: list[str]) -> list[list[int]]:
        """The ids of runs of letters or of signs, by the model alone."""
        tokenize, to_bytes = self.model.tokenize, self.to_bytes
        return [[t.id for t in tokenize(x if x.isascii() else x.translate(to_bytes))] for x in runs]

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _places(self, runs: pa.Array, words: pa.Array) -> np.ndarray:
        """The places of different runs and of different words that go through the whole tokenizer; new ones are tokenized."""
        keys = pa.concat_arrays([runs, pc.binary_join_element_wise("\0", words, "")])
        found = pc.index_in(keys, value_set=self.known)
        new = np.flatnonzero(~np.asarray(found.is_valid()))
        places = np.array(pc.fill_null(found, 0), np.int64)
        if len(new):
            places[new] = len(self.known) + np.arange(len(new))
            mine = pa.array(new[new < len(runs)])
            ids = self._runs(runs.take(mine).to_pylist()) + self._whole(words.take(pa.array(new[len(mine) :] - len(runs))).to_pylist())
            self._learn(keys.take(pa.array(new)), ids)
        return places

    def _chunks(self, chunks: pa.Array) -> np.ndarray:
        """Two places for each chunk. Chunks with digits, apostrophes, < or rarer letters go through the whole tokenizer."""
        found = pc.extract_regex(chunks, PLAIN)
        # Null where the pattern does not match; place 0 has no ids.
        letters, signs = (pc.fill_null(x, "").dictionary_encode() for x in (pc.utf8_lower(pc.struct_field(found, "w")), pc.struct_field(found, "p")))
        odd = np.flatnonzero(~np.asarray(found.is_valid()))
        # Letters and signs have only the empty run in common.
        signed = signs.dictionary.filter(pc.not_equal(signs.dictionary, ""))
        at = self._places(pa.concat_arrays([letters.dictionary, signed]), chunks.take(pa.array(odd)))
        lettered, tail = len(letters.dictionary), len(letters.dictionary) + len(signed)
        of_signs = np.zeros(len(signs.dictionary), np.int64)
        of_signs[np.asarray(pc.not_equal(signs.dictionary, ""))] = at[lettered:tail]
        places = np.stack([at[:lettered][np.asarray(letters.indices)], of_signs[np.asarray(signs.indices)]], 1)
        places[odd, 0] = at[tail:]
        return places

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chunks = pc.split_pattern(_spaced(texts), " ")
        ends = np.asarray(chunks.offsets).astype(np.int64)
        coded = chunks.flatten().dictionary_encode()
        if len(self.known) > WORDS or max(self.known.nbytes, self.used) > 16 * WORDS:
            self._reset()
        # The ids of different chunks first, then those of all.
        places = self._chunks(coded.dictionary).ravel()
        flat, begin = _strung(self.flat, self.begin[places], self.length[places])
        begin = begin[::2]
        at = np.asarray(coded.indices)
        ids, stops = _strung(flat, begin[at], np.diff(begin)[at])
        return ids, np.diff(stops[ends - ends[0]])

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        size = np.asarray(pc.binary_length(texts)).astype(np.int64)
        at = 0
        while at < len(texts):
            if size[at] > SLICE:
                yield np.concatenate([self._slice(pa.array([x]))[0] for x in cut_text(texts[at].as_py())])
                at += 1
                continue
            stop = at + 1
            total = size[at]
            while stop < len(texts) and total + size[stop] <= SLICE:
                total += size[stop]
                stop += 1
            ids, lengths = self._slice(texts.slice(at, stop - at))
            yield from np.split(ids, np.cumsum(lengths)[:-1])
            at = stop


#: Where ids do not depend on what stands on the other side: before white space, and behind a digit that a letter or digit follows.
BREAK = re.compile(r"(?=[ \t\n])|(?<=[0-9])(?=[0-9A-Za-z])")


def cut_text(text: str) -> Iterator[str]:
    """A long text in parts that are tokenized each for itself. A run of letters or signs without any break stays whole."""
    at, size = 0, SLICE // 4
    while at < len(text):
        found = BREAK.search(text, at + size)
        stop = found.start() if found else len(text)
        yield text[at:stop]
        at = stop


_LOADED: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One tokenizer and one cache for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def id_type(path: str) -> str:
    """The least little-endian number that holds every id of a tokenizer."""
    return "<u2" if max(word_tokens(path).tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
