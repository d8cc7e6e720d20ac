"""Token ids of documents with a public tokenizer, through the distinct words of a slice of text.

For a tokenizer whose pre-tokenizer never lets a piece span white space, the ids of a text are those of its white-space
separated words in a row.  Arrow finds the distinct words of a slice, and only those are looked at in Python; what was
encoded before is kept in a cache of bounded size: two generations, of which the older is dropped when the younger is
full, so words that keep coming stay.
"""

from __future__ import annotations

import functools
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import LOWER, SPACE, ragged, string_buffers, word_hashes, words

#: Segments of words in one of a worker's two generations, with about 100 bytes for each.
CACHE_SEGMENTS = 1 << 17
#: Bytes of text whose words are made distinct at once, in some 40 times as much memory; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
#: New segments that the tokenizer gets at once; what it returns takes some hundred bytes for each.
LEARN = 1 << 14
_TAIL = ".,;:!?"


def slices(column):
    """(first row, row after the last) of consecutive rows with about SLICE_BYTES of text."""
    _, offsets = string_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(max(int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1, lo + 1), n)
        yield lo, hi
        lo = hi


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow column of strings of the given sizes, one after another in data."""
    edges = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=edges[1:])
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])


class Generation:
    """Segments with their ids: found by hash, held against the text."""

    def __init__(self):
        self.segments = pa.array([], pa.large_string())
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of the segments, by hash
        self.flat, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def find(self, distinct: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The number of each of some segments, -1 where it isn't here."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            likely = np.flatnonzero(self.hashes[at] == hashes)
            number = self.numbers[at[likely]]
            equal = pc.equal(distinct.take(pa.array(likely)), self.segments.take(pa.array(number))).to_numpy(zero_copy_only=False)
            out[likely[equal]] = number[equal]
        return out

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered segments in a row, and how many each has."""
        lengths = self.begin[numbers + 1] - self.begin[numbers]
        return self.flat[ragged(self.begin[numbers], lengths)], lengths

    def add(self, unseen: pa.Array, hashes: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers for segments that aren't here, with their ids."""
        out = np.arange(len(unseen)) + len(self.segments)
        self.segments = pa.concat_arrays([self.segments, unseen])
        both, number = np.concatenate([self.hashes, hashes]), np.concatenate([self.numbers, out])
        order = np.argsort(both, kind="stable")
        self.hashes, self.numbers = both[order], number[order]
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(lengths)])
        self.flat = np.concatenate([self.flat, flat])
        return out


class WordEncoder:
    """encode(column of texts) -> (ids of all texts in a row, number of ids of each text)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("normalizer") or {}).get("normalizers") or []
        # words may be encoded alone only if white space separates pieces and is dropped, and nothing is added to a text
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_word = bool(
            any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} for s in steps)
            and split.get("type") == "Split"
            and split.get("behavior") == "Removed"
            and split.get("invert")
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
        )
        self.lower = any(s.get("type") == "Lowercase" for s in steps)
        self.tokenizer = Tokenizer.from_file(path)
        suffix, self.word_end = spec["model"].get("end_of_word_suffix"), None
        if suffix:
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.word_end = np.zeros(max(vocab.values()) + 1, bool)
            self.word_end[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        # a word is two segments: its letters, and the marks at its end or nothing
        self.young, self.old = Generation(), Generation()

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_word:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        data, offsets = string_buffers(column)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        starts, ends, first = words(data, offsets)
        spelled = _strings(data[~SPACE[data]], ends - starts).dictionary_encode()
        segment = self._segments(spelled.dictionary)
        # what the distinct words are in ids, one after another, then each word of the text by its number
        own, lengths = self.young.ids(segment.ravel())
        total = lengths.reshape(-1, 2).sum(axis=1)
        which = spelled.indices.to_numpy()
        sizes = total[which]
        ids = own[ragged((np.cumsum(total) - total)[which], sizes)]
        upto = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=upto[1:])
        return ids, np.diff(upto[first])

    def _segments(self, distinct: pa.Array) -> np.ndarray:
        """The two segments of each of some distinct words, learned where they are new."""
        if len(self.young.segments) > CACHE_SEGMENTS:
            self.young, self.old = Generation(), self.young
        data, offsets = string_buffers(distinct)
        sizes = np.diff(offsets)
        core = pc.utf8_rtrim(distinct, characters=_TAIL)
        letters = pc.match_substring_regex(core, r"^\p{L}+$").to_numpy(zero_copy_only=False)
        held = np.where(letters, pc.binary_length(core).to_numpy(), sizes)
        spelled = data[ragged(offsets[:-1], held)]
        if self.lower:
            spelled = np.where(np.repeat(letters, held), LOWER[spelled], spelled)
        cores, tails = _strings(spelled, held), _strings(data[ragged(offsets[:-1] + held, sizes - held)], sizes - held)
        both = pa.concat_arrays([cores, tails]).dictionary_encode()
        return self._numbers(both.dictionary)[both.indices.to_numpy()].reshape(2, -1).T

    def _numbers(self, distinct: pa.Array) -> np.ndarray:
        """The number of each of some distinct segments in the young generation, which gets what it lacks from the old one or learns it."""
        data, offsets = string_buffers(distinct)
        hashes = word_hashes(data, offsets[:-1], offsets[1:])
        out = self.young.find(distinct, hashes)
        lacking = np.flatnonzero(out < 0)
        older = self.old.find(distinct.take(pa.array(lacking)), hashes[lacking])
        again, new = lacking[older >= 0], lacking[older < 0]
        if len(again):
            out[again] = self.young.add(distinct.take(pa.array(again)), hashes[again], *self.old.ids(older[older >= 0]))
        if len(new):
            unseen = distinct.take(pa.array(new))
            out[new] = self.young.add(unseen, hashes[new], *self._learn(unseen.to_pylist()))
        return out

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments in a row, and how many each has; words of letters are one piece each, so many go in one text and are cut at word ends."""
        group = 256 if self.word_end is not None else 1
        letters = [k for k, x in enumerate(pieces) if group > 1 and x.isalpha()]
        groups = [letters[i : i + group] for i in range(0, len(letters), group)]
        rest = [k for k, x in enumerate(pieces) if group == 1 or not x.isalpha()]
        places: list[int] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for i in range(0, len(groups), LEARN // group):
            some = groups[i : i + LEARN // group]
            for own, e in zip(some, self.tokenizer.encode_batch_fast([" ".join(map(pieces.__getitem__, g)) for g in some], add_special_tokens=False)):
                found = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(self.word_end[found]) + 1
                if len(ends) != len(own):
                    rest += own
                    continue
                places += own
                ids.append(found)
                sizes.append(np.diff(ends, prepend=0))
        for i in range(0, len(rest), LEARN):
            some = rest[i : i + LEARN]
            alone = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[k] for k in some], add_special_tokens=False)]
            places += some
            ids.append(np.fromiter(chain.from_iterable(alone), np.uint32))
            sizes.append(np.fromiter(map(len, alone), np.int64, len(alone)))
        flat, lengths = np.concatenate(ids), np.concatenate(sizes).astype(np.int64)
        order = np.argsort(places)  # into the order of pieces
        return flat[ragged((np.cumsum(lengths) - lengths)[order], lengths[order])], lengths[order]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """The encoder of a worker; it and its cache outlive a task."""
    return WordEncoder(path)
