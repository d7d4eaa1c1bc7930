"""Whole texts to token ids with a public tokenizer, a batch of texts at a time.

A tokenizer whose file has the rules of FIXED never joins pieces across white space, so each run
between ASCII white space is encoded once and kept: texts repeat their words. Short runs of plain
Latin letters, digits and signs are lower-cased and split here by the file's own pattern, and only
pieces not met before reach the library's model; every other run, and one that holds an added token
as text, goes through the whole library, and so do whole texts under a file with other rules. What
is kept is bounded by `MOST_KEPT` runs and as many pieces, and those of one batch; past that only what
the batch at hand has again is kept on, and the rest is forgotten and encoded anew.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import per_doc, raw

MOST_KEPT = 400_000
LONGEST_KEPT = 64
#: The rules of a tokenizer file under which runs can be encoded one by one.
FIXED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
#: The file's split pattern over lower-cased plain runs.
PIECE = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+)"
#: Bytes of plain runs in UTF-8: visible ASCII, and U+00C0 to U+00FF but for the signs of multiplication and division.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = _PLAIN[0x80:0xC0] = _PLAIN[0xC3] = True
_PLAIN[[0x97, 0xB7]] = False
#: How the byte-level step writes the UTF-8 bytes of plain text: 0x80 to 0xA0 as U+0122 and on, 0xAD as U+0143, the rest as Latin-1.
BYTES = {c: "".join(chr(0x143 if b == 0xAD else b if b > 0xA0 or b < 0x7F else b - 0x7F + 0x121) for b in chr(c).encode()) for c in [*range(0x21, 0x7F), *range(0xC0, 0x100)]}


class _Kept:
    """Strings and their ids: looked up in Arrow, those not met before encoded by `encode`, short ones kept."""

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(lengths) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.length[self.n : self.n + len(lengths)] = lengths
        self.used, self.n = self.used + len(flat), self.n + len(lengths)

    def places(self, strings: pa.Array) -> np.ndarray:
        """The place of each of the distinct strings; those of long ones last until the next call."""
        self.used, self.n = int(self.length[: len(self.known)].sum()), len(self.known)
        at = np.array(pc.index_in(strings, value_set=self.known).fill_null(-1), np.int64)
        if self.n > MOST_KEPT:
            met = np.flatnonzero(at >= 0)
            kept = self.flat(at[met])
            self.forget()
            self._add(*kept)
            self.known, at[met] = strings.take(pa.array(met)), np.arange(len(met))
        new = np.flatnonzero(at < 0)
        if len(new):
            words = strings.take(pa.array(new))
            long = np.asarray(pc.binary_length(words)) > LONGEST_KEPT
            order = np.argsort(long, kind="stable")
            words, at[new[order]] = words.take(pa.array(order)), self.n + np.arange(len(order))
            self._add(*self.encode(words))
            self.known = pa.concat_arrays([self.known, words[: int((~long).sum())]])
        return at

    def flat(self, at: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings at these places, one after the other, and how many each has; place -1 is the single id `end`."""
        start, length = np.where(at < 0, self.used, self.start[at]), np.where(at < 0, 1, self.length[at])
        take = np.repeat(start - np.cumsum(length) + length, length)
        take += np.arange(len(take))
        return (self.ids[take] if end is None else np.append(self.ids[: self.used], np.uint32(end))[take]), length


class Encoder:
    """Encodes texts with the tokenizer file at `path`, as the library does with add_special_tokens=False."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        added = rules.get("added_tokens") or []
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in added)
        self.by_runs = plain and all(rules.get(k) == v for k, v in FIXED.items())
        self.added = "|".join(re.escape(t["content"]) for t in added)
        self.runs, self.pieces = _Kept(self._of_runs), _Kept(self._of_pieces)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts by the library alone, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for lower-cased pieces, which no rule splits further, by the library's model."""
        tokenize = self.tokenizer.model.tokenize
        found = [[t.id for t in tokenize(p if p.isascii() else p.translate(BYTES))] for p in pieces.to_numpy(zero_copy_only=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _of_runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs: plain short ones are split into pieces here."""
        data, off = raw(runs)
        other = (per_doc((~_PLAIN[data]).astype(np.int64), off) > 0) | (np.diff(off) > LONGEST_KEPT)
        if self.added:
            other |= np.asarray(pc.match_substring_regex(runs, self.added, ignore_case=True))
        plain = runs.filter(pa.array(~other))
        spaced = pc.replace_substring_regex(pc.utf8_lower(plain), pattern=PIECE, replacement="\\1 ")
        lists = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(spaced))
        coded = lists.flatten().dictionary_encode()
        flat, length = self.pieces.flat(self.pieces.places(coded.dictionary)[np.asarray(coded.indices)])
        n = np.asarray(pc.list_value_length(lists), np.int64)
        total = np.r_[0, np.cumsum(length)][np.r_[0, np.cumsum(n)]]
        if not other.any():
            return flat, np.diff(total)
        # those of the library in between, in the order of runs
        some, some_length = self._library(runs.filter(pa.array(other)).to_pylist())
        lengths, begin = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
        lengths[~other], lengths[other] = np.diff(total), some_length
        begin[~other], begin[other] = total[:-1], len(flat) + np.cumsum(some_length) - some_length
        take = np.repeat(begin - np.cumsum(lengths) + lengths, lengths)
        take += np.arange(len(take))
        return np.concatenate([flat, some])[take], lengths

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by `end`, and the n + 1 offsets in them. Null counts as empty."""
        gc.disable()  # it would walk the kept pieces again and again, and nothing here makes a cycle
        try:
            return self._encode(texts, end)
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("") if texts.null_count else texts
        n = len(texts)
        if not self.by_runs:
            flat, lengths = self._library(texts.to_pylist())
            return np.insert(flat, np.cumsum(lengths), np.uint32(end)), np.r_[0, np.cumsum(lengths + 1)]
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        count = np.asarray(pc.list_value_length(lists), np.int64)
        coded = lists.flatten().dictionary_encode()
        at = self.runs.places(coded.dictionary)[np.asarray(coded.indices)]
        # after each text's runs a place of its own for the end
        closes = np.cumsum(count) + np.arange(n)
        every = np.full(len(at) + n, -1)
        inner = np.ones(len(every), bool)
        inner[closes] = False
        every[inner] = at
        flat, length = self.runs.flat(every, end)
        return flat, np.r_[0, np.cumsum(length)[closes]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
