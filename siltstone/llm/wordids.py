"""Token ids of whole texts for a word-wise BPE, by way of the distinct words.

For tokenizers that drop white space and split it off before anything else (by
what their file says; others get whole texts), a text's ids are the ids of its white-space-separated chunks one after another. A
batch's chunks are made distinct first, and the ids of words are kept from batch
to batch within a bound, so a frequent word is merged once per worker rather
than once per occurrence.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words, and ids of words, beyond which a worker forgets and starts anew; about 100 MB.
KEPT = 400_000
KEPT_IDS = 3_000_000
#: What all special tokens hold.
SPECIAL = "<|"
#: Words that are encoded as one text, with a character between them that is a chunk and an id of its own.
TOGETHER = 256
BETWEEN = "\x01"
#: Words that normalising leaves as they are and that are one chunk.
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: Words that the tokenizer takes one by one, at once.
ONE_BY_ONE = 4096
#: A word of plain letters, and the punctuation after it, which is split off
#: before merging. None of these can join in a contraction such as 's.
WORD_AND_MARKS = r"^(?P<word>[a-zß-öø-ÿ]+)(?P<marks>[.,!|#%&*$]+)$"

#: What a tokenizer's file says (fixed values) if it lower-cases, drops white space and splits it off before merging.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
_loaded: dict[str, WordEncoder] = {}


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            told = json.load(f)
        #: Whether ids are those of lower-cased chunks one after another; else texts are encoded as they are.
        self.is_wordwise = {k: told[k] for k in WORDWISE} == WORDWISE and not any(t["normalized"] or SPECIAL not in t["content"] for t in told["added_tokens"])
        #: Merges alone, between white space.
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        alone = self.merger.encode(f"a {BETWEEN} a", add_special_tokens=False).ids
        #: The id of BETWEEN, if it has one.
        self.between = alone[1] if self.is_wordwise and len(alone) == 3 else None
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.start = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.used = 0

    def _room(self, words: int, ids: int) -> None:
        for name, need in (("start", words), ("size", words), ("ids", ids)):
            have = getattr(self, name)
            if len(have) < need:
                more = np.zeros(max(need, 2 * len(have)), have.dtype)
                more[: len(have)] = have
                setattr(self, name, more)

    def places(self, words: list[str]) -> np.ndarray:
        """Where each word's ids are; merges those that aren't known."""
        at = np.fromiter(map(self.place.get, words, itertools.repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            new = [words[k] for k in unknown.tolist()]
            found, sizes = self._merged(new)
            n, end = len(self.place), self.used + len(found)
            self._room(n + len(new), end)
            self.ids[self.used : end] = found
            self.start[n : n + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.size[n : n + len(new)] = sizes
            at[unknown] = np.arange(n, n + len(new))
            self.place.update(zip(new, range(n, n + len(new)), strict=True))
            self.used = end
        return at

    def _ids(self, texts: list[str]) -> list[array]:
        return [array("I", e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and each one's number of ids.

        Plain words need neither normalising nor the pattern and go many at a time,
        as a call costs more than a word; others go through the tokenizer one by one.
        """
        is_plain = np.fromiter((PLAIN(w) is not None for w in words), bool, len(words)) & (self.between is not None)
        plain, others = (list(itertools.compress(words, x)) for x in (is_plain, ~is_plain))
        parts, sizes = [np.zeros(0, np.uint32)], np.zeros(len(words), np.int64)
        counts = [np.zeros(0, np.int64)]
        for a in range(0, len(plain), TOGETHER):
            ids = np.array(self.merger.encode_batch_fast([f" {BETWEEN} ".join(plain[a : a + TOGETHER])], add_special_tokens=False)[0].ids, np.uint32)
            counts.append(np.diff(np.r_[-1, np.flatnonzero(ids == self.between), len(ids)]) - 1)
            parts.append(ids[ids != self.between])
        sizes[is_plain] = np.concatenate(counts)
        singly = [x for a in range(0, len(others), ONE_BY_ONE) for x in self._ids(others[a : a + ONE_BY_ONE])]  # an encoding takes some kB, its ids a few bytes
        sizes[~is_plain] = [len(x) for x in singly]
        joined, owner = np.concatenate([*parts, *(np.frombuffer(x, np.uint32) for x in singly)]), np.r_[np.flatnonzero(is_plain), np.flatnonzero(~is_plain)]
        return joined[np.argsort(np.repeat(owner, sizes[owner]), kind="stable")], sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and each text's number of ids. A null counts as empty."""
        if not self.is_wordwise:
            found = self._ids(pc.fill_null(texts, "").to_pylist())
            return np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = chunks.offsets.to_numpy().astype(np.int64)
        coded = chunks.flatten().dictionary_encode()
        distinct, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # special tokens are matched before lower-casing, so chunks that may hold one stay as they are
        lower = pc.if_else(pc.match_substring(distinct, SPECIAL), distinct, pc.ascii_lower(distinct))
        split = pc.extract_regex(lower, WORD_AND_MARKS)
        word = pc.if_else(pc.is_null(split), lower, pc.struct_field(split, "word")).dictionary_encode()
        marks = pc.fill_null(pc.struct_field(split, "marks"), "").dictionary_encode()
        if len(self.place) > KEPT or self.used > KEPT_IDS:
            self.forget()
        at = np.empty((len(distinct), 2), np.int64)
        for k, column in enumerate((word, marks)):
            at[:, k] = self.places(column.dictionary.to_pylist())[column.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
        at = at[index].ravel()
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(total)]
        cumulated = np.r_[0, ends]
        per_text = np.diff(cumulated[2 * (bounds - bounds[0])])
        return ids, per_text


def encoder(path: str) -> WordEncoder:
    """One per worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]
