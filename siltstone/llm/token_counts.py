"""Token counts of sections, by character offsets.

A document is encoded once as a whole, so its counts add up to what a model will
see. Each token's span of characters is then joined to the sections' spans. A
token that crosses a boundary goes to one section by a fixed rule:

* ``most`` (the default): the section that holds most of its characters, the
  earlier of two that hold as many;
* ``first``: the section that holds the first of its characters inside any.

A character whose bytes are in several tokens belongs to each of their spans.
Tokens that touch no section are counted under a null section.

Everything happens where the document lies; nothing is shuffled.

Defined results: a null text counts as empty; an empty text has one empty line
with no token. A very long text is encoded whole, whatever its runs of blanks.
Null or empty lists of spans leave all tokens outside. Documents that repeat an
id, or have none, are counted one by one. Other columns are never looked at, so
their names don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import by_bytes

#: Runs of the matcher's white space that are encoded by themselves, and the part of a pattern that asks for it.
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{50000,}")
PEEKS_AFTER_BLANKS = r"\s+(?!\S)"

_loaded: dict[tuple[str, str], tuple[Callable[[str], list[int]], np.ndarray]] = {}
SCHEMA = "key {kind}, section int, name string, start long, end long, n_tokens long, n_crossing long, doc_tokens long"


def byte_encoder(path: str, pattern: str) -> tuple[Callable[[str], list[int]], np.ndarray]:
    """The encoding of a file of ranks, and each id's number of bytes; one per worker and file."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            sizes[k] = len(token)
        plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _loaded[path, pattern] = (lambda text: encode_whole(plain, text), sizes)
    return _loaded[path, pattern]


def encode_whole(plain, text: str) -> list[int]:
    """The ids of a text, with long runs of white space taken out of the pattern's hands.

    The library's matcher keeps a state per blank, as the pattern looks ahead
    after a run, and gives up on some hundred thousand. A run is one piece to the
    pattern, without its last blank if something follows; pieces are encoded
    independently of each other, so encoding the piece by itself gives the same ids.
    """
    if not (PEEKS_AFTER_BLANKS in plain._pat_str and (found := LONG_BLANKS.search(text))):
        return plain.encode_ordinary(text)
    out, at = [], 0
    while found:
        end = found.end() if found.end() == len(text) else found.end() - 1
        out += plain.encode_ordinary(text[at : found.start()]) + plain._encode_single_piece(text[found.start() : end])
        at = end
        found = LONG_BLANKS.search(text, at)
    return out + plain.encode_ordinary(text[at:])


def spans_of(text: str, ids: list[int], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first character of each token and the one after its last."""
    data = np.frombuffer(text.encode(), np.uint8)
    stop = np.cumsum(sizes[np.array(ids, np.int64)])
    begin = np.r_[0, stop[:-1]] if len(stop) else stop
    character = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
    return character[begin], character[stop - 1] + 1


def attribute(start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """For each token [start, end) its section, -1 if none, and whether it touches more than one.

    The sections [first, last) are in order and don't overlap; empty ones get nothing.
    """
    if rule not in ("most", "first"):
        raise ValueError(f"unknown rule {rule!r}")
    some = np.flatnonzero(last > first)
    a, b = first[some], last[some]
    low = np.searchsorted(b, start, "right")
    high = np.searchsorted(a, end, "left") - 1
    out = np.where(low <= high, low, -1)
    crossing = high > low
    if rule == "most" and crossing.any():
        t = np.flatnonzero(crossing)
        best, chosen = np.zeros(len(t), np.int64), low[t].copy()
        for k in range(int((high[t] - low[t]).max()) + 1):
            at = np.minimum(low[t] + k, high[t])
            held = np.minimum(end[t], b[at]) - np.maximum(start[t], a[at])
            more = held > best
            best[more], chosen[more] = held[more], at[more]
        out[t] = chosen
    return np.where(out >= 0, some[out] if len(some) else -1, -1), crossing


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray, None]:
    """The lines, each with the line feed that ends it."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(code == 10) + 1
    if not len(ends) or ends[-1] < len(code):
        ends = np.r_[ends, len(code)]
    return np.r_[0, ends[:-1]].astype(np.int64), ends.astype(np.int64), None


def _counter(path: str, pattern: str, rule: str, lines: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = byte_encoder(path, pattern)
        for batch in batches:
            parts: dict[str, list] = {n: [] for n in ("row", "section", "name", "start", "end", "n_tokens", "n_crossing", "doc_tokens")}
            spans = None if lines else batch.column("spans").to_pylist()
            for row, text in enumerate(batch.column("text").to_pylist()):
                if lines:
                    first, last, names = lines_of(text)
                else:
                    listed = sorted((s for s in spans[row] or () if s), key=lambda s: (s["start"], s["end"]))
                    first, last = (np.array([s[n] for s in listed], np.int64) for n in ("start", "end"))
                    if (last < first).any() or (first[1:] < last[:-1]).any():
                        raise ValueError("the spans of a document overlap or end before they start")
                    names = [s["name"] for s in listed]
                ids = encode(text)
                start, end = spans_of(text, ids, sizes)
                to, crossing = attribute(start, end, first, last, rule)
                n = len(first)
                counts, cross = np.bincount(to + 1, minlength=n + 1), np.bincount(to + 1, crossing, n + 1)
                outside = bool(counts[0])
                keep = slice(0 if outside else 1, None)
                k = n + outside
                parts["row"].append(np.full(k, row))
                parts["section"].append(np.arange(-1, n)[keep])
                parts["name"].extend(([None] + (names or [None] * n))[keep])
                parts["start"].append(np.r_[-1, first][keep])
                parts["end"].append(np.r_[-1, last][keep])
                parts["n_tokens"].append(counts[keep])
                parts["n_crossing"].append(cross[keep].astype(np.int64))
                parts["doc_tokens"].append(np.full(k, len(ids)))
            if not parts["row"]:
                continue
            flat = {n: np.concatenate(v).astype(np.int64) for n, v in parts.items() if n != "name"}
            none = flat["section"] < 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(flat["row"])),
                    pa.array(flat["section"].astype(np.int32), mask=none),
                    pa.array(parts["name"], pa.string()),
                    pa.array(flat["start"], mask=none),
                    pa.array(flat["end"], mask=none),
                    *(pa.array(flat[n]) for n in ("n_tokens", "n_crossing", "doc_tokens")),
                ],
                names=["key", "section", "name", "start", "end", "n_tokens", "n_crossing", "doc_tokens"],
            )

    return count


def count_lines(docs: DataFrame, tokenizer: str, pattern: str, text: str = "text", key: str = "doc_id", rule: str = "most") -> DataFrame:
    """One row per line of each document: the id, section, start, end, n_tokens, n_crossing, doc_tokens."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = rows.transform(by_bytes).mapInArrow(_counter(tokenizer, pattern, rule, True), SCHEMA.format(kind=dict(rows.dtypes)["key"]))
    return out.drop("name").withColumnRenamed("key", key)


def count_spans(docs: DataFrame, spans: str, tokenizer: str, pattern: str, text: str = "text", key: str = "doc_id", rule: str = "most") -> DataFrame:
    """As :func:`count_lines` for the column ``spans``: arrays of (name, start, end), in code points."""
    rows = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.col(spans).cast("array<struct<name:string,start:bigint,end:bigint>>").alias("spans"),
    )
    out = rows.transform(by_bytes).mapInArrow(_counter(tokenizer, pattern, rule, False), SCHEMA.format(kind=dict(rows.dtypes)["key"]))
    return out.withColumnRenamed("key", key)
