"""Encoding of texts by a public byte-level BPE vocabulary.

Boundaries are found without a regular expression. All texts of an Arrow batch are one array of code
points; a table maps each code point to a class (letter, number, space, other white space, rest), and the
class with the one or two that follow gives its symbol. A symbol is a transition function on what kind of
slice is open. Functions are composed associatively: inside stretches of ``STRETCH`` code points side by
side, then over the stretches by doubling; the state before each stretch then tells, in one more pass,
where slices start.

The slices are dictionary-encoded, so each distinct slice of a batch is merged once, and slices seen
before in the worker come from a cache. Byte offsets of the tokens are kept on demand (token_table).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices

VOCABULARY = os.environ.get("SIFTSPARK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

LETTER, NUMBER, SPACE, WHITE, REST = 1, 2, 3, 4, 0
CACHE_SLICES = 400_000  # a worker's cache is emptied beyond this; it changes no result


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, by the properties L, N and White_Space."""
    import regex

    chars = "".join(map(chr, [c if not 0xD800 <= c < 0xE000 else 0 for c in range(0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, chars):
            out[m.start() : m.end()] = kind
    out[0xD800:0xE000] = 0
    out[0x20] = SPACE
    return out


# What is open before a code point: nothing, letters, numbers, other signs, white space, a space that the next
# slice begins with, a contraction that lacks one letter or two.
NONE, LETTERS, NUMBERS, OTHERS, BLANKS, JOINED, ONE_MORE, TWO_MORE = range(8)
# Symbols: the classes; white space that more or the text's end follows, the last one of a run, a last one that is
# a space; an apostrophe before s, t, m, d, or before re, ve, ll.
S_REST, S_LETTER, S_NUMBER, S_BLANK, S_TAIL, S_SPACE, S_SHORT, S_LONG = range(8)
STRETCH = 64


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(state after, 1 where a slice starts) by symbol and state; symbols from 8 on begin a text."""
    after, starts = np.zeros((16, 8), np.uint8), np.zeros((16, 8), np.uint8)
    runs = {S_REST: OTHERS, S_LETTER: LETTERS, S_NUMBER: NUMBERS}
    for symbol in range(8):
        for state in range(8):
            if state in (ONE_MORE, TWO_MORE):
                to, new = (NONE, 0) if state == ONE_MORE else (ONE_MORE, 0)
            elif symbol in runs:
                to, new = runs[symbol], int(state not in (runs[symbol], JOINED))
            elif symbol == S_BLANK:
                to, new = BLANKS, int(state != BLANKS)
            elif symbol in (S_SHORT, S_LONG) and state in (OTHERS, JOINED):
                to, new = OTHERS, 0
            else:
                to, new = {S_TAIL: NONE, S_SPACE: JOINED, S_SHORT: ONE_MORE, S_LONG: TWO_MORE}[symbol], 1
            after[symbol, state], starts[symbol, state] = to, new
        after[symbol + 8], starts[symbol + 8] = after[symbol, NONE], 1
    return after, starts


def symbols(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of each code point. first: True at each text's first one."""
    n = len(cp)
    cls = classes()[cp]
    white = (cls == SPACE) | (cls == WHITE)
    out = np.array([S_REST, S_LETTER, S_NUMBER, S_BLANK, S_BLANK], np.uint8)[cls]
    end = np.append(first[1:], True)  # the text ends after this one
    tail = white & ~end & np.append(~white[1:], False)
    out[tail] = np.where(cls[tail] == SPACE, S_SPACE, S_TAIL)
    quote = np.flatnonzero((cp == 0x27) & ~end)
    if len(quote):
        a = cp[quote + 1]
        out[quote[np.isin(a, [0x73, 0x74, 0x6D, 0x64])]] = S_SHORT
        more = ~end[quote + 1]
        b = cp[np.minimum(quote + 2, n - 1)]
        long = more & (((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C)))
        out[quote[long]] = S_LONG
    return out + np.where(first, 8, 0).astype(np.uint8)


def boundaries(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a slice starts. cp: code points of all texts, first: True at each text's first one."""
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    after, starts = (t.ravel() for t in automaton())
    lanes = -(-n // STRETCH)
    sym = np.zeros(lanes * STRETCH, np.int64)
    sym[:n] = symbols(cp, first)
    sym = np.ascontiguousarray(sym.reshape(lanes, STRETCH).T) * 8
    whole = np.broadcast_to(np.arange(8), (lanes, 8)).copy()  # each stretch's function of the state before it
    for row in sym:
        whole = after[row[:, None] + whole]
    step = 1
    while step < lanes:  # composition by doubling: afterwards each covers all stretches up to its own
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].astype(np.int64), 1)
        step *= 2
    state = np.append(NONE, whole[:-1, NONE]).astype(np.int64)
    out = np.zeros((STRETCH, lanes), bool)
    for j, row in enumerate(sym):
        out[j] = starts[row + state]
        state = after[row + state].astype(np.int64)
    return out.T.ravel()[:n]


@lru_cache(2)
def _merger(path: str):
    """The pair merging of one slice of bytes under the vocabulary at ``path``."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece, {}


def utf8_lengths(cp: np.ndarray) -> np.ndarray:
    return (1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)).astype(np.int64)


def encode_batch(texts: pa.Array, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets of each text in them); a null text has none."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    k = len(texts)
    text_at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + k + 1] if k else np.zeros(1, np.int64)
    data = bytes(memoryview(texts.buffers()[2])[text_at[0] : text_at[-1]]) if k and text_at[-1] > text_at[0] else b""
    text_at = text_at - text_at[0]
    if not data:
        return np.zeros(0, np.int32), np.zeros(k + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.zeros(len(cp), bool)
    begins = np.unique(text_at[:-1][text_at[:-1] < text_at[1:]])
    first[np.searchsorted(lead, begins)] = True
    at = lead[boundaries(cp, first)]
    bounds = np.append(at, len(data)).astype(np.int64)
    slices = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    coded = slices.dictionary_encode()
    merge, cache = _merger(path)
    if len(cache) > CACHE_SLICES:
        cache.clear()
    parts = []
    for piece in coded.dictionary.to_pylist():
        got = cache.get(piece)
        if got is None:
            got = cache[piece] = np.array(merge(piece), np.int32)
        parts.append(got)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat, starts = np.concatenate(parts), np.cumsum(sizes) - sizes
    code = np.asarray(coded.indices)
    each = sizes[code]
    ends = np.cumsum(each)
    ids = flat[np.arange(ends[-1]) + np.repeat(starts[code] - (ends - each), each)]
    upto = np.append(0, ends)[np.searchsorted(at, text_at)]
    return ids, upto


def _encoder(path: str, counts: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, b.num_columns - 1, 2000):
                ids, upto = encode_batch(part.column(part.num_columns - 1), path)
                kept = [part.column(i) for i in range(part.num_columns - 1)]
                names = part.schema.names[:-1]
                if counts:
                    out = pa.array(np.diff(upto))
                else:
                    out = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*kept, out], names=[*names, "n_tokens" if counts else "ids"])

    return encode


def encode(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY) -> DataFrame:
    """``keep`` and ids (array of int) of each row's whole text, without special tokens.

    Null and empty texts give an empty list; texts of any length are encoded whole; the strings of
    special tokens are ordinary text. Repeated rows stay repeated. Other columns are not read.
    ``path``: the vocabulary as ranks, readable on every executor.
    """
    cols = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:-1])
    return cols.mapInArrow(_encoder(path, False), f"{schema}, ids array<int>")


def count_tokens(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY) -> DataFrame:
    """``keep`` and n_tokens (long) of each row's whole text; 0 for null and empty ones."""
    cols = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:-1])
    return cols.mapInArrow(_encoder(path, True), f"{schema}, n_tokens long")


@lru_cache(2)
def _tokens(path: str) -> tuple[np.ndarray, np.ndarray]:
    with open(path, "rb") as f:
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in (line.split() for line in f if line.strip()))
    size = pairs[-1][0] + 1
    by = [b""] * size
    for i, t in pairs:
        by[i] = t
    ends = np.cumsum([len(t) for t in by])
    return np.frombuffer(b"".join(by), np.uint8), np.append(0, ends)


def _bytes_of(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all tokens, where each ends in them)."""
    data, at = _tokens(path)
    size = at[ids + 1] - at[ids]
    ends = np.cumsum(size)
    if not len(ids):
        return np.zeros(0, np.uint8), ends
    return data[np.arange(ends[-1]) + np.repeat(at[ids] - (ends - size), size)], ends


def _decoder(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            n = np.asarray(pc.list_value_length(lists).fill_null(0))
            raw, ends = _bytes_of(np.asarray(lists.flatten()).astype(np.int64), path)
            upto = np.append(0, ends)[np.append(0, np.cumsum(n))].astype(np.int64)
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(upto), pa.py_buffer(raw.tobytes())])
            try:
                out = texts.cast(pa.large_string()).cast(pa.string())
            except pa.ArrowInvalid:  # ids that are no whole text
                out = pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], out], names=[*b.schema.names[:-1], "text"])

    return decode


def decode(df: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY) -> DataFrame:
    """``keep`` and the text of each row's ids; null and empty lists give an empty text."""
    cols = df.select(*keep, F.col(ids_col).cast("array<int>").alias("_ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:-1])
    return cols.mapInArrow(_decoder(path), f"{schema}, text string")


def token_table(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY) -> DataFrame:
    """``keep``, ids and ends of each row's whole text: token i is the bytes from ends[i - 1] (0 for the first) to ends[i] of it.

    So a part of a text can be decoded, or a place in it be given its token. Null and empty texts give empty lists.
    """
    encoded = encode(df, text_col, keep, path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            n = np.asarray(pc.list_value_length(lists))
            _, ends = _bytes_of(np.asarray(lists.flatten()).astype(np.int64), path)
            first = np.cumsum(n) - n
            own = ends - np.repeat(np.append(0, ends)[first], n)
            at = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(at, pa.array(own.astype(np.int32)))], names=[*b.schema.names, "ends"])

    return encoded.mapInArrow(run, f"{schema}, ends array<int>")
