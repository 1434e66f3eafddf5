"""Text functions: chunks, terms, token positions, sentences, answers. Offsets are UTF-8 bytes, ends exclusive."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that are no terms.
STOPWORDS = (
    "the a an and or of to in on for is are was were be this that with as by at from it its we you they i "
    "的 了 和 与 及 或 在 是 我 你 他 她 它 们 这 那 "
    "一个 一种 以及 如果 因为 所以 我们 可以 进行 通过 对于 然后"
).split()
# Characters that end a sentence.
TERMINATORS = "。！？\n.!?"

_CJK_JAVA = r"\p{IsHan}぀-ヿ㐀-䶿"
_SENTENCE = rf"[^{TERMINATORS}]*[{TERMINATORS}]|[^{TERMINATORS}]+"

TOKENS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def n_chunks(text: Column, size: int = 480, overlap: int = 80) -> Column:
    n = F.length(text)
    return F.when(n <= max(size, 64), 1).otherwise(F.ceil((n - overlap) / F.lit(max(size, 64) - overlap)).cast("int"))


def chunks(text: Column, size: int = 480, overlap: int = 80) -> Column:
    """Windows of ``size`` characters (at least 64) that overlap; a text of at most ``size`` is one chunk, null gives null."""
    size = max(size, 64)
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    return F.transform(F.sequence(F.lit(0), n_chunks(text, size, overlap) - 1), lambda i: F.substring(text, i * (size - overlap) + 1, F.lit(size)))


def chunk_table(df: DataFrame, id_col: str, text_col: str, size: int = 480, overlap: int = 80) -> DataFrame:
    """One row a chunk: the id, chunk_index, content and char_offset, the bytes of the chunks before it (overlaps count twice).

    Null texts have no rows. The running sum is taken inside the row, so nothing is shuffled.
    """
    cut = df.where(F.col(text_col).isNotNull()).withColumn("_c", chunks(F.col(text_col), size, overlap))
    pieces = F.transform(
        F.sequence(F.lit(1), F.size("_c")),
        lambda i: F.struct(
            (i - 1).alias("chunk_index"),
            F.element_at("_c", i).alias("content"),
            F.aggregate(F.slice("_c", 1, i - 1), F.lit(0), lambda a, x: a + F.octet_length(x)).alias("char_offset"),
        ),
    )
    return cut.select(id_col, F.explode(F.when(F.size("_c") > 0, pieces)).alias("p")).select(id_col, "p.*")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """The terms of a text in order, repeated: ASCII words in lower case; each CJK character and pair of neighbours.

    Everything else separates. Stop words are left out. Null gives null, an empty text an empty array.
    """
    low = F.translate(text, _UPPER, _LOWER)  # ASCII only: lower() would make words of other letters
    pattern = F.lit(rf"[a-z0-9]+|(?=([{_CJK_JAVA}]{{1,2}}))[{_CJK_JAVA}]")
    one, two = F.regexp_extract_all(low, pattern, F.lit(0)), F.regexp_extract_all(low, pattern, F.lit(1))
    both = F.flatten(F.zip_with(one, two, lambda x, y: F.when(F.length(y) > F.length(x), F.array(x, y)).otherwise(F.array(x))))
    return F.filter(both, lambda t: ~t.isin(*STOPWORDS))


def term_bag(text: Column) -> Column:
    """The same terms as terms(), first words and characters, then pairs: cheaper where the order says nothing."""
    low = F.translate(text, _UPPER, _LOWER)
    one = F.regexp_extract_all(low, F.lit(rf"[a-z0-9]+|[{_CJK_JAVA}]"), F.lit(0))
    two = F.regexp_extract_all(low, F.lit(rf"(?=([{_CJK_JAVA}]{{2}}))[{_CJK_JAVA}]"), F.lit(1))
    return F.filter(F.concat(one, two), lambda t: ~t.isin(*STOPWORDS))


def distinct_terms(text: Column) -> Column:
    """Each term once, in order of its first place."""
    return F.array_distinct(terms(text))


def _tokenizer():
    import regex

    return regex.compile(r"[A-Za-z0-9]+|[\p{Han}぀-ヿ㐀-䶿]+")


def tokenize_text(text: str | None, run=None, stop=frozenset(STOPWORDS)) -> list[tuple[str, int, int]]:
    """(term, start byte, end byte) of every token of one text."""
    out: list[tuple[str, int, int]] = []
    at, byte = 0, 0
    for m in (run or _tokenizer()).finditer(text or ""):
        byte += len(text[at : m.start()].encode())
        word = m.group()
        if word[0] < "\x80":
            if (low := word.lower()) not in stop:
                out.append((low, byte, byte + len(word)))
            byte += len(word)
        else:
            for i, c in enumerate(word):
                n = len(c.encode())
                if c not in stop:
                    out.append((c, byte, byte + n))
                two = word[i : i + 2]
                if len(two) == 2 and two not in stop:
                    out.append((two, byte, byte + len(two.encode())))
                byte += n
        at = m.end()
    return out


SLICE = 500  # texts whose tokens are Python objects at a time


def tokenize(text: Column) -> Column:
    """Array of (term, start, end) of a text column; the terms are those of terms()."""
    return F.arrow_udf(token_arrays, TOKENS)(text)


def token_arrays(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The tokens of each text, SLICE texts at a time; null gives null."""
    run = _tokenizer()
    for s in texts:
        for lo in range(0, len(s), SLICE):
            own = s.slice(lo, SLICE).to_pylist()
            n, term, start, end = [0], [], [], []
            for x in own:
                for t, a, b in tokenize_text(x, run):
                    term.append(t)
                    start.append(a)
                    end.append(b)
                n.append(len(term))
            flat = pa.StructArray.from_arrays([pa.array(term, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["term", "start", "end"])
            yield pa.ListArray.from_arrays(pa.array(n, pa.int32()), flat, mask=pa.array([x is None for x in own]))


SENTENCES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))
_ENDS = re.compile("|".join(re.escape(c) for c in TERMINATORS).encode())


def sentences(text: Column) -> Column:
    """Array of (start, end, text): a sentence keeps its terminator, a tail without one counts, consecutive terminators are sentences.

    One pass over the bytes of a batch; the sentences' texts are places in them.
    """
    # Made here: an Arrow function asks for the session when it is made.
    return F.arrow_udf(sentence_arrays, SENTENCES)(text)


def sentence_arrays(texts: pa.Array) -> pa.Array:
    """The (start, end, text) of each text's sentences; null gives null."""
    texts = texts.cast(pa.large_string())
    if texts.offset:
        texts = pa.concat_arrays([texts])
    ends = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    first, data = int(ends[0]), texts.buffers()[2]
    data = memoryview(data)[first : int(ends[-1])] if data is not None else b""
    ends = ends - first
    # A sentence ends behind each terminator and at the end of each text; bytes of a null one belong to none.
    cut = np.fromiter((m.end() for m in _ENDS.finditer(data)), np.int64)
    filled = ends[1:] > ends[:-1]
    cut = np.union1d(cut, ends[1:][filled])
    of = np.searchsorted(ends[1:], cut)  # the first text that reaches so far
    begin = np.maximum(np.append(0, cut[:-1]), ends[:-1][of]) if len(cut) else cut
    null = np.asarray(texts.is_null())
    own = ~null[of]
    cut, of, begin = cut[own], of[own], begin[own]
    at = np.append(np.searchsorted(of, np.arange(len(texts))), len(of)).astype(np.int32)
    pieces = pa.StructArray.from_arrays(
        [pa.array((begin - ends[of]).astype(np.int32)), pa.array((cut - ends[of]).astype(np.int32)), _pieces(data, begin, cut)], names=["start", "end", "text"]
    )
    return pa.ListArray.from_arrays(at, pieces, mask=pa.array(null))


def _pieces(data, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings data[begin:end], which lie one after the other."""
    if not len(begin):
        return pa.array([], pa.string())
    size = np.append(0, np.cumsum(end - begin))
    joined = data if size[-1] == len(data) else b"".join(bytes(data[a:z]) for a, z in zip(begin, end))
    whole = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(size.astype(np.int64).tobytes()), pa.py_buffer(joined))
    return whole.cast(pa.string())


def split_sentences(text: str | None) -> list[tuple[int, int]]:
    out, byte = [], 0
    for m in re.finditer(_SENTENCE, text or ""):
        n = len(m.group().encode())
        out.append((byte, byte + n))
        byte += n
    return out


def answer_excerpt(text: Column, most: int = 120) -> Column:
    """The first ``most`` characters, with an ellipsis if there were more, trimmed."""
    return F.regexp_replace(F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text), r"^\s+|\s+$", "")


def parse_tags(csv: Column) -> Column:
    """Comma-separated tags: trimmed, blank ones left out; null gives an empty array."""
    return F.coalesce(F.filter(F.transform(F.split(csv, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def first_tag(tags: Column) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(1)), F.lit(""))


def joined_tags(tags: Column) -> Column:
    return F.coalesce(F.array_join(tags, " "), F.lit(""))


def search_text(content: Column, caption: Column, tags: Column) -> Column:
    """What the keyword index reads of an entity: its content, else caption and tags."""
    return F.when(F.coalesce(content, F.lit("")) != "", content).otherwise(F.concat(F.coalesce(caption, F.lit("")), F.lit(" "), joined_tags(tags)))


def char_offsets(df: DataFrame, doc_col: str, order_col: str, text_col: str) -> DataFrame:
    """char_offset from chunks that are rows already: bytes of the document's chunks before."""
    w = Window.partitionBy(doc_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("char_offset", F.coalesce(F.sum(F.octet_length(text_col)).over(w), F.lit(0)))
