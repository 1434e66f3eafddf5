"""One form for texts that look the same.

All texts of an Arrow batch become one array of positioned code points. A table of decompositions and
look-alikes, the same on every executor and of fixed size, is joined to it by code point: each one is
replaced by its compatibility decomposition, in which letters of other scripts drawn like Latin ones,
kinds of hyphens and kinds of spaces are replaced too, and code points that show nothing are left
out. Marks are ordered by combining class, segments of a base and its marks are composed, and the
texts are rebuilt. No text is cut and none leaves its row: the exchange that an explode over rows
would need is the array's order.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .arrow import slices
from .bpe import LETTER, NUMBER, classes

# Letters of other scripts that are drawn like a Latin letter.
LOOK_ALIKE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V",
    "а": "a", "г": "r", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ѵ": "v", "ҽ": "e", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p",
    "σ": "o", "υ": "u", "ϲ": "c", "ϳ": "j",
    # Armenian
    "Լ": "L", "Ս": "U", "Տ": "S", "Օ": "O", "ա": "w", "գ": "q", "զ": "q", "հ": "h", "յ": "j", "ո": "n", "ռ": "n",
    "ս": "u", "ց": "g", "ք": "f", "օ": "o",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H",
    "Ꮍ": "Y", "Ꮐ": "G", "Ꮒ": "h", "Ꮓ": "Z", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L",
    "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏻ": "G", "Ᏼ": "B", "ꭵ": "i", "ꮁ": "r", "ꮃ": "w", "ꮓ": "z", "ꮩ": "v",
    "ꮪ": "s", "ꮯ": "c",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓒ": "d", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F",
    "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A",
    "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Coptic
    "Ⲃ": "B", "Ⲍ": "Z", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T",
    "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
}
# Hyphens beside the ASCII one (others decompose to these).
HYPHENS = "‐‑⁃˗"
# Ranges of code points that show nothing, beside the format characters (category Cf).
HIDDEN = (
    (0x0000, 0x0008), (0x000E, 0x001F), (0x007F, 0x009F), (0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5),
    (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF),
)


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length of each code point's replacement, where it starts in the next, replacements, combining class)."""
    size = 0x110000
    length = np.ones(size, np.int64)
    ccc = np.zeros(size, np.uint8)
    other: dict[int, list[int]] = {}
    alike = {ord(a): ord(b) for a, b in LOOK_ALIKE.items()} | {ord(h): 0x2D for h in HYPHENS}
    for c in range(size):
        if 0x4E00 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7A3 or 0xD800 <= c <= 0xF8FF or 0x20000 <= c <= 0x2F7FF or 0x30000 <= c:
            continue  # ideographs, surrogates and private use stay; Hangul syllables are composed as they are
        ch = chr(c)
        ccc[c] = unicodedata.combining(ch)
        to = [alike[c]] if c in alike else [alike.get(ord(x), ord(x)) for x in unicodedata.normalize("NFKD", ch)]
        if unicodedata.category(ch) == "Cf" or any(a <= c <= b for a, b in HIDDEN):
            to = []
        elif unicodedata.category(ch) == "Zs":
            to = [0x20]
        if to != [c]:
            other[c] = to
    for a, b in HIDDEN:
        for c in range(max(a, 0x30000), b + 1):
            other[c] = []
    start = np.zeros(size, np.int64)
    flat: list[int] = []
    for c, to in other.items():
        start[c], length[c] = len(flat), len(to)
        flat += to
    changed = np.zeros(size, bool)
    changed[list(other)] = True
    start[~changed] = -1
    return length, start, np.array(flat, np.uint32), ccc


def canonical_batch(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(the canonical form of each text, its letters and digits)."""
    length, start, flat, ccc = tables()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes)
    n = length[cp]
    st = start[cp]
    if not (st < 0).all():
        out_end = np.cumsum(n)
        src = np.repeat(np.arange(len(cp)), n)
        k = np.arange(out_end[-1] if len(cp) else 0) - (out_end - n)[src]
        s = st[src]
        cp = np.where(s < 0, cp[src], flat[np.maximum(s, 0) + np.where(s < 0, 0, k)])
        ends = np.append(0, out_end)[ends]
    # A conjoining vowel or final also belongs to what stands before it.
    mark = (ccc[cp] > 0) | ((cp >= 0x1161) & (cp <= 0x11FF))
    begin = np.zeros(len(cp), bool)
    begin[np.append(0, ends[:-1])[np.append(0, ends[:-1]) < len(cp)]] = True
    joined = np.flatnonzero(mark & ~begin)
    if len(joined):
        head = ~mark | begin
        seg = np.cumsum(head) - 1  # segment: a base and its marks
        at = np.flatnonzero(head)
        touched = np.unique(seg[joined])
        lo = at[touched]
        hi = np.append(at, len(cp))[touched + 1]
        own = np.repeat(np.arange(len(lo)), hi - lo)
        pos = np.arange(len(own)) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
        cls = ccc[cp[pos]]
        # Canonical order: marks between two of class 0 by class, equal classes in their order.
        stretch = np.cumsum(cls == 0)
        cp = cp.copy()
        cp[pos] = cp[pos[np.lexsort((pos, cls, stretch, own))]]
        bounds = np.append(0, np.cumsum(hi - lo)) * 4
        slices = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(cp[pos].tobytes())])
        coded = slices.dictionary_encode()
        new = [unicodedata.normalize("NFC", x.decode("utf-32-le", "surrogatepass")) for x in coded.dictionary.to_pylist()]
        new_size = np.fromiter(map(len, new), np.int64, len(new))
        new_flat = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.asarray(coded.indices)
        # Write each composed segment over its start, drop the rest (composing never lengthens).
        keep = np.ones(len(cp), bool)
        keep[pos] = False
        size = np.minimum(new_size[code], hi - lo)
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        to = np.repeat(lo, size) + k
        cp[to] = new_flat[np.repeat((np.cumsum(new_size) - new_size)[code], size) + k]
        keep[to] = True
        ends = np.append(0, np.cumsum(keep))[ends]
        cp = cp[keep]
    kind = classes()[cp]
    alnum = np.append(0, np.cumsum((kind == LETTER) | (kind == NUMBER)))[ends]
    whole = cp.tobytes().decode("utf-32-le", "surrogatepass")
    begins = np.append(0, ends[:-1])
    return [whole[a:b] for a, b in zip(begins, ends)], np.diff(np.append(0, alnum))


def _forms(keyed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for b in batches:
            for part in slices(b, b.num_columns - 1, 2000):
                raw = part.column(part.num_columns - 1).to_pylist()
                texts = [x or "" for x in raw]
                forms, alnum = canonical_batch(texts)
                kept = [part.column(i) for i in range(part.num_columns - 1)]
                names = part.schema.names[:-1]
                if keyed:
                    yield pa.RecordBatch.from_arrays(
                        [*kept, pa.array(map(digest, forms), pa.binary()), pa.array(map(digest, texts), pa.binary()), pa.array(alnum.astype(np.int64))],
                        names=[*names, "look", "same", "alnum"],
                    )
                else:
                    forms = [None if r is None else f for r, f in zip(raw, forms)]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(forms, pa.string())], names=[*names, "form"])

    return run


def canonical(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and form: the consistent form of each text, equal for texts that look the same.

    A null text gives a null form, an empty or invisible one an empty form. Case, missing accents,
    the number of spaces, tabs and line ends are kept. Applying it twice changes nothing.
    """
    cols = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:-1])
    return cols.mapInArrow(_forms(False), f"{schema}, form string")


def look_keys(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, look (digest of the form), same (digest of the text), alnum (letters and digits)."""
    cols = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return cols.mapInArrow(_forms(True), "doc_id long, look binary, same binary, alnum long")


def look_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest id of the texts that look the same), variants (its different texts), records.

    Null and empty texts are one class. Counts fold before the shuffle, so a class may hold any share of the rows.
    """
    keys = look_keys(df, id_col, text_col)
    texts = keys.groupBy("look", "same").agg(F.min("doc_id").alias("lo"), F.count("*").alias("n"))
    own = texts.groupBy("look").agg(F.min("lo").alias("class_id"), F.count("*").alias("variants"), F.sum("n").alias("records"))
    return keys.join(own, "look").select("doc_id", "class_id", "variants", "records")


def look_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: documents of at least ``least`` letters or digits whose texts differ but look the same.

    Copies of one text fold to their smallest id before texts that look the same are paired; members are joined to the
    pairs of texts at the end. Copies of one text are no pair among themselves.
    """
    keys = scratch(look_keys(df, id_col, text_col).where(F.col("alnum") >= least).select("doc_id", "look", "same").distinct(), "looks")
    texts = keys.groupBy("look", "same").agg(F.min("doc_id").alias("rep"))
    several = scratch(texts.join(texts.groupBy("look").agg(F.count("*").alias("variants")).where("variants > 1").select("look"), "look"), "variants")
    a = several.select("look", F.col("rep").alias("a"))
    b = several.select("look", F.col("rep").alias("b"))
    pairs = a.join(b, "look").where("a < b").select("a", "b")
    members = keys.join(several, ["look", "same"]).select("rep", "doc_id")
    left = members.select(F.col("rep").alias("a"), F.col("doc_id").alias("x"))
    right = members.select(F.col("rep").alias("b"), F.col("doc_id").alias("y"))
    out = pairs.join(left, "a").join(right, "b")
    return out.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
