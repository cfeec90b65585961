"""Token ids of whole texts by a byte-level BPE vocabulary.

Texts of a batch are laid end to end as one array of code points. Each code point has a class, each
class is a transition function of a small automaton, and the automaton's state after every code
point comes from a scan over the composition of those functions, which is associative: blocks are
scanned at once and joined by their totals. Where pieces begin follows from neighbouring states, by
table, without a regular expression. Pieces are looked up in a cache; those that miss it are merged
pair by pair. Offsets of the ids in the text are kept on request, for decoding parts of a text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vocabulary as ranks; a file on every executor, never part of this library.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Classes of code points.
SPACE, BLANK, NUMBER, OTHER, APOSTROPHE, LETTER, SDMT, LL, VV, RR, EE, BREAK = range(12)
# States after a code point: nothing open; a space that the next piece takes; in a run of letters,
# numbers or others; after an apostrophe that may begin a contraction; within one; after a whole one.
NONE, HELD, LETTERS, NUMBERS, OTHERS, QUOTE, QUOTE_L, QUOTE_V, QUOTE_R, WHOLE = range(10)


def _transitions() -> list[list[int]]:
    table = [[NONE] * 10 for _ in range(12)]
    for state in range(10):
        table[SPACE][state] = HELD
        table[NUMBER][state] = NUMBERS
        table[OTHER][state] = OTHERS
        table[APOSTROPHE][state] = OTHERS if state in (HELD, OTHERS, QUOTE) else QUOTE
        for c in (LETTER, SDMT, LL, VV, RR, EE):
            table[c][state] = LETTERS
    for c, state in ((SDMT, WHOLE), (LL, QUOTE_L), (VV, QUOTE_V), (RR, QUOTE_R)):
        table[c][QUOTE] = state
    table[LL][QUOTE_L] = table[EE][QUOTE_V] = table[EE][QUOTE_R] = WHOLE
    return table


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the classes' functions: the class's element, the table of products, and each element's value at NONE."""
    generators = [tuple(f) for f in _transitions()]
    elements: dict[tuple[int, ...], int] = {tuple(range(10)): 0}
    queue = list(elements)
    for f in queue:
        for g in generators:
            h = tuple(g[x] for x in f)  # first f, then g
            if h not in elements:
                elements[h] = len(elements)
                queue.append(h)
    names = list(elements)
    assert len(names) < 256
    product = np.empty((len(names), len(names)), np.uint8)
    for i, f in enumerate(names):
        for j, g in enumerate(names):
            product[i, j] = elements[tuple(g[x] for x in f)]
    return np.array([elements[g] for g in generators], np.uint8), product, np.array([f[NONE] for f in names], np.uint8)


_ELEMENT, _PRODUCT, _AT_NONE = _monoid()


def _begins() -> np.ndarray:
    """Whether a piece begins at a code point, by the states before and after it; white space is settled apart."""
    b = np.ones((10, 10), bool)
    b[HELD, 2:] = False
    for x, y in ((LETTERS, LETTERS), (NUMBERS, NUMBERS), (OTHERS, OTHERS), (QUOTE, OTHERS), (QUOTE, WHOLE), (QUOTE, QUOTE_L), (QUOTE, QUOTE_V), (QUOTE, QUOTE_R)):
        b[x, y] = False
    for x in (QUOTE_L, QUOTE_V, QUOTE_R):
        b[x, WHOLE] = b[x, LETTERS] = False
    return b


_BEGINS = _begins()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    blanks = [*range(0x9, 0xE), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[blanks] = BLANK
    table[ord(" ")] = SPACE
    table[ord("'")] = APOSTROPHE
    for letters, c in (("sdmt", SDMT), ("l", LL), ("v", VV), ("r", RR), ("e", EE)):
        for x in letters:
            table[ord(x)] = c
    return table


def scan(elements: np.ndarray, width: int = 256) -> np.ndarray:
    """Inclusive prefix products of monoid elements, block by block."""
    n = len(elements)
    if n <= width:
        out, total = np.empty(n, np.uint8), 0
        for i, e in enumerate(elements.tolist()):
            out[i] = total = _PRODUCT[total, e]
        return out
    rows = -(-n // width)
    grid = np.zeros((rows, width), np.uint8)
    grid.reshape(-1)[:n] = elements
    grid = np.ascontiguousarray(grid.T)
    for j in range(1, width):
        grid[j] = _PRODUCT[grid[j - 1], grid[j]]
    before = np.zeros(rows, np.uint8)
    before[1:] = scan(grid[-1], width)[:-1]
    return _PRODUCT[before[:, None], grid.T].reshape(-1)[:n]


def pieces(texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """All texts joined by a line break, where each piece begins and ends in it, and how many pieces each text has."""
    joined = "\n".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not joined:
        return joined, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _classes()[points]
    breaks = np.cumsum(sizes + 1)[:-1] - 1
    kinds[breaks] = BREAK
    states = _AT_NONE[scan(_ELEMENT[kinds])]
    n = len(points)
    before = np.empty(n, np.uint8)
    before[0], before[1:] = NONE, states[:-1]
    starts = _BEGINS[before, states]
    blank = (kinds == SPACE) | (kinds == BLANK)
    dark = ~(blank | (kinds == BREAK))  # neither white space nor the end of a text
    next_dark, previous_blank = np.zeros(n, bool), np.zeros(n, bool)
    next_dark[:-1] = dark[1:]
    previous_blank[1:] = blank[:-1]
    starts[blank] = (~previous_blank | next_dark)[blank]
    # An apostrophe and a letter that don't come to a contraction are two pieces.
    pending = (states >= QUOTE_L) & (states <= QUOTE_R)
    pending[:-1] &= states[1:] != WHOLE
    starts[pending] = True
    starts[breaks] = True
    firsts = np.cumsum(sizes + 1) - sizes - 1
    starts[firsts[sizes > 0]] = True
    edges = np.flatnonzero(starts)
    ends = np.append(edges[1:], n)
    keep = kinds[edges] != BREAK
    edges, ends = edges[keep], ends[keep]
    return joined, edges, ends, np.searchsorted(edges, firsts + sizes) - np.searchsorted(edges, firsts)


class Vocabulary:
    """Ranks of byte strings, with a bounded cache of whole pieces."""

    def __init__(self, ranks: dict[bytes, int], cache_size: int = 400_000) -> None:
        self.ranks, self.cache_size = ranks, cache_size
        self.cache: dict[str, tuple[int, ...]] = {}

    @cached_property
    def names(self) -> dict[int, bytes]:
        """The byte string of each rank."""
        return {r: b for b, r in self.ranks.items()}

    @staticmethod
    @lru_cache(maxsize=4)
    def load(path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Merges the adjacent pair of lowest rank, the leftmost first, until none is left."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return (whole,)
        n = len(data)
        ends = list(range(1, n + 1))  # the part beginning at i ends at ends[i]
        left, alive = list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = ends[i]
            if not alive[i] or middle >= n or ends[middle] != end:
                continue
            ends[i], alive[middle] = end, False
            if end < n:
                left[end] = i
                if (r := ranks.get(data[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (p := left[i]) >= 0 and (r := ranks.get(data[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return tuple(out)

    def lookup(self, words: list[str]) -> list[tuple[int, ...]]:
        cache = self.cache
        found = list(map(cache.get, words))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    word = words[i]
                    ids = cache.get(word)
                    if ids is None:
                        ids = self.merge(word.encode("utf-8", "surrogatepass"))
                        if len(word) <= 64:
                            if len(cache) >= self.cache_size:
                                cache.clear()
                            cache[word] = ids
                    found[i] = ids
        return found


def _inside(word: str, ids: Sequence[int], names: dict[int, bytes]) -> list[int]:
    """The code point of a piece that each of its ids begins at, or within if the id begins inside its bytes."""
    at = list(chain.from_iterable([i] * len(ch.encode("utf-8", "surrogatepass")) for i, ch in enumerate(word)))
    found, place = [], 0
    for x in ids:
        found.append(at[place])
        place += len(names[x])
    return found


def encode(texts: Sequence[str | None], vocabulary: Vocabulary, inside: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts end to end (int32), the number of ids of each text, and the code point in its text
    at which each id's piece begins, or with ``inside`` the id itself. Null and empty texts have no ids."""
    plain = [t or "" for t in texts]
    joined, starts, ends, counts = pieces(plain)
    found = vocabulary.lookup([joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    per_piece = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter(chain.from_iterable(found), np.int32, int(per_piece.sum()))
    total = np.concatenate(([0], np.cumsum(per_piece)))
    last = np.cumsum(counts)
    firsts = np.cumsum(np.fromiter((len(t) + 1 for t in plain), np.int64, len(plain))) - np.fromiter((len(t) + 1 for t in plain), np.int64, len(plain))
    offsets = np.repeat(starts - np.repeat(firsts, counts), per_piece)
    if inside:
        for i in np.flatnonzero(per_piece > 1).tolist():
            offsets[total[i] : total[i + 1]] += _inside(joined[starts[i] : ends[i]], found[i], vocabulary.names)
    return flat, total[last] - total[last - counts], offsets


def _in_parts(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``limit`` bytes together, so that memory doesn't depend on the batch."""
    texts = batch.column(column)
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < len(batch):
        done = sizes[at - 1] if at else 0.0
        end = max(at + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def token_ids(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), vocabulary: str = BYTE_BPE_50K, offsets: bool = False, part_bytes: int = 4 << 20) -> DataFrame:
    """``keep`` and ``ids``, the token ids of each row's whole text, without special tokens.

    Null and empty texts have an empty list; names of special tokens are ordinary text. With
    ``offsets`` there is also ``starts``: for each id the code point at which it begins, or in whose
    bytes it begins.
    One pass without a shuffle; a task holds ``part_bytes`` of text, or one text if that is longer.
    Rows are kept as they are, repeated ones too; an empty table gives an empty result.
    """
    rows = df.select(*keep, F.col(text).cast("string").alias("_text"))
    fields = [f for f in rows.schema.fields if f.name != "_text"] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)]
    if offsets:
        fields.append(T.StructField("starts", T.ArrayType(T.IntegerType(), False), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary.load(vocabulary)
        for batch in batches:
            for part in _in_parts(batch, "_text", part_bytes):
                flat, counts, starts = encode(part.column("_text").to_pylist(), words, offsets)
                bounds = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(flat))]
                if offsets:
                    lists.append(pa.ListArray.from_arrays(bounds, pa.array(starts.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *lists], names=[*keep, "ids", *["starts"] * offsets])

    return rows.mapInArrow(run, T.StructType(fields))


def token_counts(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), vocabulary: str = BYTE_BPE_50K, part_bytes: int = 4 << 20) -> DataFrame:
    """``keep`` and ``n_tokens``, the number of token ids of each row's whole text; 0 for null and empty texts."""
    rows = df.select(*keep, F.col(text).cast("string").alias("_text"))
    fields = [f for f in rows.schema.fields if f.name != "_text"] + [T.StructField("n_tokens", T.LongType(), False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary.load(vocabulary)
        for batch in batches:
            for part in _in_parts(batch, "_text", part_bytes):
                _, counts, _ = encode(part.column("_text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(counts)], names=[*keep, "n_tokens"])

    return rows.mapInArrow(run, T.StructType(fields))


def decode(ids: Sequence[int], vocabulary: str = BYTE_BPE_50K) -> str:
    """The text of a list of ids; bytes that are no text become replacement characters."""
    names = Vocabulary.load(vocabulary).names
    return b"".join(names[i] for i in ids).decode("utf-8", "replace")
