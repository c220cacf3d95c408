"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Whole Arrow batches become codepoint arrays.  Each codepoint gets a class (letter, number,
white space, other); most piece boundaries follow from neighbouring classes.  Contractions
('s 't 'm 'd 're 've 'll) need a state: every codepoint becomes a transition function over four
states, packed into one byte, and an associative scan over the composition of these functions
gives the state before every codepoint.  No regular expression runs.  The resulting slices are
looked up in a bounded cache of merged pieces; offsets of tokens are kept, so decoding is one
gather over the vocabulary's bytes.

Null and empty texts give no tokens and the digests of the empty string.  Rows pass through one
by one: repeated rows and ids repeat in the result, other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import sys
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from partyloom.llm.common import ragged, row_chunks, string_views

#: White space of the pattern's \s: the Unicode property White_Space (fixed values).
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LETTER, NUMBER, SPACE, OTHER, EDGE = 0, 1, 2, 3, 4
#: Classes are those of Unicode 16, whatever the worker's Python knows.  Fixed values: letters and
#: numbers (first, last) that Unicode 15.1 and 16 added to those of Unicode 15.0.
NEW_LETTERS = (
    (0x2EBF0, 0x2EE5D),
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: CRC-32 of the whole class table; a Python whose table differs must not encode.
CLASSES_CRC = 0xE6A7F41C
#: Distinct pieces kept per worker before the cache starts anew.
CACHE_PIECES = 300_000
#: Text bytes encoded at once: the index arrays of one step stay in a core's cache.
STEP_BYTES = 1 << 18


@functools.cache
def class_table() -> np.ndarray:
    """Class of each codepoint, from the general categories and what newer Unicode versions added.

    Raises where the worker's Python can't give the classes of Unicode 16.
    """
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for ranges, value in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for first, last in ranges:
            out[first : last + 1] = value
    out[list(WHITE_SPACE)] = SPACE
    if zlib.crc32(out.tobytes()) != CLASSES_CRC:
        raise RuntimeError(f"Unicode {unicodedata.unidata_version} of this Python doesn't give the character classes of Unicode 16")
    return out


# States: 0 ordinary, 1 or 2 letters of a contraction still to come, 3 a contraction has just ended.
# A function f is a byte: bits 2s and 2s+1 hold f(s).
def _pack(f: tuple[int, int, int, int]) -> int:
    return f[0] | f[1] << 2 | f[2] << 4 | f[3] << 6


STEP, ONE, TWO = _pack((0, 3, 1, 0)), _pack((1, 1, 1, 1)), _pack((2, 2, 2, 2))
IDENTITY = _pack((0, 1, 2, 3))


@functools.cache
def compose_table() -> np.ndarray:
    """[first * 256 + second]: the function that applies first, then second."""
    every = np.arange(256, dtype=np.uint16)
    parts = np.stack([(every >> (2 * s)) & 3 for s in range(4)], 1)
    out = np.zeros((256, 256), np.uint8)
    for s in range(4):
        out |= (((every[None, :] >> (2 * parts[:, s][:, None])) & 3) << (2 * s)).astype(np.uint8)
    return out.ravel()


def scan_states(functions: np.ndarray, width: int = 256) -> np.ndarray:
    """State before each position, starting in state 0, by a blocked associative scan."""
    n = len(functions)
    if n == 0:
        return np.zeros(0, np.uint8)
    table = compose_table()
    if n <= width:
        state, out = 0, np.zeros(n, np.uint8)
        for i, f in enumerate(functions.tolist()):
            out[i] = state
            state = (f >> (2 * state)) & 3
        return out
    blocks = -(-n // width)
    padded = np.full(blocks * width, IDENTITY, np.uint8)
    padded[:n] = functions
    grid = np.ascontiguousarray(padded.reshape(blocks, width).T)
    before = np.empty_like(grid)
    run = np.full(blocks, IDENTITY, np.uint8)
    for i in range(width):
        before[i] = run
        run = table[(run.astype(np.uint16) << 8) | grid[i]]
    entry = scan_states(run, width)
    return np.ascontiguousarray(((before >> (2 * entry)) & 3).T).ravel()[:n]


def piece_starts(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each codepoint.  edges: indices at which texts start."""
    n = len(codes)
    if not n:
        return np.zeros(0, bool)
    kind = class_table()[codes]
    first = np.zeros(n + 1, bool)
    first[edges] = True
    first[n] = True
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = EDGE, kind[:-1]
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = EDGE, kind[1:]
    prev[first[:-1]] = EDGE
    after[first[1:]] = EDGE
    blank = codes == 0x20
    prev_blank = np.zeros(n, bool)
    prev_blank[1:] = blank[:-1]
    prev_blank &= prev != EDGE
    start = prev != kind
    # a blank before a visible character joins it; other white space stays alone
    visible = kind != SPACE
    start[visible & prev_blank] = False
    # the last of several white-space characters before a visible one splits off
    start |= (kind == SPACE) & (prev == SPACE) & (after != SPACE) & (after != EDGE)
    # contractions begin at an apostrophe that starts a piece
    quotes = np.flatnonzero((codes == 0x27) & start)
    if len(quotes):
        tail = np.zeros(n + 2, np.uint32)
        tail[:n] = codes
        stop = np.zeros(n + 2, bool)
        stop[: n + 1] = first
        a, b = tail[quotes + 1], tail[quotes + 2]
        in1 = ~stop[quotes + 1]
        in2 = in1 & ~stop[np.minimum(quotes + 2, n)]
        one = in1 & np.isin(a, [ord(c) for c in "stmd"])
        two = in2 & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        functions = np.full(n, STEP, np.uint8)
        functions[quotes[one]] = ONE
        functions[quotes[two]] = TWO
        state = scan_states(functions)
        start[(state == 1) | (state == 2)] = False
        start[state == 3] = True
    start[edges[edges < n]] = True
    return start


class Vocabulary:
    """Ranks of a .tiktoken file, and a bounded cache of pieces already merged."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f.read().splitlines() if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.ranks.values(), default=-1) + 1
        by_id = [b""] * size
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.lengths = np.fromiter(map(len, by_id), np.int64, size)
        self.at = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        texts = [b"%d," % i for i in range(size)]
        self.text_lengths = np.fromiter(map(len, texts), np.int64, size)
        self.text_at = np.concatenate([[0], np.cumsum(self.text_lengths)])
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.cache_pieces = cache_pieces
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.merged = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.offsets = np.zeros(1 << 14, np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Lowest-ranked pair first, leftmost among equals; a heap keeps long pieces n log n."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        ranks, n = self.ranks, len(piece)
        if n < 48:
            parts = [piece[i : i + 1] for i in range(n)]
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = ranks.get(parts[i] + parts[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return [ranks[p] for p in parts]
        end, back = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = []

        def push(i: int) -> None:
            j = end[i]
            if j < n:
                r = ranks.get(piece[i : end[j]])
                if r is not None:
                    heap.append((r, i, end[j])) if not heap_ready else heapq.heappush(heap, (r, i, end[j]))

        heap_ready = False
        for i in range(n - 1):
            push(i)
        heapq.heapify(heap)
        heap_ready = True
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                back[stop] = i
            push(i)
            if back[i] >= 0:
                push(back[i])
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def _add(self, piece: bytes) -> int:
        ids = self.merge(piece)
        if self.used + len(ids) > len(self.merged):
            self.merged = np.resize(self.merged, 2 * (self.used + len(ids)))
        k = len(self.index)
        if k + 2 > len(self.offsets):
            self.offsets = np.resize(self.offsets, 2 * k)
        self.merged[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.offsets[k + 1] = self.used
        self.index[piece] = k
        return k

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts, where each text's ids start (n + 1), and where each token starts in the bytes."""
        text = flat.tobytes()
        heads = np.flatnonzero((flat & 0xC0) != 0x80)
        codes = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)
        edges = np.unique(np.searchsorted(heads, offsets[:-1]))
        starts = heads[piece_starts(codes, edges)]
        ends = np.append(starts[1:], len(text)) if len(starts) else starts
        if len(self.index) + len(starts) > self.cache_pieces and len(self.index) > self.cache_pieces // 2:
            self.reset()
        pieces = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        get = self.index.get
        where = [get(p) for p in pieces]
        if None in where:
            for i, k in enumerate(where):
                if k is None:
                    k = get(pieces[i])
                    where[i] = self._add(pieces[i]) if k is None else k
        where = np.array(where, np.int64)
        counts = self.offsets[where + 1] - self.offsets[where] if len(where) else np.zeros(0, np.int64)
        ids = self.merged[ragged(self.offsets[where], counts)] if len(where) else np.zeros(0, np.int32)
        run = np.concatenate([[0], np.cumsum(counts)])
        id_offsets = run[np.searchsorted(starts, offsets)]
        sizes = self.lengths[ids]
        return ids, id_offsets, np.cumsum(sizes) - sizes

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, joined."""
        return self.bytes[ragged(self.at[ids], self.lengths[ids])]

    def decimal(self, ids: np.ndarray) -> np.ndarray:
        """The ids in decimal, each followed by a comma."""
        return self.text_bytes[ragged(self.text_at[ids], self.text_lengths[ids])]


_held: dict[str, Vocabulary] = {}


def vocabulary(name: str) -> Vocabulary:
    """The worker's own copy.  name: a file of the installed tokenizer package, or a path."""
    if name not in _held:
        import os

        path = name
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _held[name] = Vocabulary(path)
    return _held[name]


def encode(df: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, token_starts array<bigint>): the ids of each text and the byte at which each token starts."""
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def run(batches):
        held = vocabulary(vocab)
        for batch in batches:
            offsets, flat = string_views(batch.column(1))
            for lo, hi in row_chunks(offsets, STEP_BYTES):
                ids, at, token_at = held.encode(flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                local = token_at - np.repeat(offsets[lo:hi] - offsets[lo], np.diff(at))
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in (ids, local)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *lists], ["id", "ids", "token_starts"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>, token_starts array<bigint>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocab: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes): the bytes that the ids stand for."""
    source = df.select(df[id_col].alias("id"), df[ids_col].alias("ids"))

    def run(batches):
        held = vocabulary(vocab)
        for batch in batches:
            rows = [held.decode(np.asarray(x or [], np.int64)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["id", "bytes"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def digests(df: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids, in one pass; per row the token count and digests of ids and decoded bytes."""
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def run(batches):
        held = vocabulary(vocab)
        for batch in batches:
            offsets, flat = string_views(batch.column(1))
            for lo, hi in row_chunks(offsets, STEP_BYTES):
                ids, at, _ = held.encode(flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                spelled, decoded = held.decimal(ids).tobytes(), held.decode(ids).tobytes()
                spelled_at = np.concatenate([[0], np.cumsum(held.text_lengths[ids])])[at].tolist()
                decoded_at = np.concatenate([[0], np.cumsum(held.lengths[ids])])[at].tolist()
                sha = hashlib.sha256
                ids_sha = [sha(spelled[a : max(a, b - 1)]).hexdigest() for a, b in zip(spelled_at, spelled_at[1:], strict=False)]
                dec_sha = [sha(decoded[a:b]).hexdigest() for a, b in zip(decoded_at, decoded_at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(ids_sha), pa.array(dec_sha)],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
