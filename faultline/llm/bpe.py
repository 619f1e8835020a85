"""Byte-level BPE: Spark higher-order functions merge, Arrow batches split and assemble.

Three steps run in one stage without a shuffle:

1. a batch of texts is split by the pre-tokenisation rules into matches; each
   distinct match of the block that is not in the word cache leaves as an array
   of byte tokens, each document as an array of word numbers;
2. the higher-order functions of :func:`merge_expression` fold the ranked merges
   over the byte arrays, looking pairs up in a literal rank map. The map is the
   value of a one-row scalar subquery, so it's a constant of the plan without
   being a part of its text;
3. documents get the ids of their words, and decoding concatenates the binary
   pieces of the ids.

A long word is merged in windows that overlap, so its cost grows with its
length, not with the square of it. Tokens of a window but its last ones stand,
and the next window starts with the last of them. Merges on both sides of a
token boundary run independently of what lies farther off, so a sequence of
tokens is the encoding if and only if every two neighbours are the encoding of
their own bytes: windows that agree on a token join without error. Where they
don't, the word starts anew with windows twice as wide.

The word cache holds the merged words of a bounded sample of documents (and the
whole vocabulary); it only saves repeated work, words outside it are merged in
their block. Words are found by a 64-bit hash and compared byte by byte.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RunHasher, reliable, unused

#: Rank of a pair that does not merge; ranks and ids are below it.
NONE = 65535
#: Characters that a sub-block holds at least; bounds the numpy temporaries.
SUB_BLOCK = 1 << 18
#: Distinct words outside the cache after which a block ends and word numbers start anew.
BLOCK_WORDS = 300_000
#: Rows of an Arrow batch that are Python objects at once.
BATCH_ROWS = 1024
#: Words in one row on their way to the merge expression.
WORDS_A_ROW = 64
#: Bytes of a window of a long word, at least; windows that a fold joins before its tokens are appended to the word's.
WINDOW, WINDOWS_A_FOLD = 128, 64
#: Rows of the sample whose words make the cache, and words that the cache holds at most.
CACHE_DOCS, CACHE_WORDS = 10_000, 250_000

_SPACE, _BLANK, _LETTER, _DIGIT, _OTHER = range(5)
#: The code points of the White_Space property except U+0020.
_WHITE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _DIGIT}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[_WHITE] = _SPACE
    out[0x20] = _BLANK
    return out


def split_points(chars: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where the matches of the pre-tokenisation pattern start in ``chars`` (code points of documents laid end to end).

    Equal to finding ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
    in each document: runs of one class, where a blank before a run of letters,
    digits or others joins it, the last of several white-space characters before
    such a run stands alone, and a lone apostrophe takes an English ending.
    """
    n = len(chars)
    kind = _classes()[chars]
    white = kind <= _BLANK
    group = np.where(white, np.uint8(0), kind)
    first = np.zeros(n, bool)
    first[doc_starts[doc_starts < n]] = True
    run = first.copy()
    run[1:] |= group[1:] != group[:-1]
    s = np.flatnonzero(run)
    e = np.append(s[1:], n)
    g = group[s]
    # runs that follow white space of the same document
    after = np.zeros(len(s), bool)
    after[1:] = (g[1:] != 0) & (g[:-1] == 0) & ~first[s[1:]]
    joins = after & (kind[np.maximum(s - 1, 0)] == _BLANK)
    start = run
    start[s[joins]] = False
    start[s[joins] - 1] = True
    alone = after & ~joins
    start[s[alone] - 1] = True
    # English endings
    k = np.flatnonzero((chars[s] == 0x27) & (e - s == 1) & ~joins & (g == _OTHER))
    k = k[k + 1 < len(s)]
    k = k[(g[k + 1] == _LETTER) & ~first[s[k + 1]]]
    if len(k):
        a = chars[s[k] + 1]
        b = np.where(e[k + 1] - s[k + 1] > 1, chars[np.minimum(s[k] + 2, n - 1)], 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        hit = one | two
        at = s[k[hit]] + np.where(one[hit], 2, 3)
        start[s[k[hit]] + 1] = False
        start[at[at < n]] = True
    return np.flatnonzero(start)


class WordTable:
    """Open-addressing hash table from 64-bit word hashes to word numbers."""

    def __init__(self, hashes: np.ndarray) -> None:
        bits = max(10, int(len(hashes) * 3).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.number = np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(hashes), dtype=np.int32)
        slot = hashes & self.mask
        while len(todo):
            free = self.number[slot] < 0
            self.number[slot[free]] = todo[free]
            self.keys[slot[free]] = hashes[todo[free]]
            lost = self.number[slot] != todo
            todo, slot = todo[lost], (slot[lost] + np.uint64(1)) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 where absent."""
        out = np.full(len(hashes), -1, np.int32)
        slot = hashes & self.mask
        at = None
        while True:
            number = self.number[slot]
            same = (self.keys[slot] == (hashes if at is None else hashes[at])) & (number >= 0)
            if at is None:
                out[same] = number[same]
                at = np.flatnonzero(~same & (number >= 0))
                slot = slot[at]
            else:
                out[at[same]] = number[same]
                more = ~same & (number >= 0)
                at, slot = at[more], slot[more]
            if len(at) == 0:
                return out
            slot = (slot + np.uint64(1)) & self.mask


# ---------------------------------------------------------------- the merges


def _rank_levels(ranks: dict[bytes, int]) -> list[np.ndarray]:
    """Hashed tables of the merging pairs: slot -> left << 32 | right << 16 | merged; a pair that finds its slot taken goes to the next table."""
    pairs = []
    for piece, merged in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                pairs.append((left << 16 | right, merged))
    levels: list[np.ndarray] = []
    while pairs:
        bits, i = max(18 - 2 * len(levels), 10), len(levels)
        slots, rest = np.full(1 << bits, -1, np.int64), []
        for key, merged in pairs:
            h = xxhash.xxh64_intdigest(key.to_bytes(8, "little"), 42)
            if i:
                h = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), h)
            at = h & (1 << bits) - 1
            if slots[at] < 0:
                slots[at] = key << 16 | merged
            else:
                rest.append((key, merged))
        levels.append(slots)
        pairs = rest
        if len(levels) > 9:
            raise ValueError("the rank map doesn't settle")
    return levels


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"aggregate(cast(array() as array<int>), {value}, ({name}, _) -> {name}, {name} -> {body})"


class Merges:
    """The ranked merges as SQL over arrays of byte tokens.

    The rank map is a struct of arrays that SQL reads from a scalar subquery on a
    table of one row, of a size fixed by the vocabulary (2 MB for 50,000 ranks).
    """

    def __init__(self, spark, ranks: dict[bytes, int]) -> None:
        if max(ranks.values()) >= NONE:
            raise ValueError("ids must be below 65535")
        levels = _rank_levels(ranks)
        size = np.zeros(max(ranks.values()) + 1, np.int32)
        for piece, rank in ranks.items():
            size[rank] = len(piece)
        self.bits = [len(x).bit_length() - 1 for x in levels]
        #: The longest piece; a window's first half holds two of it.
        self.longest = int(size.max())
        self.window = max(WINDOW, 4 * self.longest)
        byte_ids = [(ranks[bytes([b])], bytes([b])) for b in range(256)]
        self.bytes_wide = max(i for i, _ in byte_ids) + 1
        first = np.full(self.bytes_wide**2, NONE, np.int64)
        for i, b in byte_ids:
            for j, c in byte_ids:
                first[i * self.bytes_wide + j] = ranks.get(b + c, NONE)
        columns = {f"r{i}": x for i, x in enumerate(levels)} | {"first": first, "size": size}
        self.map = spark.createDataFrame(pa.table({k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for k, v in columns.items()}))

    def apply(self, df: DataFrame, words: str, ids: str) -> DataFrame:
        """``df`` with ``words``, array<array<int>> of byte tokens, replaced by ``ids``, array<array<int>> of merged ids."""
        (constant,) = unused(df.columns, "ranks")
        sql = _let(constant, "ranks", f"transform({words}, w -> if(size(w) <= {self.window}, {self._merged('w')}, {self._long()}))")
        # the optimiser puts the subquery where the column is read, once, so rows don't carry it
        both = df.withColumn(constant, self.map.select(F.struct("*")).scalar())
        return both.select(*(F.expr(sql).alias(ids) if c == words else F.col(f"`{c}`") for c in df.columns))

    def _rank(self, left: str, right: str) -> str:
        found = f"{NONE}L"
        for i in reversed(range(len(self.bits))):
            h = f"xxhash64(k, {i})" if i else "xxhash64(k)"
            found = _let(
                f"get(ranks.r{i}, cast({h} & {(1 << self.bits[i]) - 1} as int))",
                f"v{i}",
                f"if(v{i} < 0, {NONE}L, if(shiftright(v{i}, 16) = k, v{i} & 65535, {found}))",
            )
        return _let(f"shiftleft({left}, 16) | {right}", "k", found)

    def _merged(self, w: str) -> str:
        """Ids of one word.

        An element is a long: rank of its pair with the next << 47 | offset << 16 |
        id, so the least element is the pair to merge next, leftmost among equals.
        Ranks of two bytes come from a square table, those of later pairs from the
        hashed ones. One step of the fold replaces it and drops its right neighbour; only the two
        pairs around it are looked up again.
        """
        id_of_m = "shiftrightunsigned(m, 47)"
        before = _let("acc[p - 2]", "x", f"shiftleft({self._rank('(x & 65535)', id_of_m)}, 47) | (x & {(1 << 47) - 1}L)")
        behind = _let("get(acc, p + 1)", "y", f"if(y is null, {NONE}L, {self._rank(id_of_m, '(y & 65535)')})")
        merged = f"shiftleft({behind}, 47) | (m & {(1 << 47) - 65536}L) | {id_of_m}"
        step = _let(
            "array_min(acc)",
            "m",
            f"if({id_of_m} = {NONE}, acc, "
            + _let("cast(array_position(acc, m) as int)", "p", f"filter(transform(acc, (x, i) -> case when i < p - 2 or i > p then x when i = p then null when i = p - 1 then {merged} else shiftleft({self._rank('(x & 65535)', id_of_m)}, 47) | (x & {(1 << 47) - 1}L) end), x -> x is not null)")
            + ")",
        )
        pair = f"coalesce(get(ranks.first, b * {self.bytes_wide} + get({w}, j + 1)), {NONE}L)"
        first = f"transform({w}, (b, j) -> shiftleft({pair}, 47) | shiftleft(cast(j as bigint), 16) | b)"
        return f"aggregate(slice({w}, 2, size({w})), {first}, (acc, _) -> {step}, acc -> transform(acc, x -> cast(x & 65535 as int)))"

    def _long(self) -> str:
        """Ids of the word ``w``, window by window.

        ``at`` is where the next window starts, ``expect`` the token that it must
        start with, ``wide`` its bytes. Tokens within a window's first half stand, at
        least two; two windows move on by a piece's length at least, which bounds
        the steps.
        """
        none = "cast(array() as array<int>)"
        anew = f"named_struct('at', 0, 'wide', 2 * s.wide, 'expect', cast(null as int), 'anew', true, 'ids', {none})"
        last = "named_struct('at', size(w), 'wide', s.wide, 'expect', cast(null as int), 'anew', s.anew, 'ids', concat(s.ids, t))"
        stands = "aggregate(t, named_struct('n', 0, 'till', 0, 'before', 0, 'go', true), (a, x) -> if(a.go and a.till + ranks.size[x] <= s.wide / 2, named_struct('n', a.n + 1, 'till', a.till + ranks.size[x], 'before', a.till, 'go', true), named_struct('n', a.n, 'till', a.till, 'before', a.before, 'go', false)))"
        more = _let(stands, "k", "named_struct('at', s.at + k.before, 'wide', s.wide, 'expect', t[k.n - 1], 'anew', s.anew, 'ids', concat(s.ids, slice(t, 1, k.n - 1)))")
        tokens = _let("slice(w, s.at + 1, s.wide)", "u", self._merged("u"))
        step = f"if(s.at >= size(w), s, {_let(tokens, 't', f'if(s.expect <> t[0], {anew}, if(s.at + s.wide >= size(w), {last}, {more}))')})"
        fold = f"aggregate(sequence(1, {WINDOWS_A_FOLD}), named_struct('at', o.at, 'wide', o.wide, 'expect', o.expect, 'anew', false, 'ids', {none}), (s, _) -> {step})"
        folds = f"4 * (size(w) div {self.longest * WINDOWS_A_FOLD}) + 4"
        joined = _let(fold, "s", "named_struct('at', s.at, 'wide', s.wide, 'expect', s.expect, 'ids', if(s.anew, s.ids, concat(o.ids, s.ids)))")
        return f"aggregate(sequence(1, {folds}), named_struct('at', 0, 'wide', {self.window}, 'expect', cast(null as int), 'ids', {none}), (o, _) -> if(o.at >= size(w), o, {joined}), o -> if(o.at >= size(w), o.ids, cast(raise_error('unfinished word') as array<int>)))"


# ---------------------------------------------------------------- the Arrow ends


class Words:
    """Byte strings laid end to end."""

    def __init__(self, words: list[bytes]) -> None:
        self.blob = np.frombuffer(b"".join(words), np.uint8)
        self.lengths = np.fromiter(map(len, words), np.int32, len(words))

    @functools.cached_property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.lengths, dtype=np.int64)

    def hashes(self) -> np.ndarray:
        return RunHasher()(self.blob, self.ends - self.lengths, self.ends)


def _same(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, blob: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether raw[starts:starts + lengths], non-empty ranges, equals blob[at:at + sizes], range by range."""
    out = lengths == sizes
    some = np.flatnonzero(out)
    if len(some):
        n = lengths[some].astype(np.int64)
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum()))
        equal = raw[np.repeat(starts[some] - first, n) + step] == blob[np.repeat(at[some] - first, n) + step]
        out[some] = np.logical_and.reduceat(equal, first)
    return out


class _Splitter:
    """Distinct words of texts, across sub-blocks."""

    def __init__(self, known: Words) -> None:
        self.hash = RunHasher()
        self.known, self.table = known, WordTable(known.hashes())
        self.n_known = len(known.lengths)

    def new_block(self) -> None:
        self.own: dict[bytes, int] = {}

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
        """Word numbers of each text, and the words numbered for the first time."""
        joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        doc_starts = np.cumsum(sizes) - sizes
        if not joined:
            return [np.zeros(0, np.int32)] * len(texts), []
        raw = joined.encode()
        buf = np.frombuffer(raw, np.uint8)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        at = split_points(chars, doc_starts[sizes > 0])
        if len(raw) == len(chars):
            starts = at
        else:
            width = 1 + (chars >= 0x80).astype(np.uint8) + (chars >= 0x800) + (chars >= 0x10000)
            starts = (np.cumsum(width, dtype=np.int64) - width)[at]
        ends = np.append(starts[1:], len(raw))
        lengths = ends - starts
        hashes = self.hash(buf, starts, ends)
        numbers = self.table.find(hashes)
        hit = np.flatnonzero(numbers >= 0)
        if len(hit):
            n = numbers[hit]
            size = self.known.lengths[n].astype(np.int64)
            numbers[hit[~_same(buf, starts[hit], lengths[hit], self.known.blob, self.known.ends[n] - size, size)]] = -1
        new: list[bytes] = []

        def number(m: int) -> int:
            word = raw[starts[m] : ends[m]]
            n = self.own.get(word)
            if n is None:
                n = self.own[word] = self.n_known + len(self.own)
                new.append(word)
            return n

        if len(miss := np.flatnonzero(numbers < 0)):
            _, where, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            like = miss[where][back]  # of the same hash
            got = np.fromiter(map(number, miss[where].tolist()), np.int32, len(where))[back]
            other = np.flatnonzero(~_same(buf, starts[miss], lengths[miss], buf, starts[like], lengths[like]))
            for i in other.tolist():
                got[i] = number(int(miss[i]))
            numbers[miss] = got
        cuts = np.searchsorted(at, np.append(doc_starts, len(chars)))
        return [numbers[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], new


def _sub_blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SUB_BLOCK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _byte_ids(ranks: dict[bytes, int]) -> np.ndarray:
    return np.array([ranks[bytes([b])] for b in range(256)], np.int32)


def _word_rows(words: list[bytes], byte_id: np.ndarray) -> pa.Array:
    flat = byte_id[np.frombuffer(b"".join(words), np.uint8)]
    ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
    inner = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
    cuts = np.append(np.arange(0, len(words), WORDS_A_ROW), len(words)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), inner)


_WORDS = pa.list_(pa.list_(pa.int32()))


def _split_docs(batches, ranks: dict[bytes, int], known: Words, schema: pa.Schema, own: tuple[str, ...]):
    """Rows (block start, words, numbers, kept columns): words go before the documents that hold them."""
    split, byte_id = _Splitter(known), _byte_ids(ranks)
    fresh_, words_, numbers_, text_ = own
    kept = [f for f in schema if f.name not in own]
    split.new_block()
    fresh = True

    def rows(n, fresh, words, numbers, keep):
        cols = {fresh_: pa.array([fresh] + [False] * (n - 1)) if n else pa.array([], pa.bool_()), words_: words, numbers_: numbers}
        cols |= keep
        return pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) for f in schema], schema=schema)

    for batch in (big.slice(i, BATCH_ROWS) for big in batches for i in range(0, big.num_rows, BATCH_ROWS)):
        texts = [t or "" for t in batch.column(text_).to_pylist()]
        for a, b in _sub_blocks(texts):
            if len(split.own) > BLOCK_WORDS:
                split.new_block()
                fresh = True
            numbers, new = split(texts[a:b])
            if new:
                words = _word_rows(new, byte_id)
                n = len(words)
                yield rows(n, fresh, words, pa.nulls(n, pa.binary()), {f.name: pa.nulls(n, f.type) for f in kept})
                fresh = False
            part = batch.slice(a, b - a)
            yield rows(b - a, fresh, pa.nulls(b - a, _WORDS), pa.array([x.tobytes() for x in numbers], pa.binary()), {f.name: part.column(f.name) for f in kept})
            fresh = False


class _Csr:
    """Rows of unequal length, laid end to end."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat, self.lengths = flat, lengths.astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def take(self, rows: np.ndarray) -> np.ndarray:
        lengths = self.lengths[rows]
        total = int(lengths.sum())
        shift = self.starts[rows] - (np.cumsum(lengths) - lengths)
        return self.flat[np.repeat(shift, lengths) + np.arange(total)]


def _pieces(ranks: dict[bytes, int]) -> _Csr:
    parts = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        parts[rank] = piece
    return _Csr(np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts)))


def decode(ids: np.ndarray, pieces: _Csr) -> bytes:
    """The binary pieces of the ids, concatenated."""
    return pieces.take(ids).tobytes()


def _assemble(batches, ranks: dict[bytes, int], cache: tuple[np.ndarray, np.ndarray], schema: pa.Schema, with_ids: bool, own: tuple[str, ...]):
    pieces = _pieces(ranks)
    fresh_, ids_, numbers_ = own
    flats, lens = [cache[0]], [cache[1]]
    words, stale = None, True
    names = [f.name for f in schema if f.name not in RESULTS]
    for batch in (big.slice(i, BATCH_ROWS) for big in batches for i in range(0, big.num_rows, BATCH_ROWS)):
        fresh = batch.column(fresh_).to_numpy(zero_copy_only=False)
        is_doc = batch.column(numbers_).is_valid().to_numpy(zero_copy_only=False)
        # stretches of word rows or of documents, cut where a block starts
        change = np.ones(len(fresh), bool)
        change[1:] = (is_doc[1:] != is_doc[:-1]) | fresh[1:]
        cuts = np.append(np.flatnonzero(change), len(fresh))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if fresh[a]:
                flats, lens, stale = [cache[0]], [cache[1]], True
            part = batch.slice(a, b - a)
            if not is_doc[a]:
                merged = part.column(ids_).flatten()
                flats.append(merged.flatten().to_numpy(zero_copy_only=False).astype(np.uint16))
                lens.append(merged.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32))
                stale = True
                continue
            if stale:
                flats, lens = [np.concatenate(flats)], [np.concatenate(lens)]
                words, stale = _Csr(flats[0], lens[0]), False
            n_tokens, ids_hex, text_hex, all_ids = [], [], [], []
            for numbers in part.column(numbers_).to_pylist():
                ids = words.take(np.frombuffer(numbers, np.int32)).astype("<u4")
                n_tokens.append(len(ids))
                ids_hex.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_hex.append(hashlib.sha256(decode(ids, pieces)).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            cols = {n: part.column(n) for n in names} | {"n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(ids_hex, pa.string()), "decoded_sha256": pa.array(text_hex, pa.string())}
            if with_ids:
                ends = np.cumsum([0, *map(len, all_ids)]).astype(np.int32)
                cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *all_ids])))
            yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) for f in schema], schema=schema)


def _sample_words(batches, ranks: dict[bytes, int]):
    """Distinct words of the sampled texts, without the vocabulary's own pieces."""
    split = _Splitter(Words(list(ranks)))
    split.new_block()
    for batch in (big.slice(i, BATCH_ROWS) for big in batches for i in range(0, big.num_rows, BATCH_ROWS)):
        texts = [t or "" for t in batch.column(0).to_pylist()]
        for a, b in _sub_blocks(texts):
            _, new = split(texts[a:b])
            new = [w for w in new if len(w) <= 64]
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary())], names=["word"])
            if len(split.own) > BLOCK_WORDS:
                split.new_block()


def word_cache(docs: DataFrame, text: str, ranks: dict[bytes, int], merges: Merges, cache_docs: int, cache_words: int):
    """(words, flat ids, id counts) of the vocabulary's own pieces and of the words of at most about ``cache_docs`` documents.

    The sample is chosen by the hash of the text, so reruns agree. The cache
    holds at most ``cache_words`` words besides the vocabulary; what it lacks is
    merged where it occurs, so it bears on speed alone.
    """
    pieces = sorted(ranks, key=ranks.get)
    words, flat, lengths = pieces, [np.array([ranks[p] for p in pieces], np.uint16)], [np.ones(len(pieces), np.int32)]
    n = docs.count()
    if n and cache_docs and cache_words:
        shared = docs.sparkSession.sparkContext.broadcast(ranks)
        share = min(1.0, cache_docs / n)
        keep = F.col(text).isNotNull() if share >= 1 else F.pmod(F.xxhash64(text), F.lit(1 << 20)) < int(share * (1 << 20))
        found = reliable(docs.select(text).where(keep).mapInArrow(lambda b: _sample_words(b, shared.value), "word binary").distinct().limit(cache_words).repartition(F.xxhash64("word")))
        chunks = found.mapInArrow(lambda b: _chunks(b, shared.value), "chunk array<binary>, ids array<array<int>>")
        for batch in merges.apply(chunks, "ids", "ids").toArrow().to_batches():
            words = words + batch.column(0).flatten().to_pylist()
            ids = batch.column(1).flatten()
            flat.append(ids.flatten().to_numpy().astype(np.uint16))
            lengths.append(ids.value_lengths().to_numpy().astype(np.int32))
        pa.default_memory_pool().release_unused()
    return Words(words), np.concatenate(flat), np.concatenate(lengths)


def _chunks(batches, ranks: dict[bytes, int]):
    """Words gathered into rows of many, with their arrays of byte tokens."""
    byte_id = _byte_ids(ranks)
    for batch in batches:
        if batch.num_rows:
            rows = _word_rows(batch.column(0).to_pylist(), byte_id)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(rows.offsets, batch.column(0).cast(pa.binary())), rows], names=["chunk", "ids"])


#: Columns that :func:`encode` adds.
RESULTS = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")


def encode(docs: DataFrame, path: str, text: str = "text", with_ids: bool = True, cache_docs: int = CACHE_DOCS, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Every column of ``docs`` except those it replaces, with n_tokens, ids_sha256, decoded_sha256 and, if asked, ids array<int>.

    A null text counts as empty: no ids, digests of nothing. Columns named like
    the results are replaced, the text column is left out; any others stay,
    whatever their names. A path is a rank file of base64 pieces and ranks, read
    on the driver alone. Words may be of any length. Repeated rows stay; an empty
    table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

    spark = docs.sparkSession
    if text not in docs.columns:
        raise ValueError(f"no column {text}")
    names = [c for c in docs.columns if c not in RESULTS[: 3 + with_ids] and c != text]
    fresh, words, numbers, ids, raw = unused([*docs.columns, *RESULTS], "fresh", "words", "numbers", "ids", "text")
    slim = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`").alias(raw))
    ranks = read_ranks(path)
    merges = Merges(spark, ranks)
    cached, flat, lengths = word_cache(slim, raw, ranks, merges, cache_docs, cache_words)
    known = spark.sparkContext.broadcast((ranks, cached))
    merged = spark.sparkContext.broadcast((ranks, flat, lengths))

    keep = [StructField(f.name, f.dataType, True) for f in slim.schema if f.name != raw]
    mid = StructType([StructField(fresh, BooleanType()), StructField(words, ArrayType(ArrayType(IntegerType()))), StructField(numbers, BinaryType()), *keep])
    out = StructType([*keep, StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()), *[StructField("ids", ArrayType(IntegerType()))] * with_ids])
    mid_arrow, out_arrow = to_arrow_schema(mid), to_arrow_schema(out)

    def split(batches):
        return _split_docs(batches, *known.value, mid_arrow, (fresh, words, numbers, raw))

    def assemble(batches):
        ranks, flat, lengths = merged.value
        return _assemble(batches, ranks, (flat, lengths), out_arrow, with_ids, (fresh, ids, numbers))

    return merges.apply(slim.mapInArrow(split, mid), words, ids).mapInArrow(assemble, out)
