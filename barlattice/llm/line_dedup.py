"""Fuzzy line deduplication: SimHash blocks, deletion neighbourhoods, edit similarity, connected groups.

Lines are compared in normal form: A-Z in lower case, white space as single blanks, ends trimmed.
Equal lines are one line from the start. Two lines are a link if their edit distance is at most
``EDITS`` percent of the longer one, and that alone decides. Of each group that links connect, the
occurrence with the smallest (id, line number) stays.

Candidates are the lines of a list. Lines of up to ``SHORT`` characters are listed under what is left
when as many characters are deleted as such a link has edits, which finds every link between them.
All lines are listed under the blocks of a SimHash of their different tokens: runs of letters and
digits, or words where a line has none. A block is the majority vote of a sample of the tokens, those
with the smallest hashes of that block, so lines that share most tokens mostly have equal blocks.
A pair that shares ``SHARED`` of its tokens has no equal block with a chance of ``MISS``; samples grow
with the logarithm of the lines, and blocks with them, so this is the same at every size.

Every pair of a list is settled. Only hashes of lists and places of lines are shuffled to find the lists
with several lines, and only these lists go on, with an outline of each line: two bits a character,
equal for equal characters. Outlines reject pairs that cannot be links; what they leave is told by the
texts, which only such lines give. Each line is first tried with the first line of a list, and pairs
that this leaves in different groups are tried then. Lists of up to ``LIST`` lines are compared at
once, longer ones line by line; none is cut.

Defined cases: blank lines have no normal form and always stay; null and empty texts have one blank
line; equal rows of an id stand for one document, whose lines stay or go together, and different
texts of an id are judged each by its own lines; null ids rank last; an empty table gives an empty
result; long lines are compared whole.

Not whole: links of longer lines that share few tokens, as with typing errors in most words, are
found with a probability only; see the README for the recall.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, log, log1p, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.llm import hashing
from barlattice.llm.common import settled, whole_text, with_group_values, written
from barlattice.llm.components import components

EDITS, LIST, SHORT = 20, 256, 14
#: Share of common tokens that the blocks are laid out for, and the chance to miss such a pair.
SHARED, MISS = 0.75, 0.01
#: Bits of a block for each token of its sample, and the chance of one bit to differ that this gives.
_BITS = 7
APART = 1 - SHARED ** (1 / _BITS)
_U = np.uint64
_LAST = np.uint32(2 ** 32 - 1)
#: Bytes of letters and digits, and all bytes of other characters than ASCII.
_TELLING = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
_TOKEN_BITS = _U(34)
#: In every other block, tokens of so many bytes come into a sample eight times as easily as shorter ones, which most lines share.
_LONG = 6
#: Classes of characters, by their last byte: letters of about equal frequency in turn, a blank is one of them.
_CLASS = np.arange(256, dtype=np.uint8) & 3
_CLASS[np.frombuffer(b" etaonihsrdlucmfwygpbvk", np.uint8)] = np.array([0, 1, 2, 3, 3, 2, 1, 0] * 3, np.uint8)[:23]
#: Widest band of outlines, in words of 64 diagonals.
BAND = 4
#: Bound of the bits that tell tasks which lines are wanted as texts.
FIELD = 2 ** 26


def layout(lines: int) -> tuple[int, int]:
    """Width and number of the blocks for a table of ``lines`` lines."""
    width = _BITS * max(4, ceil((log2(lines + 1) - 6) / 4))
    return width, ceil(log(MISS) / log1p(-(1 - APART) ** width))


def _places(width: int, tables: int) -> np.ndarray:
    """The bits of a token's hash that vote in each block."""
    random = np.random.default_rng(0)
    return np.stack([random.permutation(64)[:width] for _ in range(tables)])


def _vote(samples: np.ndarray) -> np.ndarray:
    """Bits that most of the hashes in a row have; a hash of the row decides ties."""
    n = samples.shape[1]
    reached = [np.zeros(len(samples), _U) for _ in range(n)]  # bits with more than so many votes
    for k, hashes in enumerate(samples.T):
        for votes in range(k, 0, -1):
            reached[votes] |= reached[votes - 1] & hashes
        reached[0] |= hashes
    if n % 2:
        return reached[n // 2]
    return reached[n // 2] | (reached[n // 2 - 1] & hashing.mix64(samples.sum(axis=1, dtype=_U)))


def simhash(tokens: np.ndarray, first: np.ndarray, width: int, tables: int) -> np.ndarray:
    """Blocks, a row of bytes for each run of different token hashes that start at ``first``."""
    lengths = np.diff(np.append(first, len(tokens)))
    sample = np.minimum(lengths, width // _BITS)
    runs = {n: np.flatnonzero(sample == n) for n in np.unique(sample).tolist()}
    shift = ((tokens >> (_TOKEN_BITS - _U(1)) ^ _U(1)) * _U(3)).astype(np.uint32)
    odd = hashing.powers(tables + 1)
    size = -(-width // 8)
    out = np.empty((len(first), tables, size), np.uint8)
    for t, places in enumerate(_places(width, tables)):
        ranks = ((tokens * odd[t + 1]) >> _U(32)).astype(np.uint32)
        if t % 2:
            ranks >>= shift
        taken = np.empty((len(first), width // _BITS), np.uint32)
        for k in range(taken.shape[1]):
            taken[:, k] = np.minimum.reduceat(ranks, first)
            if k + 1 < taken.shape[1]:
                ranks[ranks == np.repeat(taken[:, k], lengths)] = _LAST
        block = np.empty(len(first), _U)
        for n, of in runs.items():
            block[of] = _vote(hashing.mix64(taken[of, :n] + (_U(t + 1) << _U(32))))
        block &= np.bitwise_or.reduce(_U(1) << places.astype(_U))
        out[:, t] = hashing.mix64(block + _U(t)).view(np.uint8).reshape(-1, 8)[:, :size]
    return out.reshape(len(first), tables * size)


@lru_cache(20_000)
def _shortened(line: str) -> bytes:
    """Hashes of what is left of a short line when up to as many characters go as a link between short lines has edits."""
    most = min(SHORT * EDITS // 100, len(line) // 4)
    left = {"".join(x) for n in range(most + 1) for x in combinations(line, len(line) - n)}
    texts = pa.array(sorted(x for x in left if x))
    data, offsets = hashing.text_bytes(texts)
    return hashing.hash_spans(data, offsets[:-1], offsets[1:]).tobytes()


def _tokens(data: np.ndarray, offsets: np.ndarray, line_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different tokens of every line with words, in order of lines, and the first token of each; the first bit marks short tokens."""
    marks = _TELLING[data]
    begin = line_starts[line_starts < len(data)]
    plain = ~np.logical_or.reduceat(marks, begin)
    if plain.any():
        marks |= np.repeat(plain, np.diff(np.append(begin, len(data)))) & ~hashing._BLANK[data]
    starts, ends, _ = hashing.spans(marks, offsets)
    line = np.searchsorted(line_starts, starts, side="right") - 1
    hashes = hashing.hash_spans(hashing._LOWER[data], starts, ends) >> (_U(65) - _TOKEN_BITS)
    hashes |= (ends - starts < _LONG).astype(_U) << (_TOKEN_BITS - _U(1))
    both = np.sort((line.astype(_U) << _TOKEN_BITS) | hashes)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    line = both >> _TOKEN_BITS
    return both & ((_U(1) << _TOKEN_BITS) - _U(1)), np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))


def _line_words(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes and offsets of the texts, starts of lines, starts and ends of words, first word of each line with words, text and number of that line, and its key."""
    data, offsets = hashing.text_bytes(texts)
    starts, ends, _ = hashing.spans(~hashing._BLANK[data], offsets)
    line_starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return data, offsets, line_starts, none, none, none, none, none, none
    hashes = hashing.hash_spans(hashing._LOWER[data], starts, ends)
    line = np.searchsorted(line_starts, starts, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    lengths = np.diff(np.append(first, len(line)))
    place = np.arange(len(line)) - np.repeat(first, lengths)
    weights = hashing.powers(int(lengths.max()) + 1)[place + 1]
    keys = hashing.mix64(np.add.reduceat(hashes * weights, first) + lengths.astype(_U) * _U(0x8EBC6AF09C88C6E3))
    owner = np.searchsorted(offsets, line_starts[line[first]], side="right") - 1
    number = line[first] - np.searchsorted(line_starts, offsets[owner])
    return data, offsets, line_starts, starts, ends, first, owner, number, keys.view(np.int64)


def _outlines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number of characters of every line's normal form, and the classes of these characters, four in a byte."""
    lengths = ends - starts + 1  # with the blank after each word
    begin = np.cumsum(lengths) - lengths
    form = hashing._LOWER[data[np.minimum(np.arange(lengths.sum()) + np.repeat(starts - begin, lengths), len(data) - 1)]]
    form[begin + lengths - 1] = 32
    last = np.append((form[1:] & 0xC0) != 0x80, True)  # the last byte of each character; blanks end the words
    points = np.append(0, np.cumsum(last))
    at = points[np.append(begin[first], len(form))]
    sizes = np.diff(at) - 1
    held = -(-(sizes + 1) // 4)
    shift = np.cumsum(held) - held
    codes = np.zeros(int(held.sum()) * 4, np.uint8)
    codes[np.arange(at[-1]) + np.repeat(shift * 4 - at[:-1], sizes + 1)] = _CLASS[form[last]]
    packed = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    ends = np.append(shift, len(packed)).astype(np.int32)
    return sizes, pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(packed)])


def _blocks(texts: pa.Array, width: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, list[bytes]]:
    """Of the lines with words: text, line number, key, length of the normal form, its outline, and its blocks followed by its shortened forms."""
    data, offsets, line_starts, starts, ends, first, owner, number, keys = _line_words(texts)
    if not len(first):
        return owner, number, keys, keys, pa.array([], pa.binary()), []
    sizes, outlines = _outlines(data, starts, ends, first)
    blocks = [x.tobytes() for x in simhash(*_tokens(data, offsets, line_starts), width, tables)]
    after = np.append(first, len(starts))
    for i in np.flatnonzero(sizes <= SHORT).tolist():
        words = range(after[i], after[i + 1])
        blocks[i] += _shortened(" ".join(hashing._LOWER[data[starts[w]:ends[w]]].tobytes().decode() for w in words))
    return owner, number, keys, sizes, outlines, blocks


def _compared(width: int, tables: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What lines are compared by, from (id, row, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for a, b in hashing.slices(texts):
                owner, number, keys, sizes, outlines, blocks = _blocks(texts.slice(a, b - a), width, tables)
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a).take(at) for i in (0, 1)), pa.array(number.astype(np.int32)), pa.array(keys),
                     pa.array(sizes.astype(np.int32)), outlines, pa.array(blocks, pa.binary())],
                    names=["id", "row", "line", "key", "size", "outline", "blocks"])
    return run


def _placed(field: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, row, line, key, line_text) of every line, from (id, row, text); the normal form of a line that may be wanted, once in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        words = field.value
        for batch in batches:
            texts = batch.column(2)
            for a, b in hashing.slices(texts):
                data, _, _, starts, ends, first, owner, number, keys = _line_words(texts.slice(a, b - a))
                at, after = pa.array(owner), np.append(first, len(starts))
                unsigned = keys.view(_U)
                held = words[(unsigned >> _U(6)) & _U(len(words) - 1)] >> (unsigned & _U(63)) & _U(1)
                forms: list[str | None] = [None] * len(keys)
                for i in np.flatnonzero(held).tolist():
                    if int(keys[i]) not in seen:
                        seen.add(int(keys[i]))
                        line = data[starts[after[i]]:ends[after[i + 1] - 1]].tobytes()
                        forms[i] = b" ".join(line.lower().split()).decode()  # of bytes: A-Z only, and the blanks of the word rules
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a).take(at) for i in (0, 1)), pa.array(number.astype(np.int32)),
                     pa.array(keys), pa.array(forms, pa.string())], names=["id", "row", "line", "key", "line_text"])
    return run


def _dealt(width: int, tables: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes of the lists of lines (node, blocks), dealt to ``parts``: (part, base, hashes, places), a line being base + place."""
    size = -(-width // 8)
    whole = size * tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            nodes = np.asarray(table.column(0))
            cuts = np.flatnonzero(np.diff(nodes) != 1) + 1  # files of a task
            for start, end in zip(np.append(0, cuts).tolist(), np.append(cuts, len(nodes)).tolist()):
                for a in range(start, end, 65536):
                    held = table.column(1).slice(a, min(end, a + 65536) - a).to_pylist()
                    wide = np.zeros((len(held), tables, 8), np.uint8)
                    wide[:, :, :size] = np.frombuffer(b"".join(x[:whole] for x in held), np.uint8).reshape(-1, tables, size)
                    blocks = hashing.mix64(wide.view(_U)[:, :, 0] * _U(tables) + np.arange(tables, dtype=_U)).ravel()
                    more = [(len(x) - whole) // 8 for x in held]
                    lists = np.concatenate([blocks, np.frombuffer(b"".join(x[whole:] for x in held), _U)])
                    places = np.concatenate([np.repeat(np.arange(len(held)), tables), np.repeat(np.arange(len(held)), more)]).astype(np.uint16)
                    part = (lists & _U(0xFFFFFFFF)) % _U(parts)
                    order = np.argsort(part.astype(np.uint16 if parts <= 65536 else np.uint32), kind="stable")
                    part, hashes, places = part[order], (lists >> _U(32)).astype(np.uint32)[order], places[order]
                    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
                    spans = list(zip(first.tolist(), np.append(first[1:], len(part)).tolist()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[first].astype(np.int32)), pa.array(np.full(len(first), nodes[a])),
                         pa.array([hashes[i:j].tobytes() for i, j in spans], pa.binary()),
                         pa.array([places[i:j].tobytes() for i, j in spans], pa.binary())],
                        names=["part", "base", "hashes", "places"])
    return run


def _shared_lists(table: pa.Table) -> pa.Table:
    """(list, node) of the lists with several lines of a part; a list is named by its lines, so lists of the same lines are one."""
    hashes = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint32)
    held = table.column("places").to_pylist()
    nodes = np.frombuffer(b"".join(held), np.uint16) + np.repeat(np.asarray(table.column("base")), [len(x) // 2 for x in held])
    order = np.argsort(hashes)
    hashes, nodes = hashes[order], nodes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    lengths = np.diff(np.append(first, len(hashes)))
    several = lengths > 1
    names = np.repeat(hashing.mix64(np.add.reduceat(hashing.mix64(nodes.astype(_U) + _U(1)), first) + lengths.astype(_U))[several], lengths[several])
    return pa.table({"list": names.view(np.int64), "node": nodes[np.repeat(several, lengths)]})


def _each_list(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """Whole lists, many at a time, of rows sorted by list."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        rows = [np.asarray(batch.column(i)) for i in range(columns)]
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        if held and held[0][0][0] != rows[0][0]:
            yield [np.concatenate(x) for x in zip(*held)]
            held = []
        if last:
            yield [np.concatenate(x) for x in zip(*held, [r[:last] for r in rows])]
            held = []
        held.append([r[last:] for r in rows])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _comparable(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether lines of these lengths can be a link."""
    return np.abs(a - b) <= np.maximum(a, b) * EDITS // 100


def _band_words(most: np.ndarray) -> np.ndarray:
    return (most + 2) // 64 + 1


def _far(codes: np.ndarray, at: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of rows whose outlines prove that they are no link.

    Equal characters have equal classes, so the edit distance of two outlines is at most that of the
    lines. It is taken for many pairs at once, by bit vectors over a band of diagonals that holds every
    way of ``most`` edits; a pair is far once the band's lower edge has more edits than such a way leaves.
    Pairs whose band is wider than BAND words are not judged here, and left to their texts.
    """
    out = np.zeros(len(a), bool)
    a, b = np.where(sizes[a] >= sizes[b], a, b), np.where(sizes[a] >= sizes[b], b, a)
    order = np.argsort(sizes[a], kind="stable")
    words = _band_words(sizes[a[order]] * EDITS // 100)
    start = 0
    while start < len(order) and words[start] <= BAND:
        end = min(start + 4096, int(np.searchsorted(words, words[start], side="right")))
        of = order[start:end]
        out[of] = _far_chunk(codes, at, sizes, a[of], b[of])
        start = end
    return out


def _matrix(codes: np.ndarray, at: np.ndarray, sizes: np.ndarray, shift: np.ndarray, width: int) -> np.ndarray:
    """Codes of rows from column ``shift`` on; 4 elsewhere."""
    out = np.full((len(at), width), 4, np.uint8)
    first = np.cumsum(sizes) - sizes
    inner = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    out[np.repeat(np.arange(len(at)), sizes), inner + np.repeat(shift, sizes)] = codes[inner + np.repeat(at, sizes)]
    return out


def _far_chunk(codes: np.ndarray, at: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    m, n = sizes[a], sizes[b]
    most = m * EDITS // 100
    low = (most + m - n + 1) // 2  # diagonals below the main one
    words = int(_band_words(most.max()))
    steps = m - low
    limit = most + low - (m - n)
    total = int(steps.max()) if len(steps) else 0
    shift = 64 * words - 1 - low
    width = -(-(int((m + shift).max()) + 64) // 64) * 64 + 64 * words
    pattern = _matrix(codes, at[a], m, shift, width)
    places = np.stack([np.packbits(pattern == c, axis=1, bitorder="little").view(_U) for c in range(4)])  # class, pair, word
    places = np.ascontiguousarray(places.transpose(2, 0, 1))
    text = np.ascontiguousarray(_matrix(codes, at[b], n, np.zeros_like(n), max(total, int(n.max()))).T)
    alive = np.arange(len(a))
    score = low.copy()
    far = np.zeros(len(a), bool)
    ones = np.full(len(a), _U(2 ** 64 - 1))
    up = []  # rows that may lie below the first column: the last low + 1 bits
    for w in range(words):
        bits = np.clip(low + 1 - 64 * (words - 1 - w), 0, 64)
        up.append(np.where(bits > 0, ones << (_U(64) - np.maximum(bits, 1).astype(_U)), _U(0)))
    down = [np.zeros(len(a), _U) for _ in range(words)]
    one, top = _U(1), _U(63)
    for i in range(total):
        word, bit = i >> 6, _U(i & 63)
        row = text[i]
        pick = np.minimum(row, 3).astype(np.intp) * places.shape[2] + np.arange(places.shape[2])
        got = [places[word + w].ravel()[pick] for w in range(words + (1 if bit else 0))]
        if bit:
            got = [(got[w] >> bit) | (got[w + 1] << (_U(64) - bit)) for w in range(words)]
        carry = None
        diagonal = []
        for w in range(words):
            equal = got[w]
            both = equal & up[w]
            add = both + up[w]
            over = add < both
            if carry is not None:
                add += carry
                over |= (add == 0) & (carry == one)
            carry = over.astype(_U)
            diagonal.append((add ^ up[w]) | equal | down[w])
        score += ((diagonal[-1] >> top) == 0) & (i < steps)
        for w in range(words):
            more = down[w] | ~(diagonal[w] | up[w])
            less = diagonal[w] & up[w]
            moved = diagonal[w] >> one
            if w + 1 < words:
                moved |= diagonal[w + 1] << top
            up[w], down[w] = less | ~(moved | more), moved & more
        if i % 32 == 31 or i + 1 == total:
            lost = score > limit
            far[alive[lost]] = True
            stay = ~lost & (i + 1 < steps)
            if stay.sum() < 0.8 * len(stay):
                if not stay.any():
                    break
                alive, score, limit, steps = alive[stay], score[stay], limit[stay], steps[stay]
                places, text = np.ascontiguousarray(places[:, :, stay]), np.ascontiguousarray(text[:, stay])
                up, down = [x[stay] for x in up], [x[stay] for x in down]
                if i + 1 >= int(steps.max()):
                    break
    return far


def _near_big(i: int, j: int, sizes: np.ndarray, far: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the rows i to j that are not far, each row tried with the first of every group that this makes; then rows of groups still apart.

    Several first rows are taken at once where most rows have a group of their own.
    """
    rows = np.arange(i, j)
    group = np.arange(j - i)
    placed, heads = np.zeros(j - i, bool), np.zeros(j - i, bool)
    parents: dict[int, int] = {}
    at_once = 1

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        for g, h in np.unique(np.stack([group[a - i], group[b - i]]), axis=1).T.tolist():
            parents[_root(parents, g)] = _root(parents, h)
        return np.array([_root(parents, g) for g in group.tolist()])

    while (left := np.flatnonzero(~placed)).size:
        new = left[:at_once]
        tried = [(i + h, rows[~heads & (rows != i + h) & ~(np.isin(rows, i + new) & (rows < i + h))]) for h in new.tolist()]
        heads[new] = True
        a, b = np.concatenate([np.full(len(to), h) for h, to in tried]), np.concatenate([to for _, to in tried])
        can = _comparable(sizes[a], sizes[b])
        a, b = a[can], b[can]
        stay = ~far(a, b)
        yield a[stay], b[stay]
        group = joined(a[stay], b[stay])
        placed[new] = placed[b[stay] - i] = True
        at_once = min(64, at_once * 2) if stay.sum() < 8 * len(new) else 1
    others = rows[~heads]
    held: list[np.ndarray] = []
    for at, x in enumerate(others.tolist()):
        to = others[at + 1:]
        to = to[(group[to - i] != group[x - i]) & _comparable(sizes[to], sizes[x])]
        held.append(np.stack([np.full(len(to), x), to]))
        if sum(p.shape[1] for p in held) >= 1 << 14 or at + 1 == len(others):
            a, b = np.concatenate(held, axis=1)
            held = []
            stay = ~far(a, b)
            yield a[stay], b[stay]
            group = joined(a[stay], b[stay])


def _near(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (list, a, b, a_size, b_size) that outlines leave, of rows (list, node, size, outline) sorted by list and node.

    Two lines that are near the first line of their list are left to it; should a pair turn out to be no
    link, what it was to connect is tried by ``_between``.
    """
    def found(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists, nodes, sizes = (np.asarray(batch.column(i)) for i in range(3))
        sizes = sizes.astype(np.int64)
        data, offsets = hashing.text_bytes(batch.column(3))
        codes, at = ((data[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).ravel(), offsets[:-1] * 4

        def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return _far(codes, at, sizes, a, b)

        def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            a, b = np.where(nodes[a] < nodes[b], a, b), np.where(nodes[a] < nodes[b], b, a)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (lists[a], nodes[a], nodes[b], sizes[a].astype(np.int32), sizes[b].astype(np.int32))],
                                              names=["list", "a", "b", "a_size", "b_size"])

        first = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
        lengths = np.diff(np.append(first, len(lists)))
        head, length = np.repeat(first, lengths), np.repeat(lengths, lengths)
        end = head + length
        a = np.flatnonzero((length <= most) & (head != np.arange(len(lists))))
        a = a[_comparable(sizes[a], sizes[head[a]])]
        a = a[~far(head[a], a)]
        yield pairs(head[a], a)
        close = np.zeros(len(lists), bool)
        close[a] = True
        x = np.flatnonzero((length <= most) & (head != np.arange(len(lists))))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for step in range(1, most):
            x = x[x + step < end[x]]
            if not len(x):
                break
            y = x + step
            can = ~(close[x] & close[y]) & _comparable(sizes[x], sizes[y])
            held.append((x[can], y[can]))
            if sum(len(p[0]) for p in held) >= 1 << 18 or not len(x[x + step + 1 < end[x]]):
                a, b = (np.concatenate(z) for z in zip(*held))
                held.clear()
                stay = ~far(a, b)
                yield pairs(a[stay], b[stay])
        for i, j in zip(first[lengths > most].tolist(), (first + lengths)[lengths > most].tolist()):
            for a, b in _near_big(i, j, sizes, far):
                if len(a):
                    yield pairs(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_lists(batches):
            yield from found(batch)
    return run


def _whole_lists(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Rows sorted by list, in batches of about ``rows`` that do not part a list."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        lists = np.asarray(batch.column(0))
        if sum(map(len, held)) >= rows:
            cut = int(np.searchsorted(lists, held[-1].column(0)[-1].as_py(), side="right"))
            if cut < len(batch):
                yield pa.concat_batches([*held, batch.slice(0, cut)])
                held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that can be links between different groups u, v of a list, from rows (list, key, size, group) sorted by list."""
    for rows in _each_list(batches, 4):
        first = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
        torn = np.minimum.reduceat(rows[3], first) != np.maximum.reduceat(rows[3], first)
        lists, keys, sizes, groups = (r[np.repeat(torn, np.diff(np.append(first, len(r))))] for r in rows)

        def pairs(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            can = (groups[a] != groups[b]) & _comparable(sizes[a], sizes[b])
            if can.any():
                a, b = a[can], b[can]
                a, b = np.where(keys[a] < keys[b], a, b), np.where(keys[a] < keys[b], b, a)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[a], keys[b], groups[a], groups[b])], names=["a", "b", "u", "v"])

        ends = np.searchsorted(lists, lists, side="right")
        lengths = ends - np.searchsorted(lists, lists)
        at = np.flatnonzero(lengths <= LIST)
        for step in range(1, LIST):
            at = at[at + step < ends[at]]
            if not len(at):
                break
            yield from pairs(at, at + step)
        for i in np.flatnonzero(lengths > LIST).tolist():
            to = np.arange(i + 1, ends[i])
            yield from pairs(np.full(len(to), i), to)


def _common(a: str, b: str) -> int:
    """Length of the common start, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _aligned(a: str, b: str, most: int) -> int:
    """Edits of one way to turn ``a`` into ``b``: common runs from left to right, found by pieces of ``a``."""
    edits = i = j = 0
    while True:
        at = _common(a[i:], b[j:])
        i, j = i + at, j + at
        spare = most - edits
        if max(len(a) - i, len(b) - j) <= spare:
            return edits + max(len(a) - i, len(b) - j)
        for skip in range(1, spare + 1):
            if i + skip + 8 > len(a):
                return most + 1
            if (to := b.find(a[i + skip:i + skip + 8], j, j + spare + 8)) >= 0:
                break
        else:
            return most + 1
        edits += max(skip, to - j)
        i, j = i + skip, to


def edits_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``: a column of the table is two long integers."""
    at = _common(a, b)
    a, b = a[at:], b[at:]
    at = _common(a[::-1], b[::-1])
    a, b = a[:len(a) - at], b[:len(b) - at]
    if not a or not b:
        return len(a) + len(b) <= most
    if max(len(a), len(b)) <= most or _aligned(a, b, most) <= most:
        return True
    if len(a) > 3 * most and len(grams := {a[i:i + 3] for i in range(len(a) - 2)}) > 3 * most:
        if len(grams.difference(b[i:i + 3] for i in range(len(b) - 2))) > 3 * most:  # an edit takes at most three of them
            return False
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    places = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        equal = places.get(c, 0)
        across = (((equal & up) + up) ^ up) | equal
        more, less = down | (full & ~(across | up)), up & across
        distance += 1 if more & last else -1 if less & last else 0
        if distance - left > most:
            return False
        more, less = (more << 1 | 1) & full, (less << 1) & full
        equal |= down
        up, down = less | (full & ~(equal | more)), more & equal
    return distance <= most


def _root(parents: dict[int, int], x: int) -> int:
    at = x
    while (up := parents.get(at, at)) != at:
        at = up
    while (up := parents.get(x, x)) != at:
        parents[x], x = at, up
    return at


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of a task, enough of them to connect what all its links would connect.

    A pair whose groups earlier links of the task already connect needs no distance, so many variants of
    one line cost about as many distances as there are variants.
    """
    parents: dict[int, int] = {}
    for batch in batches:
        a_long, b_long = (np.asarray(pc.utf8_length(batch.column(i))).astype(np.int64) for i in (2, 3))
        most = np.maximum(a_long, b_long) * EDITS // 100
        keep = np.zeros(len(batch), bool)
        u, v = np.asarray(batch.column(0)).tolist(), np.asarray(batch.column(1)).tolist()
        for i in np.flatnonzero(np.abs(a_long - b_long) <= most).tolist():
            x, y = _root(parents, u[i]), _root(parents, v[i])
            if x != y and edits_within(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), int(most[i])):
                keep[i] = True
                parents[x] = y
        yield batch.select([0, 1]).filter(pa.array(keep))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Groups (u, v) of the pairs (a, b) whose edit distance is at most EDITS percent of the longer line, enough to connect them all."""
    left = texts.select(F.col("node").alias("a"), F.col("line_text").alias("a_text"))
    right = texts.select(F.col("node").alias("b"), F.col("line_text").alias("b_text"))
    both = pairs.join(left, "a").join(right, "b").select("u", "v", "a_text", "b_text")
    return both.mapInArrow(_close, "u bigint, v bigint")


def _field(keys: DataFrame, rows: int) -> np.ndarray:
    """A bit for each key, and by chance for others: at most FIELD bits, so that many keys let more others through."""
    bits = max(1 << 10, min(FIELD, 1 << max(0, rows * 16 - 1).bit_length()))
    held = (keys.select(F.shiftrightunsigned("key", 6).bitwiseAND(F.lit(bits // 64 - 1)).alias("word"), F.expr("shiftleft(1L, int(key & 63))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("mask")).toArrow())
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(held.column("word"))] = np.asarray(held.column("mask"))
    return out.view(_U)


def _row(text: str, row_id: str) -> Column:
    """What tells different texts of one id, or of no id, apart."""
    return F.xxhash64(F.col(row_id), whole_text(text))


def _decisions(docs: DataFrame, text: str, row_id: str) -> DataFrame:
    """(id, row, line, kept, keeper_id, keeper_line) of every line with words."""
    kind = docs.schema[row_id].dataType.simpleString()
    breaks = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    total = docs.agg(F.sum(F.coalesce(breaks, F.lit(0)) + 1)).first()[0] or 0
    wide = layout(total)
    rows = docs.select(F.col(row_id).alias("id"), _row(text, row_id).alias("row"), whole_text(text).alias("text"))
    compared = rows.mapInArrow(_compared(*wide), f"id {kind}, row bigint, line int, key bigint, size int, outline binary, blocks binary")
    distinct = written(compared.groupBy("key").agg(
        F.min(F.struct(F.col("id").isNull().alias("last"), "id", "line", "row")).alias("first"), F.first("size").alias("size"),
        F.first("outline").alias("outline"), F.first("blocks").alias("blocks"), F.count(F.lit(1)).alias("uses"))
        .withColumn("node", F.monotonically_increasing_id()))
    dealt = distinct.select("node", "blocks").mapInArrow(
        _dealt(*wide, max(1, total * wide[1] >> 19)), "part int, base bigint, hashes binary, places binary")
    found = (dealt.groupBy("part").applyInArrow(_shared_lists, "list bigint, node bigint")
             .repartition("node").dropDuplicates(["list", "node"]).join(distinct.select("node", "size", "outline"), "node"))
    near = written(found.select("list", "node", "size", "outline").repartition("list").sortWithinPartitions("list", "node").mapInArrow(
        _near(LIST), "list bigint, a bigint, b bigint, a_size int, b_size int"))
    members = near.select("list", F.col("a").alias("node"), F.col("a_size").alias("size")).unionByName(
        near.select("list", F.col("b").alias("node"), F.col("b_size").alias("size"))).distinct()
    wanted = written(distinct.select("node", "key").join(members.select("node").distinct(), "node"))
    spark = docs.sparkSession
    field = spark.sparkContext.broadcast(_field(wanted, wanted.count()))
    lines = written(rows.mapInArrow(_placed(field), f"id {kind}, row bigint, line int, key bigint, line_text string"))
    texts = written(lines.filter("line_text is not null").select("key", "line_text").join(wanted, "key")
                    .groupBy("node").agg(F.first("line_text").alias("line_text")))
    pairs = near.select("a", "b").distinct()
    known = settled(components(_verified(pairs.select("a", "b", F.col("a").alias("u"), F.col("b").alias("v")), texts), "u", "v"))
    placed = members.join(known, "node", "left").select("list", "node", "size", F.coalesce("component", "node").alias("group"))
    rest = (placed.repartition("list").sortWithinPartitions("list").mapInArrow(_between, "a bigint, b bigint, u bigint, v bigint")
            .distinct().join(pairs, ["a", "b"], "left_anti"))
    merged = components(_verified(rest, texts), "u", "v").select(F.col("node").alias("group"), F.col("component").alias("whole"))
    linked = known.withColumnRenamed("component", "group").unionByName(merged.select(F.col("group").alias("node"), "group")).distinct()
    linked = linked.join(merged, "group", "left").select("node", F.coalesce("whole", "group").alias("component"))
    groups = distinct.select("node", "key", "first", "uses").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keepers = groups.groupBy("component").agg(F.min("first").alias("keeper"))
    named = groups.select("key", "component", "uses").join(keepers, "component").select("key", "keeper", "uses")
    joined = with_group_values(lines.select("id", "row", "line", "key"), named, "key", "uses", lines.count())
    return joined.select("id", "row", "line",
                         ((F.col("row") == F.col("keeper.row")) & F.col("id").eqNullSafe(F.col("keeper.id"))
                          & (F.col("line") == F.col("keeper.line"))).alias("kept"),
                         F.col("keeper.id").alias("keeper_id"), F.col("keeper.line").alias("keeper_line"))


def line_decisions(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(id, line, kept, keeper_id, keeper_line) of every line with words; lines are counted from 0."""
    return _decisions(docs, text, row_id).drop("row").withColumnRenamed("id", row_id)


def _with_gone(docs: DataFrame, text: str, row_id: str, carried: DataFrame) -> tuple[DataFrame, str]:
    """``carried``, rows of ``docs`` with their ``_row`` as a last column, with the numbers of each row's dropped lines, and the name of that column."""
    key, row, held = (name + "_" * max(map(len, carried.columns)) for name in ("id", "row", "gone"))  # longer than any name of docs
    gone = (_decisions(docs, text, row_id).filter(~F.col("kept")).groupBy(F.col("id").alias(key), F.col("row").alias(row))
            .agg(F.array_sort(F.collect_set("line")).alias(held)))
    return carried.join(gone, (F.col(carried.columns[-1]) == F.col(row)) & F.col(row_id).eqNullSafe(F.col(key)), "left"), held


def line_summary(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Per document: its id, n_lines, n_dropped, and dropped, the dropped lines' numbers in order."""
    counted = docs.select(row_id, F.size(F.split(whole_text(text), "\n")).cast("long").alias("n_lines"), _row(text, row_id).alias("_" + row_id))
    rows, held = _with_gone(docs.select(row_id, text), text, row_id, counted)
    return rows.select(
        row_id, "n_lines",
        F.coalesce(F.size(held), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.concat_ws(",", F.col(held).cast("array<string>")), F.lit("")).alias("dropped"))


def drop_lines(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``docs`` with the dropped lines taken out of the text."""
    carried = docs.withColumn("_" * (1 + max(map(len, docs.columns))), _row(text, row_id))
    rows, held = _with_gone(docs, text, row_id, carried)
    lines = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(held, i))
    cleaned = F.when(F.col(held).isNull(), F.col(text)).otherwise(F.array_join(lines, "\n"))
    return rows.withColumn(text, cleaned).select(*docs.columns)
