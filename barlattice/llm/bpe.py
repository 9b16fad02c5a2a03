"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut into pieces as the tokenizer file's pre-tokenizer does. The distinct pieces of a part
of a partition lie in one symbol array. An index maps every mergeable pair to all its positions; the
pairs' ranks are applied in ascending order, each at all its positions at once, and the lists of the
pairs that a merge makes or breaks are updated. A pair can only arise from merges of lower rank, so
one ascending sweep ends with the same symbols as merging word by word.

Defined cases: null and empty texts have no tokens; the special tokens of the file are found in the
text as the library finds them and become one id; decoding returns the text, and bytes that are not
UTF-8 become U+FFFD; long texts are cut only between pieces; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm.hashing import give_back

#: The pre-tokenizer's pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts whose characters all pass PLAIN, in the faster standard module.
_PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-©«-±¿-ƺ‐-‧]*")
#: Pieces whose tokens are kept from one part of a partition to the next, and bytes of a part.
KEPT_PIECES, PART_BYTES = 150_000, 4_000_000
_NONE = np.int32(2 ** 31 - 1)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level files: printable Latin-1 bytes
    stand for themselves, the others for code points from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Tokenizer:
    """A byte-level BPE file: merges, special tokens and bytes of each id."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([vocab[c] for c in letters], np.int32)
        parts = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in parts], np.int64)
        right = np.array([vocab[b] for _, b in parts], np.int64)
        self.made = np.array([vocab[a + b] for a, b in parts], np.int32)
        self.double = left == right
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.id_bytes = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.id_bytes[i] = (bytes(of_letter[c] for c in token) if all(c in of_letter for c in token)
                                else token.encode("utf-8"))
        self._cut = regex.compile(PATTERN).findall
        self._cut_plain = re.compile(_PLAIN_PATTERN).findall
        self._special = (re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
                         if self.special else None)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Lists of pieces; special tokens come as a list of their own."""
        runs = self._special.split(text) if self._special else [text]
        for i, run in enumerate(runs):
            if run:
                yield [run] if i % 2 else (self._cut_plain if _PLAIN.fullmatch(run) else self._cut)(run)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of pieces that lie one after another in ``data``, and the tokens of each piece."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        symbol = self.byte_ids[data]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(lengths)
        after[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        rank = np.full(n, _NONE, np.int32)
        paired = np.flatnonzero(after >= 0)
        rank[paired] = self._rank(symbol[paired], symbol[paired + 1])
        alive = np.ones(n, bool)
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []
        self._index(lists, active, rank[paired], paired.astype(np.int32))
        while active:
            r = heapq.heappop(active)
            at = lists.pop(r)
            at = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if self.double[r]:
                at = _every_other(np.unique(at), after)
            gone = after[at]
            beyond = after[gone]
            symbol[at] = self.made[r]
            alive[gone] = False
            rank[gone] = _NONE
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            left = before[at]
            # pairs made: with the symbol on the right, and of the symbol on the left
            first = np.concatenate([at, left[left >= 0]])
            second = after[first]
            ended = second < 0
            fresh = self._rank(symbol[first], symbol[second])
            fresh[ended] = _NONE
            rank[first] = fresh
            self._index(lists, active, fresh, first)
        owner = np.repeat(np.arange(len(lengths)), lengths)[alive]
        return symbol[alive], np.bincount(owner, minlength=len(lengths))

    @staticmethod
    def _index(lists: dict, active: list, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Append positions to the list of their pair."""
        known = ranks != _NONE
        ranks, positions = ranks[known], positions[known]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for (a, b), r in zip(pairwise(cuts), ranks[cuts[:-1]].tolist()):
            if r in lists:
                lists[r].append(positions[a:b])
            else:
                lists[r] = [positions[a:b]]
                heapq.heappush(active, r)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.id_bytes.__getitem__, ids)).decode("utf-8", errors="replace")


def _every_other(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of positions that overlap in a chain, the first, the third and so on."""
    starts = np.concatenate([[True], after[at[:-1]] != at[1:]])
    index = np.arange(len(at))
    run = np.maximum.accumulate(np.where(starts, index, 0))
    return at[(index - run) % 2 == 0]


class Encoder:
    """Encodes parts of a partition; tokens of pieces are kept between parts up to a bound."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.tokens, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > KEPT_PIECES:
            self._clear()
        known, special = self.known, self.tokenizer.special
        old = len(known)
        rows = []
        for text in texts:
            row: list[int] = []
            for run in self.tokenizer.pieces(text):
                row += [known.setdefault(p, len(known)) for p in run]
            rows.append(np.array(row, np.int64))
        fresh = list(known)[old:] if len(known) > old else []
        raw = [b"" if p in special else p.encode("utf-8") for p in fresh]
        tokens, counts = self.tokenizer.merge(np.frombuffer(b"".join(raw), np.uint8),
                                              np.fromiter(map(len, raw), np.int64, len(raw)))
        alone = [(i, special[p]) for i, p in enumerate(fresh) if p in special]
        if alone:
            where = np.array([i for i, _ in alone])
            tokens = np.insert(tokens, (np.cumsum(counts) - counts)[where], [t for _, t in alone])
            counts[where] = 1
        self.starts = np.concatenate([self.starts, len(self.tokens) + np.cumsum(counts) - counts])
        self.lengths = np.concatenate([self.lengths, counts])
        self.tokens = np.concatenate([self.tokens, tokens])
        out = []
        for row in rows:
            lengths = self.lengths[row]
            shift = self.starts[row] - (np.cumsum(lengths) - lengths)
            out.append(self.tokens[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))])
        return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts in parts of about PART_BYTES."""
    for batch in batches:
        texts = batch.column(1)
        start, held = 0, 0
        rows: list[str] = []
        for i in range(len(batch)):
            rows.append(texts[i].as_py() or "")
            held += len(rows[-1])
            if held > PART_BYTES or i == len(batch) - 1:
                yield batch.column(0).slice(start, i + 1 - start), rows
                start, held, rows = i + 1, 0, []


def encode(docs: DataFrame, tokenizer_file: str, text: str = "text", row_id: str = "doc_id",
           decoded: bool = False) -> DataFrame:
    """Per row: its id, n_tokens and ids (little-endian unsigned 32-bit integers, one after another).

    With ``decoded`` the ids are also decoded in the same pass, as :func:`decode` does.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, "rb") as f:  # a file of a few MB on the driver; its content is sent along
        content = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Tokenizer(content.value))
        for ids, texts in _parts(batches):
            tokens = encoder.encode(texts)
            columns = [ids, pa.array([len(t) for t in tokens], pa.int64()),
                       pa.array([t.astype("<u4").tobytes() for t in tokens], pa.binary())]
            if decoded:
                columns.append(pa.array([encoder.tokenizer.decode(t.tolist()) for t in tokens], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)
        encoder._clear()
        give_back()

    names = [row_id, "n_tokens", "ids", *(["decoded"] if decoded else [])]
    kind = docs.schema[row_id].dataType.simpleString()
    schema = f"`{row_id}` {kind}, n_tokens bigint, ids binary" + ", decoded string" * decoded
    return docs.select(row_id, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """``encoded`` with the column decoded, the text of its ids."""
    with open(tokenizer_file, "rb") as f:
        content = encoded.sparkSession.sparkContext.broadcast(f.read())
    names = [c for c in encoded.columns if c != "decoded"]
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(content.value)
        for batch in batches:
            texts = [tokenizer.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*names).schema)
    return encoded.select(*names).mapInArrow(run, f"{schema}, decoded string")


def digest_columns(decoded: DataFrame, row_id: str = "doc_id") -> DataFrame:
    return decoded.select(row_id, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
