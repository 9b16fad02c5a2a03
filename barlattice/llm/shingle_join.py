"""Self-join of documents on the Jaccard similarity of their word shingles, by vertical partitioning.

The order of all shingles (their 64-bit hashes) is cut into fragments. A task of the first step gets
one fragment of every document and counts there in how many different sets each shingle lies; only
shingles of two or more sets leave it, so that overlaps are counted on what can overlap at all.

Candidates. Ordered by (count, hash), two sets that reach the threshold share a shingle among their
first n - ceil(t * n) + 1. A document whose shingles of its own fill these places has no link and
ends here. The others are listed by shared shingle, and links are found in two rounds: first each
document with the best document of each of its lists, then, between the components that gives, all
remaining pairs of a list whose sizes and sketches allow the threshold. Pairs that are connected
already are not formed, which is what keeps a group of thousands of near copies from making the
square of its size; no pair that could join two components is left out.

Verification. The shared shingles of each document are cut into ``PARTS`` coarser fragments, the
partial overlaps of a pair are counted in each, and their sum decides.

Documents with the same set are one class all along, so copies only meet in the last join.

Defined cases: null, empty and blank texts have the empty set, n_shingles 0, and are linked with
nothing; a text of fewer words than a shingle is one shingle; rows that repeat an id are copies like
others; the component is the smallest id, null ids ranking last; an empty table gives an empty
result; long texts add rows, never a larger row than their own shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.llm import hashing
from barlattice.llm.common import settled, whole_text, with_group_values, written
from barlattice.llm.components import components

#: Shingles of a fragment, on average (the number of fragments follows the data), and that a task
#: cuts at a time; fragments of the verification; bytes of a word, used only to choose the number of
#: fragments.
FRAGMENT_SHINGLES, SENT_SHINGLES, PARTS, WORD_BYTES = 2_000_000, 1_000_000, 4, 6
_U = np.uint64
#: Bits of a set's sketch, in 64-bit columns.
SKETCH = 512
_BITS = [f"bits{i}" for i in range(SKETCH // 64)]


def set_key(held: np.ndarray) -> int:
    """A 63-bit key of a set of shingles."""
    total = np.array([len(held)], _U) * _U(0xC2B2AE3D27D4EB4F) + hashing.mix64(held ^ _U(0x9FB21C651E98DF25)).sum(dtype=_U)
    return int(hashing.mix64(total)[0] >> _U(1))


def _keys(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        for a, b in hashing.slices(texts):
            sets = hashing.shingles(texts.slice(a, b - a), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_key(s) for s in sets], pa.int64())],
                names=[batch.schema.names[0], "n_shingles", "set_key"])
    hashing.give_back()


def _segments(batches: Iterator[pa.RecordBatch], n: int, fragments: int) -> Iterator[pa.RecordBatch]:
    """One row per fragment: keys and sizes of the sets that have shingles there, how many, and the shingles."""
    sets: dict[int, np.ndarray] = {}
    held = 0
    for batch in batches:
        texts = batch.column(0)
        for a, b in hashing.slices(texts):
            for s in hashing.shingles(texts.slice(a, b - a), n):
                if len(s) and (key := set_key(s)) not in sets:
                    sets[key] = s
                    held += len(s)
            if held > SENT_SHINGLES:
                yield _cut(sets, fragments)
                sets, held = {}, 0
    if sets:
        yield _cut(sets, fragments)
        sets.clear()
    hashing.give_back()


def _cut(sets: dict[int, np.ndarray], fragments: int) -> pa.RecordBatch:
    keys = np.array(list(sets), np.int64)
    sizes = np.array([len(s) for s in sets.values()], np.int32)
    every = np.concatenate(list(sets.values()))
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), sizes)
    fragment = ((every >> _U(32)) * _U(fragments) >> _U(32)).astype(np.int32)
    order = np.argsort(fragment, kind="stable")
    cuts = np.searchsorted(fragment[order], np.arange(fragments + 1))
    rows = []
    for f in range(fragments):
        part = order[cuts[f]:cuts[f + 1]]
        if len(part):
            inside, counts = np.unique(owner[part], return_counts=True)
            rows.append((f, keys[inside].tobytes(), sizes[inside].tobytes(), counts.astype(np.int32).tobytes(), _pack(every[part])))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))],
        names=["fragment", "keys", "sizes", "counts", "held"])


def _pack(values: np.ndarray) -> bytes:
    """The upper 56 bits, in 7 bytes each."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpack(held: bytes) -> np.ndarray:
    out = np.zeros((len(held) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(held, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view(">u8").astype(_U)


def _joined(group: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in group.column(name)])


def _shared(group: pa.Table, fragments: int) -> pa.Table:
    """Of one fragment: the shingles of two or more sets, with the number of sets.

    The sets are dealt into as many buckets by key as there are fragments, one row per bucket.
    """
    keys, sizes, counts = _joined(group, "keys", np.int64), _joined(group, "sizes", np.int32), _joined(group, "counts", np.int32)
    held = np.concatenate([_unpack(x.as_py()) for x in group.column("held")])
    # a set that came from two batches counts once
    _, first = np.unique(keys, return_index=True)
    once = np.zeros(len(keys), bool)
    once[first] = True
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), counts)
    mask = once[owner]
    owner, held = owner[mask], held[mask]
    order = np.argsort(held, kind="stable")
    owner, held = owner[order], held[order]
    starts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    lengths = np.diff(np.append(starts, len(held)))
    often = np.repeat(lengths, lengths)
    mask = often > 1
    owner, held, often = owner[mask], held[mask], often[mask].astype(np.int32)
    bucket = (keys % fragments)[owner]
    order = np.lexsort((owner, bucket))
    owner, held, often, bucket = owner[order], held[order], often[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(fragments + 1))
    rows = []
    for i in range(fragments):
        part = slice(cuts[i], cuts[i + 1])
        if cuts[i] < cuts[i + 1]:
            inside, n = np.unique(owner[part], return_counts=True)
            rows.append((i, keys[inside].tobytes(), sizes[inside].tobytes(), n.astype(np.int32).tobytes(),
                         held[part].tobytes(), often[part].tobytes()))
    return pa.table([pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.binary()) for i in range(6)],
                    names=["bucket", "keys", "sizes", "counts", "held", "often"])


def _sets(group: pa.Table, percent: int) -> pa.Table:
    """Of one bucket: the sets that may have a link, with all they share with others.

    ``first`` are the shared shingles among the first places by (count, hash). The sketch has the
    parities of the shared shingles by ``SKETCH`` bits of their hash: two sets differ in at least as
    many shingles as their sketches in bits.
    """
    keys, sizes, counts = _joined(group, "keys", np.int64), _joined(group, "sizes", np.int32), _joined(group, "counts", np.int32)
    held, often = _joined(group, "held", _U), _joined(group, "often", np.int32)
    known, which, at = np.unique(keys, return_index=True, return_inverse=True)
    n = sizes[which].astype(np.int64)
    owner = np.repeat(at, counts)
    shared = np.bincount(owner, minlength=len(known))
    places = n - (percent * n + 99) // 100 + 1 - (n - shared)
    keep = places > 0
    mask = keep[owner]
    order = np.lexsort((held[mask], often[mask], owner[mask]))
    owner, held = owner[mask][order], held[mask][order]
    kept = np.flatnonzero(keep)
    owner = np.searchsorted(kept, owner)
    n, shared, places = n[kept], shared[kept], np.minimum(places[kept], shared[kept])
    ends = np.cumsum(shared)
    place = np.arange(len(owner)) - np.repeat(ends - shared, shared)
    first = held[place < np.repeat(places, shared)]
    sketch = np.zeros((len(kept), SKETCH // 8), np.uint8)
    for start in range(0, len(kept), 2048):  # bounded counts at a time
        part = slice(ends[start] - shared[start], ends[min(start + 2048, len(kept)) - 1])
        bit = (owner[part] - start) * SKETCH + (held[part] >> _U(8)).astype(np.int64) % SKETCH
        rows = min(2048, len(kept) - start)
        odd = (np.bincount(bit, minlength=rows * SKETCH) & 1).astype(np.uint8).reshape(rows, SKETCH)
        sketch[start:start + rows] = np.packbits(odd, axis=1)
    words = sketch.view(np.int64).reshape(len(kept), SKETCH // 64)

    def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values.view(np.int64)))

    return pa.table({"set_key": known[kept], "n": n, "shared": shared.astype(np.int64), "held": lists(held, shared),
                     "first": lists(first, places)} | {c: np.ascontiguousarray(words[:, i]) for i, c in enumerate(_BITS)})


def _part(held: str, part: int) -> Column:
    """The shingles of one of the PARTS ranges."""
    return F.filter(held, lambda x: F.shiftrightunsigned(x, 62) == part)


def _can_reach(percent: int) -> Column:
    """Sizes, shared shingles and sketches that allow the threshold."""
    both = F.col("a_n") + F.col("b_n")
    most = F.least("a_shared", "b_shared", "a_n", "b_n")
    differ = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _BITS),
                 both - F.col("a_shared") - F.col("b_shared"))
    return (100 * most >= percent * (both - most)) & ((100 + percent) * (both - differ) >= 2 * percent * both)


def _verify(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Links among pairs (a, b, a_n, b_n): partial overlaps by fragment, summed."""
    left = parts.select(F.col("set_key").alias("a"), "part", F.col("held").alias("a_held"))
    right = parts.select(F.col("set_key").alias("b"), "part", F.col("held").alias("b_held"))
    partial_counts = (pairs.join(left, "a").join(right, ["b", "part"])
                      .select("a", "b", "a_n", "b_n", F.size(F.array_intersect("a_held", "b_held")).alias("common")))
    return (partial_counts.groupBy("a", "b", "a_n", "b_n").agg(F.sum("common").alias("common"))
            .filter(100 * F.col("common") >= percent * (F.col("a_n") + F.col("b_n") - F.col("common")))
            .select("a", "b"))


def _as(frame: DataFrame, prefix: str, key: str) -> DataFrame:
    return frame.select(key, *[F.col(c).alias(prefix if c == "set_key" else f"{prefix}_{c}")
                               for c in frame.columns if c != key])


def set_links(docs: DataFrame, text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """(a, b): links between different sets that connect all sets that links connect."""
    texts = docs.select(whole_text(text).alias("text")).filter(F.col("text") != "")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(PARTS, size // (WORD_BYTES * FRAGMENT_SHINGLES))

    def cut(group: pa.Table) -> pa.Table:
        out = _shared(group, fragments)
        hashing.give_back()
        return out

    def gather(group: pa.Table) -> pa.Table:
        out = _sets(group, percent)
        hashing.give_back()
        return out

    segments = texts.mapInArrow(partial(_segments, n=n, fragments=fragments),
                                "fragment int, keys binary, sizes binary, counts binary, held binary")
    shared = segments.groupBy("fragment").applyInArrow(
        cut, "bucket int, keys binary, sizes binary, counts binary, held binary, often binary")
    bits = "".join(f", {c} bigint" for c in _BITS)
    whole = written(shared.groupBy("bucket").applyInArrow(
        gather, f"set_key bigint, n bigint, shared bigint, held array<bigint>, first array<bigint>{bits}"))
    parts = whole.select("set_key", F.explode(F.array(*[
        F.struct(F.lit(p).alias("part"), _part("held", p).alias("held"))
        for p in range(PARTS)])).alias("s")).select("set_key", "s.part", "s.held").filter(F.size("held") > 0)
    lists = whole.select("set_key", "n", "shared", *_BITS, F.explode("first").alias("shingle"))
    best = lists.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"), F.min_by(
        F.struct("set_key", "n", "shared", *_BITS), F.struct(1 - F.col("shared") / F.col("n"), "set_key")).alias("hub"))
    hubs = best.filter("size > 1").select("shingle", "hub.*")
    stars = (_as(lists, "a", "shingle").join(_as(hubs, "b", "shingle"), "shingle").filter("a <> b")
             .filter(_can_reach(percent)).select("a", "b", "a_n", "b_n").distinct())
    near = settled(_verify(stars, parts, percent))
    known = components(near)
    placed = lists.join(known.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn(
        "component", F.coalesce("component", "set_key"))
    mixed = placed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    placed = settled(placed.join(mixed.filter("low <> high").select("shingle"), "shingle", "left_semi"))
    rest = (_as(placed, "a", "shingle").join(_as(placed, "b", "shingle"), "shingle")
            .filter((F.col("a") < F.col("b")) & (F.col("a_component") != F.col("b_component")))
            .filter(_can_reach(percent)).select("a", "b", "a_n", "b_n").distinct())
    return near.unionByName(_verify(rest, parts, percent))


def linked_components(docs: DataFrame, text: str = "text", row_id: str = "doc_id", n: int = 4,
                      percent: int = 85) -> DataFrame:
    """Per row: its id, n_shingles and component_id, the smallest id that links reach."""
    kind = docs.schema[row_id].dataType.simpleString()
    keyed = written(docs.select(F.col(row_id), whole_text(text).alias("text")).mapInArrow(
        partial(_keys, n=n), f"`{row_id}` {kind}, n_shingles bigint, set_key bigint"))
    known = components(set_links(docs, text, n, percent))
    sets = (keyed.filter("n_shingles > 0").groupBy("set_key")
            .agg(F.min(row_id).alias("low"), F.count(F.lit(1)).alias("copies"))
            .join(known.withColumnRenamed("node", "set_key"), "set_key", "left")
            .withColumn("component", F.coalesce("component", "set_key")))
    lows = sets.groupBy("component").agg(F.min("low").alias("component_id"))
    named = sets.join(lows, "component").select("set_key", "component_id", "copies")
    linked = with_group_values(keyed.filter("n_shingles > 0"), named, "set_key", "copies", keyed.count())
    empty = keyed.filter("n_shingles = 0").withColumn("component_id", F.col(row_id))
    return (linked.select(row_id, "n_shingles", "component_id")
            .unionByName(empty.select(row_id, "n_shingles", "component_id")))


def drop_near_copies(docs: DataFrame, text: str = "text", row_id: str = "doc_id", n: int = 4,
                     percent: int = 85) -> DataFrame:
    """The documents that are the smallest id of their component, with the columns of ``docs``.

    Rows that repeat an id stay or go together.
    """
    found = linked_components(docs, text, row_id, n, percent)
    stay = found.filter(F.col(row_id).eqNullSafe(F.col("component_id"))).select(F.col(row_id).alias("__id")).distinct()
    return docs.join(stay, F.col(row_id).eqNullSafe(F.col("__id"))).select(*docs.columns)
