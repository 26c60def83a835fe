"""SimHash near-duplicates: fingerprints of word shingles, linked through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.llm.common import REMEMBERED, broadcast_if_small, durable, join_by_weight, memory, only, row_key
from cellwise.llm.components import smallest_reachable

SEED = 42
FAN = 16  # children of a node
PAIRS_AT_ONCE = 1024  # pairs of nodes; each gives up to FAN * FAN pairs of children


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 of each shingle: A-Z lower-cased, words between ASCII white space, joined by one space."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=True)]


def _mixed(h: np.ndarray, turn: int) -> np.ndarray:
    """Another 64 bits from the same hash; turn 0 is the hash itself."""
    if not turn:
        return h
    x = h + np.uint64(0x9E3779B97F4A7C15 * turn % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bit_majorities(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros((words, batch.num_rows), dtype=np.uint64)
        for i in range(batch.num_rows):
            if found := shingle_hashes(batch.column(1)[i].as_py(), shingle):
                hashes = np.array(found, dtype=np.uint64)
                for k in range(words):
                    out[k, i] = bit_majorities(_mixed(hashes, k))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.view(np.int64)) for x in out)], names=["id", *(f"f{k}" for k in range(words))])


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, f0, f1, ...) of each row: `words` fingerprints of 64 bits, zero if the text has no words or is null."""
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return slim.mapInArrow(lambda b: _fingerprint_batches(b, shingle, words), ", ".join(["id long", *(f"f{k} long" for k in range(words))]))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Groups of fingerprints, each sorted by Gray rank; nodes of FAN children hold the bits that all below share.

    fps: one row per fingerprint, of one or more 64-bit words. group: rows of different groups are never compared.
    """

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        self.order = np.lexsort((gray_rank(fps[:, 0]), group))
        self.fps, group = fps[self.order], group[self.order]
        lowest, highest, of = self.fps, self.fps, group
        self.group, self.settled = group, None
        self.levels = []  # (AND, OR, first child, children) of each node; level 0 stands over the fingerprints
        while True:
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, dtype=np.int64)
            sizes = np.diff(np.r_[starts, len(of)])
            place = np.arange(len(of)) - np.repeat(starts, sizes)
            first = np.flatnonzero(place % FAN == 0)
            lowest, highest = (np.bitwise_and.reduceat(lowest, first, axis=0), np.bitwise_or.reduceat(highest, first, axis=0)) if len(first) else (lowest, highest)
            self.levels.append((lowest, highest, first, np.diff(np.r_[first, len(of)])))
            of = of[first]
            if not len(of) or (of[1:] != of[:-1]).all():
                break

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of children of pairs of nodes; each pair of a node with itself gives each pair of its children once."""
        _, _, first, n = self.levels[level]
        each = n[a] * n[b]
        pair = np.repeat(np.arange(len(a)), each)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
        x, y = first[a][pair] + at // n[b][pair], first[b][pair] + at % n[b][pair]
        keep = x <= y
        return x[keep], y[keep]

    def neighbours(self, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows that follow each other in Gray order and differ in at most `limit` bits."""
        near = np.bitwise_count(self.fps[1:] ^ self.fps[:-1]).sum(axis=1, dtype=np.int64) <= limit
        at = np.flatnonzero(near & (self.group[1:] == self.group[:-1]))
        return self.order[at], self.order[at + 1]

    def settle(self, label: np.ndarray) -> None:
        """Nodes all of whose rows have one label need no comparison with nodes of that label: -1 marks the others."""
        low = high = label[self.order]
        self.settled = []
        for _, _, first, _ in self.levels:
            if len(first):
                low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            self.settled.append(np.where(low == high, low, -1))

    def _open(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not self.settled:
            return np.ones(len(x), dtype=bool)
        a = self.settled[level]
        return (a[x] < 0) | (a[x] != a[y])

    def links(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows (by their place in fps as given) that differ in at most `limit` bits, in batches."""
        roots = np.arange(len(self.levels[-1][2]))
        roots = roots[self._open(len(self.levels) - 1, roots, roots)]
        stack = [(len(self.levels) - 1, roots[i : i + PAIRS_AT_ONCE], roots[i : i + PAIRS_AT_ONCE]) for i in range(0, len(roots), PAIRS_AT_ONCE)]
        while stack:
            level, a, b = stack.pop()
            x, y = self._children(level, a, b)
            if not level:
                near = x < y
                x, y = x[near], y[near]
                near = np.bitwise_count(self.fps[x] ^ self.fps[y]).sum(axis=1, dtype=np.int64) <= limit
                if near.any():
                    yield self.order[x[near]], self.order[y[near]]
                continue
            low, high = self.levels[level - 1][:2]
            # Bits that all below one node have and all below the other lack, on either side: no pair differs in fewer.
            apart = np.bitwise_count((low[x] & ~high[y]) | (low[y] & ~high[x])).sum(axis=1, dtype=np.int64)
            near = (apart <= limit) & self._open(level - 1, x, y)
            x, y = x[near], y[near]
            stack += [(level - 1, x[i : i + PAIRS_AT_ONCE], y[i : i + PAIRS_AT_ONCE]) for i in range(0, len(x), PAIRS_AT_ONCE)]


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; afterwards parent leads each element towards the smallest of its set."""
    while len(a):
        while (parent[a] != a).any():
            a = parent[a]
        while (parent[b] != b).any():
            b = parent[b]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        a, b = low[open_], high[open_]
        np.minimum.at(parent, b, a)
    parent[:] = parent[parent]


def _forest(batches: Iterator[pa.RecordBatch], words: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Links of the partition's groups, as a spanning forest: fewer edges than rows, whatever the groups' sizes."""
    read = [b for b in batches if b.num_rows]
    if not read:
        return
    got = pa.Table.from_batches(read)
    columns = [got.column(i).to_numpy() for i in range(got.num_columns)]
    rep, fps = columns[0], np.stack([c.view(np.uint64) for c in columns[2:]], axis=1)
    _, group, size = np.unique(columns[1], return_inverse=True, return_counts=True)
    shared = size[group] > 1
    rep, fps, group = rep[shared], fps[shared], group[shared]
    if not len(rep):
        return
    nodes, of = np.unique(rep, return_inverse=True)
    parent = np.arange(len(nodes))
    index = GrayIndex(fps, group)
    x, y = index.neighbours(limit)  # joins most near copies, so that their groups need not be searched pair by pair
    unite(parent, of[x], of[y])
    while (parent[parent] != parent).any():
        parent = parent[parent]
    index.settle(parent[of])
    for x, y in index.links(limit):
        unite(parent, of[x], of[y])
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    if len(child):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[parent[child]])], names=["a", "b"])


def block_masks(blocks: int, equal: int, word: int = 0) -> list[tuple[int, int]]:
    """(word, mask) of each choice of `equal` out of `blocks` runs of bits of a 64-bit word."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    runs = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [(word, sum(c)) for c in combinations(runs, equal)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicate_components(docs: DataFrame, shingle: int = 3, limit: int = 2, words: int = 1, masks: list[tuple[int, int]] | None = None, doc_id: str = "doc_id", text: str = "text", rows_per_partition: int = 200_000) -> DataFrame:
    """(id, f0, ..., component) of each row: component is the smallest id reachable over links of at most `limit` bits.

    Equal fingerprints make one class first. The upper nodes of the index are masked bit patterns: a class stands under
    each of `masks` with the bits that it has there. If `equal` = blocks - limit (the default for one word: 3 of 5 blocks
    at 2 bits), every two fingerprints within the limit meet below one such node at least, so no link is lost. Below a
    node, fingerprints are in Gray order, and nodes of shared bits prune pairs of whole groups. A task emits a spanning
    forest, so large groups of near copies give few edges.

    Rows with a null text have fingerprint zero; a null id takes part through its fingerprint only, and its component
    is null if no row with an id has that fingerprint. Repeated rows stay; an empty table gives no rows. Columns other
    than the id and the text are not carried.
    """
    masks = masks or block_masks(limit + 3, 3)
    names = [f"f{k}" for k in range(words)]
    prints = durable(fingerprints(docs, shingle, words, doc_id, text))
    classes = durable(prints.groupBy(*names).agg(F.min("id").alias("rep")))
    n = classes.count()
    keyed = classes.where("rep IS NOT NULL").select("rep", *names, F.explode(F.array(*(F.xxhash64(F.lit(i), F.col(f"f{w}").bitwiseAND(F.lit(_signed(m)))) for i, (w, m) in enumerate(masks)))).alias("key"))
    parts = max(1, -(-n * len(masks) // rows_per_partition), min(64, n // 500))
    edges = keyed.select("rep", "key", *names).repartition(parts, "key").mapInArrow(lambda b: _forest(b, words, limit), "a long, b long")
    component = smallest_reachable(edges)
    labelled = classes.join(component, F.col("rep") == F.col("node"), "left").select(*(F.col(c).alias(f"_{c}") for c in names), F.coalesce("component", "rep").alias("component"))
    same = [F.col(c) == F.col(f"_{c}") for c in names]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return prints.join(labelled, condition).select("id", *names, "component")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: three-word shingles, links at 2 bits; cases as above."""
    found = near_duplicate_components(docs, doc_id=doc_id, text=text)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


#: For similarity: bits of a text's fingerprint, those of them that travel with every key, and how often a pair at the limit may be missed.
WIDE, CARRIED, MISSED = 1024, 192, 1e-4
#: Rows up to which a key has 16 bits; beyond, 24.
FEW = 1 << 28
#: Shingles of a block of texts that a task compares with another.
BLOCK = 500_000


def apart(similarity: float) -> float:
    """The share of fingerprint bits in which two sets of equal size and this Jaccard similarity differ: their angle over a half turn."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def wide_masks(similarity: float, texts: int) -> tuple[np.ndarray, int]:
    """(the bits of each mask, the limit of differing bits among those carried) for pairs of `similarity`.

    A mask is 16 or 24 random places of the fingerprint, so texts stand under a mask in nodes of the bits that they have
    there. There are as many masks as it takes for a pair to meet in none with a chance of MISSED; the limit is 4.6
    standard deviations above what such a pair differs by. Neither depends on the number of texts, but for the bits.
    """
    bits, p = 16 if texts <= FEW else 24, apart(similarity)
    meets = (1 - p) ** bits
    masks = int(np.ceil(np.log(MISSED) / np.log1p(-meets))) if meets < 1 else 1
    random = np.random.default_rng(SEED)
    places = np.stack([random.choice(WIDE, bits, replace=False) for _ in range(masks)])
    return places, min(CARRIED, int(CARRIED * p + 4.6 * np.sqrt(CARRIED * p * (1 - p))) + 1)


_WORDS: dict[bytes, int] = memory()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word; common words are remembered, until there are too many."""
    try:
        return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    except KeyError:
        if len(_WORDS) > REMEMBERED:
            _WORDS.clear()
        found = [_WORDS[w] if w in _WORDS else xxhash.xxh64_intdigest(w, SEED) for w in words]
        _WORDS.update((w, h) for w, h in zip(words, found, strict=True) if len(w) < 64)
        return np.array(found, dtype=np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The different word shingles of a text, as sorted 64-bit hashes; words as in shingle_hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = word_hashes(words)
    n = max(1, len(w) - shingle + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(min(shingle, len(w))):
        h = _mixed(h ^ w[k : k + n], k + 1)
    return np.unique(h)


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """WIDE bits for each set, as bytes: bit i of word k is set if it is in over half of the k-th mixed hashes."""
    turns = np.arange(WIDE // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    counts = np.zeros((len(sets), WIDE), dtype=np.int32)
    of = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    for at in range(0, len(every), 2048):
        x = every[at : at + 2048, None] + turns
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little")
        owner = of[at : at + 2048]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(owner)], strict=True):
            for c in range(a, b, 255):
                counts[owner[a]] += np.add.reduce(bits[c : min(b, c + 255)], axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little")


def _print_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    only(_WORDS)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [t or "" for t in part.column(2).to_pylist()]
            sets = [shingle_set(t, shingle) for t in texts]
            prints = wide_fingerprints(sets)
            words = [xxhash.xxh3_128_digest(b" ".join(t.encode().lower().split())) for t in texts]
            bits = [p.tobytes() if len(x) else None for p, x in zip(prints, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.binary()), pa.array(bits, pa.binary())], names=["id", "k", "words", "bits"])


KEYED = ", ".join(["rep long", "key long", *(f"f{k} long" for k in range(CARRIED // 64))])


def _key_batches(batches: Iterator[pa.RecordBatch], places: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each text and mask: the text, the node (mask and bits), and the carried words."""
    masks, names = len(places), [x.split()[0] for x in KEYED.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            prints = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint8).reshape(-1, WIDE // 8)
            chosen = np.unpackbits(prints, axis=1, bitorder="little")[:, places.reshape(-1)].reshape(len(prints), masks, -1)
            pattern = np.packbits(chosen, axis=2).astype(np.int64) @ (1 << 8 * np.arange(places.shape[1] // 8))
            key = pattern + (np.arange(masks, dtype=np.int64) << 32)
            carried = np.ascontiguousarray(prints[:, : CARRIED // 8]).view("<i8")
            columns = [np.repeat(part.column(0).to_numpy(), masks), key.reshape(-1), *(np.repeat(c, masks) for c in carried.T)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _set_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    only(_WORDS)
    for batch in batches:
        sets = [shingle_set(t, shingle).view(np.int64) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["node", "component", "shingles"])


def _similar(table: pa.Table, similarity: float) -> pa.Table:
    """The links between a group's rows that seek and those that do not, whose Jaccard similarity, counted from the sets, is at least `similarity`; as a forest."""
    table = table.combine_chunks()
    seeks = table.column("seeks").to_numpy(zero_copy_only=False)
    out = {"a": np.zeros(0, dtype=np.int64), "b": np.zeros(0, dtype=np.int64)}
    if not seeks.any() or seeks.all():
        return pa.table(out)
    mine, others = (table.filter(pa.array(s)).combine_chunks() for s in (seeks, ~seeks))
    sets, held = mine.column("shingles").combine_chunks(), others.column("shingles").combine_chunks()
    sizes, want = np.diff(held.offsets.to_numpy()), np.diff(sets.offsets.to_numpy())
    of, values = np.repeat(np.arange(len(sizes)), sizes), held.flatten().to_numpy()
    order = np.argsort(values, kind="stable")
    under, values = of[order], values[order]
    sought = sets.flatten().to_numpy()
    low, high = np.searchsorted(values, sought, side="left"), np.searchsorted(values, sought, side="right")
    names, other = mine.column("node").to_numpy(), others.column("node").to_numpy()
    nodes, at = np.unique(np.r_[names, other], return_inverse=True)
    parent, ends = np.arange(len(nodes)), np.cumsum(want)
    for x in range(len(names)):
        begin, n = low[ends[x] - want[x] : ends[x]], (high - low)[ends[x] - want[x] : ends[x]]
        places = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(under[places], minlength=len(sizes))
        near = np.flatnonzero(shared >= similarity * (want[x] + sizes - shared) - 1e-9)
        if len(near):
            unite(parent, np.full(len(near), at[x]), at[len(names) + near])
    while (parent[parent] != parent).any():
        parent = parent[parent]
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return pa.table({"a": nodes[child], "b": nodes[parent[child]]})


def verified(candidates: DataFrame, texts: DataFrame, shingle: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links of at least `similarity` that hold the components together which such links have within each candidate component.

    candidates: node, component (its smallest node), k. texts: k, text. Every text of a component is compared with its
    smallest one first, so a group of copies of one text, of any size, is done in one pass. The texts that this leaves
    open are compared with all of their component by the whole sets, in blocks of about `block` shingles.
    """
    n = candidates.count()
    wanted = broadcast_if_small(candidates.select("node", "component", F.col("k").alias("_k")), n)
    read = texts.join(wanted, F.col("k") == F.col("_k")).select("node", "component", "text")
    sets = durable(read.mapInArrow(lambda b: _set_batches(b, shingle), "node long, component long, shingles array<long>").dropDuplicates(["node"]))

    def blocks(of: DataFrame, name: str) -> DataFrame:
        """The components of several blocks: no more than there are blocks' worth of shingles."""
        counted = of.groupBy(F.col("component").alias("_component")).agg(F.ceil(F.sum(F.size("shingles")) / F.lit(block)).cast("int").alias(name)).where(f"{name} > 1")
        return broadcast_if_small(counted, counted.count())

    several = blocks(sets, "n")
    dealt = sets.join(several, F.col("component") == F.col("_component"), "left").select("node", "component", "shingles", F.coalesce("n", F.lit(1)).alias("n"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    first = dealt.where("node = component").select(F.col("component").alias("_first"), F.col("shingles").alias("_shingles"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("_mine"))
    met = dealt.join(first, (F.col("component") == F.col("_first")) & (F.col("mine") == F.col("_mine")))
    shared = F.size(F.array_intersect("shingles", "_shingles"))
    near = shared >= F.lit(similarity) * (F.size("shingles") + F.size("_shingles") - shared) - F.lit(1e-9)
    told = durable(met.select("node", "component", "shingles", "n", "mine", near.alias("near")))

    rest = told.where("NOT near")
    open_ = durable(rest.groupBy(F.col("component").alias("_component")).agg(F.ceil(F.sum(F.size("shingles")) / F.lit(block)).cast("int").alias("u")))
    each = told.join(broadcast_if_small(open_, open_.count()), F.col("component") == F.col("_component")).select("node", "component", "shingles", "n", "mine", "near", "u")
    held = each.select("node", "component", "shingles", F.lit(False).alias("seeks"), F.explode(F.sequence(F.lit(0), F.col("u") - 1)).alias("i"), F.col("mine").alias("j"))
    seek = each.where("NOT near").select("node", "component", "shingles", F.lit(True).alias("seeks"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("u")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    found = held.unionByName(seek).groupBy("component", "i", "j").applyInArrow(lambda t: _similar(t, similarity), "a long, b long")
    return told.where("near AND node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found)


def similar_classes(classes: DataFrame, texts: DataFrame, shingle: int, similarity: float, block: int = BLOCK, rows_per_partition: int = 200_000) -> DataFrame:
    """(node, component) of the nodes that have another of at least `similarity`: the smallest node reached over such links.

    classes: node, k, bits (fingerprints of WIDE bits, null for texts without words). texts: k, text. The upper nodes of
    the index are masked bit patterns, wide_masks says how many; below one, texts are in Gray order, and those that
    differ in few enough of the carried bits are candidates. Their sets of shingles decide.
    """
    n = classes.count()
    places, limit = wide_masks(similarity, n)
    words, parts = CARRIED // 64, max(1, -(-n * len(places) // rows_per_partition), min(64, n // 500))
    keyed = classes.where("bits IS NOT NULL").select("node", "bits").mapInArrow(lambda b: _key_batches(b, places), KEYED)
    met = keyed.repartition(parts, "key").mapInArrow(lambda b: _forest(b, words, limit), "a long, b long")
    candidates = smallest_reachable(met)
    named = classes.select(F.col("node").alias("_node"), "k").join(broadcast_if_small(candidates, candidates.count()), F.col("node") == F.col("_node"))
    return smallest_reachable(verified(durable(named.select("node", "component", "k")), texts, shingle, similarity, block))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """docs without near copies, with all columns: of each component of links, one row stays.

    Two texts are linked if the Jaccard similarity of their sets of word shingles is at least `similarity`. Their
    fingerprints, through the Gray-order index, choose which texts are compared; the sets themselves decide. Rows are
    told apart by id and text, so texts under one id are compared like any others, and rows with a null id too. The
    smallest id stays, a null id last; of different texts under it the one with the smallest digest, of rows that agree
    in both one. All texts without words (null, empty, white space) are copies of each other.
    """
    key = row_key(doc_id, text)
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), key.alias("k"), F.col(text).alias("text"))
    prints = durable(slim.mapInArrow(lambda b: _print_batches(b, shingle), "id long, k binary, words binary, bits binary"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "k")
    grouped = prints.groupBy("words").agg(F.min(order).alias("best"), F.first("bits").alias("bits"), F.count("*").alias("n"))
    classes = durable(grouped.withColumn("node", F.monotonically_increasing_id()))
    component = similar_classes(classes.select("node", F.col("best.k").alias("k"), "bits"), slim.select("k", "text"), shingle, similarity, block)
    linked = component.count()
    named = broadcast_if_small(component.withColumnRenamed("node", "_node"), linked)
    with_best = durable(classes.join(named, F.col("node") == F.col("_node")).select("words", "best", "component"))
    winners = with_best.groupBy(F.col("component").alias("_key")).agg(F.min("best").alias("stays"), F.count("*").alias("_n"))
    led = join_by_weight(with_best, winners, "component", linked).select(F.col("words").alias("_words"), F.col("stays.k").alias("leader"))
    # Classes that are alone keep their best row, the others that of their component.
    stays = classes.join(broadcast_if_small(led, linked), F.col("words") == F.col("_words"), "left").select(F.col("words").alias("_key"), F.coalesce("leader", "best.k").alias("stays"), F.col("n").alias("_n"))
    rows = prints.groupBy("k", "words").agg(F.count("*").alias("n"))
    told = join_by_weight(rows, stays, "words", prints.count())
    flags = durable(told.select(F.col("k").alias("_k"), (F.col("k") != F.col("stays")).alias("gone"), "n").where("gone OR n > 1").select("_k", "gone"))
    whole = docs.select(F.struct("*").alias("row"), key.alias("k"))  # names of docs' columns clash with none of ours
    marked = whole.join(broadcast_if_small(flags, flags.count()), F.col("k") == F.col("_k"), "left")
    several = marked.where("NOT gone").groupBy("k").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return marked.where("_k IS NULL").select("row.*").unionByName(several.select("row.*"))
