"""Exact removal of repeated passages: shard suffix arrays of the candidate passages, with permuted common prefixes.

A string of `width` bytes that two texts share holds the same smallest hash of a short gram at the same place. So texts are
cut at these grams: the runs of windows under one gram ("strips") of any text go to the shard that the gram's hash names, and
equal windows of different texts meet there. Only strips whose gram stands in two texts at least are sent.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.llm.common import durable, ensure_checkpoint_dir
from cellwise.llm.suffix_array import permuted_prefixes, suffix_array

GRAM = 16
#: For windows of WIDE bytes at least: unlike texts share few grams of this size, however many texts there are.
LONG_GRAM, WIDE = 24, 48
#: Odd factors and what is mixed in, for each word of a gram.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
MIXED = (0, 0x632BE59BD9B4E019, 0xE7037ED1A0B428DB)
TEXT_AT_ONCE = 1 << 18
#: Buckets of the table of classes at most; Spark allows 100,000. Shards and parts have no such bound.
MOST_BUCKETS = 50_000
#: Bytes that a strip takes, about.
STRIP = 80
#: Ids count as this if they are null: larger than any other.
NO_ID = (1 << 63) - 1


def gram_size(width: int) -> int:
    """Bytes of a gram, a multiple of 8."""
    return LONG_GRAM if width >= WIDE else GRAM


def window_minima(text: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` bytes the smallest hash of its grams."""
    gram = gram_size(width)
    n = len(text) - gram + 1
    words = np.ndarray((len(text) - 7,), dtype="<u8", buffer=text, strides=(1,))
    h = words[:n] * np.uint64(FACTORS[0])
    for k in range(1, gram // 8):
        h += (words[8 * k : 8 * k + n] ^ np.uint64(MIXED[k])) * np.uint64(FACTORS[k])
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    span, covered = width - gram + 1, 1
    while 2 * covered <= span:
        h = np.minimum(h[: len(h) - covered], h[covered:])
        covered *= 2
    rest = span - covered
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def strips(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window, windows, hash) of each run of windows under one gram."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    if total < width:
        return tuple(np.zeros(0, dtype=d) for d in (np.int64, np.int64, np.int64, np.uint64))
    minima = window_minima(np.frombuffer(b"".join(texts), dtype=np.uint8), width)
    of = np.repeat(np.arange(len(texts)), np.maximum(sizes - width + 1, 0))
    inside = np.arange(len(of)) - np.repeat(np.cumsum(np.maximum(sizes - width + 1, 0)) - np.maximum(sizes - width + 1, 0), np.maximum(sizes - width + 1, 0))
    value = minima[starts[of] + inside]
    first = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.zeros(0, dtype=np.int64)
    return of[first], inside[first], np.diff(np.r_[first, len(of)]), value[first]


def _some(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about TEXT_AT_ONCE bytes, each with the number of its first."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= TEXT_AT_ONCE):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def _blob(values: np.ndarray, dtype: str) -> bytes:
    return np.ascontiguousarray(values, dtype=dtype).tobytes()


def _joined(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def _split_by(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    first = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
    for at, end in zip(first, [*first[1:], len(order)], strict=True):
        yield int(part[order[at]]), order[at:end]


# 1. Equal texts become one class: first within a batch, then within the bucket that their digest names.


def _squeezed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _pieces(squeezed: bytes, sizes: np.ndarray) -> list[bytes]:
    """What was joined and squeezed, apart again."""
    data = pa.decompress(squeezed, int(sizes.sum()), codec="zstd", asbytes=True)
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [data[e - n : e] for e, n in zip(ends, sizes.tolist(), strict=True)]


#: The different texts of a batch that go to one bucket, squeezed together; how often each stands there, and the rows' ids.
PARCELS = "bucket long, texts binary, sizes binary, counts binary, ids binary"


def _batch_classes(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[bytes, list[int]] = {}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found.setdefault((text.as_py() or "").encode(), []).append(NO_ID if doc_id is None else doc_id)
        texts = list(found)
        digests = np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") % buckets for t in texts], dtype=np.int64)
        for bucket, at in _split_by(digests):
            own = [texts[i] for i in at.tolist()]
            ids = [found[t] for t in own]
            row = (bucket, _squeezed(b"".join(own)), _blob(np.array([len(t) for t in own]), "<u4"), _blob(np.array([len(i) for i in ids]), "<u4"), _blob(np.array([i for some in ids for i in some], dtype=np.int64), "<i8"))
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if k else pa.int64()) for k, v in enumerate(row)], names=[x.split()[0] for x in PARCELS.split(", ")])


CLASSES = "bucket long, class long, first long, text binary, ids binary"


def _bucket_classes(group: pa.Table) -> pa.Table:
    found: dict[bytes, list[np.ndarray]] = {}
    for row in group.to_pylist():
        counts = np.frombuffer(row["counts"], dtype="<u4")
        ids = np.split(np.frombuffer(row["ids"], dtype="<i8"), np.cumsum(counts)[:-1])
        for text, some in zip(_pieces(row["texts"], np.frombuffer(row["sizes"], dtype="<u4")), ids, strict=True):
            found.setdefault(text, []).append(some)
    bucket = group.column("bucket")[0].as_py()
    texts = sorted(found)
    ids = [np.sort(np.concatenate(found[t])) for t in texts]
    return pa.table([pa.array([bucket] * len(texts), pa.int64()), pa.array([(bucket << 32) + i for i in range(len(texts))], pa.int64()), pa.array([int(i[0]) for i in ids], pa.int64()), pa.array(texts, pa.binary()), pa.array([i.tobytes() for i in ids], pa.binary())], names=["bucket", "class", "first", "text", "ids"])


# 2. Hashes that stand in two classes at least. A bucket sends each of its hashes once, as 40 bits: the part that it goes to
# holds few enough of them that two rarely agree, and if they do, a strip too many is sent, no more.

SHORT = np.uint64((1 << 40) - 1)


def _short(value: np.ndarray, parts: int) -> np.ndarray:
    """40 bits of the hash that do not follow from the part."""
    return (value // np.uint64(parts)) & SHORT


def _blob40(value: np.ndarray) -> bytes:
    return np.ascontiguousarray(value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _joined40(column: pa.ChunkedArray) -> np.ndarray:
    five = _joined(column, "u1").reshape(-1, 5)
    wide = np.zeros((len(five), 8), dtype=np.uint8)
    wide[:, :5] = five
    return wide.view("<u8").reshape(-1)


def _lengths(column: pa.ChunkedArray, size: int) -> list[int]:
    return [len(x) // size for x in column.to_pylist()]


def _columns(rows: list[tuple], longs: int, names: list[str]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], pa.int64() if k < longs else pa.binary()) for k in range(len(names))], names=names)


#: Hashes that one class of the bucket has, and those that several have, with how many strips they name.
HASHES = "part long, bucket long, once binary, often binary, counts binary"
#: Hashes that two classes have at least; the crowded ones with the number of shards that share their windows.
SHARED = "part long, bucket long, hashes binary, crowded binary, splits binary"


def _names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _bucket_hashes(own: pa.Table, width: int, parts: int) -> pa.Table:
    found, rows = [], []
    for at, texts in _some(own.column("text").to_pylist()):
        of, _, _, value = strips(texts, width)
        found.append((at + of, value))
    of, value = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(value):
        order = np.argsort(value, kind="stable")
        value, of = value[order], of[order]
        first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        counts = np.diff(np.r_[first, len(value)])
        several = np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)
        value = value[first]
        bucket, short = own.column("bucket")[0].as_py(), _short(value, parts)
        for p, i in _split_by((value % np.uint64(parts)).astype(np.int64)):
            many = several[i]
            rows.append((p, bucket, _blob40(short[i[~many]]), _blob40(short[i[many]]), _blob(counts[i[many]], "<u4")))
    return _columns(rows, 2, _names_of(HASHES))


def _shared_hashes(group: pa.Table, crowd: int) -> pa.Table:
    buckets = group.column("bucket").to_numpy()
    once, often = _joined40(group.column("once")), _joined40(group.column("often"))
    value = np.concatenate((once, often))
    bucket = np.concatenate((np.repeat(buckets, _lengths(group.column("once"), 5)), np.repeat(buckets, _lengths(group.column("often"), 5))))
    counts = np.concatenate((np.ones(len(once), dtype=np.int64), _joined(group.column("counts"), "<u4").astype(np.int64)))
    order = np.argsort(value, kind="stable")
    value, bucket, counts = value[order], bucket[order], counts[order]
    rows: list[tuple] = []
    if len(value):
        first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        sizes, total = np.diff(np.r_[first, len(value)]), np.add.reduceat(counts, first)
        keep, split = np.repeat(total > 1, sizes), np.repeat(-(-total // crowd), sizes)
        value, bucket, split = value[keep], bucket[keep], split[keep]
        part = group.column("part")[0].as_py()
        for b, i in _split_by(bucket):
            full = split[i] > 1
            rows.append((part, b, _blob40(value[i[~full]]), _blob40(value[i[full]]), _blob(split[i[full]], "<u4")))
    return _columns(rows, 2, _names_of(SHARED))


# 3. The strips under these hashes, sent to the hashes' shards: each different string of a bucket once, with its places. The
# strips of a crowded hash are cut into their windows, and equal windows go to one of its shards.

STRIPS = ("shard", "bucket", "bytes", "sizes", "strings", "numbers", "starts", "known", "firsts")


def _keys(part: np.ndarray, short: np.ndarray) -> np.ndarray:
    """One number for part and hash. Two that agree by chance send a strip too many, no more."""
    x = short * np.uint64(0x9E3779B97F4A7C15) ^ part.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def _windows(texts: list[bytes], of: np.ndarray, first: np.ndarray, sizes: np.ndarray, value: np.ndarray, splits: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """The windows of strips as strips of their own: text, first, size and a hash in which the window has a say."""
    n = sizes - width + 1
    which = np.repeat(np.arange(len(of)), n)
    begin = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    own = np.array([zlib.crc32(texts[t][a : a + width]) for t, a in zip(of[which].tolist(), begin.tolist(), strict=True)], dtype=np.uint64)
    mixed = (value[which] ^ (own % splits[which].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    return of[which], begin, np.full(len(which), width, dtype=np.int64), mixed ^ (mixed >> np.uint64(32))


def _shared_strips(own: pa.Table, shared: pa.Table, width: int, parts: int) -> pa.Table:
    rows: list[tuple] = []
    if own.num_rows and shared.num_rows:
        bucket = own.column("bucket")[0].as_py()
        numbers, firsts, texts = own.column("class").to_numpy() & 0xFFFFFFFF, own.column("first").to_numpy(), own.column("text").to_pylist()
        part = shared.column("part").to_numpy()
        plain = _keys(np.repeat(part, _lengths(shared.column("hashes"), 5)), _joined40(shared.column("hashes")))
        full = _keys(np.repeat(part, _lengths(shared.column("crowded"), 5)), _joined40(shared.column("crowded")))
        split = np.concatenate((np.ones(len(plain), dtype=np.int64), _joined(shared.column("splits"), "<u4").astype(np.int64)))
        wanted, at = np.unique(np.concatenate((plain, full)), return_index=True)
        split = split[at]
        found = []
        for at, some in _some(texts):
            of, first, n, value = strips(some, width)
            key = _keys((value % np.uint64(parts)).astype(np.int64), _short(value, parts))
            place = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            hit = np.flatnonzero(wanted[place] == key)
            of, first, sizes, value, splits = of[hit], first[hit], n[hit] + width - 1, value[hit], split[place[hit]]
            crowded = splits > 1
            if crowded.any():
                cut = _windows(some, of[crowded], first[crowded], sizes[crowded], value[crowded], splits[crowded], width)
                of, first, sizes, value = (np.concatenate((x[~crowded], y)) for x, y in zip((of, first, sizes, value), cut, strict=True))
            found.append(((at + of).astype("<u4"), first.astype("<u4"), sizes.astype("<u4"), value))
        of, first, sizes, value = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        # Dealt out once for the bucket: shards are as many as its own share of all is small.
        for q, i in _split_by((value % np.uint64(parts)).astype(np.int64)):
            known: dict[bytes, int] = {}
            rows_of, starts = of[i], first[i]
            strings = np.array([known.setdefault(texts[t][a : a + z], len(known)) for t, a, z in zip(rows_of.tolist(), starts.tolist(), sizes[i].tolist(), strict=True)], dtype="<u4")
            present, which = np.unique(rows_of, return_inverse=True)
            lengths = np.fromiter(map(len, known), dtype="<u4", count=len(known))
            rows.append((q, bucket, _squeezed(b"".join(known)), lengths.tobytes(), strings.tobytes(), _blob(which, "<u4"), starts.tobytes(), _blob(numbers[present], "<u4"), _blob(firsts[present], "<i8")))
    return _columns(rows, 2, list(STRIPS))


# 4. A suffix array of each shard's different strips; windows that share `width` bytes with an earlier document's.


def repeated_windows(strings: list[bytes], firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest `firsts` among all windows equal to it, for each window of each string in order; windows of each string)."""
    sizes = np.array([len(x) for x in strings], dtype=np.int64)
    text = np.frombuffer(b"\x01".join(strings) + b"\x01" + bytes(width + 16), dtype=np.uint8)
    n = int(sizes.sum()) + len(strings)
    starts = np.cumsum(sizes + 1) - sizes - 1
    windows = sizes - width + 1
    of = np.repeat(np.arange(len(strings)), windows)
    place = np.repeat(starts, windows) + np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    # Symbols one up: zero is the sentinel's. A zero byte of a text stays below all others.
    order = suffix_array(np.r_[text[:n].astype(np.uint16) + 1, np.uint16(0)], 257)
    number = np.full(n + 1, -1, dtype=np.int64)
    number[place] = np.arange(len(place))
    ranked = order[number[order] >= 0]  # suffixes that begin a whole window
    shared, by_place = permuted_prefixes(text, ranked, width)
    common = np.empty(len(ranked), dtype=np.int64)
    common[by_place] = shared
    group = np.flatnonzero(common < width)
    least = np.minimum.reduceat(firsts[of[number[ranked]]], group)
    out = np.empty(len(place), dtype=np.int64)
    out[number[ranked]] = np.repeat(least, np.diff(np.r_[group, len(ranked)]))
    return out, windows


def _removed(group: pa.Table, width: int) -> pa.Table:
    seen: dict[bytes, int] = {}
    strings, classes, starts, firsts = [], [], [], []
    for row in group.to_pylist():
        numbers = [seen.setdefault(x, len(seen)) for x in _pieces(row["bytes"], np.frombuffer(row["sizes"], dtype="<u4"))]
        which = np.frombuffer(row["numbers"], dtype="<u4")
        strings.append(np.array(numbers)[np.frombuffer(row["strings"], dtype="<u4")])
        classes.append(np.frombuffer(row["known"], dtype="<u4").astype(np.int64)[which] + (row["bucket"] << 32))
        firsts.append(np.frombuffer(row["firsts"], dtype="<i8")[which])
        starts.append(np.frombuffer(row["starts"], dtype="<u4").astype(np.int64))
    of, classes, starts, firsts = (np.concatenate(x) for x in (strings, classes, starts, firsts))
    earliest = np.full(len(seen), NO_ID, dtype=np.int64)
    np.minimum.at(earliest, of, firsts)
    least, windows = repeated_windows(list(seen), earliest, width)
    base = np.cumsum(windows) - windows
    out = []
    for at in range(0, len(of), 1 << 17):  # occurrences
        o, own = of[at : at + (1 << 17)], firsts[at : at + (1 << 17)]
        occurrence = np.repeat(np.arange(len(o)), windows[o])
        inside = np.arange(len(occurrence)) - np.repeat(np.cumsum(windows[o]) - windows[o], windows[o])
        hit = least[base[o][occurrence] + inside] < own[occurrence]
        edge = np.r_[True, occurrence[1:] != occurrence[:-1]]
        begin = np.flatnonzero(hit & (edge | ~np.r_[False, hit[:-1]]))
        end = np.flatnonzero(hit & (np.r_[edge[1:], True] | ~np.r_[hit[1:], False]))
        who = at + occurrence[begin]
        out.append((classes[who], starts[who] + inside[begin], inside[end] - inside[begin] + width))
    cls, low, size = (np.concatenate(x) for x in zip(*out, strict=True))
    rows = [(b, _blob(cls[i] & 0xFFFFFFFF, "<u4"), _blob(low[i], "<u4"), _blob(size[i], "<u4")) for b, i in _split_by(cls >> 32)]
    return pa.table([pa.array([r[k] for r in rows], pa.binary() if k else pa.int64()) for k in range(4)], names=["bucket", "numbers", "lows", "sizes"])


# 5. What is left of each document.

REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _merged(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    first = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
    return list(zip(low[first].tolist(), high[np.r_[first[1:] - 1, len(high) - 1]].tolist(), strict=True))


def _kept(own: pa.Table, removed: pa.Table, width: int, texts_too: bool) -> pa.Table:
    cls, low, high = (_joined(removed.column(c), "<u4").astype(np.int64) for c in ("numbers", "lows", "sizes")) if removed.num_rows else (np.zeros(0, dtype=np.int64),) * 3
    high = low + high
    order = np.argsort(cls, kind="stable")
    cls, low, high = cls[order], low[order], high[order]
    out = []
    for c, first, text, ids in zip(*(own.column(x).to_pylist() for x in ("class", "first", "text", "ids")), strict=True) if own.num_rows else ():
        a, b = np.searchsorted(cls, [c & 0xFFFFFFFF, (c & 0xFFFFFFFF) + 1])
        spans = _merged(low[a:b], high[a:b]) if b > a else []
        kept = b"".join(text[x:y] for x, y in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)], strict=True))
        for doc_id in np.frombuffer(ids, dtype="<i8").tolist():
            # The same text in a smaller document covers all of it, if it is long enough.
            spans_of, kept_of = (spans, kept) if doc_id == first or len(text) < width else ([(0, len(text))], b"")
            row = (None if doc_id == NO_ID else doc_id, len(text), len(text) - len(kept_of), len(spans_of), hashlib.sha256(kept_of).hexdigest())
            out.append((*row, kept_of.decode("utf-8", "ignore")) if texts_too else row)
    names = [*(x.split()[0] for x in REPORT.split(", ")), *(["text"] if texts_too else [])]
    kinds = [pa.int64()] * 4 + [pa.string()] * (len(names) - 4)
    return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)


def remove_repeats(docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text", bytes_per_task: int = 8 << 20, texts: bool = False, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row: without each byte that a string of `width` bytes covers
    which also starts in a row with a smaller id. texts: also the text that is left (a character cut in two goes).

    Strings are judged on the input, as UTF-8 bytes; they never cross rows. A null text is empty. A null id counts as larger than
    all others; rows of equal ids take nothing from each other. An empty table gives no rows. Other columns are not carried.

    The classes of equal texts are written to the shared checkpoint folder once, as a table in buckets of about
    `bytes_per_task` (of more, once there are `most_buckets`), which is dropped when the result is in that folder. A task
    holds a bucket's texts or a shard's different strips; the windows of a gram whose strips alone would fill half a shard
    are dealt to several. Rows between buckets and shards are one for each pair that shares strips.
    """
    if width < GRAM:
        raise ValueError(f"width must be {GRAM} at least")
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-total // bytes_per_task))
    buckets, crowd = min(parts, most_buckets), max(1, bytes_per_task // (2 * STRIP))
    ensure_checkpoint_dir(spark)
    name = f"cellwise_classes_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"
    try:
        batched = slim.mapInArrow(lambda b: _batch_classes(b, buckets), PARCELS)
        # A table bucketed as the later steps need it: its texts are shuffled once, here.
        batched.groupBy("bucket").applyInArrow(_bucket_classes, CLASSES).write.bucketBy(buckets, "bucket").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        classes = spark.table(name)

        hashed = classes.select("bucket", "text").groupBy("bucket").applyInArrow(lambda t: _bucket_hashes(t, width, parts), HASHES)
        shared = hashed.groupBy("part").applyInArrow(lambda t: _shared_hashes(t, crowd), SHARED)
        sent = classes.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(lambda a, b: _shared_strips(a, b, width, parts), ", ".join(f"{c} {'long' if k < 2 else 'binary'}" for k, c in enumerate(STRIPS)))
        removed = sent.groupBy("shard").applyInArrow(lambda t: _removed(t, width), "bucket long, numbers binary, lows binary, sizes binary")
        return durable(classes.groupBy("bucket").cogroup(removed.groupBy("bucket")).applyInArrow(lambda a, b: _kept(a, b, width, texts), REPORT + (", text string" if texts else "")))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
