"""Repeated byte strings across documents, by a common-prefix-aware merge sort of suffixes.

Removed is each byte covered by a WINDOW-byte string that also starts in a document with a smaller id.

Not every suffix is sorted. Each window has an anchor: its leftmost GRAM-byte string of least hash. Equal windows have equal anchors at equal
offsets, so only suffixes at anchors matter, about one in eighteen, with the bytes before them back to the first window.

The corpus is divided by a hash of the id into runs of bounded size, kept together in a table bucketed by run.
1. Each run reports the hashes of its anchors, sorted; hash ranges find those that occur in two documents or more.
2. Each run sorts its suffixes at such anchors (equal ones once, with the smallest id) and sends them,
   front-coded, in slices of one global order.
3. A slice's runs are merged by a loser tree that knows each string's common prefix with the last one out, and so
   never compares known prefixes again. The merged common prefixes give classes of equal right sides at each length, those of the sorted
   left sides likewise; windows equal on both sides are equal, and those with a smaller id elsewhere are reported to their runs.
4. Each run removes what its reported windows cover.
A string in a third of all documents is one suffix a run from step 2 on. An anchor string that takes up several slices with its many
continuations is divided: its windows go, each with its offset, to slices by a hash of the window, and are compared as they are.

A run reports to parts, each of several hash ranges or slices, which a part's task works on one after the other: rows of an exchange are runs times parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import free_name, fresh_path, fresh_table, written

WINDOW, GRAM = 50, 16
#: Places an anchor can have in a window.
SPAN = WINDOW - GRAM + 1
#: Bytes of text in a run, about, and bytes worked on at once.
RUN_BYTES, BLOCK = 6 << 20, 1 << 20
#: Bits of the anchors' hashes.
HASH_BITS = 48
#: Documents that slice bounds are estimated from, at least, and one a run: they balance slices, results don't depend on them.
SPLIT_DOCS = 2000
#: Hash ranges or slices of a part, at most; there are at least so many parts before a part has several.
RANGES, PARTS = 8, 256
#: Slices that an anchor string takes up before it is divided.
HOT_SLICES = 4
_NO_ID = np.iinfo(np.int64).max
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _blocks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about BLOCK bytes together."""
    begin, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        size += n
        if size >= BLOCK:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(lengths):
        yield begin, len(lengths)


def block_anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents joined in data: anchors' places, first and last windows that have them, and hashes."""
    empty = np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= WINDOW
    if not long.any():
        return empty, empty, empty, np.zeros(0, np.uint64)
    h = data.astype(np.uint64) + np.uint64(1)
    for level, step in enumerate((1, 2, 4, 8)):
        h = h[:-step] * _MIX[level] + h[step:]
    h ^= h >> np.uint64(29)
    h *= _MIX[4]
    h >>= np.uint64(64 - HASH_BITS)
    low, off, covered = h, np.zeros(len(h), np.uint8), 1
    while covered < SPAN:
        step = min(covered, SPAN - covered)
        later = low[step:] < low[:-step]
        off = np.where(later, off[step:] + np.uint8(step), off[:-step])
        low = np.minimum(low[:-step], low[step:])
        covered += step
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - WINDOW + 1, -1)
    windows = np.flatnonzero(inside.cumsum() > 0)
    at = windows + off[windows]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    return at[new], windows[new], windows[last], h[at[new]]


class _Run:
    """The documents of a run in canonical order, and its anchors over them all."""

    def __init__(self, table: pa.Table, anchors: bool = True):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in table.column("__text").to_pylist()]
        ids = [_NO_ID if i is None else i for i in table.column("__id").to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.ids = np.array([ids[k] for k in self.order], np.int64)
        self.texts = [texts[k] for k in self.order]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.ends = self.lengths.cumsum()
        if anchors:
            self.data = np.frombuffer(b"".join(self.texts), np.uint8)
            parts = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]]
            for a, b in _blocks(self.lengths):
                begin = int(self.ends[a - 1]) if a else 0
                at, first, last, h = block_anchors(self.data[begin : int(self.ends[b - 1])], self.ends[a:b] - begin)
                parts.append([at + begin, first + begin, last + begin, h])
            self.at, self.first, self.last, self.hash = (np.concatenate(c) for c in zip(*parts))
            self.doc = np.searchsorted(self.ends, self.at, "right")


def _pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers as differences of as many bytes as the largest needs."""
    gaps = np.diff(values, prepend=np.uint64(0))
    width = max(1, -(-int(gaps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack_sorted(data: bytes) -> np.ndarray:
    width, body = data[0], np.frombuffer(data, np.uint8, offset=1)
    full = np.zeros((len(body) // width, 8), np.uint8)
    full[:, :width] = body.reshape(width, -1).T
    return full.view("<u8").ravel().astype(np.uint64).cumsum(dtype=np.uint64)


def merge_runs(runs: list[list[bytes]], known: list[list[int]]) -> tuple[list[int], list[int]]:
    """Merges sorted runs with a loser tree. known: each string's common prefix with the one before it in its run.
    Returns the run of each string in merged order, and its common prefix with the string before it there.

    A node keeps the loser of its match and how long a prefix it shares with the match's winner, which is the last string out
    when the match is played again: of two candidates the one that shares more with it is smaller, and only if both share the same are bytes
    compared, from there on.
    """
    width = 1 << max(0, (len(runs) - 1).bit_length())
    heads: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (width - len(runs))
    nexts, shared = [1] * width, [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """The winner and the loser among runs that share as much with the last string out."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        k = shared[a]
        if x == y:
            shared[max(a, b)] = len(x)
            return (a, b) if a < b else (b, a)
        most = min(len(x), len(y))
        while k < most and x[k] == y[k]:
            k += 1
        winner, loser = (a, b) if k == len(x) or (k < len(y) and x[k] < y[k]) else (b, a)
        shared[loser] = k
        return winner, loser

    losers, level = [0] * width, list(range(width))
    node = width
    while len(level) > 1:
        node //= 2
        following = []
        for i in range(0, len(level), 2):
            winner, losers[node + i // 2] = play(level[i], level[i + 1])
            following.append(winner)
        level = following
    champion, order, prefixes = level[0], [], []
    while heads[champion] is not None:
        order.append(champion)
        prefixes.append(shared[champion])
        i, run = nexts[champion], runs[champion]
        if i < len(run):
            heads[champion], shared[champion], nexts[champion] = run[i], known[champion][i], i + 1
        else:
            heads[champion], shared[champion] = None, -1
        node = (champion + width) >> 1
        while node:
            rival = losers[node]
            if shared[rival] > shared[champion]:
                losers[node], champion = champion, rival
            elif shared[rival] == shared[champion]:
                champion, losers[node] = play(champion, rival)
            node >>= 1
    return order, prefixes


def _prefixes(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row of bytes with the row before."""
    if not len(rows):
        return np.zeros(0, np.int64)
    same = rows[1:] == rows[:-1]
    found = np.where(same.all(1), rows.shape[1], same.argmin(1))
    return np.concatenate([[0], found])


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... length[i] of them, for all i."""
    total = np.concatenate([[0], length.cumsum()])
    return np.arange(total[-1]) - np.repeat(total[:-1] - begin, length)


def _range_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of n ranges of hashes each is in."""
    if n <= 1 << 15:
        return (hashes * np.uint64(n) >> np.uint64(HASH_BITS)).astype(np.int64)
    return ((hashes >> np.uint64(24)) * np.uint64(n) >> np.uint64(HASH_BITS - 24)).astype(np.int64)


def _bundle(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([a.nbytes for a in arrays], "<i8").tobytes(), *(a.tobytes() for a in arrays)])


def _unbundle(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, "<i8", len(kinds)).tolist(), 8 * len(kinds), []
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


_NOTE = ("<i4", "<i4", "u1", "u1", "u1", "u1", "<i4", "u1")


def _send(run: _Run, repeated: np.ndarray, splits: np.ndarray, hot: np.ndarray, n_slices: int) -> tuple[list[tuple[int, bytes]], bytes]:
    """A run's front-coded suffixes by slice (those of hot anchors as windows, by slices from n_slices on), and its own note of which anchor has which suffix."""
    chosen = np.flatnonzero(repeated)
    at, first, last, doc = run.at[chosen], run.first[chosen], run.last[chosen], run.doc[chosen]
    right, left = last + WINDOW - at, at - first
    rows = np.zeros((len(chosen), WINDOW + 1 + SPAN), np.uint8)
    rows[np.repeat(np.arange(len(at)), right), _ranges(np.zeros_like(right), right)] = run.data[_ranges(at, right)]
    rows[:, WINDOW] = right
    rows[np.repeat(np.arange(len(at)), left), WINDOW + left.repeat(left) - _ranges(np.zeros_like(left), left)] = run.data[_ranges(first, left)]
    rows[:, -1] = left + 1
    keys = rows.view(f"S{rows.shape[1]}").ravel()
    order = np.lexsort((run.ids[doc], keys))
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    number = np.zeros(len(at), np.int64)
    number[order] = new.cumsum() - 1
    distinct, ids = rows[order[new]], run.ids[doc[order[new]]]
    head = np.ascontiguousarray(distinct[:, :GRAM]).view(f"S{GRAM}").ravel()
    divided = np.isin(head, hot) if len(hot) else np.zeros(len(head), bool)
    out, pack = [], zstandard.ZstdCompressor(level=3)
    cold, cold_ids, head = distinct[~divided], ids[~divided], head[~divided]
    bounds = np.concatenate([[0], np.searchsorted(head, splits), [len(head)]])
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        part, own = cold[bounds[k] : bounds[k + 1]], cold_ids[bounds[k] : bounds[k + 1]]
        size = part[:, WINDOW].astype(np.int64)
        prefix = np.minimum(_prefixes(part[:, :WINDOW]), np.minimum(size, np.concatenate([[0], size[:-1]])))
        columns = np.arange(WINDOW)
        tails = part[:, :WINDOW][(columns >= prefix[:, None]) & (columns < size[:, None])]
        before = part[:, -1].astype(np.int64) - 1
        lefts = part[:, WINDOW + 1 : -1][np.arange(SPAN - 1) < before[:, None]]
        blob = np.array([len(part), len(tails)], "<i4").tobytes() + prefix.astype(np.uint8).tobytes() + part[:, WINDOW].tobytes() + before.astype(np.uint8).tobytes() + own.astype("<i8").tobytes() + tails.tobytes() + lefts.tobytes()
        out.append((k, pack.compress(blob)))
    who, offsets, windows = _windows(distinct, np.flatnonzero(divided))
    spot = n_slices + (_window_hashes(windows) % np.uint64(n_slices)).astype(np.int64)
    order = np.argsort(spot, kind="stable")
    who, offsets, windows, spot = who[order], offsets[order], windows[order], spot[order]
    bounds = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1], [True]])) if len(spot) else np.zeros(1, np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        out.append((int(spot[a]), pack.compress(_bundle(windows[a:b], ids[who[a:b]].astype("<i8")))))
    note = _bundle(at.astype("<i4"), number.astype("<i4"), (run.ids[doc] > ids[number]).astype("u1"), left.astype("u1"), right.astype("u1"), divided.astype("u1"), who.astype("<i4"), offsets.astype("u1"))
    return out, note


def _windows(distinct: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the chosen suffixes: the suffix, the anchor's offset in the window, and the window's bytes."""
    who, offsets, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, WINDOW), np.uint8)]
    right, before = distinct[:, WINDOW].astype(np.int64), distinct[:, -1].astype(np.int64) - 1
    for offset in range(SPAN):
        own = chosen[(before[chosen] >= offset) & (right[chosen] >= WINDOW - offset)]
        who.append(own)
        offsets.append(np.full(len(own), offset))
        windows.append(np.concatenate([distinct[own, WINDOW + 1 : WINDOW + 1 + offset][:, ::-1], distinct[own, : WINDOW - offset]], 1))
    return np.concatenate(who), np.concatenate(offsets), np.ascontiguousarray(np.concatenate(windows))


def _window_hashes(windows: np.ndarray) -> np.ndarray:
    h = np.full(len(windows), 7, np.uint64)
    for k in range(windows.shape[1]):
        h = (h + windows[:, k] + np.uint64(1)) * _MIX[0]
        h ^= h >> np.uint64(29)
    return h


def _compare_windows(blobs: list[bytes]) -> list[np.ndarray]:
    """For each run's windows of a slice: whether the same one has a smaller id elsewhere."""
    parts = [_unbundle(zstandard.decompress(b), "u1", "<i8") for b in blobs]
    windows = np.concatenate([w for w, _ in parts]).reshape(-1, WINDOW)
    ids, ends = np.concatenate([i for _, i in parts]), np.cumsum([len(i) for _, i in parts])
    keys = windows.view(f"V{WINDOW}").ravel()
    _, same = np.unique(keys, return_inverse=True)
    least = np.full(int(same.max(initial=-1)) + 1, _NO_ID)
    np.minimum.at(least, same, ids)
    return np.split((ids > least[same]).astype(np.uint64), ends[:-1])


def _receive(blob: bytes) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes, their known prefixes, lengths right and left, ids, and left sides (nearest byte first, filled with 0)."""
    blob = zstandard.decompress(blob)
    n, tail = np.frombuffer(blob, "<i4", 2)
    at = 8
    prefix, right, before = (np.frombuffer(blob, np.uint8, n, at + k * n) for k in range(3))
    ids = np.frombuffer(blob, "<i8", n, at + 3 * n)
    at += 11 * n
    tails = blob[at : at + tail]
    texts, last, begin = [], b"", 0
    for p, r in zip(prefix.tolist(), right.tolist()):
        last = last[:p] + tails[begin : begin + r - p]
        begin += r - p
        texts.append(last)
    lefts = np.zeros((n, SPAN - 1), np.uint8)
    lefts[np.arange(SPAN - 1) < before[:, None]] = np.frombuffer(blob, np.uint8, offset=at + int(tail))
    return texts, prefix.tolist(), right.astype(np.int64), before.astype(np.int64), ids, lefts


def _compare(blobs: list[bytes]) -> list[np.ndarray]:
    """For each run's suffixes of a slice: a bit for each window offset whose window has a smaller id elsewhere."""
    runs = [_receive(b) for b in blobs]
    order, prefixes = merge_runs([r[0] for r in runs], [r[1] for r in runs])
    order, prefixes = np.array(order), np.array(prefixes)
    begins = np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])])
    inner = np.argsort(order, kind="stable")  # merged places, run by run in each run's order
    right, before, ids = (np.concatenate([r[k] for r in runs]) for k in (2, 3, 4))
    lefts = np.concatenate([r[5] for r in runs])
    n = len(ids)
    by_left = np.argsort(lefts.view(f"S{SPAN - 1}").ravel(), kind="stable")
    left_prefix = _prefixes(lefts[by_left])
    found = np.zeros(n, np.uint64)
    for offset in range(SPAN):
        rows = np.flatnonzero((before >= offset) & (right >= WINDOW - offset))
        if not len(rows):
            continue
        right_class = (prefixes < WINDOW - offset).cumsum()[inner[rows]]
        left_class = np.empty(n, np.int64)
        left_class[by_left] = (left_prefix < offset).cumsum()
        key = right_class * (n + 1) + left_class[rows]
        by_key = np.lexsort((ids[rows], key))
        key, own = key[by_key], ids[rows][by_key]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        least = own[np.flatnonzero(first)][first.cumsum() - 1]
        found[rows[by_key[own > least]]] |= np.uint64(1 << offset)
    return [found[a:b] for a, b in zip(begins[:-1], begins[1:])]


def _covered(run: _Run, note: bytes, by_slice: dict[int, np.ndarray], n_slices: int) -> np.ndarray:
    """A mask over the run's bytes."""
    change = np.zeros(int(run.lengths.sum()) + 1, np.int32)
    if note:
        at, number, later, left, right, divided, who, offsets = _unbundle(note, *_NOTE)
        bits = np.zeros(len(divided), np.uint64)
        bits[divided == 0] = np.concatenate([np.zeros(0, np.uint64), *(by_slice[k] for k in sorted(by_slice) if k < n_slices)])
        hit = np.concatenate([np.zeros(0, np.uint64), *(by_slice[k] for k in sorted(by_slice) if k >= n_slices)])
        np.bitwise_or.at(bits, who, hit << offsets.astype(np.uint64))
        at, bits = at.astype(np.int64), bits[number]
        for offset in range(SPAN):
            gone = (left >= offset) & (right >= WINDOW - offset) & ((bits >> np.uint64(offset) & np.uint64(1) > 0) | (later > 0))
            np.add.at(change, at[gone] - offset, 1)
            np.add.at(change, at[gone] - offset + WINDOW, -1)
    return change.cumsum()[:-1] > 0


def _whole_characters(text: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """gone, and the other bytes of each character that it cuts apart."""
    character = ((text & 0xC0) != 0x80).cumsum()
    return (np.bincount(character[gone], minlength=int(character[-1]) + 1) > 0)[character]


def _kept(docs: DataFrame, rest: str, doc_id: str, text: str, characters: bool = False) -> DataFrame:
    """rest (a struct of a row, or null), doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes; with characters, only whole ones)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"), F.expr(rest).alias("__row"))
    size, n_docs = rows.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0)), F.count(F.lit(1))).first()
    n_runs = max(1, math.ceil(size / RUN_BYTES))
    # one file a bucket; a run is never split, and needs no further shuffle
    buckets = min(n_runs, 50_000)
    name, path = fresh_table("suffix_runs"), fresh_path(spark, "suffix-runs")
    ranges = max(1, min(RANGES, n_runs // PARTS))
    rows = rows.withColumn("__run", F.pmod(F.xxhash64("__id", F.octet_length("__text")), F.lit(n_runs)).cast("int"))
    rows.repartition(buckets, "__run").write.bucketBy(buckets, "__run").option("path", path).saveAsTable(name)
    rows = spark.table(name)
    texts = rows.select("__run", "__id", "__text")

    def hashes(key: tuple, table: pa.Table) -> pa.Table:
        run = _Run(table)
        order = np.lexsort((run.ids[run.doc], run.hash))
        value, own = run.hash[order], run.ids[run.doc[order]]
        new = np.concatenate([[True], value[1:] != value[:-1]])[: len(value)]
        several = np.zeros(int(new.sum()), bool)
        if len(value):
            begin = np.flatnonzero(new)
            several = own[begin] < own[np.concatenate([begin[1:], [len(own)]]) - 1]
        distinct = value[new]
        part = _range_of(distinct, n_runs) // ranges
        bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(0, np.int64)
        pairs = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        return pa.table({
            "part": pa.array([int(part[a]) for a, _ in pairs], pa.int32()), "run": pa.array([key[0].as_py()] * len(pairs), pa.int32()),
            "hashes": pa.array([_pack_sorted(distinct[a:b]) for a, b in pairs], pa.binary()), "several": pa.array([np.packbits(several[a:b]).tobytes() for a, b in pairs], pa.binary()),
        })

    def shared(table: pa.Table) -> pa.Table:
        values = [_unpack_sorted(x) for x in table.column("hashes").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)) for x, v in zip(table.column("several").to_pylist(), values)]
        begins = [_range_of(v, n_runs) for v in values]
        masks = [np.zeros(len(v), bool) for v in values]
        for k in range(min(int(b[0]) for b in begins), max(int(b[-1]) for b in begins) + 1):
            cuts = [slice(*np.searchsorted(b, [k, k + 1]).tolist()) for b in begins]
            _, number, count = np.unique(np.concatenate([v[c] for v, c in zip(values, cuts)]), return_inverse=True, return_counts=True)
            more = count > 1
            more[number[np.concatenate([x[c] for x, c in zip(several, cuts)]) > 0]] = True
            ends = np.cumsum([c.stop - c.start for c in cuts])
            for mask, cut, found in zip(masks, cuts, np.split(more[number], ends[:-1])):
                mask[cut] = found
        return pa.table({"run": table.column("run"), "part": table.column("part"), "n": pa.array([len(v) for v in values], pa.int32()), "mask": pa.array([np.packbits(m).tobytes() for m in masks], pa.binary())})

    hashed = texts.groupBy("__run").applyInArrow(hashes, "part int, run int, hashes binary, several binary")
    masks = written(hashed.groupBy("part").applyInArrow(shared, "run int, part int, n int, mask binary"), "suffix-masks")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(0)]
            found = [t[k : k + GRAM] for t in whole for k in range(0, len(t) - WINDOW, 1 + len(t) // 32)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["head"])

    # equal windows have GRAM bytes from their anchor on in common, so bounds of so many bytes keep them in one slice
    some = docs.sample(fraction=min(1.0, max(SPLIT_DOCS, n_runs) / max(1, n_docs)), seed=11).select(F.col(text))
    heads = np.sort(np.array(some.mapInArrow(prefixes, "head binary").toPandas()["head"].map(bytes).tolist(), f"S{GRAM}"))
    splits = heads[np.linspace(0, len(heads), n_runs + 1)[1:-1].astype(int)] if len(heads) else heads
    grams, times = np.unique(splits, return_counts=True)
    hot, splits = grams[times >= HOT_SLICES], grams
    data_schema = "run int, part int, slices array<int>, data array<binary>"

    def by_part(run: int, found: list[tuple[int, bytes]], note: list[tuple[int, int, bytes]]) -> pa.Table:
        parts: dict[int, list[tuple[int, bytes]]] = {}
        for k, blob in found:
            parts.setdefault(k // ranges, []).append((k, blob))
        listed = [(part, *map(list, zip(*held))) for part, held in parts.items()] + [(part, [k], [blob]) for part, k, blob in note]
        kinds = {"run": pa.int32(), "part": pa.int32(), "slices": pa.list_(pa.int32()), "data": pa.list_(pa.binary())}
        columns = [[run] * len(listed), *(list(c) for c in zip(*listed))] if listed else [[]] * 4
        return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), columns)})

    def send(key: tuple, table: pa.Table, marks: pa.Table) -> pa.Table:
        run = _Run(table)
        marks = sorted(marks.to_pylist(), key=lambda r: r["part"])
        more = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=r["n"]) for r in marks)]).astype(bool)
        distinct, number = np.unique(run.hash, return_inverse=True)
        out, note = _send(run, more[number] if len(distinct) else np.zeros(0, bool), splits, hot, n_runs)
        return by_part(key[0].as_py(), out, [(-1, -1, note)])

    sent = texts.groupBy("__run").cogroup(masks.groupBy("run")).applyInArrow(send, data_schema)
    sent = written(sent, "suffix-slices")

    def compare(table: pa.Table) -> pa.Table:
        runs, held, pack = table.column("run").to_pylist(), {}, zstandard.ZstdCompressor(level=3)
        for run, names, blobs in zip(runs, table.column("slices").to_pylist(), table.column("data").to_pylist()):
            for k, blob in zip(names, blobs):
                held.setdefault(k, []).append((run, blob))
        out: dict[int, list[tuple[int, bytes]]] = {run: [] for run in runs}
        for k in sorted(held):
            own = held.pop(k)
            found = (_compare if k < n_runs else _compare_windows)([blob for _, blob in own])
            for (run, _), bits in zip(own, found):
                out[run].append((k, pack.compress(bits.astype("<u8").tobytes())))
        return pa.concat_tables([by_part(run, found, []) for run, found in out.items()])

    found = sent.where("part >= 0").groupBy("part").applyInArrow(compare, data_schema)
    notes = sent.where("part < 0").unionByName(found)
    out_schema = rows.select(F.col("__row"), F.col("__id").alias("doc_id")).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")

    def remove(table: pa.Table, notes: pa.Table) -> pa.Table:
        run = _Run(table, anchors=False)
        if not len(run.texts):
            table = table.slice(0, 0)
        by_slice = {k: data for r in notes.to_pylist() for k, data in zip(r["slices"], r["data"])}
        note = by_slice.pop(-1, b"")
        gone = _covered(run, note, {k: np.frombuffer(zstandard.decompress(x), "<u8") for k, x in by_slice.items()}, n_runs)
        removed, spans, kept, end = [], [], [], 0
        for t, n in zip(run.texts, run.lengths.tolist()):
            own = gone[end : end + n]
            end += n
            many = int(own.sum())
            removed.append(many)
            spans.append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if many else 0)
            if many:
                raw = np.frombuffer(t, np.uint8)
                t = raw[~(_whole_characters(raw, own) if characters else own)].tobytes()
            kept.append(t)
        ordered = table.take(pa.array(run.order, pa.int64()))
        return pa.table({"__row": ordered.column("__row"), "doc_id": ordered.column("__id"), "n_bytes": pa.array(run.lengths), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return rows.groupBy("__run").cogroup(notes.groupBy("run")).applyInArrow(remove, out_schema)


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text counts as empty. Rows of equal id are one document: they don't remove each other's bytes. A null id counts as larger than all others. An
    empty table gives an empty result. Other columns aren't read.
    """
    out = _kept(docs, "cast(null as int)", doc_id, text)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with the repeated bytes gone from text (and n_chars, where there is one, counted anew). Bytes of a
    character that is cut apart go with it. A null text stays null."""
    names = docs.columns
    flag, whole = free_name("__text_is_null", names), free_name("__text", names)
    row = "struct(" + ", ".join(f"`{c}`" for c in names if c != "text") + f", text is null as `{flag}`)"
    out = _kept(docs, row, "doc_id", "text", characters=True)
    kept = F.when(F.col(f"__row.`{flag}`"), F.lit(None).cast("string")).otherwise(F.col("kept").cast("string"))
    out = out.withColumn(whole, kept)
    return out.select(*[F.col(whole).alias(c) if c == "text" else F.length(whole).cast("long").alias(c) if c == "n_chars" else F.col(f"__row.`{c}`").alias(c) for c in names])


