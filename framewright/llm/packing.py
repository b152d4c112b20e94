"""Hierarchical multi-length packing into context windows.

Documents are routed to tiers of context sizes: full windows of the longest size are cut off first, and what is left
goes to the smallest tier that holds it. Tiers are packed from the longest down; a window starts with a document
of its own tier, and its gap is filled from shorter tiers, nearest first, the last document
cut where the window is full. So every window is full. Windows of a tier then go to step groups of equal numbers of tokens, dealt
out by attention cost so that groups cost about the same.

Each task packs the rows it reads, in blocks, and carries what fills no window over to the
next block: no shuffle, bounded memory. A task's last tokens go to windows of halving sizes, powers of two down to 1.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from framewright.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_group long"


@dataclass(slots=True)
class Piece:
    doc: tuple  # (doc_id, ids as bytes, number of ids)
    start: int
    length: int


class Packer:
    """add documents, then take windows: lists of (size, pieces), each full."""

    def __init__(self, tiers: list[int]):
        self.tiers = sorted(tiers)
        if any(b != 2 * a for a, b in zip(self.tiers, self.tiers[1:])) or self.tiers[0] & (self.tiers[0] - 1):
            raise ValueError("tiers are successive powers of two")
        self.waiting: dict[int, deque[Piece]] = {t: deque() for t in self.tiers}
        self.tokens = dict.fromkeys(self.tiers, 0)
        self.windows: list[tuple[int, list[Piece]]] = []

    def add(self, doc: tuple) -> None:
        longest, at = self.tiers[-1], 0
        while doc[2] - at >= longest:
            self.windows.append((longest, [Piece(doc, at, longest)]))
            at += longest
        if doc[2] > at:
            self._route(Piece(doc, at, doc[2] - at))

    def _route(self, piece: Piece) -> None:
        tier = next(t for t in self.tiers if t >= piece.length)
        self.waiting[tier].append(piece)
        self.tokens[tier] += piece.length

    def _take(self, tier: int, most: int) -> Piece:
        """The tier's next piece, cut to most tokens; the rest of it is routed again."""
        piece = self.waiting[tier].popleft()
        self.tokens[tier] -= piece.length
        if piece.length > most:
            self._route(Piece(piece.doc, piece.start + most, piece.length - most))
            piece.length = most
        return piece

    def pack(self) -> list[tuple[int, list[Piece]]]:
        """All windows that can be filled now."""
        for k in range(len(self.tiers) - 1, -1, -1):
            self._pack_tier(k)
        out, self.windows = self.windows, []
        return out

    def _pack_tier(self, k: int) -> None:
        size, below = self.tiers[k], self.tiers[k::-1]
        while self.waiting[size] and sum(self.tokens[t] for t in below) >= size:
            pieces = [self._take(size, size)]
            gap = size - pieces[0].length
            while gap:
                tier = next(t for t in (*below[1:], size) if self.waiting[t])
                pieces.append(self._take(tier, gap))
                gap -= pieces[-1].length
            self.windows.append((size, pieces))

    def close(self) -> list[tuple[int, list[Piece]]]:
        """The last windows, of halving sizes."""
        out, left = self.pack(), deque(p for t in reversed(self.tiers) for p in self.waiting[t])
        total = sum(p.length for p in left)
        while total:
            size = min(self.tiers[-1], 1 << (total.bit_length() - 1))
            pieces, gap = [], size
            while gap:
                piece = left.popleft()
                if piece.length > gap:
                    left.appendleft(Piece(piece.doc, piece.start + gap, piece.length - gap))
                    piece.length = gap
                pieces.append(piece)
                gap -= piece.length
            out.append((size, pieces))
            total -= size
        return out


def step_groups(windows: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """A group number a window: groups hold windows of one size, at most step_tokens, of like attention cost (the sum
    of squared lengths): sorted by cost and dealt out to and fro."""
    out, first = [0] * len(windows), 0
    for size in sorted({s for s, _ in windows}):
        own = [i for i, (s, _) in enumerate(windows) if s == size]
        own.sort(key=lambda i: -sum(p.length * p.length for p in windows[i][1]))
        n = -(-len(own) * size // max(size, step_tokens))
        for at, i in enumerate(own):
            turn, place = divmod(at, n)
            out[i] = first + (place if turn % 2 == 0 else n - 1 - place)
        first += n
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str, tiers: list[int] = [512, 1024, 2048, 4096], end_id: int = 2, step_tokens: int = 16384,  # noqa: B006
    block_tokens: int = 1 << 20, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window (the sequence's size), step_group.

    A document's ids are those of its whole text and end_id; each is in exactly one piece, and every sequence is full. A null text counts
    as empty (just end_id). Repeated rows are packed once each, under their common id; a null doc_id stays null. An empty
    table gives an empty result. Other columns are not read.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        packer, base = Packer(tiers), TaskContext.get().partitionId() << 36
        sequence, group, waiting = base, base, 0

        def out(windows: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
            nonlocal sequence, group
            columns: list[list] = [[] for _ in range(9)]
            groups = step_groups(windows, step_tokens)
            for (size, pieces), number in zip(windows, groups):
                offset = 0
                for p in pieces:
                    found = (p.doc[0], p.start, p.length, zlib.crc32(p.doc[1][4 * p.start : 4 * (p.start + p.length)]), p.doc[2], sequence, offset, size, group + number)
                    for column, value in zip(columns, found):
                        column.append(value)
                    offset += p.length
                sequence += 1
            group += max(groups, default=-1) + 1
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for key, found in zip(ids, encode.ids(texts)):
                packer.add((key, found + end, len(found) // 4 + 1))
                waiting += len(found) // 4 + 1
                if waiting >= block_tokens:
                    yield out(packer.pack())
                    waiting = 0
        yield out(packer.close())

    return docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text").mapInArrow(pack, SCHEMA)
