"""Token ids of whole texts, with a bounded memory of words.

Both public vocabularies cut a text before a space that a visible character
follows, whatever stands around it, so a text's ids are the ids of those pieces
in order. Pieces recur, so each worker remembers the ids of the pieces it met lately;
only new pieces go through the tokenizers library. Most of these are plain words: their
cuts are known beforehand, so they go to the vocabulary's own model in the form that its pre-tokenizer would
give them, many at once and without offsets. Arrow and numpy number the pieces of a block and put ids together.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that are certainly visible: a space before any other one stays inside its piece.
_VISIBLE = "[!-~¡-˿Ͱ-ᙿᚁ-៿Ḁ-῿Ⰰ-ⷿぁ-퟿豈-﷏]"
_CUT = re.compile(f" (?={_VISIBLE})")
#: What the texts have that can't be cut at each space.
_ODD_TEXT = f" (?:[^{_VISIBLE[1:-1]}]|$)"
#: A word of letters whose small forms and composition stand alone, a few marks behind it, and perhaps such a pair on the next line: always cut apart.
_WORD, _MARKS = "[A-Za-zÀ-ÖØ-öø-įı-ƺЀ-ҁҊ-ԯ]+", r"[!-&(-/:-@\[-`{-~]{0,6}"
_PLAIN = rf"^(?P<word>{_WORD})(?P<mark>{_MARKS})(?:\n(?P<below>{_WORD})(?P<last>{_MARKS}))?$"
#: Pieces and bytes that a worker remembers at most; beyond, the half that was met least lately is forgotten, and pieces longer than _LONGEST.
_MOST, _BYTES, _LONGEST = 1_000_000, 100 << 20, 64
#: Bytes of text worked on at once.
_BLOCK = 8 << 20
#: Words given to the library as one string.
_JOINED = 128

_known: dict[str, "PieceEncoder"] = {}
#: Runs of ids within a flat array: the array, where each begins, and their sizes.
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


def _joined(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs one after the other."""
    at = np.repeat((begins - np.cumsum(sizes) + sizes).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at]


def _runs(parts: list[bytes]) -> Runs:
    sizes = np.array([len(p) // 4 for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes, sizes


class PieceEncoder:
    """ids(texts): for each text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.letters = _byte_letters()
        #: For each id, whether its token begins a word or line (byte-level) or ends a word (with a suffix for it).
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.edge = np.zeros(max(names.values(), default=0) + 1, bool)
        self.edge[[i for t, i in names.items() if (t.endswith(self.ends) if self.ends else t[0] == self.letters[32] or t == self.letters[10])]] = True
        # the same model without the work that a plain word doesn't need
        self.words = Tokenizer.from_file(path)
        self.words.normalizer, self.words.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        # the pieces remembered, their ids, and the round in which each was met last
        self.pieces, self.round = pa.array([], pa.large_string()), 0
        self.flat, self.begins, self.sizes, self.met = np.zeros(0, "<u4"), *(np.zeros(0, np.int64) for _ in range(3))

    def ids(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """texts: strings, nulls as empty."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        texts = pc.fill_null(texts, "")
        ends = pc.cumulative_sum(pc.binary_length(texts)).to_numpy()
        begin = 0
        while begin < len(texts):
            done = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + _BLOCK, "right")))
            yield from self._block(texts.slice(begin, end - begin))
            begin = end

    def _block(self, texts: pa.Array) -> Iterator[bytes]:
        odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD_TEXT).to_numpy(zero_copy_only=False))
        if not len(odd):
            yield from self._encoded(pc.split_pattern(texts, " "))
            return
        plain = pc.if_else(pa.array(np.isin(np.arange(len(texts)), odd)), "", texts)
        cut = [_CUT.split(t) for t in texts.take(pa.array(odd)).to_pylist()]
        irregular = dict(zip(odd.tolist(), self._encoded(pa.array(cut, pa.list_(pa.large_string())))))
        for k, found in enumerate(self._encoded(pc.split_pattern(plain, " "))):
            yield irregular.get(k, found)

    def _encoded(self, split: pa.ListArray) -> Iterator[bytes]:
        """The ids of texts given as lists of pieces; a text's first piece has no space before it, so it's encoded apart."""
        coded, starts = split.values.dictionary_encode(), split.offsets.to_numpy()
        codes = coded.indices.to_numpy()
        flat, begins, sizes = self._found(coded.dictionary)
        sizes = sizes[codes]
        sizes[starts[:-1]] = 0
        ids = _joined(flat, begins[codes], sizes)
        bounds = np.concatenate([[0], np.cumsum(sizes)])[starts].tolist()
        for first, a, b in zip(coded.dictionary.take(pa.array(codes[starts[:-1]])).to_pylist(), bounds[:-1], bounds[1:]):
            yield (self._alone(first) if first else b"") + ids[a:b].tobytes()

    def _found(self, pieces: pa.Array) -> Runs:
        """The ids of distinct pieces, each with the space before it; new ones are learned."""
        self.round += 1
        at = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(len(self.pieces), len(self.pieces) + len(new))
            learned = pieces.take(pa.array(new))
            flat, begins, sizes = self._learned(learned)
            self.pieces = pa.concat_arrays([self.pieces, learned])
            self.begins, self.sizes = np.concatenate([self.begins, len(self.flat) + begins]), np.concatenate([self.sizes, sizes])
            self.flat, self.met = np.concatenate([self.flat, flat]), np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.met[at] = self.round
        out = self.flat, self.begins[at], self.sizes[at]
        if len(self.pieces) > _MOST or self.pieces.nbytes + self.flat.nbytes > _BYTES:
            self._forget()
        return out

    def _forget(self) -> None:
        self.met[pc.binary_length(self.pieces).to_numpy() > _LONGEST] = 0
        kept = np.argsort(-self.met, kind="stable")[: len(self.pieces) // 2]
        kept = np.sort(kept[self.met[kept] > 0])
        self.pieces = self.pieces.take(pa.array(kept))
        self.flat, self.sizes, self.met = _joined(self.flat, self.begins[kept], self.sizes[kept]), self.sizes[kept], self.met[kept]
        self.begins = np.cumsum(self.sizes) - self.sizes

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learned(self, pieces: pa.Array) -> Runs:
        parts = pc.extract_regex(pieces, _PLAIN)
        is_plain = parts.is_valid().to_numpy(zero_copy_only=False)
        plain, others = np.flatnonzero(is_plain), np.flatnonzero(~is_plain)
        word, mark, below, last = parts.take(pa.array(plain)).flatten()
        line = "" if self.ends else "\n"
        groups = [(word, lambda new: self._learn_words(new, "")), (below, lambda new: self._learn_words(new, line)), (mark, self._learn_marks), (last, self._learn_marks)]
        flats, begins, sizes, total = [], np.zeros((len(plain), 4), np.int64), np.zeros((len(plain), 4), np.int64), 0
        for place, (column, learn) in zip((0, 2, 1, 3), groups):
            coded = column.dictionary_encode()
            codes, (flat, b, n) = coded.indices.to_numpy(), learn(coded.dictionary.to_pylist())
            begins[:, place], sizes[:, place] = total + b[codes], n[codes]
            flats.append(flat)
            total += len(flat)
        flat = _joined(np.concatenate(flats), begins.ravel(), sizes.ravel())
        rest, rest_begins, rest_sizes = self._learn_others(pieces.take(pa.array(others)).to_pylist())
        out_begins, out_sizes = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        out_sizes[plain], out_sizes[others] = sizes.sum(1), rest_sizes
        out_begins[plain], out_begins[others] = np.cumsum(sizes.sum(1)) - sizes.sum(1), len(flat) + rest_begins
        return np.concatenate([flat, rest]), out_begins, out_sizes

    def _learn_marks(self, marks: list[str]) -> Runs:
        return _runs([self._alone(m) if m else b"" for m in marks])

    def _learn_words(self, words: list[str], before: str) -> Runs:
        """Plain words, each with a space, or with the line break named in before, or nothing for an empty word. Tokens that begin (or end) words tell them apart."""
        letters, real = self.letters, [w for w in words if w]
        lead = "" if self.ends else letters[10] + " " if before else letters[32]
        shown = [lead + (w if w.isascii() else w.encode().decode("latin-1").translate(letters)) for w in (map(str.lower, real) if self.ends else real)]
        ids: list[int] = []
        for found in self.words.encode_batch_fast([" ".join(shown[at : at + _JOINED]) for at in range(0, len(shown), _JOINED)], add_special_tokens=False):
            ids += found.ids
        flat = np.array(ids, "<u4")
        edges = np.flatnonzero(self.edge[flat])
        if len(edges) != len(real):
            raise ValueError("the vocabulary doesn't tell words apart")
        cuts = np.concatenate([[0], edges + 1]) if self.ends else np.concatenate([edges, [len(flat)]])
        begins, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        own = np.array([bool(w) for w in words], bool)
        begins[own], sizes[own] = cuts[:-1], np.diff(cuts)
        return flat, begins, sizes

    def _learn_others(self, pieces: list[str]) -> Runs:
        """Any other pieces, each with the space before it, in joined strings: the tokens' offsets tell them apart.
        Those that end in white space go alone, as a token of nothing else has no certain offset."""
        found = [self._alone(" " + p) if not p or p[-1].isspace() else b"" for p in pieces]
        rest = [k for k, p in enumerate(pieces) if p and not p[-1].isspace()]
        for at in range(0, len(rest), 1024):
            part = rest[at : at + 1024]
            one = self.tokenizer.encode(" " + " ".join(pieces[k] for k in part), add_special_tokens=False)
            ids, starts = np.array(one.ids, "<u4").tobytes(), np.array([a for a, _ in one.offsets], np.int64)
            ends = np.searchsorted(starts, np.cumsum([len(pieces[k]) + 1 for k in part])) * 4
            begin = 0
            for k, end in zip(part, ends.tolist()):
                found[k] = ids[begin:end]
                begin = end
        return _runs(found)


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file; kept between tasks."""
    if path not in _known:
        _known[path] = PieceEncoder(path)
    return _known[path]
