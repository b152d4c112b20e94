"""Packing and token files: every id once, and exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from framewright.llm.packing import pack_documents
from framewright.llm.tokens import PieceEncoder
from framewright.llm.wavelet import WaveletMatrix, find_token, read_documents, write_token_shards
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def whole(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_ids_of_whole_texts(name):
    encoder, tokenizer = PieceEncoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(st.sampled_from(list("ab éÉİıŉЖж́'stS1,.!\n\t  \x0b\x1c\u0085 　漢😀<|>#ẞΣς")), max_size=30), max_size=4))
    def check(texts):
        for text, found in zip(texts, encoder.ids(texts), strict=True):
            assert found == whole(tokenizer, text)[:-1].tobytes()

    check()


def test_packing_covers_every_id_once(table, odd_rows):
    path = public_tokenizers.path(FILES[0])
    tokenizer, docs = Tokenizer.from_file(path), [r for r in odd_rows if r != odd_rows[7]]  # ids with one text each
    docs = [(k, t, s) for k, (_, t, s) in enumerate(docs)] + [(None, "no id", "a")]
    pieces = pack_documents(table(docs), path, block_tokens=3000).collect()
    own, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        own[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for key, text, _ in docs:
        ids, at = whole(tokenizer, text), 0
        for p in sorted(own[key], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == ps[0].window and at & (at - 1) == 0 and at <= 4096
    groups = defaultdict(set)
    for p in pieces:
        groups[p.step_group].add((p.sequence_id, p.window))
    assert all(sum(w for _, w in g) <= 16384 and len({w for _, w in g}) == 1 for g in groups.values())
    assert pack_documents(table([]), path).collect() == []


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 50, 3000).astype(np.uint32)
    m = WaveletMatrix.of(ids, 16)
    assert (m.decoded() == ids).all()
    for at in (0, 1, 511, 512, 513, 2999):
        assert m.access(at) == ids[at]
    for token in (0, 7, 49, 51, 1 << 16):
        places = np.flatnonzero(ids == token)
        assert m.rank(token, 3000) == len(places) and m.rank(token, 1000) == (places < 1000).sum()
        assert [m.select(token, k) for k in range(len(places))] == places.tolist()
    empty = WaveletMatrix.of(np.zeros(0, np.uint32), 16)
    assert len(empty.decoded()) == 0 and empty.rank(3, 0) == 0
    with pytest.raises(IndexError):
        m.access(3000)


def test_token_shards_round_trip(spark, table, odd_rows, tmp_path):
    path = public_tokenizers.path(FILES[1])
    tokenizer, out = Tokenizer.from_file(path), f"file://{tmp_path}/shards"
    write_token_shards(table(odd_rows), path, out, shard_tokens=500)
    rows = sorted(read_documents(spark, out).collect(), key=lambda r: r.start)
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, everything = 0, []
    for r, (key, text, _) in zip(rows, order, strict=True):
        ids = whole(tokenizer, text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        everything += ids.tolist()
    assert sum(r["count"] for r in find_token(spark, out, 2).collect()) == everything.count(2)
    write_token_shards(table([]), path, out + "0")
    assert read_documents(spark, out + "0").collect() == []
