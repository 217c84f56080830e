"""Token folders and packing: exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from terrascope.llm import packing, token_files
from tests.llm.frames import edge_docs, edge_rows, empty_docs, saved

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text, end):
    tok = Tokenizer.from_file(PATH)
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


def test_token_files_round_trip(spark, tmpdir_run):
    docs = saved(edge_docs(spark), tmpdir_run + "/docs")
    manifest = token_files.write_token_files(docs, tmpdir_run + "/tokens", PATH, end_id=2)
    got = token_files.read_token_files(spark, tmpdir_run + "/tokens", PATH, end_id=2).collect()
    want = sorted(((i, t) for i, t, *_ in edge_rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in want]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (i or -1, len(x), zlib.crc32(x.tobytes())) for i, x in ((i, ids_of(t, 2)) for i, t in want))
    rows = sorted(manifest.collect())
    assert [r.base for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    ids, offsets, tokens = token_files.read_documents(tmpdir_run + "/tokens", rows[0].name)
    assert isinstance(tokens, np.memmap) and len(offsets) == len(ids) + 1 and tokens.dtype == np.uint16


def test_token_files_empty(spark, tmpdir_run):
    token_files.write_token_files(empty_docs(spark), tmpdir_run + "/tokens", PATH, end_id=2)
    assert token_files.read_token_files(spark, tmpdir_run + "/tokens", PATH, end_id=2).count() == 0


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing(spark, capacity):
    rows = edge_docs(spark).select("doc_id", "text").collect()
    got = packing.pack(edge_docs(spark), PATH, capacity=capacity).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for r in rows:
        ids = ids_of(r.text, 0)
        if sum(x.doc_id == r.doc_id for x in rows) > 1:
            continue
        at = 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert sum(r.length for r in got) == sum(len(ids_of(r.text, 0)) for r in rows)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert {p.sequence_length for p in pieces} == {at}
        assert capacity - at <= 4 or at & (at - 1) == 0
    assert packing.pack(empty_docs(spark), PATH).count() == 0


def test_classes_and_decompositions():
    sizes = packing.classes(1024, 4)
    assert all(1024 - 4 <= s * k <= 1024 for s, k in sizes.items())
    for r, parts in enumerate(packing.decompositions(1024, 4)):
        assert sum(parts) == r and set(parts) <= set(sizes)
