from __future__ import annotations

import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracelane.llm import packing, records, tokens
from tracelane.llm.token_counts import MARK, UnigramTrie, token_counts
from tracelane.llm.tokens import encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


WHOLE = {BYTE: plain(BYTE), WORD: plain(WORD)}
PIECES = st.sampled_from(["word", "Wörter", "ÉTÉ", "don't", "x,", "end.", "İx", "ΣΑΣ", "12", "a1", "²", "  ", " ", "\n", "\t", " ", "　", "<|endoftext|>", "###", "ﬁ", "é", "日本", "😀"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12), min_size=1, max_size=5), st.sampled_from(["", " "]))
def test_pieces_equal_whole_texts(texts, joint):
    texts = [joint.join(t) for t in texts]
    for path, drops in ((BYTE, False), (WORD, True)):
        assert [ids.tolist() for ids in encoder(path, drops).encode(pa.array(texts))] == [WHOLE[path](t) for t in texts]


@pytest.mark.parametrize("chars", [3_000_000, 500, 1])
def test_slices_of_batches(monkeypatch, chars):
    """Texts of a batch that is encoded in several slices, and of a batch that is a slice itself."""
    monkeypatch.setattr(tokens, "SLICE_CHARS", chars)
    words = ["Word", "the", "Über", "été,", "end.", "x.y", "a,b", "...", "stop.,", "İx", "straße.", "no", "cœur,", "A.", ",", ".", "o.\n", "ﬁn."]
    rng = np.random.default_rng(3)
    texts = [" ".join(words[k] for k in rng.integers(0, len(words), rng.integers(0, 30))) for _ in range(120)] + ["a.", ". b", "c, ", "é. x", ""]
    for path, drops in ((BYTE, False), (WORD, True)):
        want = [WHOLE[path](t) for t in texts]
        held = pa.array(texts)
        assert [ids.tolist() for ids in tokens.PieceEncoder(path, drops).encode(held)] == want
        assert [ids.tolist() for ids in tokens.PieceEncoder(path, drops).encode(held.slice(17, 90))] == want[17:107]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_encoding_of_real_batches(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_CHARS", 100_000)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").combine_chunks()
    for path, drops in ((BYTE, False), (WORD, True)):
        assert [ids.tolist() for ids in tokens.PieceEncoder(path, drops).encode(texts)] == [WHOLE[path](t) for t in texts.to_pylist()]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_neighbours_on_the_curve_are_alike(spark):
    """Documents next to each other in the order of packing share far more words than any two do."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, WORD).where("start = 0").select("doc_id", "sequence_id", "offset").orderBy("sequence_id", "offset").collect()
    words = {r.doc_id: set((r.text or "").lower().split()) for r in docs.collect()}
    order = [words[r.doc_id] for r in rows]
    alike = lambda step: np.mean([len(a & b) / max(len(a | b), 1) for a, b in zip(order, order[step:])])
    assert alike(1) > 1.5 * np.mean([alike(k) for k in (37, 53, 71, 89)])


def test_records_round_trip(spark, odd):
    got = records.token_records(odd, BYTE).collect()
    assert len(got) == len(ODD)
    order = sorted(got, key=lambda r: r.start)
    start = 0
    for r in order:
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in order] == sorted((r[0] for r in ODD), key=lambda i: (i is not None, i or 0))
    want = sorted((str(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in ODD for ids in [[*WHOLE[BYTE](t), 0]])
    assert want == sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got)


def test_records_index_and_corruption(spark, make, tmp_path):
    docs = make([(i, f"text number {i}") for i in range(20)])
    files = records.write(docs, f"file://{tmp_path}", BYTE, files=3).collect()
    assert sum(f.n_docs for f in files) == 20
    seen = {}
    for f in files:
        for k in reversed(range(f.n_docs)):
            doc, ids = records.draw(f.path, f.index_path, k)
            seen[doc] = ids.tolist()
    assert seen == {i: [*WHOLE[BYTE](f"text number {i}"), 0] for i in range(20)}
    data = bytearray(open(files[0].path.removeprefix("file://"), "rb").read())
    data[15] ^= 1
    with pytest.raises(ValueError, match="corrupt"):
        records.unframe(bytes(data))
    assert records.token_records(make([]), BYTE).count() == 0


def check_packing(got, rows, most=2048):
    by_row = {}
    for r in got:
        by_row.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    total = 0
    for doc, text in rows:
        total += len(WHOLE[WORD](text)) + 1
    assert sum(r.length for r in got) == total
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    fills = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        fills.append(at)
    assert sorted(fills, reverse=True)[:-1] == [most] * (len(fills) - 1) and sorted(sequences) == list(range(len(sequences)))


def test_packing(spark, odd, make):
    got = packing.pack(odd, WORD).collect()
    check_packing(got, ODD)
    pieces = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.start, ids))
    assert [i for _, p in sorted(pieces[6]) for i in p] == [*WHOLE[WORD](dict(ODD[5:])[6]), 1]
    assert packing.pack(make([]), WORD).count() == 0


def test_hilbert_neighbours():
    """The curve visits every cell once, and from one to the next by a single step."""
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    keys = packing.hilbert_key(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def best_cut(trie, word):
    best = [(0, 0)] + [None] * len(word)
    for j in range(1, len(word) + 1):
        n = len(word[j - 1].encode())
        options = [(best[j - 1][0] + n * trie.byte_cost, best[j - 1][1] + n)]
        options += [(best[i][0] + trie.cost[word[i:j]], best[i][1] + 1) for i in range(j) if word[i:j] in trie.cost]
        best[j] = min(options)
    return best[-1][1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcé日", min_size=1, max_size=9), min_size=1, max_size=20))
def test_trie_equals_each_word_alone(words):
    trie = UnigramTrie(["a", "b", "ab", "abc", MARK, MARK + "a", "ca", "cab", "é"])
    assert trie.counts(words) == [best_cut(trie, w) for w in words]


def test_token_counts(spark, odd, make):
    got = token_counts(odd, public_tokenizers.path("piece_bpe_32k.model")).collect()
    from tracelane.llm.token_counts import _trie

    trie = _trie(public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((str(i), len((t or "").split()), sum(best_cut(trie, MARK + w) for w in (t or "").split()) if len(t or "") < 60_000 else -1) for i, t in ODD)
    have = sorted((str(r.doc_id), r.n_pretokens, r.n_tokens if r.doc_id != 5 else -1) for r in got)
    assert have == want
    assert token_counts(make([]), public_tokenizers.path("piece_bpe_32k.model")).count() == 0
