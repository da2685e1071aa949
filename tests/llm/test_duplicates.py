from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from conftest import ODD
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelane.llm import repeats, similarity_join, spotsigs
from tracelane.llm import shingles as sh
from tracelane.llm.components import components


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def near_texts(n=40, seed=1):
    """Groups of near copies that change a few words of 120, chains of them, exact copies, and texts that share one passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, passage = [], [word() for _ in range(60)]
    for g in range(n // 8):
        body = [word() for _ in range(120)]
        for k in range(4):
            changed = list(body)
            for _ in range(k):
                changed[rng.randrange(120)] = word()
            rows.append(" ".join(changed))
        rows.append(rows[-1])
        for _ in range(3):
            rows.append(" ".join([word() for _ in range(60)] + passage))
    return [(i, t) for i, t in enumerate(rows)]


def classes_of(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(rows))], links


@pytest.mark.parametrize("block", [1024, 4])
def test_join_equals_brute_force(spark, make, monkeypatch, block):
    monkeypatch.setattr(similarity_join, "BLOCK", block)
    rows = near_texts()
    want, links = classes_of(rows)
    got = {r.doc_id: r for r in similarity_join.jaccard_join(make(rows)).collect()}
    assert [(got[i].class_id, got[i].n_links) for i in range(len(rows))] == list(zip(want, links))
    kept = sorted(r.doc_id for r in similarity_join.keep_one(make(rows)).collect())
    assert kept == sorted(set(want))


def test_join_odd_rows(spark, odd, make):
    got = similarity_join.jaccard_join(odd).collect()
    assert len(got) == len(ODD)
    assert {r.n_copies for r in got if r.doc_id in (1, 2, 7)} == {3}  # texts without words
    kept = similarity_join.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got) == 8
    assert similarity_join.jaccard_join(make([])).count() == 0


@pytest.mark.parametrize("beyond", [b"\xff\xff\xff\xff", b"  \n\t", b"\0\0\0\0", b"abcd"])
def test_words_whatever_lies_beyond_the_last_text(beyond):
    for bodies in (["a b", "c \n\t "], ["a\n", "b "], ["a ", "", ""], [" \n\t "], ["\u3000\u3000"]):
        raw = [b.encode() for b in bodies]
        at = np.cumsum([0, *map(len, raw)], dtype=np.int64)
        texts = pa.LargeStringArray.from_buffers(len(bodies), pa.py_buffer(at), pa.py_buffer(b"".join(raw) + beyond))
        assert [[w for w in words if w] for words in sh.split_words(texts).to_pylist()] == [b.split() for b in bodies]


def test_sets_do_not_depend_on_the_batch():
    rng = random.Random(1)
    bodies = [r[1] or "" for r in ODD] + ["Ends in a mark.", "wörter am ende \u3000"]
    alone = {b: {tuple(b.lower().split()[i : i + 5]) for i in range(max(1, len(b.split()) - 4))} - {()} for b in bodies}
    keys, marked = {}, {b: spotsigs.signatures([b, "x"])[0].tolist() for b in bodies}
    for _ in range(200):
        some = rng.sample(bodies, rng.randrange(1, len(bodies) + 1))
        for b, s in zip(some, sh.shingle_sets(pa.array(some), 5)):
            assert len(s) == len(alone[b]) and keys.setdefault(b, sh.set_key(s)) == sh.set_key(s)
        assert [s.tolist() for s in spotsigs.signatures(some)] == [marked[b] for b in some]


def test_posterior():
    least = similarity_join.least_matches(0.8, 1e-6)
    assert list(least) == sorted(least) and 0 < least[0] < 16 and least[-1] < 0.8 * 128
    rng = np.random.default_rng(0)
    a = rng.integers(0, 4, (30, 128)).astype(np.uint16)
    a[7] = a[3]
    i, j = similarity_join.surviving_pairs(a, None, 0.8, 1e-6)
    assert (3, 7) in set(zip(i.tolist(), j.tolist()))
    x, y = similarity_join.surviving_pairs(a[:5], a[5:], 0.8, 1e-6)
    assert (3, 2) in set(zip(x.tolist(), y.tolist()))


def test_intersections_agree():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(12)]
    i, j = np.triu_indices(12, 1)
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j)]
    assert similarity_join.intersections(sets, i, j).tolist() == want == similarity_join.intersections(sets, i[:20], j[:20]).tolist() + want[20:]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(30)] + [(200, 200), (301, 302), (302, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def removed(bodies, length):
    seen = {}
    for t in bodies:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in bodies:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        out.append(mask)
    return out


def check_repeats(got, rows, length):
    bodies = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), body, mask in zip(rows, bodies, removed(bodies, length)):
        kept = bytes(b for b, m in zip(body, mask) if not m)
        spans = sum(1 for k in range(len(mask)) if mask[k] and not (k and mask[k - 1]))
        want.append((str(i), len(body), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)


@pytest.mark.parametrize("group", [4096, 3])
def test_repeats_equal_brute_force(spark, make, group):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    common, short = text(90), text(35)
    rows = [(i, text(60) + common[rng.randrange(30) :] + text(40) + (short if i % 3 else "") + text(50)) for i in range(30)]
    rows += [(90, rows[0][1]), (90, rows[0][1]), (91, "ab" * 100), (92, "x" * 300), (93, common + text(10) + common), (94, None), (95, ""), (None, text(20) + common)]
    check_repeats(repeats.remove_repeats(make(rows), length=40, gram=16, group=group, step=5).collect(), rows, 40)


@pytest.mark.parametrize("group", [4096, 8, 2])
def test_repeats_of_a_crowded_phrase(spark, make, group):
    """A phrase shorter than a window in every row; some rows are near copies of each other, so that single windows of its contexts repeat."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase, around = text(30), [(text(40), text(40)) for _ in range(4)]
    rows = []
    for i in range(60):
        before, after = around[i % 4][0], around[i // 7 % 4][1]
        k, j = rng.randrange(1, 40), rng.randrange(1, 40)
        rows.append((i, text(k) + before[k:] + phrase + after[:j] + text(40 - j)))
    check_repeats(repeats.remove_repeats(make(rows), length=40, gram=16, group=group, step=7).collect(), rows, 40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), max_size=6))
def test_anchors(bodies):
    """Every window has one anchor, which it holds, at the same place as every equal window."""
    starts = np.cumsum([0, *map(len, bodies)])
    text = "".join(bodies)
    at, first, last, _ = repeats.anchors(np.frombuffer(text.encode(), np.uint8), starts, 12, 4)
    found = {}
    for p, a, b in zip(at.tolist(), first.tolist(), last.tolist()):
        for w in range(a, b + 1):
            assert w not in found and w <= p <= w + 8
            found[w] = p - w
    assert sorted(found) == [s + i for s, t in zip(starts.tolist(), bodies) for i in range(len(t) - 11)]
    assert len({(text[w : w + 12], d) for w, d in found.items()}) == len({text[w : w + 12] for w in found})


def test_repeats_odd_rows(spark, odd, make):
    got = {r.doc_id: r for r in repeats.remove_repeats(odd).collect()}
    assert got[5].n_removed == 70_000 and got[6].n_removed == got[6].n_bytes and got[3].n_removed == 0 and got[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert repeats.remove_repeats(make([])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=12), max_size=8), max_size=6))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    coded = [repeats.front_code([(b, b[::-1], 1, 2, 3) for b in r]) for r in runs]
    got = list(repeats.LoserTree([repeats.decode(c) for c in coded])) if runs else []
    flat = sorted(b for r in runs for b in r)
    assert [g[0][0] for g in got] == flat and all(g[0][2] == g[0][0][::-1] for g in got)
    assert [g[1] for g in got][1:] == [repeats.shared(a, b) for a, b in zip(flat, flat[1:])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=10), st.text("ab", min_size=1, max_size=10)), min_size=2, max_size=14))
def test_covered(pairs):
    pairs = sorted((r.encode(), l.encode()) for l, r in pairs)
    rights, lefts = [p[0] for p in pairs], [p[1] for p in pairs]
    lcps = [0] + [repeats.shared(a, b) for a, b in zip(rights, rights[1:])]
    want = []
    for i in range(len(pairs)):
        ok = [(x, y) for j in range(len(pairs)) if j != i for x, y in [(repeats.shared(lefts[i], lefts[j]), repeats.shared(rights[i], rights[j]))] if x + y >= 8]
        want.append((max((x for x, _ in ok), default=0), max((y for _, y in ok), default=0)))
    got = repeats.covered(rights, lcps, lefts, 8)
    assert got == want == repeats.reaches(rights, lcps, lefts, [False] * len(pairs), 8)
    assert repeats.reaches(rights, lcps, lefts, [True] * len(pairs), 8) == [(len(a), len(b)) for a, b in zip(lefts, rights)]


def test_spotsigs(spark, make, odd):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(n))
    rows = [(i, prose(80)) for i in range(30)]
    rows[5] = (5, rows[4][1])
    got = {r.doc_id: r for r in spotsigs.fingerprints(make(rows)).collect()}
    for i, text in rows:
        after = rows[i - 1][1]  # the next in descending order; after the last, the first
        edit = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        own, changed = (spotsigs.decoded(f) for f in (got[i].fingerprint, got[i].edited_fingerprint))
        a, b = set(own.tolist()), set(changed.tolist())
        assert got[i].near_edited == len(a & b) / len(a | b) and 0.1 < got[i].near_edited < 0.7
        assert (got[i].near_next == 1) == (i == 5)
    assert got[4].fingerprint == got[5].fingerprint
    assert spotsigs.fingerprints(odd).count() == len(ODD) and spotsigs.fingerprints(make([])).count() == 0
    assert spotsigs.fingerprints(make([(1, "alone the one")])).first().near_next == 1


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=1), st.sets(st.integers(0, 40), min_size=1), st.sampled_from([0.0, 0.5, 0.8]))
def test_pruned_jaccard(a, b, t):
    exact = len(a & b) / len(a | b)
    got = spotsigs.pruned_jaccard(np.array(sorted(a)), np.array(sorted(b)), t)
    assert got == exact if exact >= t else got in (0.0, exact)
    if exact >= 0.8:
        assert abs(spotsigs.length_partition(len(a)) - spotsigs.length_partition(len(b))) <= 1


def plain_signatures(text, chain=2):
    """Signatures as tuples of words."""
    words = regex.sub(r"[^\pL\pN]+", " ", text).lower().split()
    content = [w for w in words if w not in spotsigs.ANCHORS]
    out, after = set(), []
    for w in reversed(words):
        if w not in spotsigs.ANCHORS:
            after = [w, *after][:chain]
        elif len(after) == chain:
            out.add((w, *after))
    if not out:
        out = {("run", *content[k : k + chain]) for k in range(len(content) - chain + 1)} or {("word", w) for w in words} or {("text", text)}
    return out


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_spotsigs_equals_plain_words(spark):
    """The likenesses of the query, on the whole of the smallest table, are those of sets of words."""
    from tracelane.llm.queries import op1_spotsigs

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    order = sorted(docs, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    likeness = lambda a, b: len(a & b) / len(a | b)
    sets = {i: plain_signatures(t) for i, t in docs.items()}
    got = {r.doc_id: r for r in op1_spotsigs(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        changed = plain_signatures(spotsigs.edited(docs[i], docs[after[i]]))
        assert (r.n_chars, r.n_signatures) == (len(docs[i]), len(sets[i])) == (r.n_chars, len(spotsigs.decoded(r.fingerprint)))
        assert abs(r.near_edited - likeness(sets[i], changed)) < 1e-9 and abs(r.near_next - likeness(sets[i], sets[after[i]])) < 1e-9
        assert (r.alike_edited, r.alike_next) == (r.near_edited >= 0.8 - 1e-9, r.near_next >= 0.8 - 1e-9)


def test_next_of_many_ranges(spark, make):
    """Each row is followed by the next one in whatever ranges ids fall into."""
    rows = [(i * 7 % 1000, f"the {i} text of") for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {r.doc_id: r.edited_sha256 for r in spotsigs.fingerprints(make(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
    text = dict(rows)
    order = sorted(text, reverse=True)
    assert got == {i: hashlib.sha256(spotsigs.edited(text[i], text[j]).encode()).hexdigest() for i, j in zip(order, order[1:] + order[:1])}


def test_spotsigs_classes_of_odd_rows(spark, odd, make):
    got = spotsigs.near_classes(odd).collect()
    assert len(got) == len(ODD) and {r.class_id for r in got if r.doc_id in (1, 2)} == {1}  # null and empty are equal; white space alone is not
    assert {r.class_id for r in got if r.doc_id == 7} == {7} and sum(r.doc_id is None for r in got) == 1
    assert spotsigs.near_classes(make([])).count() == 0


def test_spotsigs_matches(spark, make):
    """Classes of near-equal fingerprints equal brute force over all pairs."""
    rows = near_texts()
    rows = [(i, " ".join(w if k % 3 else "the " + w for k, w in enumerate(t.split()))) for i, t in rows]
    sets = [set(s.tolist()) for s in spotsigs.signatures([t for _, t in rows])]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                old, new = root[i], root[j]
                a, b = max(old, new), min(old, new)
                root = [b if r == a else r for r in root]
    got = {r.doc_id: r.class_id for r in spotsigs.near_classes(make(rows)).collect()}
    assert [got[i] for i in range(len(rows))] == root
