from __future__ import annotations

import random

import corpus_pipeline
from conftest import ODD
from test_duplicates import classes_of
from test_others import labelled, spans_of, targets_of
from test_tokens import check_packing

from tracelane.llm.queries import QUERIES


def test_names():
    assert [n for n in QUERIES] and sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near copies", "secrets", "mixture", "packing"]


def test_pipeline(spark, make, tmp_path):
    rows, labels = labelled(120)
    rng = random.Random(5)
    sources = {i: f"s{i % 4}" for i, _ in rows}
    for i in range(120, 140):
        rows.append((i, rows[i - 119][1] + (" tail" if i % 2 else "")))
        sources[i] = sources[i - 119]
    rows[7] = (7, rows[7][1] + ' password = "abcdef123456"')
    docs = make([(i, t, sources[i]) for i, t in rows])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, at, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(sorted(((r.doc_id, r.text, r.source, r.n_chars) for r in at.collect())))
    good, single, clean, mixed = seen
    bad = {i for i, q, _ in labels if q == 0}
    assert {r[0] for r in good} & bad == set() and len(good) >= 0.9 * sum(i not in bad for i, _ in rows)
    roots, _ = classes_of([(r[0], r[1]) for r in good])
    assert [r[0] for r in single] == sorted(good[k][0] for k in set(roots))
    for before, after in zip(single, clean):
        spans = spans_of(before[1])
        assert (before == after) == (not spans) and not spans_of(after[1]) and after[3] == len(after[1])
    assert any(a != b for a, b in zip(single, clean))
    sizes, words, longest = {}, {}, max(len(r[1].split()) for r in clean)
    for r in clean:
        sizes[r[2]] = sizes.get(r[2], 0) + len(r[1].split())
    for r in mixed:
        words[r[2]] = words.get(r[2], 0) + len(r[1].split())
    assert all(abs(words[s] - t) <= longest for s, t in targets_of(sizes).items())
    check_packing(corpus_pipeline.packing(spark, at, str(tmp_path)).collect(), [(r[0], r[1]) for r in mixed])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0 and rng


def test_stages_take_odd_rows(spark, odd, make, tmp_path):
    """Nulls, empty and very long texts, equal rows, one id twice, a null id, clashing columns; and the empty table."""
    _, labels = labelled(60)
    spark.createDataFrame([(1000 + i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = lambda df: sorted(map(str, df.collect()))
    want = {"quality": len(ODD), "near copies": 8, "secrets": len(ODD)}  # no labelled row is here, so that none is rejected
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, odd, str(tmp_path))
        assert out.columns == odd.columns and out.schema.simpleString() == odd.schema.simpleString()
        got = rows(out)
        assert set(got) <= set(rows(odd)) and len(got) == want.get(name, len(got)), name
        assert step(spark, odd.limit(0), str(tmp_path)).count() == 0
    pieces = corpus_pipeline.packing(spark, odd, str(tmp_path)).collect()
    assert sum(r.start == 0 for r in pieces) == len(ODD) and all(r.doc_tokens == 1 for r in pieces if r.doc_id in (1, 2))
    assert corpus_pipeline.packing(spark, odd.limit(0), str(tmp_path)).count() == 0
