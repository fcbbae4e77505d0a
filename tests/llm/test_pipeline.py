from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_dedup import groups_of, plain_simhash
from tests.llm.test_secrets import plain_spans


def made_documents() -> list[tuple]:
    """Clean texts in two languages, copies, near copies, secrets, junk."""
    r = random.Random(1)
    french = "le la les des une est dans pour avec été ération mentaux".split()
    rows = [(i, prose(i, 60), "en", "a", 1) for i in range(40)]
    rows += [(100 + i, " ".join(r.choice(french) for _ in range(60)), "fr", "b", 1) for i in range(40)]
    rows += [(200 + i, rows[i][1].upper(), "en", "a", 1) for i in range(8)]
    rows += [(300 + i, prose(900, 900 + (i > 3)), "en", None, 1) for i in range(6)]
    rows += [(400, prose(7, 30) + " token = abcdefghijklmnop " + prose(8, 30), "en", "a", 1)]
    rows += [(500, None, "en", "a", None), (501, "", "en", "a", 0), (502, "1234 !!", None, None, 7)]
    return rows


def test_stages(spark, tmp_path):
    rows = made_documents()
    text = {r[0]: r[1] for r in rows}
    docs = spark.createDataFrame(rows, SCHEMA)
    ids = set(text) - {500, 501, 502}  # no letters
    lower = {}
    for k in ids:
        lower.setdefault(text[k].lower(), []).append(k)
    after_exact = {max(g) for g in lower.values()}
    prints = {k: plain_simhash(text[k]) for k in after_exact}
    groups = groups_of(sorted(after_exact), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    after_near = {k for k in after_exact if groups[k] == k}
    kept = [ids, after_exact, after_near, after_near]
    assert len(after_near) < len(after_exact) < len(ids)
    for (name, stage), expected in zip(corpus_pipeline.STAGES, kept):
        docs = corpus_pipeline.staged(stage(spark, docs, ""), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert {r.doc_id for r in docs.select("doc_id").collect()} == expected, name
    final = {r.doc_id: r for r in docs.collect()}
    (start, end, _), *_ = plain_spans(text[400])
    assert final[400].text == text[400][:start] + "[SECRET]" + text[400][end:]
    assert all(r.n_chars == len(r.text) and (k == 400 or r.text == text[k]) for k, r in final.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in packed.select("doc_id").collect()} == after_near


def test_run_equals_its_stages(spark, tmp_path):
    docs = spark.createDataFrame(made_documents(), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    ran = {(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, ""), "stage")
    assert ran == {(r.doc_id, r.piece, r.ids_crc32) for r in docs.collect()}


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, ""), "stage")
    assert docs.count() == 0
