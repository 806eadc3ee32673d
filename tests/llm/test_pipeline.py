"""The pipeline on a small folder, against a plain version of its stages, and the queries that have no SQL."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from test_operators import plain_groups, plain_lines

import corpus_pipeline
from knotwork.llm import langid, near_dup, quality, tokens
from knotwork.llm.queries import QUERIES

WORDS = {"en": "the and of to in is that it on with".split(), "de": "der und die das nicht ist ein mit von zu".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels with junk, copies, near copies, repeated lines, nulls and an empty text."""
    rng = random.Random(21)

    def prose(lang, n=60):
        return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "a", "en", "ing"]) for _ in range(n)) + "."

    docs, labels = [], []
    for i in range(260):
        lang = rng.choice(list(WORDS))
        text, good = prose(lang), 1
        if i % 5 == 0:
            text, good = " | ".join(text.upper().split()) + "!!", 0
        if i % 7 == 3 and docs:
            near = docs[rng.randrange(len(docs))]
            text, lang, good = (near[1] or "x") + " " + rng.choice(WORDS[lang]), near[2], next((q for d, q in labels if d == near[0]), 1)
        if i % 6 == 1:
            text += "\nThis line is found in a great many documents."
        docs.append((i, text, lang, f"s{i % 3}", len(text)))
        labels.append((i, good))
    docs += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, docs[2][1], docs[2][2], "s", docs[2][4])]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}", docs, labels


def outside(doc_id, parts, part):
    return zlib.crc32(str(doc_id).encode()) % parts != part


def test_stages(spark, folder):
    path, docs, labels = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    marks = dict(x for x in labels if outside(x[0], 4, 2))
    known = sorted(((str(d[0]), d[1], marks[d[0]]) for d in docs if d[0] in marks))
    model = quality.fit(quality.indicators([t for _, t, _ in known]), np.array([q > 0 for _, _, q in known]))
    want = [d for d, s in zip(docs, model.score([d[1] for d in docs]), strict=True) if s >= quality.THRESHOLD]
    got = corpus_pipeline.STAGES[0][1](spark, frame, path)
    assert got.columns == frame.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(d[0] for d in want)
    assert sum(d[0] % 5 == 0 for d in want) < 10 < sum(d[0] % 5 > 0 for d in want)

    got2 = corpus_pipeline.STAGES[1][1](spark, got, path)
    said = langid.train(got.where(~langid.held_out(got["doc_id"]))).predict([d[1] for d in want])
    want = [d for d, lang, s in zip(want, *said, strict=True) if lang == d[2] and s >= 0.5]
    assert got2.columns == frame.columns and sorted(r["doc_id"] for r in got2.collect()) == sorted(d[0] for d in want)

    got3 = corpus_pipeline.STAGES[2][1](spark, got2, path)
    lines = plain_lines([(d[0], d[1]) for d in want])
    assert got3.columns == frame.columns
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in got3.collect()) == sorted((i, t, len(t)) for i, _, _, t in lines)
    assert any(n for _, _, n, _ in lines)

    got4 = corpus_pipeline.STAGES[3][1](spark, got3, path)
    kept = {i for i, _, _, k in plain_groups([(i, t) for i, _, _, t in lines], 5) if k}
    assert sorted(r["doc_id"] for r in got4.collect()) == sorted(kept) and len(kept) < len(lines)

    last = corpus_pipeline.run(spark, path).collect()
    ids = tokens.ChunkIds(tokens.word_bpe_path())
    text = {i: t for i, _, _, t in lines}
    assert {r["doc_id"]: r["doc_tokens"] for r in last} == {i: len(ids.encode([text[i]])[0]) // 4 + 1 for i in kept}
    assert sum(r["length"] for r in last) == sum({r["doc_id"]: r["doc_tokens"] for r in last}.values())


ODD = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the and of " * 60_000, "en", "s", 660_000), (3, "the and of it " * 30, "en", "s", 420), (3, "the and of it " * 30, "en", "s", 420), (4, "the and of it " * 30, "en", None, None), (5, "\n" * 50, None, "s", 50)]


@pytest.mark.parametrize("docs", [[], ODD], ids=["empty", "odd"])
def test_odd_tables(spark, folder, tmp_path, docs):
    """Empty tables, nulls in all columns, a long text, repeated rows and ties; extra columns with the stages' own names."""
    path = f"file://{tmp_path}"
    extra = "gone string, keeper string, `key` string, h1 string, v string, grouped string, found string, n_dropped string, `__score` string"
    spark.createDataFrame([(*d, *["c"] * 9) for d in docs], f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(folder[2] if docs else [], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    frame = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame, path).count() >= 0
    kept = near_dup.drop_near_duplicates(frame)
    assert kept.columns == frame.columns and kept.where("grouped <> 'c' or `__score` <> 'c'").isEmpty()
    if docs:
        assert sorted(r["doc_id"] for r in kept.where("doc_id >= 3").collect()) == [3, 5] and kept.where("doc_id is null").count() == 1
    assert corpus_pipeline.run(spark, path).count() >= 0


@pytest.mark.parametrize("name", [k for k in QUERIES if k not in ("op5_html_text", "op9_nearest")])
def test_queries_cover_all_documents(spark, folder, name):
    path, docs, _ = folder
    got = QUERIES[name](spark, path)
    if name != "op8_token_shards":
        assert {r["doc_id"] for r in got.select("doc_id").collect()} == {d[0] for d in docs}
    if name == "op2_language_id":
        assert all(r["held_out"] == (not outside(r["doc_id"], 5, 0)) for r in got.collect())
    if name == "op3_quality":
        assert all(r["held_out"] == (not outside(r["doc_id"], 4, 2)) and r["predicted"] == int(r["score"] >= 0.7) for r in got.collect())
