"""Every operator and every pipeline stage on texts that break naive code, on empty tables, and beside columns named like their own."""

import hashlib
import re

import pytest

import corpus_pipeline
from vectorloom.llm import dartminhash, decontam, editprint, secrets, spm, substrings, tokencounts, toolchat, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = [
    " " * 1_000_000, "\n" * 200_000 + "x", "w" * 1_000_000, "é" * 300_000, '{"a":' * 100_000, "".join(map(chr, range(1, 700))) * 20, "\x00\x00 a\x00b", "﻿​  \x85", "a " * 100_000,
    "password=" * 20_000, "AKIA" * 50_000, "0" * 500_000, "\U0010ffff" * 1000, "́" * 5000, "▁" * 5000 + " ▁ ", "<s></s><unk>" * 50, "", None, None, "same text twice", "same text twice",
]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(None if i == 18 else i, t, None, None, None) for i, t in enumerate(TEXTS)]
    path = str(tmp_path_factory.mktemp("hostile") / "documents")
    extra = [f"{k} AS `{c}`" for k, c in enumerate(("id", "h", "key", "at", "hits", "copy", "rep", "label", "bands", "digest", "salt", "_salt", "_salts", "n", "part", "y", "toxic", "item_id", "size", "class_id", "held_out"))]
    spark.createDataFrame(rows, DOCS).selectExpr("*", *extra).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


WHOLE = sorted((None if i == 18 else i for i in range(len(TEXTS))), key=lambda x: (x is None, x))


def models(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = spark.read.parquet(f"{SF}/documents.parquet")
    return secrets.fit(known), toxicity.fit(known, labels)


@pytest.mark.parametrize("name", ["secrets", "toxicity", "editprint", "tokencounts", "spm", "substrings", "dartminhash", "decontam"])
def test_operators(spark, docs, name):
    field, toxic = models(spark) if name in ("secrets", "toxicity") else (None, None)
    items = spark.createDataFrame([(1, "same text twice"), (2, "w" * 1_000_000), (3, None), (None, "a a a a a")], "item_id long, text string")
    run = {
        "secrets": lambda d: secrets.SecretScan(field).spans(d), "toxicity": lambda d: toxicity.score(d, toxic), "editprint": editprint.near, "tokencounts": tokencounts.section_counts,
        "spm": spm.digests, "substrings": substrings.dedup, "dartminhash": dartminhash.classes, "decontam": lambda d: decontam.contained(d, items),
    }[name]
    out = run(docs).cache()
    if name == "decontam":
        assert sorted((r["doc_id"], r["item_id"]) for r in out.collect()) == [(2, 2), (19, 1), (20, 1)]
    else:
        assert ids(out) == WHOLE
    assert run(docs.where("false")).count() == 0
    rows = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    if name == "spm":
        e = spm.Encoder(spm.default_model())
        for i in (0, 4, 6, 7, 13, 14, 15):
            assert rows[i]["ids_sha256"] == sha(",".join(map(str, e.lib.encode(TEXTS[i])))) and rows[i]["decoded_sha256"] == sha(e.lib.decode(e.lib.encode(TEXTS[i])))
    if name == "substrings":
        assert rows[8]["n_removed"] == 99_999 and rows[2]["n_words"] == 1 and rows[0]["kept_sha256"] == sha("")
    if name == "dartminhash":
        assert rows[20]["class_id"] == 19 and rows[0]["class_id"] == 0
    if name == "editprint":
        assert rows[20]["class_id"] == 19 and all(rows[i]["n_chars"] == len(TEXTS[i] or "") for i in rows)
    if name == "secrets":
        assert rows[11]["n_hex"] == 1 and rows[9]["n_assign"] >= 1
    if name == "tokencounts":
        assert rows[0]["n_tokens"] == 1_000_000 and rows[1]["n_sections"] == 200_001


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_pipeline_stages(spark, docs, number):
    """Stages keep hostile but clean documents, with all columns; only exact and near copies go, and the last stage gives each its ids."""
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, docs, SF)
    got = ids(out)
    if number < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    if name == "near_dedup":  # null counts as empty: 16 stands for 17; rows without a doc_id stay
        assert got == [i for i in WHOLE if i not in (17, 20)]
    else:
        assert got == WHOLE
    assert stage(spark, docs.where("false"), SF).count() == 0


def test_secrets_of_stage_against_spans(spark, docs):
    """What the stage redacts is what the field and the patterns find in its own input."""
    field = secrets.fit(docs)
    kept = {r["doc_id"]: r["text"] for r in secrets.SecretScan(field).redact(docs).where("doc_id is not null").select("doc_id", "text").collect()}
    for i, t in enumerate(TEXTS):
        if i == 18 or t is None:
            continue
        want = t
        for s, _, e in reversed(secrets.merged(secrets.scan_texts([t], field)[0])):
            want = want[:s] + "[SECRET]" + want[e:]
        assert kept[i] == want


def test_archive_and_chat(spark):
    pages = spark.createDataFrame([(i, t, t) for i, t in enumerate(TEXTS)], "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS header", "3 AS record", "4 AS _salt")
    got = {r["page_id"]: r for r in warc.write(pages).index().collect()}
    assert len(got) == len(TEXTS) and all(got[i]["payload_bytes"] == len((t or "").encode()) and got[i]["payload_digest"] == sha(t or "") for i, t in enumerate(TEXTS))
    chats = spark.createDataFrame([(i % 3, i, ("user", "assistant", None)[i % 3], t) for i, t in enumerate(TEXTS)], "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS state", "2 AS first", "3 AS n")
    assert toolchat.formatted(toolchat.asked(chats), toolchat.ASK).count() == len(TEXTS)
    assert toolchat.formatted(toolchat.asked(chats.limit(0)), toolchat.ASK).count() == 0
