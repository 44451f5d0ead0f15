"""Chats, archives, the registered queries against DuckDB, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meterlake.llm import chat, queries, warc
from meterlake.sources.storage import shared_folder
from tests.conftest import FOLDER
from tests.llm.test_documents import brute_spans, similarity

TURNS = "conv_id bigint, turn bigint, role string, text string"


def chats(spark, rows):
    df = spark.createDataFrame(rows, TURNS)
    for c in ("part", "t", "g", "turns", "segments", "formatted", "groups", "x"):
        df = df.withColumn(c, F.lit("clash"))
    out = chat.format_chats(df)
    return {r.conv_id: r for r in out.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("trained", chat.trained_text(F.col("segments"))).collect()}


def test_chats_read_back(spark):
    marks = ["<|turn|>", "<|says|>", "<|part|>", "<|end|>", "<|end|>\n", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<\\|end|>", "<\\\\/s>", "[\\INST]", "\\", "<", "[", "&", "$1", "é", "\n", " ", ""]
    rng = random.Random(1)
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 12)):
            text = "".join(rng.choice(marks) for _ in range(rng.randrange(6)))
            rows.append((c, rng.choice([t, t, 3, None]), rng.choice(["user", "assistant", "assistant", "system", "<|says|>", None]), rng.choice([text, text, None])))
    rows += [(None, 0, "user", "x"), (None, 0, "user", "x"), (77, None, None, None)]
    rows += [(99, t, "user" if t % 600 < 300 else "assistant", f"turn {t}") for t in range(1500)]
    got = chats(spark, rows)
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, chat_escape(r or ""), chat_escape(x or ""), r or "", x or "") for k, t, r, x in rows if k == c))
        want = [(r[4], r[5]) for r in own]
        assert [(b.role, b.text) for b in got[c].back] == want
        assert got[c].trained == "".join(x for r, x in want if r == "assistant")
        assert "".join(s.text for s in got[c].segments) == got[c].formatted
        blocks = sum(1 for i, (r, _) in enumerate(want) if i == 0 or want[i - 1][0] != r)
        assert got[c].formatted.count(chat.TURN) == blocks
    assert chats(spark, []) == {}


def chat_escape(s: str) -> str:
    import re

    return re.sub(r"([<\[])(\\*)(\|[A-Za-z_]{1,32}\|>|/?s>|/?INST\]|/?SYS>)", r"\1\\\2\3", s)


def test_archives(spark):
    big = "<p>" + "é" * 80 + "</p>"
    pages = [(5, "u", big), (2, "u\r\nx y", big), (9, None, big), (None, "n", big), (3, "a", "short"), (4, "b", "short"), (6, "c", None), (7, "d", "")]
    pages += [(20, "e", "x\r\n\r\ny" * 30), (21, "f", "\r\n\r\n" + "z" * 200 + "\r\n"), (22, "f", "q" * 150 + "\r\n\r\n"), (23, "g", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9), (2, "again", big)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash")).withColumn("payload", F.lit("c")).repartition(3)
    rows = warc.deduplicated(df).collect()
    assert len(rows) == len(pages)
    by: dict = {}
    for r in rows:
        by.setdefault(r.record_id, []).append(r)
    assert sorted(r.type for r in by["<urn:page:2>"]) == ["response", "response"]
    for i in ("5", "9", "none"):
        assert [(r.type, r.refers_to) for r in by[f"<urn:page:{i}>"]] == [("revisit", "<urn:page:2>")]
    for i, _, html in pages:
        for r in by[f"<urn:page:{'none' if i is None else i}>"]:
            raw = (html or "").encode()
            assert r.payload_bytes == len(raw) and r.digest == hashlib.sha256(raw).hexdigest()
            assert r.payload is None if r.type == "revisit" else r.payload == (html or "")
    assert warc.deduplicated(df.limit(0)).count() == 0


def test_damaged_archive_is_refused(spark):
    path = shared_folder(spark, "warc")
    spark.sql("SELECT 'WARC/1.1\\r\\nContent-Length: 9\\r\\n\\r\\nabc' AS value").write.option("lineSep", "\r\n\r\n").text(path)
    with pytest.raises(Exception, match="within a record"):
        warc.read_archives(spark, path).collect()


@pytest.mark.parametrize("name", sorted(queries.SQL_TEXT))
def test_query_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    cursor = duck.execute(queries.SQL_TEXT[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([r[columns.index(c)] for c in sorted(columns)]) for r in cursor.fetchall())
    assert sorted(repr([r[c] for c in sorted(columns)]) for r in df.collect()) == want


def test_every_operator_has_its_query():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(queries.SQL_TEXT) <= set(__spark_entry__.oracle_sql())


def test_pipeline_stages(spark):
    """Each stage on what the one before kept, against what it must do."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, FOLDER)
        docs.cache()
        kept[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
    before, after = kept["toxicity"]
    toxic = {r.doc_id for r in queries.QUERIES["op8_toxicity"](spark, FOLDER).where("predicted = 1").collect()}
    assert {r.doc_id for r in after} == set(before) - toxic
    before, after = kept["near_copies"]
    left = {r.doc_id for r in after}
    smaller = {i: [r.text for k, r in before.items() if k < i and abs(len(r.text) - len(before[i].text)) < 0.3 * len(r.text)] for i in before}
    best = {i: max((similarity(before[i].text, t) for t in smaller[i]), default=0) for i in before}
    assert {i for i in before if best[i] < 0.6} <= left and not {i for i in before if best[i] == 1} & left
    assert sum(best[i] >= 0.85 for i in left) <= 0.2 * sum(best[i] >= 0.85 for i in before)
    before, after = kept["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaks = {i for i, r in before.items() if any(t in r.text for t in items)}
    left = {r.doc_id for r in after}
    assert not left & leaks and len(set(before) - leaks - left) <= 3
    before, after = kept["personal_data"]
    assert {r.doc_id for r in after} == set(before)
    for r in after:
        assert brute_spans(r.text) == [] or r.text != before[r.doc_id].text
        if not brute_spans(before[r.doc_id].text) and not any(c in "0123456789@" for c in before[r.doc_id].text):
            assert r.text == before[r.doc_id].text
        assert r.n_chars == len(r.text)
    before, after = kept["packing"]
    tokens: dict[int, int] = {}
    for r in after:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert set(tokens) == set(before) and all(tokens[r.doc_id] == r.doc_tokens for r in after)
