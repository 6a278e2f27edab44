"""The bound queries on small tables: columns, a row for each row, and what null, empty and repeated rows give."""

from __future__ import annotations

import hashlib

import pytest

from spanloom.llm import queries

TEXTS = ["the cat sat on the mat and looked at the dog " * 3, None, "", "mail a@b.co now\nAll rights reserved.", "token: abcdef123456\nAll rights reserved.", "the cat sat on the mat and looked at the dog " * 3]
COLUMNS = {
    "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans n_spans",
    "op2_hostrep": "page_id host path rule verdict bad_rate bad_rate_bound",
    "op3_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op4_suffixes": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_kmtree": "query_id rank vec_id score",
    "op6_langid": "doc_id held_out lang_pred score",
    "op7_credentials": "doc_id n_assign n_access n_hex base_sha256 spans n_live n_example",
    "op8_simhash": "doc_id fingerprint component_id",
    "op9_decontam": "doc_id contaminated items windows",
    "op10_linededup": "doc_id n_lines n_removed removed",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en" if i % 2 else None, "s", len(t) if t is not None else None) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, "http://Example.com/en/1", "x"), (1, None, None), (2, "no scheme", ""), (2, "https://a.net/es/7?x", "")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(1, 0, 0), (7, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "the cat sat on the mat and looked at the dog"), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, [float(i % 3) - 1, float(i), 1.0]) for i in range(60)], "vec_id long, embedding array<double>").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, tables, name):
    df = queries.QUERIES[name](spark, tables)
    assert df.columns == COLUMNS[name].split()
    got = df.collect()
    if name == "op5_kmtree":
        assert sorted((r.query_id, r["rank"]) for r in got) == [(q, k) for q in (0, 50) for k in range(1, 6)]
        return
    if name == "op2_hostrep":
        by = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got)
        assert by == [(0, "example.com", "/en/1", "example.com/en/", "block"), (1, "", "", None, by[1][4]), (2, "", "", None, by[2][4]), (2, "a.net", "/es/7", "net/es/", "block")]
        return
    assert sorted(r.doc_id for r in got) == list(range(len(TEXTS)))
    by = {r.doc_id: r for r in got}
    none = hashlib.sha256(b"").hexdigest()
    if name == "op1_pii":
        assert by[1].base_sha256 == by[2].base_sha256 == none and by[3].spans == "email:5:11" and by[3].n_spans == 1
    elif name == "op3_packing":
        assert by[1].length == by[2].length == 1 and by[1].ids_crc32 == by[2].ids_crc32
    elif name == "op4_suffixes":
        assert by[1].n_bytes == 0 and by[5].n_removed == len(TEXTS[5]) and by[5].kept_sha256 == none and by[0].n_removed == 0
    elif name == "op6_langid":
        assert by[1].lang_pred == by[2].lang_pred == "und" and by[1].score == 0
    elif name == "op7_credentials":
        assert by[4].n_assign == 1 and by[1].spans == ""
    elif name == "op8_simhash":
        assert by[1].fingerprint == by[2].fingerprint == "0" * 16 and by[5].component_id == 0 and by[2].component_id == 1
    elif name == "op9_decontam":
        assert [by[i].contaminated for i in range(6)] == [True, False, False, False, False, True] and list(by[0]["items"]) == [1]
    elif name == "op10_linededup":
        assert by[4].removed == "1" and by[5].removed == "0" and by[1].n_lines == 0 and by[3].n_lines == 2
