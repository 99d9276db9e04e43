"""Every operator and stage on odd rows and on empty tables."""

import pytest

import corpus_pipeline
from tracemill.llm import chat_format, decontaminate, html_extract, language_id, license_scan, minhash, packing, quality_rules, suffix_dedup, toxicity


def _labels(spark, rows=((1, 1, 0), (2, None, 1), (4, 0, None), (4, 1, 1), (None, 0, 0), (6, 0, 1), (10, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def _benchmark(spark, rows=((1, "one two three"), (2, None), (3, ""), (1, "one two three"), (None, "x"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def _languages(docs):
    langs, model = language_id.train(docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang"))
    return language_id.identify(docs, langs, model)


OPERATORS = {
    "quality": lambda s, d: quality_rules.quality_rules(d, _labels(s))[0],
    "suffix": lambda s, d: suffix_dedup.suffix_dedup(d),
    "leaks": lambda s, d: decontaminate.decontaminate(d, _benchmark(s)),
    "license": lambda s, d: license_scan.license_scan(d),
    "language": lambda s, d: _languages(d),
    "minhash": lambda s, d: minhash.minhash_dedup(d),
    "packing": lambda s, d: packing.pack(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, toxicity.fit(d, _labels(s))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_documents(spark, odd_docs, no_docs, name):
    rows = OPERATORS[name](spark, odd_docs).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(12))
    assert OPERATORS[name](spark, no_docs).count() == 0


def test_defined_results(spark, odd_docs):
    by = {r["doc_id"]: r for r in OPERATORS["minhash"](spark, odd_docs).collect()}
    assert by[5]["class_id"] == 4 and by[0]["class_id"] == 0 and by[11]["class_id"] == 11 and by[2]["class_id"] == 2
    by = {r["doc_id"]: r for r in OPERATORS["suffix"](spark, odd_docs).collect()}
    assert by[5]["n_removed"] == by[5]["n_bytes"] > 100_000 and by[5]["n_spans"] == 1 and by[0]["n_bytes"] == 0 and by[0]["kept_text"] is None
    by = {r["doc_id"]: r for r in OPERATORS["leaks"](spark, odd_docs).collect()}
    assert by[6]["contaminated"] and by[6]["items"] == ["1"] and by[0]["n_words"] == 0 and not by[0]["contaminated"]
    by = {r["doc_id"]: r for r in OPERATORS["language"](spark, odd_docs).collect()}
    assert by[0]["lang_pred"] == by[1]["lang_pred"] == by[2]["lang_pred"] == "und" and by[4]["lang_pred"] in ("en", "fr")
    assert all(0 <= r["score"] <= 1 for r in by.values())
    by = {r["doc_id"]: r for r in OPERATORS["quality"](spark, odd_docs).collect()}
    assert by[0]["base_failed"] and by[9]["base_failed"] and not by[4]["base_failed"] and by[8]["n_dup_lines"] == 299


@pytest.mark.parametrize("i", range(5))
def test_stages(spark, tmp_path, odd_docs, no_docs, i):
    _labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    _benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = corpus_pipeline.STAGES[i][1]
    out, none = stage(spark, odd_docs, str(tmp_path)), stage(spark, no_docs, str(tmp_path))
    assert none.count() == 0
    if i < 4:
        assert out.columns == none.columns == odd_docs.columns and out.schema.simpleString() == odd_docs.schema.simpleString()
        assert all(r["_g"] == r["_kept"] == r["_hit"] == r["_statistics"] == 1 for r in out.collect())
    kept = {r["doc_id"] for r in out.collect()}
    assert kept <= set(range(12)) and 4 in kept
    assert (5 in kept) == (i not in (1, 2))


def test_chat_rows(spark):
    schema = "conv_id long, turn long, role string, text string, rendered string, part int"
    rows = [(1, 0, "user", "hi", "", 0), (1, 0, "user", "hi", "", 0), (1, None, None, None, "", 0), (None, 2, "assistant", "", "", 0), (2, 1, "user", "Bot: yes\nHuman: no", "", 0)]
    out = chat_format.chat_turns(spark.createDataFrame(rows, schema)).collect()
    assert len(out) >= 5 and sum(r["conv_id"] == 1 and r["turn"] == 0 for r in out) == 2
    assert chat_format.chat_turns(spark.createDataFrame([], schema)).count() == 0


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, host string, print int"
    rows = [(1, "http://a.x/1", None, "", "", 0), (2, None, "", "", "", 0), (3, "http://a.x/3", "<p>One &amp; two<br>x", "", "", 0), (3, "http://a.x/3", "<p>One &amp; two<br>x", "", "", 0), (4, "no url", "<article><p>" + "w " * 200_000, "", "", 0)]
    out = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.main_texts(spark.createDataFrame(rows, schema)).collect())
    assert out[0] == (1, "", 0) and out[1] == (2, "", 0) and out[2] == out[3] == (3, "One & two x", 11) and out[4][2] == 399_999
    assert html_extract.main_texts(spark.createDataFrame([], schema)).count() == 0
