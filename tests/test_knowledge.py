"""Conformance, codes, questions, excerpts, reports and stores on the documented cases."""

import json
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracemill.functions import payload as pl
from tracemill.functions import questions as qf
from tracemill.operators import chunkstore as cs
from tracemill.operators import context as cx
from tracemill.operators import documentation as dc
from tracemill.operators import report as rp
from tracemill.operators import retrieval as rt
from tracemill.operators import store as st
from tracemill.operators.fields import conformance
from tracemill.sources import refdata as rd


def test_field_conformance(spark):
    rows = [("002", "12345a789"), ("003", ""), ("003", "000000"), ("011", "123456"), ("010", "61000000"), ("010", "ABC"), ("037", "402812345678"),
            ("039", "00"), ("052", "0123456789ABCDEF"), ("2", "4000****9010"), ("200", "PROP"), ("201", "123456"), ("066", "ABCDEFGH"), ("300", "12")]
    fields = spark.createDataFrame(rows, "field_number string, value string")
    chunks = spark.createDataFrame(
        [(1, "S", "Field 200 Prop. Attributes 3 AN, EBCDIC", "Prop", "", "doc.pdf", "text", None), (2, "T", "x", "Autre", "4 N", "glob.pdf", "field_definition", "201"), (3, "T", "x", "Connu", "2 N", "glob.pdf", "field_definition", "066")],
        "chunk_id int, session_id string, text string, field_name string, attributes string, source string, type string, field_number string",
    )
    reference = rd.field_reference(spark)
    known = reference.unionByName(reference.limit(1).withColumns({"field_key": F.lit("66"), "attributes": F.lit("C0")}))
    bad = {(r["field_number"], r["value"]): r for r in conformance(fields, known, chunks, "S").collect()}
    assert set(bad) == {("002", "12345a789"), ("003", ""), ("010", "ABC"), ("052", "0123456789ABCDEF"), ("200", "PROP"), ("201", "123456")}
    assert bad[("002", "12345a789")]["attributes"] == "19 N"
    assert bad[("002", "12345a789")]["non_conformity_type"] == "contient des lettres/symboles non conformes (attendu numérique)"
    assert (bad[("003", "")]["observed_value"], bad[("003", "")]["non_conformity_type"]) == ("(vide)", "Champ absent de la trace")
    assert bad[("200", "PROP")]["source"] == "doc.pdf" and bad[("200", "PROP")]["attributes"] == "3 AN"
    assert bad[("201", "123456")]["non_conformity_type"] == "longueur (6) dépasse le maximum (4)"
    assert "valeur observée 'ABC' — " in bad[("010", "ABC")]["message"]


def test_hsm_codes(spark):
    resolved = rd.resolve_codes(rd.command_pairs(spark))
    raw = ["05", "ED05", "Erreur HSM détectée : Code d'erreur HSM 05.", "Code Résultat HSM (HsmResultCode) : 99", "ED", "EC", "ED_05", "7", " "]
    codes = spark.createDataFrame(list(enumerate(raw)), "query_id int, raw string")
    got = {r["query_id"]: (r["lookup_key"], r["command_code"], r["response_code"], r["error_number"], r["display"]) for r in dc.parse_hsm_codes(codes, resolved).collect()}
    assert got[0] == ("05", None, None, "05", "05")
    assert got[1] == ("ED05", "EC", "ED", "05", "EC → ED / 05")
    assert got[2][0] == "05" and got[3][0] == "99"
    assert got[4][:3] == ("ED", "EC", "ED") and got[5][:3] == ("EC", "EC", "ED")
    assert got[6][0] in ("05", "ED05") and got[7][0] == "07" and got[8][0] == ""
    entries = dc.dictionary_entries(dc.parse_hsm_codes(codes, resolved), rd.hsm_errors(spark))
    assert {(r["query_id"], r["entry_code"]) for r in entries.collect()} >= {(0, "05"), (1, "ED05"), (3, "99"), (4, "ED"), (5, "EC")}


def test_questions(spark):
    rows = ["réponse ED", "la commande EC est-elle valide ?", "commande dont la réponse est CB", "Quel est le code de réponse 'ED' ?", "valeur du champ 039 ?", "Résume-moi l'ensemble"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, q string").select("i", qf.code_tokens("q").alias("c"), qf.first_field_number("q").alias("n"), qf.chunks_wanted("q").alias("k"))
    got = {r["i"]: r for r in df.collect()}
    assert [got[i]["c"] for i in range(3)] == [["ED"], ["EC"], ["CB"]] and got[3]["c"][0] == "ED"
    assert (got[4]["n"], got[4]["k"], got[5]["k"]) == ("39", 8, 16)


def test_context_budget_and_counts(spark):
    words = ["ED01" if i in (3, 8) else "rien" for i in range(1, 13)]
    rows = [("f", i, f"=== Transaction {i} === {w} " + "x" * 150) for i, w in enumerate(words, 1)]
    blocks = spark.createDataFrame(rows, "file_id string, block_no bigint, text string")
    counts = cx.term_counts(blocks, spark.createDataFrame([("ED01",)], "term string")).collect()[0]
    assert (counts["occurrences"], counts["transactions"]) == (2, 2)
    classed = blocks.select("file_id", "block_no", cx.block_class(F.col("text"), F.array(F.lit("ED01"))).alias("block_class"), F.length("text").cast("bigint").alias("size"))
    chosen = cx.select_blocks(classed, 1000)
    numbers = {r["block_no"] for r in chosen.collect()}
    assert {3, 8} <= numbers and len(numbers) == 5
    assert "5/12" in cx.inclusion_notice(classed, chosen, 1000).collect()[0]["notice"]


def test_report_enrichment(spark):
    schema = "file_id string, idx int, rrn string, stan string, transaction_id string, failed_functions array<string>, alerts array<string>, processing_code string"
    parser = [("f", 0, "111", None, None, ["GetAuthRouting"], ["GetAuthRouting() a échoué (résultat : NOK)."], "000000"), ("f", 1, None, None, None, ["AuthProcess", "GetAuthRouting"], [], None)]
    report = [("f", 0, " 111 ", None, None, [], [], None, ["Exécution de GetOriginalAuthData() : résultat -1."], ""), ("f", 1, None, None, None, ["AuthProcess"], ["AuthProcess refuse"], "9", [], "connu")]
    out = rp.enrich_report(spark.createDataFrame(report, schema + ", steps array<string>, hint string"), spark.createDataFrame(parser, schema))
    rows = {r["idx"]: r for r in out.collect()}
    assert rows[0]["failed_functions"] == ["GetAuthRouting", "GetOriginalAuthData"] and rows[0]["processing_code"] == "000000"
    assert rows[0]["alerts"][1] == "GetOriginalAuthData() a échoué." and "GetAuthRouting, GetOriginalAuthData" in rows[0]["hint"]
    assert rows[1]["failed_functions"] == ["AuthProcess", "GetAuthRouting"] and rows[1]["hint"] == "connu"
    assert rows[1]["alerts"] == ["AuthProcess refuse", "GetAuthRouting() a échoué."]


def test_command_lookup_modes(spark):
    chunks = spark.createDataFrame(
        [(1, "h1", "A", "EC", "ED", False, "table"), (2, "h1", "A", None, None, True, "codes"), (3, "h2", "B", None, None, False, "the ED word"), (4, "h2", "B", None, None, False, "used")],
        "chunk_id int, file_hash string, session_id string, command_code string, response_code string, contains_error_table boolean, text string",
    )
    resolved = rd.resolve_codes(rd.command_pairs(spark))
    codes = spark.createDataFrame([(1, "ED", None), (2, "ED", "B"), (3, "ZZ", "B")], "query_id int, code string, session_id string")
    strict = [(r["query_id"], r["chunk_id"], r["class"]) for r in rt.command_lookup(codes, chunks, resolved).orderBy("query_id", "rank").collect()]
    assert strict == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 3, 3)]
    numbers = chunks.union(spark.createDataFrame([(5, "h3", "C", None, None, False, "result 123 here")], chunks.schema))
    three = rt.command_lookup(spark.createDataFrame([(1, "123", None)], codes.schema), numbers, resolved).collect()
    assert {(r["chunk_id"], r["class"]) for r in three} >= {(5, 3)}
    loose = {(r["query_id"], r["chunk_id"]) for r in rt.command_lookup(codes, chunks, resolved, loose=True).collect()}
    assert (1, 4) in loose and (2, 4) in loose
    hit = rt.annotate_pair(rt.command_lookup(codes, chunks, resolved).join(chunks.select("chunk_id", "text"), "chunk_id")).filter("query_id = 2").collect()[0]
    assert hit["text"].startswith("[CORRESPONDANCE RAG : Code Réponse 'ED' <-> Code Commande Source 'EC']\n")


def test_store(spark, tmp_path):
    usage = [json.dumps({"usage_metadata": {"input_tokens": 3, "output_tokens": 4, "total_tokens": 0}}), json.dumps({"response_metadata": {"usage": {"input_tokens": 5, "completion_tokens": 1}}}), "{}"]
    got = spark.createDataFrame(list(enumerate(usage)), "i int, r string").select("i", pl.token_usage("r").alias("u")).orderBy("i").collect()
    assert [(r["u"]["input_tokens"], r["u"]["output_tokens"], r["u"]["total_tokens"]) for r in got] == [(3, 4, 7), (5, 1, 6), (0, 0, 0)]
    budget = st.usage_budget(spark.createDataFrame([(600000,), (150000,)], "total_tokens bigint")).collect()[0]
    assert (budget["used"], budget["remaining"], budget["percentage"]) == (750000, 250000, 75.0)
    old = spark.createDataFrame([("a", "t", "2024-01-01", "2024-01-01")], "id string, title string, created_at string, updated_at string")
    new = spark.createDataFrame([("a", "u", "2024-02-01", "2024-02-01"), ("b", "v", "2024-02-01", "2024-02-01")], old.schema)
    rows = {r["id"]: (r["title"], r["created_at"]) for r in st.upsert(old, new).collect()}
    assert rows == {"a": ("u", "2024-01-01"), "b": ("v", "2024-02-01")}
    titles = spark.createDataFrame([(i, "x", "Base", f"2024-01-01 10:0{i // 3}:00") for i in range(5)], "id int, agent_type string, title string, created_at string")
    used = spark.createDataFrame([("x", "Base")], "agent_type string, title string")
    typed = titles.withColumn("created_at", F.to_timestamp("created_at"))
    assert [r["unique_title"] for r in st.unique_titles(typed).orderBy("id").collect()] == ["Base", "Base · 10:00", "Base #2", "Base · 10:01", "Base #3"]
    assert st.unique_titles(typed, used).filter("unique_title = 'Base'").count() == 0
    more = spark.createDataFrame([("x", t) for t in ("Base", "Base · 10:00", "Base #2", "Base #4")], used.schema)
    given = [r["unique_title"] for r in st.unique_titles(typed, more).orderBy("id").collect()]
    assert len(set(given)) == 5 and not set(given) & {"Base", "Base · 10:00", "Base #2", "Base #4"} and given[0] == "Base #3"
    tie = [spark.createDataFrame([("a", t, "2024-01-01", "2024-03-01")], old.schema) for t in ("m", "n")]
    assert st.upsert(*tie).first()["title"] == "n" and st.upsert(*tie[::-1]).first()["title"] == "m"


def titles_one_by_one(rows, stored, limit):
    """The rule over sorted rows: plain, then once a minute, then the next free number."""
    room = limit - 10
    old, plain, given = set(stored), {(a, t[:limit]) for _, a, t, _ in rows}, {}
    taken, seen, minutes, left = old | plain, set(), set(), []
    for i, agent, title, at in sorted(rows, key=lambda r: (r[3], r[0])):
        base, clock = title[:limit], at.strftime("%H:%M")
        if (agent, base) not in seen and (agent, base) not in old:
            given[i] = base
        else:
            timed = base[: limit - 8] + f" · {clock}"
            if (agent, base[:room], clock) not in minutes and (agent, timed) not in taken:
                given[i] = timed
            else:
                left.append((i, agent, base))
            minutes.add((agent, base[:room], clock))
        seen.add((agent, base))
    used = {(a, m[1][:room], int(m[2])) for a, t in taken if (m := re.fullmatch("(?s)(.*) #([1-9][0-9]{0,7})", t))}
    for i, agent, base in left:
        n = 2
        while (agent, base[:room], n) in used:
            n += 1
        used.add((agent, base[:room], n))
        given[i] = base[: limit - len(f" #{n}")] + f" #{n}"
    return given


def test_titles_are_unique_in_all_forms(spark):
    rng = random.Random(8)
    start = datetime(2024, 1, 1, 10)
    names = ["A", "A · 10:00", "A #3", "A #03", "B" * 25, "B" * 24 + "c", "B" * 15 + "x", "A #2 #2", "A · 10:01 #2", "é\n"]
    rows = [(i, rng.choice("xy"), rng.choice(names), start + timedelta(seconds=rng.randrange(180))) for i in range(150)]
    rows += [(1000 + i, "z", "B", start) for i in range(103)] + [(1200, "z", "B #7", start), (1201, "z", "B · 10:00", start)]
    stored = [("x", "A"), ("x", "A #2"), ("x", "A #5"), ("y", "A · 10:01"), ("x", "B" * 15 + " #2"), ("z", "B #50"), ("z", "B #51")]
    frame = spark.createDataFrame(rows, "id int, agent_type string, title string, created_at timestamp")
    known = spark.createDataFrame(stored, "agent_type string, title string")
    for existing in (stored, []):
        got = {r["id"]: r["unique_title"] for r in st.unique_titles(frame, known if existing else None, max_len=25).collect()}
        assert got == titles_one_by_one(rows, existing, 25)
        agents = {i: a for i, a, *_ in rows}
        all_titles = [(agents[i], t) for i, t in got.items()] + existing
        assert len(set(all_titles)) == len(all_titles) and max(map(len, got.values())) <= 25


def test_a_failed_rebuild_leaves_the_collection(spark, tmp_path):
    from tracemill.sources import sinks

    path = str(tmp_path / "collection")
    assert sinks.read_collection(spark, path) is None
    first = sinks.rebuild_collection(spark.range(10), path)
    broken = spark.range(10).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("id"))
    with pytest.raises(Exception, match="lost"):
        sinks.rebuild_collection(broken, path)
    assert sinks.read_collection(spark, path).count() == 10
    second = sinks.rebuild_collection(sinks.read_collection(spark, path).filter("id < 4").withColumn("part", F.col("id") % 2), path, ["part"])
    assert second.count() == 4 and first.count() == 10 and sinks.read_collection(spark, path, 1).count() == 10
    sinks.remove_versions(spark, path, keep=1)
    assert sinks.read_collection(spark, path).count() == 4
    assert len([f for f in (tmp_path / "collection").iterdir() if f.name.startswith("v")]) == 1


def test_chunk_reuse(spark, tmp_path):
    from tracemill.sources.sinks import append_chunks

    rows = [("h", "v2", i) for i in range(5)]
    new = spark.createDataFrame(rows, "file_hash string, chunking_version string, chunk_index int")
    path = str(tmp_path / "store")
    assert append_chunks(new.filter("chunk_index < 3"), path).count() == 3
    assert append_chunks(new, path).count() == 5
    assert append_chunks(new, path).count() == 5
    nameless = spark.createDataFrame([(None, "v2", 1), (None, "v2", 1)], new.schema)
    assert append_chunks(nameless, path).count() == 6 == append_chunks(nameless, path).count()
    old = spark.createDataFrame([("h", "v1", i) for i in range(10)], new.schema)
    stats = cs.hash_stats(old.withColumn("page", F.lit(1))).collect()[0]
    assert not stats["found"] and stats["version_mismatch"]
    assert {(r["chunking_version"], r["chunk_index"]) for r in cs.rebuild_version(old, new).collect()} == {("v2", i) for i in range(5)}


def test_payload_fit(spark):
    df = spark.createDataFrame([("q", "ligne\n" * 1000), ("q" * 50, "court")], "question string, body string")
    out = cx.fit_payload(df, ["question", "body"], 1000, "m").collect()
    assert out[0]["estimated_tokens"] <= 800 and not out[0]["skipped"] and "PAYLOAD_TRUNCATED" in out[0]["body"]
    assert out[1]["body"] == "court" and not out[1]["skipped"]
    array = json.dumps([{"i": i, "t": "a, b: \"é\""} for i in range(400)], ensure_ascii=False)
    whole = json.dumps({"k": list(range(1500)), "s": "a:b"})
    for text in (array, whole):
        cut = cx.fit_payload(spark.createDataFrame([("q", text)], df.schema), ["question", "body"], 2000, "m").first()["body"]
        assert json.loads(cut) and len(cut) < len(text)
        if text is array:
            assert json.dumps(json.loads(cut), ensure_ascii=False) == cut and json.loads(cut) == json.loads(array)[: len(json.loads(cut))]


def test_hsm_documentation_cascade(spark):
    chunks = spark.createDataFrame(
        [
            (1, "h", "A", "doc", 3, "EC", "ED", False, "EC command, error 05 listed"),
            (2, "h", "B", "doc", 4, None, None, False, "ED answers with error codes"),
            (3, "h", "B", "doc", 5, None, None, False, "nothing about it"),
        ],
        "chunk_id int, file_hash string, session_id string, source string, page int, command_code string, response_code string, contains_error_table boolean, text string",
    )
    pages = spark.createDataFrame([("manual", 7, "KA key import, response KB"), ("manual", 8, "unrelated")], "source string, page int, text string")
    codes = spark.createDataFrame([("q1", "ED05", "A"), ("q2", "ED05", "C"), ("q3", "KA", "A"), ("q4", "ZZ", "A")], "query_id string, raw string, session_id string")
    rows = dc.hsm_documentation(codes, chunks, pages, rd.hsm_errors(spark), rd.resolve_codes(rd.command_pairs(spark))).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["origin"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["origin"], r["label"]))
    assert got["q1"] == [("dictionary", "dictionnaire HSM"), ("rag_session", "doc (p. 3)")]
    assert got["q2"] == [("dictionary", "dictionnaire HSM"), ("rag", "doc (p. 3)"), ("rag", "doc (p. 4)")]
    assert got["q3"] == [("page", "manual (p. 7)")]
    assert "q4" not in got
