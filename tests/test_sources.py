"""Files in and out: line numbers over splits, reference files, sheets, the folder watch."""

import json

from pyspark.sql import functions as F

from tracemill.operators.chunkstore import scope
from tracemill.plans.trace_report import analyze
from tracemill.sources import documents as sd
from tracemill.sources import refdata as rd
from tracemill.sources import sinks
from tracemill.sources.traces import read_traces
from tracemill.streaming.landing import watch


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "a.trc68").write_text("\n".join(f"ligne {i}" if i % 7 else "" for i in range(1, 401)))
    (tmp_path / "b.LOG").write_bytes(b"x \xff y S|4| m\nfin\n")
    (tmp_path / "c.pdf").write_text("pas une trace")
    seen = {}
    for size in ("200b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        lines = read_traces(spark, str(tmp_path))
        seen[size] = sorted((r["file_id"].split("/")[-1], r["line_no"], r["line"]) for r in lines.collect())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen["200b"] == seen["128m"] and len(seen["200b"]) == 402
    assert all(line in (f"ligne {no}", "") for name, no, line in seen["200b"] if name == "a.trc68")


def test_reference_files(spark, tmp_path):
    iso = tmp_path / "iso.json"
    iso.write_text(json.dumps({"mti": {"0200": "Demande"}, "fields": {"003": {"name": "PC", "description": "code"}}}, indent=1))
    mti, fields = rd.read_iso_reference(spark, str(iso))
    assert mti.collect()[0]["description"] == "Demande" and fields.collect()[0]["name"] == "PC"
    pairs = tmp_path / "pairs.json"
    pairs.write_text('{"XA": "XB",\n "XC": "XD"}')
    assert {tuple(r) for r in rd.command_pairs(spark, str(pairs)).collect()} == {("XA", "XB"), ("XC", "XD")}
    pairs.write_text("{}")
    assert {tuple(r) for r in rd.command_pairs(spark, str(pairs)).collect()} == {("EC", "ED")}
    sheet = tmp_path / "spec.csv"
    sheet.write_text("function,source,path,description,exception\n F1 ,m,p,ancien,e\n,,,,\nF2,m\nF1,m,p,nouveau,e\n")
    rows = {r["function"]: (r["description"], r["exception"]) for r in rd.read_function_specs(spark, str(sheet)).collect()}
    assert rows == {"F1": ("nouveau", "e"), "F2": ("", "")}
    assert rd.read_function_specs(spark, str(tmp_path / "absent.csv")).count() == 0


def test_documents(spark):
    pages = spark.createDataFrame(
        [("s", 1, "intro\nField 3—Processing Code\nsuite"), ("s", 2, "fin\nField 4-Amount\n 11   STAN   F   4   6   N   BCD\n 11   Autre   9   AN\n 37   RRN   12   AN")],
        "source string, page bigint, text string",
    )
    sections = {r["field_number"]: (r["field_name"], r["page"], r["text"]) for r in sd.field_sections(pages).collect()}
    assert sections["3"] == ("Processing Code", 1, "Field 3—Processing Code\nsuite\nfin")
    assert sections["4"][0] == "Amount" and sections["4"][2].count("\n") == 3
    table = {r["number"]: (r["name"], r["length"], r["type_code"]) for r in sd.field_table(pages).collect()}
    assert table == {"11": ("STAN", 6, "N"), "37": ("RRN", 12, "AN")}
    cells = spark.createDataFrame([("f", "o", 1, " a ", None), ("f", "o", 2, None, " ")], "source string, sheet string, row_no int, x string, y string")
    assert [r["text"] for r in sd.sheet_lines(cells, ["x", "y"]).collect()] == ["Ligne 1: a"]
    store = spark.createDataFrame([(1, "A", "h1"), (2, "B", "h2"), (3, "A", "h3")], "chunk_id int, session_id string, file_hash string")
    assert {r["chunk_id"] for r in scope(store, "A").collect()} == {1, 3}
    assert {r["chunk_id"] for r in scope(store, "A", ["h2"]).collect()} == {1, 2, 3}


def test_long_sections_are_parts_and_files(spark, tmp_path):
    text = {page: "\n".join((["Field 7—Hot"] if page == 0 else []) + [f"ligne {page}/{i} é" for i in range(page % 5)]) for page in range(300)}
    pages = spark.createDataFrame([("s", p, t) for p, t in text.items()] + [("t", 1, "Field 8—Petit\nfin")], "source string, page bigint, text string")
    whole = "\n".join(t for t in text.values() if t)
    rows = sorted((r["part"], r["first_line"], r["line_count"], r["text"]) for r in sd.field_sections(pages, size=64).filter("source = 's'").collect())
    assert "\n".join(r[3] for r in rows) == whole and [r[1] for r in rows] == list(range(1, whole.count("\n") + 2, 64))
    assert all(r[2] == r[3].count("\n") + 1 for r in rows) and sd.field_sections(pages).count() == 2
    lines = sd.field_section_lines(pages).select("source", "section", "page", "i", F.col("line").alias("text"))
    path = str(tmp_path / "texts")
    manifest = sinks.write_texts(lines, path, ["source", "section"], ["page", "i"], parts=6)
    mine = manifest.filter("source = 's'").orderBy("part").collect()
    assert len(mine) > 3 and sum(r["bytes"] for r in mine) == len(whole.encode()) + 1
    for a, b in zip(mine, mine[1:]):
        assert b["first_line"] == a["first_line"] + a["line_count"] and b["first_byte"] == a["first_byte"] + a["bytes"]
    back = sinks.read_texts(spark, path, spark.createDataFrame([("s",)], "source string").join(lines.select("source", "section").distinct(), "source"), ["source", "section"], ["page", "i"])
    assert "\n".join(r["text"] for r in back.collect()) == whole


MIXED = """
2025-02-11 08:15:00.000 DEBUG LINK_A| - M.T.I : [0800] echo
2025-02-11 08:15:00.040 DEBUG LINK_A| FLD (070) : (03) : [301]
2025-02-11 08:15:09.000 DEBUG POS_7| - M.T.I : [0100] purchase
2025-02-11 08:15:09.010 DEBUG POS_7| TRANSACTION_IDENTIFIER} 9 REF-55-AB
2025-02-11 08:15:09.020 DEBUG POS_7| INTERNAL STAN} 6 731904
2025-02-11 08:15:09.030 DEBUG POS_7| PAN} 16 5200828282828210
2025-02-11 08:15:09.200 DEBUG POS_7| FLD (037) : (12) : [504208731904]
2025-02-11 08:15:09.300 DEBUG POS_7| FLD (039) : (02) : [00]
2025-02-11 08:15:20.000 DEBUG LINK_B| - M.T.I : [0810] echo reply
2025-02-11 08:15:31.000 DEBUG ATM_3| - M.T.I : [0200] withdrawal
2025-02-11 08:15:31.050 DEBUG ATM_3| INTERNAL STAN} 6 731950
2025-02-11 08:15:31.400 DEBUG ATM_3| FLD (039) : (02) : [51]
"""


def test_mixed_trace_and_folder_watch(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "t1.txt").write_text(MIXED)
    result = analyze(read_traces(spark, str(landing)))
    assert {r["stan"]: (r["mti"], r["transaction_id"]) for r in result.transactions.collect()} == {"731904": ("0100", "REF-55-AB"), "731950": ("0200", None)}
    assert result.summary().collect()[0]["heartbeats"] == 2
    sinks.write_trace_report(result.text(), str(tmp_path / "report"))
    report = spark.read.text(str(tmp_path / "report"))
    assert report.filter("value LIKE '=== Transaction%'").count() == 2
    assert {r["file_id"] for r in report.select("file_id").distinct().collect()} == {r["file_id"] for r in result.transactions.select("file_id").distinct().collect()}
    for name in ("t1.txt", "t2.txt"):
        (landing / name).write_text(MIXED)
        watch(spark, str(landing), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "transactions")).count() == 4
