"""Trace operators on inline traces, and against a brute-force model on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from tests.brute import merge, read
from tracemill.operators import events as ev
from tracemill.operators import report as rp
from tracemill.operators import transactions as tr
from tracemill.operators.transactions import TX
from tracemill.plans.trace_report import analyze
from tracemill.sources.refdata import clean_specs

PAYMENT_ECHO_GHOST = """2025-03-04 17:20:11.120 0007 TILL_A|4| - M.T.I : [1100]
2025-03-04 17:20:11.121 0007 TILL_A|4| INTERNAL STAN} 6 550017
2025-03-04 17:20:11.123 0007 TILL_A|4| PAN} 16 5412345678901232
2025-03-04 17:20:11.130 0007 TILL_A|4| - FLD (037) : (12) : [506317550017]
2025-03-04 17:20:11.190 0007 TILL_A|4| - FLD (039) : (2) : [00]
2025-03-04 17:20:14.000 0009 ECHO_B|4| - M.T.I : [0800]
2025-03-04 17:20:14.004 0009 ECHO_B|4| INTERNAL STAN} 6 000093
2025-03-04 17:20:14.009 0009 ECHO_B|4| - FLD (070) : (3) : [301]
2025-03-04 17:20:15.000 0011 LOST_C|4| lecture du journal
2025-03-04 17:20:15.002 0011 LOST_C|4| fin sans identifiant"""


def trace(spark, text, file_id="T"):
    rows = [(file_id, i, line) for i, line in enumerate(text.split("\n"), 1)]
    return spark.createDataFrame(rows, "file_id string, line_no bigint, line string")


def specs(spark, *names):
    rows = [(n, "mod", "/src", "texte", "NOK", i) for i, n in enumerate(names)]
    return clean_specs(spark.createDataFrame(rows, "function string, source string, path string, description string, exception string, row_no int"))


@pytest.mark.parametrize("block", [2, 1 << 20])
def test_payment_echo_and_ghost(spark, block):
    result = analyze(trace(spark, PAYMENT_ECHO_GHOST), block=block)
    rows = result.transactions.collect()
    assert [(r["session_id"], r["stan"], r["pan"], r["rrn"], r["approval"]) for r in rows] == [
        ("TILL_A", "550017", "5412345678901232", "506317550017", "Approuvée")
    ]
    summary = result.summary().collect()[0]
    assert (summary["transactions"], summary["heartbeats"], summary["alerts"]) == (1, 1, 0)
    text = [r["text"] for r in result.text().orderBy("tx_no", "section", "at").collect()]
    assert text[1] == "STAN: 550017 | PAN: ************1232 | ID: N/A"
    assert text[-2:] == ["Alertes: Aucune", "Fonctions OK: Aucune"]


def test_hsm_and_failures(spark):
    text = "\n".join(
        f"2025-03-04 17:20:11.000 0001 S1|4| {m}"
        for m in (
            "- M.T.I : [1100]",
            "INTERNAL STAN} 6 550044",
            "FetchFirstLeg() : résultat -1",
            "StoreVoucher () (NOK)",
            "TO HSM : Command=VK",
            "HsmResultCode = 99",
            "End MapBranch (fine)",
            "- FLD (003) : (6) : [ABC]",
            "mot libre",
        )
    )
    result = analyze(trace(spark, text), specs=specs(spark, "MapBranch", "StoreVoucher", "FetchFirstLeg"))
    failed = result.failed_functions().orderBy("first_seen").select("name").collect()
    assert [r["name"] for r in failed] == ["FetchFirstLeg", "StoreVoucher"]
    alerts = [r["alert"] for r in result.alerts().orderBy("first_seen").collect()]
    assert alerts[0] == "FetchFirstLeg() a échoué (résultat : résultat -1)."
    assert "Erreur HSM détectée : Code d'erreur HSM 99." in alerts and len(alerts) == 4
    kinds = [r["kind"] for r in result.events.orderBy("at").collect()]
    assert kinds == ["mti", "failed", "failed", "to_hsm", "hsm_result", "succeeded", "field", "network", "format"]
    full = analyze(trace(spark, text), mode="full").events
    assert full.filter("kind = 'line' AND text LIKE '%mot libre'").count() == 1


FAILURES = [
    ("ReadLimits", "End   ReadLimits NOK ( -1 )", "NOK ( -1 )"),
    ("StoreVoucher", "End StoreVoucher ( NOK )", "( NOK )"),
    ("LoadClock", "End LoadClock(-1)", "(-1)"),
    ("MapBranch", "End MapBranch NOK (-1)", "NOK (-1)"),
    ("verify_frame_no", "End verify_frame_no NOK", "NOK"),
    ("Put_ReplyBlock", "End Put_ReplyBlock ( NOK )", "( NOK )"),
    ("FindRoute", "End FindRoute != OK", "!= OK"),
    ("FindRoute", "End FindRoute ERROR", "ERROR"),
    ("FindRoute", "End FindRoute( -1 )", "( -1 )"),
    ("FetchFirstLeg", "FetchFirstLeg() : resultat -1.", "resultat -1"),
    ("FetchFirstLeg", "FetchFirstLeg() result=-1", "result=-1"),
    ("FetchFirstLeg", "FetchFirstLeg() NOK (-1)", "NOK (-1)"),
]


@pytest.mark.parametrize("documented", [True, False])
def test_failure_matrix(spark, documented):
    text = "\n".join(f"2025-03-04 17:20:11.000 0001 S{i}|4| {line}" for i, (_, line, _) in enumerate(FAILURES))
    known = specs(spark, *sorted({f for f, _, _ in FAILURES})) if documented else None
    rows = ev.chronology(trace(spark, text), known).collect()
    found = {(r["line_no"], r["name"], r["kind"]): r["alert"] for r in rows}
    for i, (name, _, code) in enumerate(FAILURES, 1):
        alert = found[(i, name, "failed" if documented else "undocumented")]
        assert alert.startswith(f"{name}() a échoué (résultat : {code})"), alert


def test_line_grammar(spark):
    from tracemill.functions.trace_line import split_line

    text = "\n".join(["a b S|4| m", "a b S| m", "S|4| m", "a S |4| m", "  10:00 x S|D|msg|more ", "2024/1/1 10:00 S|4|", ""])
    rows = {r["line_no"]: r for r in split_line(trace(spark, text)).collect()}
    assert set(rows) == {1, 2, 5, 6}
    assert (rows[2]["level"], rows[2]["message"], rows[2]["ts_text"]) == ("m", "m", None)
    assert (rows[5]["ts_text"], rows[5]["message"]) == ("10:00", "msg|more")
    assert (rows[6]["ts_text"], rows[6]["message"]) == ("2024/1/1 10:00", "")


def random_trace(seed, n=160):
    rng = random.Random(seed)
    sessions = [f"S{i}" for i in range(4)]
    hot = lambda: rng.choice(sessions + ["S0"] * 4)
    lines = []
    for i in range(1, n + 1):
        message = rng.choice(
            [
                f"- M.T.I : [{rng.choice(['0200', '0800', '1110', '1100'])}]",
                f"M.T.I : [{rng.choice(['0210', '1110'])}]",
                f"INTERNAL STAN}} 6 {rng.randint(1, 5):06d}",
                f"- FLD (011) : (6) : [{rng.randint(1, 5):06d}]",
                f"- FLD (037) : (12) : [{rng.randint(1, 6):012d}]",
                f"FLD (039) : (2) : [{rng.choice(['00', '05', '51'])}]",
                f"- FLD (003) : (6) : [{rng.choice(['000000', 'AB'])}]",
                "FLD (070) : (3) : [301]",
                f"End Fn{rng.randint(0, 3)}x NOK (-1)",
                "rien",
            ]
        )
        lines.append((i, "" if rng.random() < 0.03 else f"2024-01-01 00:00:00 1 {hot()}|4| {message}"))
    return lines


@pytest.mark.parametrize("seed,block", [(2, 3), (4, 16)])
def test_against_brute_force(spark, seed, block):
    files = {f"F{k}": random_trace(seed * 10 + k) for k in range(3)}
    rows = [(f, no, line) for f, lines in files.items() for no, line in lines]
    lines = spark.createDataFrame(rows, "file_id string, line_no bigint, line string").repartition(5)

    segmented = tr.segments(tr.line_facts(lines), responses=True, block=block)
    tx = tr.response_as_of(tr.drop_ghosts(tr.assemble(segmented)), tr.response_pairs(segmented), block=block)
    got = {
        (r["file_id"], r["session_id"], r["close_line"], r["mti"], r["is_heartbeat"], r["stan"], r["rrn"], r["response_code"], r["network_response"])
        for r in tx.collect()
    }
    want = {
        (f, t["session"], t["close"], t["mti"], t["hb"], t["stan"], t["rrn"], t["code"], t["network"])
        for f, ls in files.items()
        for t in read(ls)
    }
    assert got == want

    result = analyze(lines, keep_heartbeats=True, block=block)
    failed = {}
    for r in result.failed_functions().orderBy("first_seen").collect():
        failed.setdefault((r["file_id"], r["session_id"], r["seg"]), []).append(r["name"])
    fields = {}
    for r in result.fields.collect():
        fields.setdefault((r["file_id"], r["session_id"], r["seg"]), {})[r["field_number"]] = r["value"]
    order = tr.file_order(result.transactions, block=block).orderBy("file_id", "tx_no").collect()
    got = [
        (r["file_id"], r["session_id"], r["mti"], r["is_heartbeat"], r["stan"], r["rrn"], r["response_code"], r["parts"],
         failed.get((r["file_id"], r["session_id"], r["seg"]), []), fields.get((r["file_id"], r["session_id"], r["seg"]), {}))
        for r in order
    ]
    want = [
        (f, t["session"], t["mti"], t["hb"], t["stan"], t["rrn"], t["code"], t["parts"], t["fns"], t["fields"])
        for f, ls in files.items()
        for t in merge(read(ls))
    ]
    assert got == want


def test_long_specification(spark, monkeypatch):
    from tracemill.operators import containment, events

    text = "\n".join(f"2025-03-04 17:20:11.000 0001 S|4| End Function{i}x NOK" for i in range(6))
    known = specs(spark, *[f"Function{i}x" for i in range(4)], "ab", "x")
    plain = {(r["line_no"], r["name"], r["kind"]) for r in ev.line_events(ev.with_documented_names(tr.line_facts(trace(spark, text)), known)).collect()}
    monkeypatch.setattr(events, "LITERAL_NAMES", 1)
    monkeypatch.setattr(containment, "AUTOMATON_BYTES", 30)
    searched = {(r["line_no"], r["name"], r["kind"]) for r in ev.line_events(ev.with_documented_names(tr.line_facts(trace(spark, text)), known)).collect()}
    assert plain == searched and len(plain) > 6


def test_report_top_and_badge(spark):
    result = analyze(trace(spark, PAYMENT_ECHO_GHOST), keep_heartbeats=True)
    assert [r["session_id"] for r in result.report().collect()] == ["TILL_A"]
    assert {r["badge"] for r in rp.alert_badge(result.transactions).collect()} == {0}
    assert result.transactions.select(*TX).distinct().count() == 2
    assert result.merged.agg(F.count_if("is_heartbeat")).collect()[0][0] == 1
