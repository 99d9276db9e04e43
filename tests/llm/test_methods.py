"""Each operator against brute force or known answers."""

import hashlib
import itertools
import math
import re
import textwrap
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tracemill.llm import chat_format as cf
from tracemill.llm import decontaminate, html_extract, language_id, license_scan, minhash, packing, quality_rules, suffix_dedup, toxicity
from tracemill.llm.language_id import identify, train
from tracemill.llm.scan import Chunk

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def removed(texts: dict[int, str], n: int) -> dict[int, bytearray]:
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        out[i] = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                out[i][p : p + n] = b"\1" * n
            seen.add(b[p : p + n])
    return out


@pytest.mark.parametrize("hot", [0, 256])
def test_repeated_bytes(spark, corpus, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 4096)
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()} | {500: "ä" * 120, 501: "b" * 350, 502: "xä" * 80}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    dealt, spans, _ = suffix_dedup.repeated_spans(docs, 100, hot)
    got = {i: bytearray(len((t or "").encode())) for i, t in texts.items()}
    for r in spans.collect():
        got[r["doc_id"]][r["start"] : r["end"]] = b"\1" * (r["end"] - r["start"])
    want = removed(texts, 100)
    assert got == want and any(map(any, want.values()))
    rows = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(docs).collect()}
    for i, t in texts.items():
        raw = t.encode()
        assert rows[i]["kept_sha256"] == hashlib.sha256(bytes(c for c, x in zip(raw, want[i], strict=True) if not x)).hexdigest()
        keep, at = [], 0
        for ch in t:
            size = len(ch.encode())
            keep.append("" if all(want[i][at : at + size]) else ch)
            at += size
        assert rows[i]["kept_text"] == "".join(keep)


def test_decontamination_blocks(spark, corpus, monkeypatch):
    docs = corpus.filter("doc_id < 100")
    passage = corpus.filter("doc_id = 13").first()["text"]
    items = [(i, " ".join(passage.split()[i : i + 20])) for i in range(0, 30, 3)] + [(90, "Ba be"), (91, passage.upper())]
    bench = spark.createDataFrame(items, "item_id int, text string")
    columns = ["doc_id", "n_words", "n_hit", "items", "spans", "longest_words", "longest_start", "contaminated"]
    one = sorted(decontaminate.decontaminate(docs, bench).select(columns).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert sorted(decontaminate.decontaminate(docs, bench).select(columns).collect()) == one
    lower = lambda t: WORD.findall(t.lower())
    for r in one:
        words = lower(corpus.filter(f"doc_id = {r['doc_id']}").first()["text"]) if r["doc_id"] in (1, 4, 13) else None
        if words is None:
            continue
        hit, found = set(), set()
        for i, t in items:
            w = lower(t)
            m = min(13, len(w))
            windows = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)}
            for p in range(len(words) - m + 1):
                if tuple(words[p : p + m]) in windows:
                    hit |= set(range(p, p + m))
                    found.add(str(i))
        assert (r["n_hit"], r["items"], sum(s["end"] - s["start"] for s in r["spans"])) == (len(hit), sorted(found), len(hit))


def test_classes(spark, corpus, monkeypatch):
    bags = {}
    for r in corpus.collect():
        w = WORD.findall(r["text"])
        bags[r["doc_id"]] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    up = {i: i for i in bags}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(bags, 2):
        common = sum((bags[i] & bags[j]).values())
        if common >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - common):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    for block in (16_384, 2):
        monkeypatch.setattr(minhash, "BLOCK", block)
        assert {r["doc_id"]: r["class_id"] for r in minhash.minhash_dedup(corpus).collect()} == {i: root(i) for i in bags}


def test_chain_without_a_common_neighbour(spark):
    """Neighbours are alike, the ends are not: a bucket led by an end is compared across components."""
    base = [f"w{i}" for i in range(100)]
    texts = []
    for step in range(12):
        texts.append(" ".join([f"n{i}" for i in range(step * 4)] + base[step * 4 :]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["class_id"] for r in minhash.minhash_dedup(docs).collect()} == {0}


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 20, 200)
    b = np.maximum(a + rng.integers(-6, 7, 200), 0)
    e = minhash.mix(np.arange(1, 201, dtype=np.uint64))
    some = b > 0
    owner = np.concatenate([np.zeros(200, int), np.ones(some.sum(), int)])
    sign = minhash.bag_minhash(owner, np.concatenate([e, e[some]]), np.concatenate([a, b[some]]), 2, 8192)
    assert abs((sign[0] == sign[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.025


def test_statistics_and_list(spark, corpus):
    texts = [r["text"] for r in corpus.collect()] + ["a b c\na b c\n\nx a b c", "# $ | é日 <b>&amp;", "q\x0bw\x0ce\x85r"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.with_statistics(docs, "s").collect():
        t = texts[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(windows)
        repeat = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
        s = r["s"]
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(repeat))
    rng = np.random.default_rng(0)
    rows = {"symbol_share": rng.random(2000), "mean_word": 3 + 4 * rng.random(2000)}
    bad = (rows["symbol_share"] > 0.7) & (rows["mean_word"] < 5)
    rules = quality_rules.learn_list(rows, bad, np.arange(2000) % 3 == 0)
    hit = np.any([quality_rules._covered(r, rows, 2000) for r in rules], axis=0)
    assert (hit & bad).sum() >= 0.9 * bad.sum() and (hit & ~bad).sum() <= 0.02 * bad.sum()


def test_boundaries_are_optimal():
    rng = np.random.default_rng(5)
    for _ in range(20):
        tops = np.sort(rng.choice(60, 8, replace=False)) + 1
        counts = rng.integers(1, 9, 8)
        for k in (1, 2, 3, 8, 20):
            edges = packing.best_boundaries(tops, counts, tops * counts, k)

            def padding(edges):
                return sum(c * (min(e for e in edges if e >= t) - t) for t, c in zip(tops, counts, strict=True))

            best = min(padding([*some, tops[-1]]) for some in itertools.combinations(tops[:-1], min(k, 8) - 1))
            assert padding(edges) == best and len(edges) <= k


def test_batches(spark, corpus, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 7)
    rows = packing.pack(corpus, buckets=3, budget=300).collect()
    assert len(rows) == corpus.count() == len({(r["bucket"], r["batch"], r["slot"]) for r in rows})
    for bucket in {r["bucket"] for r in rows}:
        inside = [r for r in rows if r["bucket"] == bucket]
        held = max(1, 300 // inside[0]["boundary"])
        full = Counter(r["batch"] for r in inside)
        assert all(r["padding"] >= 0 for r in inside) and sorted(full.values())[1:] == [held] * (len(full) - 1)


def test_mixture(spark):
    texts = [("the house and the garden are there with them " * 5, "en"), ("le chat est dans la maison avec nous pour toujours " * 5, "fr"), ("das haus ist nicht sehr schön und der garten auch " * 5, "de")]
    langs, model = train(spark.createDataFrame(texts * 3, "text string, lang string"))
    asked = [(0, "the garden and the house"), (1, "la maison est pour nous"), (2, texts[0][0] * 3 + texts[1][0] * 3), (3, "12 34 !"), (4, "日本語")]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(asked, "doc_id long, text string"), langs, model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 3)] == ["en", "fr", "und"] and set(got[2]["langs"]) == {"en", "fr"} and got[4]["lang_pred"] != "und"
    assert identify(spark.createDataFrame(asked, "doc_id long, text string"), [], np.zeros((1 << 16, 0))).filter("lang_pred = 'und'").count() == 5


def test_viterbi_and_cut_conversations(spark, monkeypatch):
    model = cf.Model(Counter({("start", "user"): 5, ("turn", "user", "assistant"): 9, ("turn", "assistant", "user"): 9, ("emit", "length", 3, "user"): 4, ("emit", "length", 7, "assistant"): 4}), ["assistant", "user"])
    rng = np.random.default_rng(0)
    rows = [(i, "x" * int(n)) for i, n in enumerate(rng.choice([4, 5, 60, 70], 9))]

    def score(states):
        total = 0.0
        for i, (s, (_, t)) in enumerate(zip(states, rows, strict=True)):
            total += model.emission(cf.observe(t)[0][0])[s] + (model.turn[states[i - 1], s] if i else model.start[s])
        return total

    best = max(itertools.product(range(2), repeat=9), key=score)
    assert [r for *_, r in cf.viterbi(model, rows, None, None)] == list(best)
    data = [(c, t, "user" if (t + c) % 2 else "assistant", ("w " * (40 if (t + c) % 2 == 0 else 4)) + ("\nUser: why\nBot: so" if t % 5 == 0 else "")) for c in range(3) for t in range(70 if c == 1 else 5)]
    turns = spark.createDataFrame(data, "conv_id int, turn int, role string, text string")
    whole = sorted(cf.chat_turns(turns).collect())
    monkeypatch.setattr(cf, "PART_ROWS", 9)
    assert sorted(cf.chat_turns(turns).collect()) == whole
    assert any(r["part"] == 2 and r["role"] == "assistant" and r["text"] == "so" for r in whole)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body class="page"><header class="masthead"><a href="/">Site</a></header>
<div class="cookie-notice">We use cookies</div><nav><ul><li>menu {i}</li></ul></nav>{open}<h1>Title {i}</h1><p>First <b>bold</b> &amp; plain
text {i}.</p><script>var x="</p>";</script><form><input><p>Mail</p></form><div class="promo">Buy now</div><p>Second &#233; {i}<br>line</p>{close}
<aside class="sidebar"><p>Side</p></aside><section id="comments"><article class="comment"><p>Nice {i}</p></article></section><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize("marks", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("<div>", "</div>")])
def test_extraction(spark, marks):
    pages = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(i=i, open=marks[0], close=marks[1])) for i in range(24)]
    out = {r["page_id"]: r["text"] for r in html_extract.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Title {i}\nFirst bold & plain text {i}.\nSecond é {i} line" for i in range(24)), out[0]


def test_template_nodes(spark):
    """A constant block inside the articles of a host is template, also without any mark; varying blocks are not."""
    page = "<article><h1>T{i}</h1><div class='x'>Read more on our site</div><p>Body {i}</p></article>"
    pages = [(i, "http://h.example/p", page.format(i=i)) for i in range(20)]
    out = {r["page_id"]: r["text"] for r in html_extract.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[3] == "T3\nBody 3"


def test_licenses(spark):
    texts = [f"Copyright (c) 2020 Someone\n\n{license_scan._MIT.upper()}", "some text\n  licensed under the apache LICENCE, version 2.0!\nmore", "Copyright 2020 x", license_scan._ISC.replace(" ", "  \t"), "SPDX-License-Identifier: GPL-3.0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["text_license"], r["licenses"]) for r in license_scan.license_scan(docs).collect()}
    assert got == {0: ("MIT", ["MIT"]), 1: (None, ["Apache-2.0"]), 2: (None, []), 3: ("ISC", ["ISC"]), 4: ("GPL-3.0", ["GPL-3.0"])}


def test_clauses(spark, corpus):
    rng = np.random.default_rng(4)
    plain = [r["text"] for r in corpus.collect()]
    rows = []
    for i in range(240):
        w = plain[i % 60].split() + [f"u{i}"]
        toxic = i % 4 == 0
        if toxic:
            for bad in rng.choice(["zuk", "glompen", "glomter"], 2):
                w.insert(int(rng.integers(0, len(w))), str(bad))
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic").filter("doc_id < 180"))
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs.select("doc_id", "text"), grammar).collect()}
    assert np.mean([out[i]["predicted"] == t for i, _, t in rows if i >= 180]) > 0.95
    asked = spark.createDataFrame([(0, "you zuk"), (1, "ba be"), (2, "glomxx ba. ba")], "doc_id long, text string")
    states = {r["doc_id"]: r["states"] for r in toxicity.toxicity(asked, grammar).collect()}
    assert states[0] == ["insult_aimed_free"] and states[1] == [] and states[2] == ["insult_plain_free"]


def test_oracles_on_a_small_table(spark, corpus, tmp_path):
    """The SQL of the license scan and of decontamination against the operators."""
    from tracemill.llm.queries import ORACLES, QUERIES

    bench = spark.createDataFrame([(1, corpus.first()["text"]), (20, "ba")], "item_id long, text string")
    corpus.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("op3_decontaminate", "op4_license_scan"):
        rows = QUERIES[name](spark, str(tmp_path)).toPandas()
        want = con.execute(ORACLES[name]).df()[list(rows.columns)]
        key = lambda d: d.astype(object).where(d.notna(), None).astype(str).sort_values("doc_id").reset_index(drop=True)
        assert key(rows).equals(key(want))


def _wrapped(text, width):
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in re.split(r"\n\s*\n|\n(?=[A-Z0-9(])", text))


def test_whole_licenses_at_any_wrap(spark):
    """Every listed text with a copyright line, at five widths; published files where this machine has them."""
    known = [(i, t) for i, t in license_scan.known_licenses() if len(t) > 500]
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    folder = Path("/usr/share/common-licenses")
    published = [(i, (folder / f).read_text()) for f, i in files.items() if (folder / f).exists()]
    rows, want = [], []
    for i, t in known + published:
        for width in (60, 66, 70, 76, 100):
            own = "" if (i, t) in published else "Copyright (c) 2021, Some Holder. All rights reserved.\n\n"
            text = "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_on_hyphens=False) for p in re.split(r"\n\s*\n", t)) if not own else _wrapped(t, width)
            rows.append((len(rows), own + text)), want.append(i)
    got = {r["doc_id"]: r["text_license"] for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(rows))] == want


def test_license_rows_with_null_and_repeated_ids(spark):
    rows = [(None, license_scan._MIT), (1, "x"), (1, license_scan._ISC), (2, license_scan._MIT + "\nand more"), (None, None)]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["text_license"])) for r in got) == [("1", "ISC"), ("1", "None"), ("2", "None"), ("None", "MIT"), ("None", "None")]


def test_grammar_paths_against_rules():
    """End states of whole clauses against what stands in them, for clauses of many lengths."""
    rng = np.random.default_rng(4)
    clauses = [rng.choice(6, size=int(n), p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.1]) for n in rng.integers(1, 9, 400)] + [rng.integers(0, 6, 3000), np.zeros(2500, int), np.ones(1, int), np.full(5, 2)]
    clauses += [np.array(c) for n in (1, 2, 3) for c in itertools.product(range(6), repeat=n)]
    symbol, clause = np.concatenate(clauses), np.repeat(np.arange(len(clauses)), [len(c) for c in clauses])
    got = toxicity.ACCEPT[toxicity.end_states(symbol, clause)]
    for c, state in zip(clauses, got, strict=True):
        insult, threat, target, negation, report = (x in c for x in (toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT))
        name = "insult" if insult and len(c) > 1 else "threat" if threat and target else None
        mood = "reported" if report else "negated" if negation else "free"
        assert (toxicity.STATES[state] if state >= 0 else None) == (name and f"{name}_{'aimed' if target else 'plain'}_{mood}")


def test_clause_states(spark):
    grammar = toxicity.Grammar()
    grammar.tables = {0: (toxicity.fingerprint(["zukko"]), np.array([5.0]))}
    x = np.zeros((400, 7))
    bad = np.arange(400) % 4 == 0
    x[bad, 0], x[bad, 1] = 5.0, np.log1p(5.0)
    grammar.weights, grammar.bias = toxicity.fit_weights(x, bad.astype(float))
    asked = {
        "zukko": [], "the garden zukko is nice": ["insult_plain_free"], "you are a zukko": ["insult_aimed_free"], "you are not a zukko": ["insult_aimed_negated"],
        "zukko he is not": ["insult_aimed_negated"], "she wrote in her long and careful letter that he is a zukko": ["insult_aimed_reported"],
        "he kills you": ["threat_aimed_free"], "I will kill you tomorrow": ["threat_aimed_free"], "kill": [],
    }
    out = {r["doc_id"]: r for r in toxicity.toxicity(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), grammar).collect()}
    assert [out[i]["states"] for i in range(len(asked))] == list(asked.values())
    lone, plain, aimed, negated, denied, reported, *threats, kill = (out[i]["score"] for i in range(len(asked)))
    assert lone == kill < 0.1 and aimed > plain > negated and min(aimed, *threats) > 0.3 and reported < aimed and denied < aimed


def test_language_sets_by_hand(spark):
    """EM and the choice of the set against plain loops; four languages in one text."""
    rng = np.random.default_rng(11)
    letters = ["abcdef", "ghijkl", "mnopqr", "stuvwx", "yzabgh"]
    text = lambda lang, n: " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(n))
    langs, model = train(spark.createDataFrame([(text(x, 400), f"l{x}") for x in range(5)], "text string, lang string"))
    asked = ["".join(text(x, 60) + " " for x in (0, 1, 2, 3)), text(4, 50), text(1, 40) + " " + text(2, 80)]
    batch = pa.RecordBatch.from_arrays([pa.array(asked)], ["text"])
    owner, bins = language_id.trigrams(Chunk(batch, "text"))
    shares, _ = language_id.mixtures(owner, bins, 3, model)
    for i in range(3):
        mine = bins[owner == i]
        like = [[sum(float(model[b, j]) for b in mine[k : k + language_id.STRETCH]) for j in range(5)] for k in range(0, len(mine), language_id.STRETCH)]
        total = [sum(x[j] for x in like) for j in range(5)]
        like = [[math.exp(x - max(row)) for x in row] for row in like]
        share = [0.2] * 5
        for _ in range(language_id.ROUNDS):
            weighed = [[s * x for s, x in zip(share, row, strict=True)] for row in like]
            share = [max(sum(w[j] / sum(w) for w in weighed) / len(like), 1e-12) for j in range(5)]
        order = sorted(range(5), key=lambda j: -share[j])
        best = (-math.inf, None)
        for k in range(1, 6):
            inside = {total.index(max(total)): 1.0} if k == 1 else {j: share[j] / sum(share[x] for x in order[:k]) for j in order[:k]}
            fit = sum(math.log(max(sum(s * row[j] for j, s in inside.items()), 1e-300)) for row in like) - language_id.PENALTY * k * math.log1p(len(like))
            best = max(best, (fit, inside), key=lambda x: x[0])
        assert {j for j in range(5) if shares[i, j] > 0} == set(best[1])
        assert all(abs(shares[i, j] - s) < 1e-4 for j, s in best[1].items())
    assert [set(np.flatnonzero(shares[i])) for i in range(3)] == [{0, 1, 2, 3}, {4}, {1, 2}]
