"""A plain, one-line-at-a-time model of the trace rules, used to check the Spark operators on small traces."""

import re

MTI = re.compile(r"M\.?\s*T\.?\s*I\.?\s*:+\s*\[?(\d{3,4})\]?", re.I)
FAIL = r"(?:NOK\s*\(\s*-\d+\s*\)|NOK|\(\s*-\d+\s*\)|!=\s*OK)"


def read(lines):
    """Transactions of one file in saving order, before merging."""
    now, order, pairs, waiting, out = {}, [], [], {}, []

    def close(session, at):
        tx = now[session]
        if tx["hb"] or any(tx[k] for k in ("stan", "txid", "rrn", "pan")):
            known = [p for p in pairs if p[1] == tx["stan"]]
            out.append({**tx, "close": at, "network": known[-1][2] if known and tx["stan"] else None})

    for no, raw in lines:
        line = raw.strip()
        prefix, bar, rest = line.partition("|")
        words = prefix.split()
        if not bar or len(words) < 2 or prefix != prefix.rstrip():
            continue
        session = words[-1]
        mti = MTI.search(line)
        m011 = re.search(r"FLD\s*\(011\)\s*:?[^:]*:\s*\[?(\d+)", line)
        m037 = re.search(r"FLD\s*\(037\).*?\[([^\]]+)\]", line)
        m039 = re.search(r"FLD\s*\(039\).*?\[([^\]]+)\]", line)
        if mti and mti.group(1) == "1110":
            waiting[session] = [None, None]
        elif session in waiting:
            if m011:
                waiting[session][0] = m011.group(1)
            if m039:
                waiting[session][1] = m039.group(1)
            if all(waiting[session]):
                pairs.append((no, *waiting.pop(session)))
        start = re.search(r"-\s*" + MTI.pattern, line, re.I)
        if session not in order:
            order.append(session)
        if start or session not in now:
            if start and session in now:
                close(session, no)
            now[session] = dict(
                session=session, first=no, mti=None, hb=False, stan=None, txid=None, pan=None, rrn=None, code=None, fns=[], fields={}
            )
        tx = now[session]
        if mti:
            tx["mti"] = mti.group(1)
            tx["hb"] |= mti.group(1).zfill(4)[1] == "8"
        if start:
            continue
        tx["hb"] |= "FLD (070)" in line and "[301]" in line
        for key, pattern in (("stan", r"INTERNAL STAN\}\s*\d+\s+(\S+)"), ("txid", r"TRANSACTION_IDENTIFIER\}\s*\d+\s+(\S+)"), ("pan", r"PAN\}\s*\d+\s+(\S+)")):
            found = re.search(pattern, line)
            if found:
                tx[key] = found.group(1)
        if m037:
            tx["rrn"] = m037.group(1)
        if m039:
            tx["code"] = m039.group(1)
        field = re.search(r"-\s*FLD\s*\((\d+)\)\s*:?\s*\(\d+\)\s*:?\s*\[([^\]]*)\]", line)
        if field:
            tx["fields"][field.group(1)] = field.group(2)
        for found in re.finditer(rf"\b([A-Za-z][A-Za-z0-9_]{{2,}})\b(?:\s*\(\s*\))?\s*({FAIL})", line):
            if found.group(1) not in tx["fns"] and found.group(1).upper() != "END":
                tx["fns"].append(found.group(1))
    for session in order:
        close(session, None)
    return out


def merge(transactions):
    """Orphans into the first transaction with their RRN, then equal STANs into the first."""
    txs = [{**t, "fns": list(t["fns"]), "fields": dict(t["fields"]), "parts": 1} for t in transactions]
    named = [t for t in txs if t["stan"] or t["txid"]]

    def take(into, part):
        into["fns"] += [f for f in part["fns"] if f not in into["fns"]]
        into["fields"] = {**part["fields"], **into["fields"]}
        into["code"] = into["code"] or part["code"]
        into["parts"] += part["parts"]

    left = []
    for t in txs:
        home = next((n for n in named if n["rrn"] == t["rrn"]), None) if t["rrn"] else None
        if t in named or home is None or (t["hb"] and not home["hb"]):
            left.append(t)
        else:
            take(home, t)
    final, by_stan = [], {}
    for t in left:
        first = by_stan.setdefault(t["stan"], t) if t["stan"] else t
        if first is t:
            final.append(t)
        else:
            take(first, t)
            first["rrn"] = first["rrn"] or t["rrn"]
    return final
