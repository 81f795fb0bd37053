"""Operator 11 against an enumeration of edits, over many partitions, and on hard input."""

import hashlib
import itertools
import random
import re
import zlib

from quarry.llm.repair import ONE, TURNS, Reduction, cheapest, conversation_turns, damaged, op11_structure_repair, planned, product, repair_report, repaired

SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost int"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    """(blank, duplicate, truncated) of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        visible = text.rstrip(" \t\n\x0b\x0c\r")
        blank, again = not visible, (role, text) in seen
        out.append((blank, not blank and again, not blank and not again and visible[-1] not in ".!?"))
        seen.add((role, text))
    return out


def enumerated(rows):
    """Cost, audit and result of the least of all edits, with up to two inserts at a place."""
    best, flags = None, faults(rows)
    options = [["D"] if f[0] or f[1] else ["K", "Ru", "Ra", "D"] for f in flags]
    puts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    for edits in itertools.product(*options):
        for ins in itertools.product(puts, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for i in range(len(rows) + 1):
                for r in ins[i]:
                    cost, audit = cost + 2, audit + "I"
                    out.append(({"u": "user", "a": "assistant"}[r], ""))
                if i < len(rows):
                    e, (role, text) = edits[i], rows[i]
                    audit += e[0]
                    cost += {"K": 0, "R": 2, "D": 3}[e[0]] + (e != "D" and flags[i][2])
                    if e != "D":
                        out.append(({"K": role, "Ru": "user", "Ra": "assistant"}[e], text))
            if LEGAL.match("".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return best


def scanned(rows):
    scan = Reduction()
    for (role, _), (blank, again, cut) in zip(rows, faults(rows), strict=True):
        scan.add(TURNS[role[:1] if role[:1] in "uas" else "", blank or again, cut])
    return cheapest(scan.total())


def test_scan_equals_enumeration():
    r = random.Random(1)
    for _ in range(60):
        rows = [(r.choice(["system", "user", "assistant", "tool", ""]), r.choice(["a.", "b", " ", "c!", "d?\n"])) for _ in range(r.randint(0, 3))]
        assert scanned(rows) == enumerated(rows)[:2], rows


def test_product_is_associative():
    r = random.Random(2)
    ms = [*TURNS.values()]
    for _ in range(300):
        a, b, c = (r.choice(ms) for _ in range(3))
        a, b = product(a, r.choice(ms)), product(b, r.choice(ms))
        assert product(product(a, b), c) == product(a, product(b, c))
        assert product(ONE, a) == product(a, ONE) == a


def reference(rows):
    """The report of all rows (conv_id, turn, role, text) in plain Python; edits by dynamic programming over whole results."""
    out = set()
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if fault:
                text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
                kept += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        pairs = [x[1:] for x in kept]
        flags, turns = faults(pairs), [x[0] for x in kept if x[0] is not None]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        cost, audit, text = least(pairs, flags)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.add((conv, gaps, *(sum(f[i] for f in flags) for i in range(3)), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def least(pairs, flags):
    """Over prefixes of the rows: of each last initial the least (cost, audit, lines)."""

    def put(states, to, x):
        if to not in states or x < states[to]:
            states[to] = x

    def inserted(states):
        states = dict(states)
        for _ in range(2):
            for last, (c, a, t) in list(states.items()):
                put(states, "a" if last == "u" else "u", (c + 2, a + "I", (*t, "assistant:" if last == "u" else "user:")))
        return states

    states = {"": (0, "", ())}
    for (role, text), (blank, again, cut) in zip(pairs, flags, strict=True):
        new = {}
        for last, (c, a, t) in inserted(states).items():
            put(new, last, (c + 3, a + "D", t))
            if blank or again:
                continue
            to = "a" if last == "u" else "u"
            put(new, to, (c + 2 + cut, a + "R", (*t, f"{'user' if to == 'u' else 'assistant'}:{text}")))
            if role[:1] == to or (role[:1] == "s" and last == ""):
                put(new, role[:1], (c + cut, a + "K", (*t, f"{role}:{text}")))
        states = new
    c, a, t = min(x for last, x in inserted(states).items() if last in ("", "a"))
    return c, a, "\n".join(t)


def hard(seed):
    r = random.Random(seed)
    rows = [(c, r.choice([None, *range(9)]), r.choice(["system", "user", "assistant", "tool", None, ""]), r.choice(["a.", "b", None, "", " \n", "c! ", "long text. " * 40, "é?"])) for c in [None, *range(25)] for _ in range(r.randint(1, 9))]
    return rows + [(99, i, r.choice(["user", "assistant"]), f"turn {i}{r.choice(['.', ''])}") for i in range(700)] + rows[:5]


def test_report_equals_plain_python_over_many_partitions(spark):
    rows = hard(3)
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {tuple(x) for x in repair_report(conversation_turns(damaged(df)), df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == reference(rows)


def test_repaired_rows_are_legal(spark):
    df = spark.createDataFrame([(*x, "clash", 1) for x in hard(4)], SCHEMA)
    turns = conversation_turns(df)
    by = {}
    for x in repaired(turns, planned(turns)).orderBy("conv_id", "at").collect():
        assert x.at == len(by.setdefault(x.conv_id, []))
        by[x.conv_id].append(x)
    assert by
    for rows in by.values():
        assert LEGAL.match("".join(x.role[:1] for x in rows))
        assert all(x.text == "" for x in rows if x.edit == "I")


def test_empty_table_and_the_query(spark, sf):
    none = spark.createDataFrame([], SCHEMA)
    assert repair_report(conversation_turns(damaged(none)), none).count() == 0
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(x) for x in op11_structure_repair(spark, sf).collect()} == reference(rows)
