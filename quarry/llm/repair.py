"""Operator 11, conversation structure repair: a scan of 4x4 matrices.

A repaired conversation has role initials (s?(ua)+)?, which an automaton of four states reads: nothing yet (0), after a system turn (1),
after a user turn (2), after an assistant turn (3). What a turn can be edited to is a matrix over (cost, audit): the entry from one state
to another is its cheapest edit, by cost and then by the audit's letters, with the closure of inserts before it. Sums are costs added and
audits joined, and the lesser one is chosen; equal costs never have audits of which one begins the other (inserts alone lengthen an audit, and cost),
so joining keeps the order from both sides and the product is associative.

Turns are ranged by conversation and place over all partitions. Each task reduces its stretch of a conversation to one matrix in a tree
(two equal halves at a time), and stretches are joined sixteen at a time by neighbouring partitions, until each conversation
has one. No text takes part in that. With the audit at its head, a conversation's rows then stream by once more and come out
repaired; the digest of a conversation is sequential by definition, and is taken batch by batch.

Cases: a null role or text is one space, and so is a null id or turn in the damage's key; null turns come first; rows of one turn are
ordered by role and by SHA-256 of the text; rows of null conv_id are one conversation. A text without a visible character is blank. Repeated rows are duplicates.
A conversation without rows has no edits. Very long texts are read once for their last characters and once on the way out;
the matrix of a stretch holds eleven audits of its length. An empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import by_bytes, spent, table, written

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
STATES = 4
#: Neighbouring stretches that are joined at once.
JOINED = 16
WHITE = " \t\n\x0b\x0c\r"
#: States from which a user's, an assistant's and a system turn may come, and where they lead.
BEFORE = {"u": ((0, 1, 3), 2), "a": ((2,), 3), "s": ((0,), 1)}

Entry = tuple[int, str] | None
Matrix = tuple[Entry, ...]
ONE: Matrix = tuple((0, "") if i == j else None for i in range(STATES) for j in range(STATES))


def product(a: Matrix, b: Matrix) -> Matrix:
    """Of each way through both the least."""
    out = []
    for i in range(0, STATES * STATES, STATES):
        row = [(x, b[STATES * k : STATES * k + STATES]) for k, x in enumerate(a[i : i + STATES]) if x is not None]
        for j in range(STATES):
            best = None
            for (cost, audit), to in row:
                y = to[j]
                if y is not None and (best is None or cost + y[0] <= best[0]):
                    z = (cost + y[0], audit + y[1])
                    if best is None or z < best:
                        best = z
            out.append(best)
    return tuple(out)


def _matrix(steps: list[tuple[int, int, int, str]]) -> Matrix:
    out = [None] * (STATES * STATES)
    for i, j, cost, letter in steps:
        at = i * STATES + j
        out[at] = min(out[at] or (cost, letter), (cost, letter))
    return tuple(out)


_ONCE = _matrix([*((i, i, 0, "") for i in range(STATES)), *((i, to, INSERT, "I") for r in "ua" for i, to in [(i, BEFORE[r][1]) for i in BEFORE[r][0]])])
#: Inserts, none included; two at most are ever cheapest.
INSERTS = product(_ONCE, _ONCE)


def turn_matrix(initial: str, gone: bool, cut: bool) -> Matrix:
    """A turn's edits, with inserts before it. gone: it has to be deleted; cut: it is truncated."""
    steps = [(i, i, DELETE, "D") for i in range(STATES)]
    if not gone:
        for r in "ua":
            steps += [(i, BEFORE[r][1], REROLE + CUT * cut, "R") for i in BEFORE[r][0]]
        if initial in BEFORE:
            steps += [(i, BEFORE[initial][1], KEEP + CUT * cut, "K") for i in BEFORE[initial][0]]
    return product(INSERTS, _matrix(steps))


TURNS = {(r, gone, cut): turn_matrix(r, gone, cut) for r in ("u", "a", "s", "") for gone in (False, True) for cut in (False, True)}


class Reduction:
    """The product of matrices that come one after the other, as a tree."""

    def __init__(self):
        self.halves: list[tuple[int, Matrix]] = []

    def add(self, m: Matrix) -> None:
        rank = 0
        while self.halves and self.halves[-1][0] == rank:
            m = product(self.halves.pop()[1], m)
            rank += 1
        self.halves.append((rank, m))

    def total(self) -> Matrix:
        out = None
        while self.halves:
            m = self.halves.pop()[1]
            out = m if out is None else product(m, out)
        return out or ONE


def cheapest(m: Matrix) -> tuple[int, str]:
    """Cost and audit of the best way from the start to an end."""
    ends = product(m, INSERTS)
    return min(x for x in (ends[0], ends[3]) if x is not None)


#: A stretch: its partition, matrix, roles and turns at both ends, turns in between, and counts of faults.
STRETCH = "conv_id long, part long, costs array<long>, audits array<string>, first_role string, last_role string, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long"
NAMES = [c.split()[0] for c in STRETCH.split(", ")]
COUNTS = slice(9, 13)


def _illegal(left: str, right: str) -> int:
    return left + right not in ("su", "ua", "au")


def _packed(m: Matrix) -> tuple[list, list]:
    return [x and x[0] for x in m], [x and x[1] for x in m]


def _unpacked(costs: list, audits: list) -> Matrix:
    return tuple(None if c is None else (c, a) for c, a in zip(costs, audits, strict=True))


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    lists, number, text = {2: pa.list_(pa.int64()), 3: pa.list_(pa.string())}, pa.int64(), pa.string()
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], lists.get(i, text if i in (4, 5) else number)) for i in range(len(NAMES))], names=NAMES)


class _Stretch:
    def __init__(self, conv: int | None, role: str):
        self.conv, self.first_role, self.last_role, self.scan = conv, role, None, Reduction()
        self.first_turn = self.last_turn = self.row = None
        self.turns, self.counts = 0, [0, 0, 0, 0]

    def add(self, turn, role, text_key, blank, truncated, again) -> None:
        row = (turn, role, text_key)
        again = again or row == self.row
        fault = 0 if blank else 1 if again else 2 if truncated else None
        if fault is not None:
            self.counts[fault] += 1
        initial = role[:1]
        if self.last_role is not None:
            self.counts[3] += _illegal(self.last_role, initial)
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.row, self.last_role = row, initial
        self.scan.add(TURNS[initial if initial in BEFORE else "", fault in (0, 1), fault == 2])

    def out(self, part: int) -> tuple:
        return (self.conv, part, *_packed(self.scan.total()), self.first_role[:1], self.last_role, self.first_turn, self.last_turn, self.turns, *self.counts)


def _stretches(batches):
    """Of turns sorted by conversation and place a stretch for each conversation. Equal rows are never in two partitions."""
    part, at, done = TaskContext.get().partitionId(), None, []
    for b in batches:
        for conv, turn, role, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at is None or at.conv != conv:
                if at is not None:
                    done.append(at.out(part))
                at = _Stretch(conv, role)
            at.add(turn, role, *rest)
        if len(done) > 1000:
            yield _arrow(done)
            done = []
    if at is not None:
        done.append(at.out(part))
    yield _arrow(done)


def joined(a: tuple, b: tuple) -> tuple:
    """Two neighbouring stretches as one; the matrices are left to the caller."""
    turns = a[8] + b[8] - (a[7] is not None and a[7] == b[6])
    counts = [x + y for x, y in zip(a[COUNTS], b[COUNTS], strict=True)]
    counts[3] += _illegal(a[5], b[4])
    return (*a[:5], b[5], a[6] if a[6] is not None else b[6], b[7] if b[7] is not None else a[7], turns, *counts)


def _levels(batches):
    """Stretches sorted by conversation, group and partition, those of a group as one."""
    at, scan, group, done = None, None, None, []

    def out():
        return (at[0], group[1], *_packed(scan.total()), *at[4:])

    for b in batches:
        for *row, g in zip(*(c.to_pylist() for c in b.columns), strict=True):
            m = _unpacked(row[2], row[3])
            if group != (row[0], g):
                if at is not None:
                    done.append(out())
                at, scan, group = tuple(row), Reduction(), (row[0], g)
            else:
                at = joined(at, tuple(row))
            scan.add(m)
        if len(done) > 1000:
            yield _arrow(done)
            done = []
    if at is not None:
        done.append(out())
    yield _arrow(done)


PLANS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _plans(batches):
    for b in batches:
        rows = []
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            gaps = 0 if r[6] is None else r[7] - r[6] + 1 - r[8]
            rows.append((r[0], gaps, *r[COUNTS], *cheapest(_unpacked(r[2], r[3]))))
        types = [pa.int64()] * 7 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in PLANS.split(", ")])


def place() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text_key")]


def planned(turns: DataFrame) -> DataFrame:
    """PLANS of turns (conv_id, turn, role, text, text_key), for every conversation that has rows."""
    visible = F.rtrim("text", F.lit(WHITE))
    facts = turns.select("conv_id", "turn", "role", "text_key", (visible == "").alias("blank"), (~F.substring(visible, -1, 1).isin(".", "!", "?")).alias("truncated"))
    earliest = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("earliest")
    first = facts.groupBy("conv_id", "role", "text_key").agg(earliest).select(F.col("conv_id").alias("c_"), F.col("role").alias("r_"), F.col("text_key").alias("k_"), F.col("earliest.turn").alias("t_"))
    on = F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("role") == F.col("r_")) & (F.col("text_key") == F.col("k_"))
    again = (~F.col("turn").eqNullSafe(F.col("t_"))).alias("again")
    seen = written(facts.join(first, on).select("conv_id", "turn", "role", "text_key", "blank", "truncated", again), "turns")
    parts = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stretches = written(seen.repartitionByRange(parts, *place()).sortWithinPartitions(*place()).mapInArrow(_stretches, STRETCH), "stretches")
    spent(seen)
    while parts > 1:
        parts = -(-parts // JOINED)
        group = F.floor(F.col("part") / JOINED).cast("long").alias("group")
        before = stretches
        near = stretches.select(*NAMES, group).repartition("conv_id", "group").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "group", "part")
        stretches = written(near.mapInArrow(_levels, STRETCH), "stretches")
        spent(before)
    return stretches.mapInArrow(_plans, PLANS)


REPAIRED = "conv_id long, at long, edit string, role string, text string"


def _repaired(batches):
    """Of rows sorted by conversation, each with its audit at the head, the repaired ones and, with edit '', the end of each conversation."""
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    conv, audit, at, last, n, started = None, "", 0, "", 0, False

    def inserts(out):
        nonlocal at, last, n
        while at < len(audit) and audit[at] == "I":
            last = "a" if last == "u" else "u"
            out.append((conv, n, "I", "user" if last == "u" else "assistant", ""))
            at, n = at + 1, n + 1

    def end(out):
        inserts(out)
        out.append((conv, n, "", None, None))

    for batch in batches:
        for b in by_bytes(batch, 3, 8 << 20):
            out: list[tuple] = []
            for c, head, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if head is not None:
                    if started:
                        end(out)
                    conv, audit, at, last, n, started = c, head, 0, "", 0, True
                    continue
                inserts(out)
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    role = "assistant" if last == "u" else "user"
                last = role[:1]
                out.append((conv, n, edit, role, text))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i < 2 else pa.string()) for i in range(5)], names=names)
    if started:
        out = []
        end(out)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i < 2 else pa.string()) for i in range(5)], names=names)


def _streamed(turns: DataFrame, plans: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    heads = plans.select("conv_id", F.col("audit").alias("head"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), none.alias("text_key"))
    rows = heads.unionByName(turns.select("conv_id", none.alias("head"), "turn", "role", "text", "text_key"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("head").isNull(), *place()[1:]]
    return rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "head", "role", "text").mapInArrow(_repaired, REPAIRED)


def repaired(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, at (from 0), edit (K, R or I), role and text of every turn that stays or is put in."""
    return _streamed(turns, plans).where("edit <> ''")


def _digests(batches):
    digest, first, out = hashlib.sha256(), True, []
    for b in batches:
        for conv, edit, role, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "edit", "role", "text")), strict=True):
            if edit:
                digest.update((("" if first else "\n") + role + ":" + text).encode())
                first = False
            else:
                out.append((conv, digest.hexdigest()))
                digest, first = hashlib.sha256(), True
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names=["conv_id", "repaired_sha256"])
        out = []


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """Nulls of role and text as one space, and the key that tells texts apart and orders them within a turn."""
    t = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return t.withColumn("text_key", F.sha2(F.col("text").cast("binary"), 256))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that are chosen by crc32 of conv_id:turn."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    t = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    t = t.withColumn("text", text).withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
    return t.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def repair_report(turns: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """PLANS and repaired_sha256 of every one of the distinct conv_ids."""
    found = planned(turns)
    ids = conv_ids.select(F.col("conv_id").cast("long").alias("c_")).distinct()
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    plans = written(ids.join(found, F.col("c_").eqNullSafe(F.col("conv_id")), "left").select(F.col("c_").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit")), "plans")
    hashes = _streamed(turns, plans).mapInArrow(_digests, "conv_id long, repaired_sha256 string").select(F.col("conv_id").alias("c_"), "repaired_sha256")
    return plans.join(hashes, F.col("c_").eqNullSafe(F.col("conv_id"))).drop("c_")


def op11_structure_repair(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    turns = written(conversation_turns(damaged(conversations)), "damaged")
    return repair_report(turns, conversations)


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _then(state: str, cost: str, letter: str, line: str | None) -> str:
    text = f"{state}.t" if line is None else f"{state}.t || chr(10) || {line}"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}}} END"


def _edited(to: int) -> str:
    """SQL of a state after a row, from those with inserts before it (w0 to w3)."""
    options = [_then(f"w{to}", str(DELETE), "D", None)]
    for r, name in (("u", "user"), ("a", "assistant"), ("s", None)):
        before, end = BEFORE[r]
        if end == to:
            for i in before:
                if name:
                    options.append(f"CASE WHEN NOT gone THEN {_then(f'w{i}', f'{REROLE} + cut', 'R', chr(39) + name + ':' + chr(39) + ' || text')} END")
                options.append(f"CASE WHEN NOT gone AND initial = '{r}' THEN {_then(f'w{i}', 'cut', 'K', 'role || chr(58) || text')} END")
    return _least(*options)


_INSERTED = f"s0 AS w0, s1 AS w1, {_least('s2', *(_then(f's{i}', str(INSERT), 'I', chr(39) + 'user:' + chr(39)) for i in (0, 1, 3)))} AS w2"
_INSERTED_A = _least("s3", _then("w2", str(INSERT), "I", "'assistant:'"))
_EMPTY = "{'c': 0::BIGINT, 'a': '', 't': ''}"
_NO = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"

OP11_SQL = f"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
keyed AS (SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
bytes AS (SELECT id, 4294967295 AS c, key AS rest FROM keyed
  UNION ALL SELECT id, xor(c >> 8, t[(xor(c, ascii(rest)) & 255) + 1]), rest[2:] FROM bytes, crc WHERE rest <> ''),
faulty AS (SELECT k.*, xor(b.c, 4294967295) % 20 AS fault FROM keyed k JOIN bytes b ON b.id = k.id AND b.rest = ''),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM faulty, LATERAL (SELECT unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy) WHERE fault <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS visible FROM damaged),
again AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, role[1:1] AS initial FROM placed),
rows_ AS (
  SELECT *, visible = '' AS blank, visible <> '' AND again AS duplicate, visible <> '' AND NOT again AND right(visible, 1) NOT IN ('.', '!', '?') AS truncated,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM again),
facts AS (SELECT *, blank OR duplicate AS gone, CASE WHEN truncated THEN {CUT} ELSE 0 END AS cut FROM rows_),
ids AS (SELECT DISTINCT conv_id FROM conversations),
scan(conv_id, n, s0, s1, s2, s3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {_EMPTY}, {_NO}, {_NO}, {_NO} FROM ids
  UNION ALL
  SELECT conv_id, n, {_edited(0)}, {_edited(1)}, {_edited(2)}, {_edited(3)} FROM (
    SELECT *, {_INSERTED_A} AS w3 FROM (
      SELECT f.conv_id, f.n, f.role, f.text, f.initial, f.gone, f.cut, s3, {_INSERTED}
      FROM scan JOIN facts f ON f.conv_id IS NOT DISTINCT FROM scan.conv_id AND f.n = scan.n + 1))),
last AS (SELECT conv_id, arg_max(s0, n) AS s0, arg_max(s3, n) AS s3, arg_max(w2, n) AS w2 FROM (SELECT conv_id, n, s3, {_INSERTED.replace("s0 AS w0, s1 AS w1", "s0")} FROM scan) GROUP BY conv_id),
best AS (SELECT conv_id, {_least("s0", _INSERTED_A)} AS b FROM last),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM facts GROUP BY conv_id)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(b.b.c AS BIGINT) AS cost, b.b.a AS audit, sha256(b.b.t[2:]) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""
