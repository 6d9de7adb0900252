"""Operator 13, repair of conversation structure: the cheapest edits that make a conversation's roles alternate.

A conversation's turns are a path in a graph of (turns read, state), the states being: nothing yet, system, user, assistant. Keep, Rerole and
Delete read a turn, Insert adds one with an empty text; a repaired conversation is empty, or an optional system turn and then
pairs of user and assistant. Edits cost small whole numbers, so distances to the end come from Dial's algorithm: a ring of
one bucket more than the dearest edit, emptied in order of distance. The audit is then walked from the start along tight arcs (those whose cost
is the difference of their ends' distances), the edit with the least initial first, so it is the least string of all cheapest edits.
Conversations that are alike in roles and faults are solved once a task.

Faults, of which a turn has the first that holds: blank (only ASCII white space), duplicate (role and text seen earlier in the conversation),
truncated (the last character that is not white space is none of ``.!?``). Blank and duplicate turns are deleted.

Turns are read in the order of turn (nulls first), role and text. Null roles and texts are one space, so such texts are blank, and such a
role is none of the three. A null id is a conversation of its own; repeated rows are duplicates; an empty table gives no rows; other columns are not
read. A conversation is one row of the result and its turns are held in one task, each text once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK, DUPLICATE, SHORT, SOUND = "bdt."
_WHITE = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The states from which a user or assistant turn may follow.
_BEFORE = {USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
_AFTER = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Results kept a task; it changes speed only.
REMEMBERED = 50_000


def distances(initials: str, faults: str) -> dict[int, int]:
    """Node (4 * turns read + state) -> the least cost from there to the end, of all nodes no further than the start, by Dial's algorithm."""
    n = len(initials)
    ring: list[list[int]] = [[] for _ in range(1 + max(REROLE + TRUNCATED, DELETE, INSERT))]
    ring[0] = [4 * n + NOTHING, 4 * n + ASSISTANT]
    best = dict.fromkeys(ring[0], 0)
    done: set[int] = set()
    d, waiting = 0, 2
    while waiting and NOTHING not in done:
        bucket = ring[d % len(ring)]
        while bucket:  # grows by arcs of no cost
            node = bucket.pop()
            waiting -= 1
            if node in done or best[node] != d:
                continue
            done.add(node)
            i, state = divmod(node, 4)
            arcs = [(4 * i + p, INSERT) for p in _BEFORE.get(state, ())]
            if i:
                at = 4 * (i - 1)
                arcs.append((at + state, DELETE))
                fault = faults[i - 1]
                if fault in (SOUND, SHORT):
                    more = TRUNCATED if fault == SHORT else 0
                    own = _INITIAL.get(initials[i - 1]) == state
                    if state == SYSTEM:
                        arcs += [(at + NOTHING, more)] if own else []
                    else:
                        arcs += [(at + p, more if own else REROLE + more) for p in _BEFORE.get(state, ())]
            for to, cost in arcs:
                if d + cost < best.get(to, 1 << 62):
                    best[to] = d + cost
                    ring[(d + cost) % len(ring)].append(to)
                    waiting += 1
        d += 1
    return {node: best[node] for node in done}


def audit(initials: str, faults: str) -> tuple[int, str]:
    """(cost, initials of the cheapest edits in order); of equal costs the least string."""
    far = distances(initials, faults)
    n, i, state, out = len(initials), 0, NOTHING, []
    while i < n or state not in (NOTHING, ASSISTANT):
        here, sound = far[4 * i + state], i < n and faults[i] in (SOUND, SHORT)
        more = TRUNCATED if sound and faults[i] == SHORT else 0
        own = _INITIAL.get(initials[i]) if sound else None
        arcs = [("D", i + 1, state, DELETE)] if i < n else []
        arcs.append(("I", i, _AFTER[state], INSERT))
        if own is not None and (own == _AFTER[state] or (own, state) == (SYSTEM, NOTHING)):
            arcs.append(("K", i + 1, own, more))
        if sound:
            arcs.append(("R", i + 1, _AFTER[state], REROLE + more))
        letter, i, state = next((x, j, q) for x, j, q, cost in arcs if 4 * j + q in far and far[4 * j + q] + cost == here)
        out.append(letter)
    return far[NOTHING], "".join(out)


def repaired(letters: str, initials: str, roles: list[str], texts: list[str]) -> list[dict[str, str]]:
    """The turns that the edits leave."""
    i, state, out = 0, NOTHING, []
    for x in letters:
        if x != "D":
            state = SYSTEM if x == "K" and initials[i] == "s" else _AFTER[state]
            made = "user" if state == USER else "assistant"
            out.append({"role": roles[i] if x == "K" else made, "text": "" if x == "I" else texts[i]})
        i += x != "I"
    return out


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[str, str], tuple[int, str]] = {}
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"]
    turn_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    current, rows = None, []  # the open conversation: its id as an array of one row

    def close() -> tuple:
        turns = [r[0] for r in rows if r[0] is not None]
        roles, texts = [r[1] for r in rows], [r[2] for r in rows]
        seen: set[tuple[str, str]] = set()
        faults = []
        for _, role, text, flaw in rows:
            faults.append(flaw if flaw == BLANK else DUPLICATE if (role, text) in seen else flaw)
            seen.add((role, text))
        # a role without an initial, or with a longer one in UTF-16, is none of the three
        initials, what = "".join(r[:1] or "-" for r in roles), "".join(faults)
        if (initials, what) not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[initials, what] = audit(initials, what)
        cost, letters = known[initials, what]
        illegal = sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        return gaps, what.count(BLANK), what.count(DUPLICATE), what.count(SHORT), illegal, cost, letters, repaired(letters, initials, roles, texts)

    def send(ids: list[pa.Array], out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [pa.string(), turn_type]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names)

    for b in batches:
        own, ids, out = b.column(0).to_pylist(), [], []
        for k, row in enumerate(zip(own, *(b.column(c).to_pylist() for c in range(1, 6)), strict=True)):
            if current is None or row[0] != current[0]:
                if current is not None:
                    ids.append(current[1])
                    out.append(close())
                current, rows = (row[0], b.column(0).slice(k, 1)), []
            if row[5]:
                rows.append(row[1:5])
        if out:
            yield send(ids, out)
    if current is not None:
        yield send([current[1]], [close()])


def repair(turns: DataFrame, present: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: conv_id, gaps (turn numbers between the first and last that no turn has), blank, duplicate, truncated, illegal
    (neighbouring roles that may not follow each other), cost, audit, turns (the repaired conversation). Rows for which present is false only name their
    conversation."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit(" ")), F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    core = F.rtrim(text, F.lit(_WHITE))
    flaw = F.when(core == "", BLANK).when(~F.substring(core, -1, 1).isin(".", "!", "?"), SHORT).otherwise(SOUND)
    kind = turns.schema[id_col].dataType.simpleString()
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), flaw.alias("flaw"), (F.lit(True) if present is None else present).alias("present"))
    rows = rows.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    return rows.mapInArrow(_solve, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<role:string,text:string>>")


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with the faults that the repair is tested on, drawn by the checksum of conversation and turn: _lost (the row is dropped), no text, no
    sentence ends, a copy, a wrong role. Nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    out = conversations.select("conv_id", "turn", F.when(draw == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (draw == 0).alias("_lost"), F.explode(F.array_repeat(F.lit(0), F.when(draw == 3, 2).otherwise(1))).alias("_copy"))
    return out.drop("_copy")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair(damage(table(spark, sf_dir, "conversations")), present=~F.col("_lost"))
    lines = F.concat_ws("\n", F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    return out.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("turns")


def _sql() -> str:
    add = lambda x, cost, letter: f"lpad((left({x}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({x}, 10) || '{letter}'"
    z, s, u, a = (f"p.{x}" for x in "zsua")
    more = f"CASE WHEN r.fault = '{SHORT}' THEN {TRUNCATED} ELSE 0 END"
    sound = f"r.fault IN ('{SOUND}', '{SHORT}')"
    before = f"least({z}, {s}, {a})"
    step = lambda initial, old, frm, role: f"least({add(old, DELETE, 'D')}, CASE WHEN {sound} AND r.initial = '{initial}' THEN {add(frm, more, 'K')} END" + (f", CASE WHEN {sound} THEN {add(frm, f'{REROLE} + {more}', 'R')} END)" if role else ")")
    inserted = f"least({u}, {add(before, INSERT, 'I')})"
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH bits AS (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes FROM conversations),
dr AS (SELECT raw.* EXCLUDE (bytes), xor(list_reduce([4294967295::BIGINT] || bytes, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM raw, crc),
dm AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM dr WHERE k <> 0),
nr AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, {white}) AS core FROM dm),
fl AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prior, CASE WHEN core = '' THEN '{BLANK}' WHEN pos > min(pos) OVER (PARTITION BY conv_id, role, text) THEN '{DUPLICATE}' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN '{SHORT}' ELSE '{SOUND}' END AS fault FROM nr),
cv AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = '{BLANK}') AS blank, count(*) FILTER (fault = '{DUPLICATE}') AS duplicate, count(*) FILTER (fault = '{SHORT}') AS truncated,
 count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal, list({{'initial': initial, 'fault': fault, 'role': role, 'text': text}} ORDER BY pos) AS rs FROM fl GROUP BY conv_id),
pt AS (SELECT cv.*, list_reduce([{{'z': '000000000', 's': NULL::VARCHAR, 'u': NULL::VARCHAR, 'a': NULL::VARCHAR, 'initial': '', 'fault': ''}}] || flatten(list_transform(rs, lambda r: [{{'z': '', 's': '', 'u': '', 'a': '', 'initial': '', 'fault': '+'}}, {{'z': '', 's': '', 'u': '', 'a': '', 'initial': r.initial, 'fault': r.fault}}])) || [{{'z': '', 's': '', 'u': '', 'a': '', 'initial': '', 'fault': '+'}}],
 lambda p, r: CASE WHEN r.fault = '+' THEN {{'z': {z}, 's': {s}, 'u': {inserted}, 'a': least({a}, {add(f'({inserted})', INSERT, 'I')}), 'initial': '', 'fault': ''}}
 ELSE {{'z': {add(z, DELETE, 'D')}, 's': {step('s', s, z, False)}, 'u': {step('u', u, before, True)}, 'a': {step('a', a, u, True)}, 'initial': '', 'fault': ''}} END) AS p FROM cv),
ad AS (SELECT * EXCLUDE (p), left(least(p.z, p.a), 9)::BIGINT AS cost, substr(least(p.z, p.a), 10) AS audit FROM pt),
ed AS (SELECT conv_id, rs, audit, unnest(range(1, length(audit) + 1)) AS k FROM ad),
el AS (SELECT conv_id, rs, k, audit[k] AS x, length(replace(left(audit, k), 'I', '')) AS i, length(replace(left(audit, k), 'D', '')) AS j FROM ed),
kp AS (SELECT *, max(CASE WHEN j = 1 AND x = 'K' AND rs[i].initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS head FROM el WHERE x <> 'D'),
rp AS (SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN rs[i].role WHEN (j - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE rs[i].text END, chr(10) ORDER BY k) AS lines FROM kp GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ad ON ad.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN rp ON rp.conv_id IS NOT DISTINCT FROM c.conv_id"""


OP13_SQL = _sql()
