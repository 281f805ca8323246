"""Conversation structure repair by a square-root checkpointed DP.

A repaired conversation's role initials read ``(s?(ua)+)?``.  The automaton has
four states (start, after s, after u, after a), and from each state an inserted
or reroled turn can only be the one role that may follow, so a string of edits
names its repair.  ``vec[s]`` is the least cost from state s to the end.

1. Turns are numbered and cut into blocks of about the square root of the
   longest conversation (``turns``); each turn is one small code.
2. A block is summed up as a 4 x 4 matrix of costs (state before -> state
   after).  Per conversation these matrices give, from the back, the vector at
   the end of every block: the checkpoints, the only vectors that are stored.
3. Each block is recomputed backward from its checkpoint and walked forward
   from all four states (which state does it leave in?); the conversation's
   blocks then pass the state on from the front.
4. Each block is recomputed once more and walked from its state.  Where
   several edits are tight (lie on a cheapest path), the ASCII-least is taken.

A conversation of any length is spread over its blocks; only the audit string
and the SHA-256, which are sequential by definition, belong to one row.

Edge cases: a null conv_id is a conversation of its own; nulls of role and text
are one space, so such a row is blank; null turns come first; rows of the same
turn are ordered by role and text, then as read; repeated rows are repeated
turns (all but the first are duplicates, or all blank); an empty role or one
with another initial than s, u, a can't be kept as it is; very long texts travel
as rows, never gathered; further columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm import turns as T
from cohortkit.llm.common import cut

START, S, U, A = range(4)
AFTER = (U, U, A, U)                    # state after a turn of the one role that may follow
ROLE = ("user", "user", "assistant", "user")
END = (0, 6, 3, 0)                      # what is missing at the end: u and a after s, a after u
KEPT = ({START: S}, {START: U, S: U, A: U}, {U: A}, {})  # by initial s, u, a, other: state -> state
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
GONE = -1
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
FAR = 1 << 40

NOT_BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, gone): dropped turns stay as rows with ``gone``, so that their conversation does."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = (F.crc32(name) % 20).cast("int")
    rows = conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), (fault == 0).alias("gone"),
        F.when(fault == 0, F.lit("")).when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault < 2, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 3, F.lit(2)).otherwise(F.lit(1)).alias("_copies"))
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).drop("_copy", "_copies")


def plain(conversations: DataFrame) -> DataFrame:
    """The same columns without damage, to repair conversations as they are."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    return conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
                                F.lit(False).alias("gone"), role, text)


def _codes(numbered: DataFrame) -> DataFrame:
    """(conv, at, turn, code): code = 4 * initial + fault, or GONE."""
    blank = ~F.col("text").rlike(NOT_BLANK)
    name = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    slim = numbered.select("conv", "at", "turn", "gone", F.substring("role", 1, 1).alias("i"), blank.alias("blank"),
                           F.col("text").rlike(ENDED).alias("ended"), name.alias("name"))
    first = (slim.where(~F.col("gone") & ~F.col("blank")).groupBy("conv", "name").agg(F.min("at").alias("at"))
             .select("at", F.lit(True).alias("first")))
    initial = F.when(F.col("i") == "s", 0).when(F.col("i") == "u", 1).when(F.col("i") == "a", 2).otherwise(3)
    fault = (F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("ended"), TRUNCATED)
             .otherwise(FINE))
    return slim.join(first, "at", "left").select(
        "conv", "at", "turn", F.when(F.col("gone"), F.lit(GONE)).otherwise(4 * initial + fault).cast("int").alias("code"))


_STEPS: dict = {}


def step(code: int, vec: tuple):
    """One turn, from the back: (costs before it less ``base``, base, (edits, state after) by state).

    ``vec`` are the costs after the turn.  Few pairs (code, vec) exist, so each is worked out once.
    """
    key = (code, vec)
    if key in _STEPS:
        return _STEPS[key]
    initial, fault = divmod(code, 4)
    extra = 3 if fault == TRUNCATED else 0
    moves = []  # by state: edit -> (cost, state after, turn used up)
    for s in range(4):
        own = {"D": (DELETE, s, True), "I": (INSERT, AFTER[s], False)}
        if fault not in (BLANK, DUPLICATE):
            if s in KEPT[initial]:
                own["K"] = (KEEP + extra, KEPT[initial][s], True)
            own["R"] = (REROLE + extra, AFTER[s], True)
        moves.append(own)
    cost = [min(c + vec[t] for c, t, used in own.values() if used) for own in moves]
    for _ in range(3):  # inserts before the turn lead on to other states
        cost = [min(cost[s], INSERT + cost[AFTER[s]]) for s in range(4)]
    walks = []
    for s in range(4):
        edits, at, used = "", s, cost[s] >= FAR
        while not used:
            edit = min(e for e, (c, t, u) in moves[at].items() if c + (vec if u else cost)[t] == cost[at])
            _, at, used = moves[at][edit]
            edits += edit
        walks.append((edits, at))
    base = min(cost)
    _STEPS[key] = out = (tuple(c - base if c < FAR else FAR for c in cost), base, tuple(walks))
    return out


def backward(codes: list, vec: tuple):
    """Costs before the first turn and the walks of every turn, the last first."""
    total, low = 0, min(vec)
    vec, total = tuple(c - low if c < FAR else FAR for c in vec), low
    walks = []
    for code in reversed(codes):
        if code != GONE:
            vec, base, walk = step(code, vec)
            total += base
            walks.append(walk)
        else:
            walks.append(None)
    return tuple(c + total if c < FAR else FAR for c in vec), walks


def matrix(codes: list) -> list:
    """16 costs: from the state before (row) to the state after the block (column)."""
    columns = [backward(codes, tuple(0 if t == s else FAR for s in range(4)))[0] for t in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)]


def forward(codes: list, walks: list, state: int):
    """The edits of every turn from ``state``, and the state after."""
    edits = []
    for code, walk in zip(codes, reversed(walks)):
        text, state = walk[state] if code != GONE else ("", state)
        edits.append(text)
    return edits, state


def plan_rows(codes: list, edits: list, state: int):
    """(roles inserted before, role kept or given, deleted?) of every turn; the role is null where it is kept."""
    out = []
    for code, text in zip(codes, edits):
        before, role, gone = [], None, code == GONE
        for e in text:
            if e == "I":
                before.append(ROLE[state])
                state = AFTER[state]
            elif e == "R":
                role, state = ROLE[state], AFTER[state]
            elif e == "K":
                state = KEPT[code // 4][state]
            else:
                gone = True
        out.append((before, role, gone))
    return out


_SUMS = ("conv {0}, block bigint, costs array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
         "first_i int, last_i int, turns bigint, first_turn bigint, last_turn bigint")


def _sum_up(batches):
    names = ["block", "costs", "blank", "duplicate", "truncated", "illegal", "first_i", "last_i", "turns", "first_turn", "last_turn"]
    for batch in batches:
        out = []
        for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist()):
            codes = [r["code"] for r in rows]
            there = [r for r in rows if r["code"] != GONE]
            faults = [r["code"] % 4 for r in there]
            initials = [r["code"] // 4 for r in there]
            known = [r["turn"] for r in there if r["turn"] is not None]
            out.append((block, matrix(codes), faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED),
                        sum((x, y) not in LEGAL for x, y in zip(initials, initials[1:])),
                        initials[0] if initials else None, initials[-1] if initials else None,
                        len(set(known)), known[0] if known else None, known[-1] if known else None))
        types = [pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * 4, pa.int32(), pa.int32(), *[pa.int64()] * 3]
        cols = list(zip(*out)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["conv", *names])


LEGAL = {(0, 1), (1, 2), (2, 1)}


def _checkpoints(batches):
    """Per conversation: its figures, and the costs at the end of each of its blocks."""
    for batch in batches:
        out = []
        for parts in batch.column("parts").to_pylist():
            vec, ends = END, []
            for p in reversed(parts):
                ends.append({"block": p["block"], "costs": list(vec)})
                m = p["costs"]
                vec = tuple(min(m[4 * s + t] + vec[t] for t in range(4)) for s in range(4))
            illegal = sum(p["illegal"] for p in parts)
            last = None
            for p in parts:
                if p["first_i"] is not None:
                    illegal += last is not None and (last, p["first_i"]) not in LEGAL
                    last = p["last_i"]
            turns, last, lowest = 0, None, None
            for p in parts:
                if p["turns"]:
                    turns += p["turns"] - (last == p["first_turn"] and last is not None)
                    lowest = p["first_turn"] if lowest is None else lowest
                    last = p["last_turn"]
            out.append((last - lowest + 1 - turns if turns else 0, *[sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated")],
                        illegal, vec[START], ends[::-1]))
        cols = list(zip(*out)) or [[]] * 7
        ends = pa.list_(pa.struct([("block", pa.int64()), ("costs", pa.list_(pa.int64()))]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), *[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], ends)],
            names=["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "ends"])


def _exits(batches):
    """Per block: the state after it, by the state before it."""
    for batch in batches:
        out = []
        for rows, vec in zip(batch.column("rows").to_pylist(), batch.column("costs").to_pylist()):
            codes = [r["code"] for r in rows]
            _, walks = backward(codes, tuple(vec))
            out.append([forward(codes, walks, s)[1] for s in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(out, pa.list_(pa.int64()))],
                                         names=["conv", "block", "exits"])


def _entries(batches):
    """Per conversation: the state before each of its blocks, and what is inserted at the end."""
    for batch in batches:
        out = []
        for parts in batch.column("parts").to_pylist():
            state, got = START, []
            for p in parts:
                got.append({"block": p["block"], "state": state, "last": False})
                state = p["exits"][state]
            got[-1]["last"] = True
            out.append(got)
        kind = pa.list_(pa.struct([("block", pa.int64()), ("state", pa.int64()), ("last", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(out, kind)], names=["conv", "entries"])


_PLAN = "array<struct<at:bigint,before:array<string>,role:string,gone:boolean,after:array<string>>>"


def _plans(batches):
    """Per block: its edits, and the plan of each of its turns."""
    kind = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.list_(pa.string())), ("role", pa.string()),
                               ("gone", pa.bool_()), ("after", pa.list_(pa.string()))]))
    for batch in batches:
        audits, plans = [], []
        for rows, vec, state, last in zip(*[batch.column(c).to_pylist() for c in ("rows", "costs", "state", "last")]):
            codes = [r["code"] for r in rows]
            _, walks = backward(codes, tuple(vec))
            edits, after = forward(codes, walks, state)
            plan = [{"at": r["at"], "before": b, "role": x, "gone": g, "after": []}
                    for r, (b, x, g) in zip(rows, plan_rows(codes, edits, state))]
            if last:
                plan[-1]["after"] = {START: [], S: ["user", "assistant"], U: ["assistant"], A: []}[after]
                edits.append("I" * len(plan[-1]["after"]))
            audits.append("".join(edits))
            plans.append(plan)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(audits, pa.string()),
                                          pa.array(plans, kind)], names=["conv", "block", "edits", "plan"])


def _per_conv(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", *fields))).alias("parts"))


def repair(turns: DataFrame, least_block: int = T.LEAST_BLOCK):
    """(figures, repaired turns) of ``turns`` as made by ``damage`` or ``plain``.

    figures: conv, gaps, blank, duplicate, truncated, illegal, cost, audit; one row per conversation.
    repaired turns: conv, at, no, role, text, in the order of (at, no).
    """
    key = turns.schema["conv"].dataType.simpleString()
    numbered = T.number(turns, ["turn", "role", "text"])
    size = T.block_size(numbered, least_block)
    blocks = T.blocks(_codes(numbered), size, ["code", "turn"]).transform(cut)
    sums = blocks.mapInArrow(_sum_up, _SUMS.format(key))
    known = _per_conv(sums, [c for c in sums.columns if c not in ("conv", "block")]).mapInArrow(
        _checkpoints, f"conv {key}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
        "ends array<struct<block:bigint,costs:array<bigint>>>").transform(cut)
    ends = known.select(F.inline("ends"))
    armed = blocks.join(ends, "block")
    left = armed.mapInArrow(_exits, f"conv {key}, block bigint, exits array<bigint>")
    entries = _per_conv(left, ["exits"]).mapInArrow(
        _entries, f"conv {key}, entries array<struct<block:bigint,state:bigint,last:boolean>>")
    planned = armed.join(entries.select(F.inline("entries")), "block").mapInArrow(
        _plans, f"conv {key}, block bigint, edits string, plan {_PLAN}").transform(cut)
    audit = _per_conv(planned, ["edits"]).select(
        F.col("conv").alias("_conv"), F.array_join(F.transform("parts", lambda p: p["edits"]), "").alias("audit"))
    figures = known.drop("ends").join(audit, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    empty = lambda r: F.struct(r.alias("role"), F.lit("").alias("text"))
    own = F.when(F.col("p.gone"), F.array().cast("array<struct<role:string,text:string>>")).otherwise(
        F.array(F.struct(F.coalesce("p.role", "role").alias("role"), F.col("text").alias("text"))))
    plan = planned.select(F.explode("plan").alias("p")).withColumn("at", F.col("p.at"))
    lines = (numbered.select("conv", "at", "role", "text").join(plan, "at")
             .select("conv", "at", F.posexplode(F.concat(F.transform("p.before", empty), own, F.transform("p.after", empty))).alias("no", "line"))
             .select("conv", "at", "no", "line.role", "line.text"))
    return figures, lines


def digests(lines: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): each conversation streams through one hash, batch by batch."""
    key = lines.schema["conv"].dataType.simpleString()

    def run(batches):
        state, kind = None, None
        for batch in batches:
            kind, done = batch.schema.field("conv").type, []
            for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv", "role", "text")]):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append((state[0], state[1].hexdigest()))
                    state = (conv, hashlib.sha256())
                else:
                    state[1].update(b"\n")
                state[1].update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())],
                                             names=["conv", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state[0]], kind), pa.array([state[1].hexdigest()], pa.string())],
                                             names=["conv", "repaired_sha256"])

    return (lines.repartition("conv").sortWithinPartitions("conv", "at", "no").select("conv", "role", "text")
            .mapInArrow(run, f"conv {key}, repaired_sha256 string"))


def audit(conversations: DataFrame, least_block: int = T.LEAST_BLOCK) -> DataFrame:
    """Damage, repair and digest: one row per conv_id."""
    figures, lines = repair(damage(conversations), least_block)
    hashed = digests(lines).withColumnRenamed("conv", "_conv")
    none: Column = F.sha2(F.lit("").cast("binary"), 256)
    return (figures.join(hashed, F.col("conv").eqNullSafe(F.col("_conv")), "left")
            .select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                    F.coalesce("repaired_sha256", none).alias("repaired_sha256")))
