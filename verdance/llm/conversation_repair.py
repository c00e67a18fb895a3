"""Conversation structure repair: Wagner-Fischer alignment of turns with the
alternating grammar ``(s?(ua)+)?`` of role initials.

A conversation of up to LONG_ROWS rows is aligned in one task with the target
strings of every feasible length: one table holds the costs of the last r
symbols of the alternating string for all r, a second one those with an ``s``
still to come, and both are filled within Ukkonen bands that the cost of a
greedy repair opens. The audits of all lengths of least cost are traced back
and compared. Longer conversations are dealt out by order into blocks: since
the target alternates, its positions fold into four states, a block becomes a
4 x 4 table of costs, and the tables of a conversation's blocks are combined;
each block then traces its own part of the audit. Only hashing a conversation
is sequential, by the nature of SHA-256: its pieces stream through one task in
order, without being gathered.

Defined results: a null conv_id is a conversation of its own; null roles and
texts are one space, and so are nulls within the key that decides the damage;
rows of one turn go by role, then text, nulls of turn before all others; rows
that repeat conv_id, turn, role and text are duplicates of the first; roles
are compared by their first character only, an empty role has none; texts of
any length are read whole; an empty table gives an empty result; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import in_arrow, remove, stored, table

#: A conversation of more rows is dealt out into blocks of about BLOCK_ROWS.
LONG_ROWS, BLOCK_ROWS = 2_000, 20_000
#: Long conversations' ids are broadcast up to this many.
BROADCAST_IDS = 10_000
#: Bytes of remembered audits in a worker.
MEMO_BYTES = 16 << 20

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
FAR = 1 << 40
#: States of the folded target: nothing yet, after s, a comes, after a pair.
START, AFTER_S, WANTS_A, PAIRED = range(4)
#: The state behind the u or a that comes next.
NEXT = [WANTS_A, WANTS_A, PAIRED, WANTS_A]
#: The state behind a kept row of an initial.
KEPT = [{"s": AFTER_S, "u": WANTS_A}, {"u": WANTS_A}, {"a": PAIRED}, {"u": WANTS_A}]


# --- rows and their faults -------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that each turn's key decides."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        kind.alias("kind"),
    ).where("kind != 0")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(copies).alias("copy")).drop("copy")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("x"))


def _kind(role: Column, text: Column) -> Column:
    """``-`` for a blank row, else its role's initial, upper-case where it is truncated."""
    bare = F.rtrim(text, F.lit(SPACE))
    return F.when(F.length(F.ltrim(bare, F.lit(SPACE))) == 0, F.lit("-")).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), _initial(role)).otherwise(F.upper(_initial(role)))


# --- alignment of one conversation ------------------------------------------


def incumbent(pattern: str) -> int:
    """The cost of a greedy repair: a missing role is inserted, an unknown one changed."""
    cost, state = 0, START
    for kind in pattern:
        if kind == "-":
            cost += DELETE
            continue
        initial = kind.lower()
        cost += TRUNCATED * kind.isupper()
        if initial in KEPT[state]:
            state = KEPT[state][initial]
        elif initial in "ua":
            cost += INSERT
            state = KEPT[NEXT[state]][initial]
        else:
            cost += REROLE
            state = NEXT[state]
    return cost + INSERT * {START: 0, AFTER_S: 2, WANTS_A: 1, PAIRED: 0}[state]


def align(pattern: str) -> tuple[int, str]:
    """Cost and audit of a conversation, given by a sign a row: ``-`` must go,
    else s, u, a or x, upper-case where the row is truncated.

    ``rest[i, r]`` is the least cost of turning rows i and later into the last
    r symbols of ``...uaua``, ``first[i, r]`` the same with an s before them.
    """
    rows, most = len(pattern), incumbent(pattern)
    width = rows + most // INSERT + 2
    rest = np.full((rows + 1, width + 1), FAR, np.int64)
    first = np.full((rows + 1, width + 1), FAR, np.int64)
    steps, even = np.arange(width + 1, dtype=np.int64) * INSERT, np.arange(width + 1) % 2 == 0
    rest[rows, : most // INSERT + 1] = steps[: most // INSERT + 1]
    for i in range(rows - 1, -1, -1):
        kind, left = pattern[i], rows - i
        low, high = max(0, left - most // DELETE), min(width, left + most // INSERT) + 1
        cost = rest[i + 1, low:high] + DELETE
        if kind != "-":
            more = TRUNCATED * kind.isupper()
            changed = np.full(high - low, FAR, np.int64)
            at = max(low, 1)
            keeps = even[at:high] if kind in "uU" else ~even[at:high] if kind in "aA" else np.zeros(high - at, bool)
            changed[at - low :] = rest[i + 1, at - 1 : high - 1] + more + np.where(keeps, KEEP, REROLE)
            cost = np.minimum(cost, changed)
        rest[i, low:high] = np.minimum.accumulate(cost - steps[low:high]) + steps[low:high]
        low, high = max(0, low - 1), max(1, high - 1)  # with the s, a symbol more is left
        first[i, low:high] = first[i + 1, low:high] + DELETE
        if kind in "sS":
            first[i, low:high] = np.minimum(first[i, low:high], rest[i + 1, low:high] + TRUNCATED * kind.isupper())
    without, with_s = rest[0, ::2], first[0, 2::2]
    least = int(min(without.min(), with_s.min(initial=FAR)))
    audits = [_traced(pattern, rest, first, 2 * int(k), False) for k in np.flatnonzero(without == least)]
    audits += [_traced(pattern, rest, first, 2 * int(k) + 2, True) for k in np.flatnonzero(with_s == least)]
    return least, min(audits)


def _traced(pattern: str, rest: np.ndarray, first: np.ndarray, r: int, pending: bool) -> str:
    """The ASCII-least audit of least cost for one length."""
    out, i = [], 0
    while i < len(pattern) or r or pending:
        here = first if pending else rest
        now = here[i, r]
        if i < len(pattern) and here[i + 1, r] + DELETE == now:
            out.append("D")
            i += 1
            continue
        if not pending and r and rest[i, r - 1] + INSERT == now:
            out.append("I")
            r -= 1
            continue
        kind = pattern[i]
        more = TRUNCATED * kind.isupper()
        if pending:
            out.append("K")
            pending = False
        else:
            kept = kind.lower() == ("u" if r % 2 == 0 else "a") and rest[i + 1, r - 1] + more == now
            out.append("K" if kept else "R")
            r -= 1
        i += 1
    return "".join(out)


class Audits(dict):
    """align() by pattern; those seen since it last held MEMO_BYTES are kept."""

    held = 0

    def __missing__(self, pattern: str) -> tuple[int, str]:
        if self.held > MEMO_BYTES:
            self.clear()
            self.held = 0
        self[pattern] = found = align(pattern)
        self.held += len(pattern) + len(found[1]) + 300
        return found


def _edited(audit: str, rows: Iterator[tuple[str, str]], state: int = START) -> Iterator[tuple[str, str]]:
    """Role and text of each repaired row."""
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = KEPT[state][role[:1]]
        else:
            role, state = "assistant" if state == WANTS_A else "user", NEXT[state]
        yield role, text


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _whole(turns: list, roles: list[str], texts: list[str], kinds: list[str], audits: Audits) -> tuple[dict, str]:
    """Counts and audit of one conversation."""
    seen, pattern, duplicate = set(), [], 0
    for role, text, kind in zip(roles, texts, kinds, strict=True):
        key = (role, text)
        again = kind != "-" and key in seen
        duplicate += again
        pattern.append("-" if again else kind)
        seen.add(key)
    cost, audit = audits["".join(pattern)]
    known = [t for t in turns if t is not None]
    counts = {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
        "blank": kinds.count("-"),
        "duplicate": duplicate,
        "truncated": sum(p.isupper() for p in pattern),
        "illegal": _illegal([r[:1] for r in roles]),
        "cost": cost,
    }
    return counts, audit


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _conversations(batches) -> Iterator[tuple]:
    """(conv_id, turns, roles, texts, kinds) of rows that come in order."""
    held: tuple | None = None
    for batch in batches:
        for conv, turn, role, text, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None or held[0] != conv:
                if held is not None:
                    yield held
                held = (conv, [], [], [], [])
            for part, value in zip(held[1:], (turn, role, text, kind), strict=True):
                part.append(value)
    if held is not None:
        yield held


def _short(rows: DataFrame, with_turns: bool) -> DataFrame:
    """One row a conversation, or one row a repaired turn."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    if with_turns:
        schema = f"conv_id {conv}, position bigint, role string, text string"
    else:
        schema = f"conv_id {conv}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"

    to = to_arrow_schema(T.StructType.fromDDL(schema))

    def function(batches):
        audits, out, size = Audits(), [], 0
        for conv_id, turns, roles, texts, kinds in _conversations(batches):
            counts, audit = _whole(turns, roles, texts, kinds, audits)
            edited = list(_edited(audit, iter(zip(roles, texts, strict=True))))
            if with_turns:
                out += [(conv_id, at, role, text) for at, (role, text) in enumerate(edited)]
                size += sum(len(text) + 50 for _, text in edited)
            else:
                digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in edited).encode()).hexdigest()
                out.append((conv_id, *(counts[c] for c in COUNTS), audit, digest))
                size += len(audit) + 200
            if size > 1 << 20:
                yield _batch(out, to)
                out, size = [], 0
        if out:
            yield _batch(out, to)

    return in_arrow(ordered.select("conv_id", "turn", "role", "text", "kind"), function, schema)


def _batch(rows: list[tuple], to: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), to.types, strict=True)], schema=to)


# --- long conversations -------------------------------------------------------


def _closed(costs: np.ndarray) -> np.ndarray:
    """Costs by state (first axis) when turns may be inserted at this place."""
    a, b = costs[WANTS_A].copy(), costs[PAIRED].copy()
    costs[WANTS_A] = np.minimum(a, b + INSERT)
    costs[PAIRED] = np.minimum(b, a + INSERT)
    costs[START] = np.minimum(costs[START], costs[WANTS_A] + INSERT)
    costs[AFTER_S] = np.minimum(costs[AFTER_S], costs[WANTS_A] + INSERT)
    return costs


def _before(kind: str, extra: int, after: np.ndarray) -> np.ndarray:
    """Costs to go before a row and `extra` copies of it, given those behind."""
    after = after + DELETE * extra
    costs = after + DELETE
    if kind != "-":
        more = TRUNCATED * kind.isupper()
        for state in range(4):
            costs[state] = np.minimum(costs[state], after[NEXT[state]] + REROLE + more)
            if kind.lower() in KEPT[state]:
                costs[state] = np.minimum(costs[state], after[KEPT[state][kind.lower()]] + KEEP + more)
    return _closed(costs)


#: Costs to go behind the last row.
ENDED = [0, 6, 3, 0]


def _block_audit(kinds: list[str], extras: list[int], costs: list[np.ndarray], state: int, last: bool) -> tuple[str, int]:
    """The audit of one block from a state on, and the state behind it."""
    out, i = [], 0
    while i < len(kinds) or (last and costs[i][state]):
        now = costs[i][state]
        if i < len(kinds):
            kind, behind = kinds[i], costs[i + 1] + DELETE * extras[i]
            if behind[state] + DELETE == now:
                out.append("D" * (extras[i] + 1))
                i += 1
                continue
        if costs[i][NEXT[state]] + INSERT == now:
            out.append("I")
            state = NEXT[state]
            continue
        more = TRUNCATED * kind.isupper()
        to = KEPT[state].get(kind.lower())
        if to is not None and behind[to] + KEEP + more == now:
            out.append("K" + "D" * extras[i])
            state = to
        else:
            out.append("R" + "D" * extras[i])
            state = NEXT[state]
        i += 1
    return "".join(out), state


def _id(pdf: pd.DataFrame):
    """The conv_id of a group, None where it is null."""
    value = pdf["conv_id"].iloc[0]
    return None if pd.isna(value) else value


def _stepped(groups: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    return groups.groupBy(*keys).applyInPandas(function, schema)


def _blocks(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Distinct rows of long conversations with copies, block, position and
    whether an earlier row equals them; blocks are cut by order."""
    merged = rows.groupBy("conv_id", "turn", "role", "text", "kind").agg(F.count(F.lit(1)).alias("copies"))
    dealt, merged_at = stored(merged, "repair-merged")
    parts = max(2, -(-dealt.count() // BLOCK_ROWS))
    head = F.substring("text", 1, 100)
    ordered = dealt.repartitionByRange(parts, F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", head).sortWithinPartitions("conv_id", "turn", "role", "text")
    placed, placed_at = stored(ordered.withColumn("position", F.monotonically_increasing_id()).withColumn("block", F.shiftright("position", 33)), "repair-placed")
    key = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    keyed = placed.withColumn("key", key)
    own = keyed.groupBy("conv_id", "key", "block").agg(F.min("position").alias("first_here"))
    earliest = own.groupBy("conv_id", "key").agg(F.min("block").alias("first_block"))
    known = own.join(earliest.withColumnRenamed("conv_id", "conv_").withColumnRenamed("key", "key_"), F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("key") == F.col("key_"))).select("conv_id", "key", "block", "first_here", "first_block")
    known = known.select(*(F.col(c).alias(f"{c}_") for c in known.columns))
    again = (F.col("first_block_") < F.col("block")) | (F.col("first_here_") < F.col("position"))
    flagged = keyed.join(known, F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("key") == F.col("key_")) & (F.col("block") == F.col("block_"))).select("conv_id", "block", "position", "turn", "role", "text", "kind", "copies", again.alias("again"))
    out, path = stored(flagged, "repair-flagged")
    remove(rows.sparkSession, merged_at, placed_at)
    return out, [path]


def _long(rows: DataFrame, with_turns: bool) -> DataFrame:
    """As _short, for conversations of any length."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()
    flagged, _ = _blocks(rows)
    slim = flagged.select("conv_id", "block", "position", "turn", F.substring("role", 1, 1).alias("initial"), F.when(F.col("again"), F.lit("-")).otherwise(F.col("kind")).alias("sign"), "kind", "copies", "again")
    summary = f"conv_id {conv}, block bigint, costs array<bigint>, first_turn {turn}, last_turn {turn}, turns bigint, first string, last string, blank bigint, duplicate bigint, truncated bigint, illegal bigint"

    def summed(pdf):
        pdf = pdf.sort_values("position")
        signs, extras = pdf["sign"].tolist(), (pdf["copies"] - 1).tolist()
        to_end = np.full((4, 4), FAR, np.int64)
        np.fill_diagonal(to_end, 0)
        for kind, extra in zip(reversed(signs), reversed(extras), strict=True):
            to_end = _before(kind, extra, to_end)
        known, initials = pdf["turn"].dropna(), pdf["initial"].tolist()
        blank = int(pdf.loc[pdf["kind"] == "-", "copies"].sum())
        rest = pdf[pdf["kind"] != "-"]
        duplicate = int((rest["copies"] - 1).sum() + rest["again"].sum())
        none = known.empty
        return pd.DataFrame([{
            "conv_id": _id(pdf), "block": int(pdf["block"].iloc[0]), "costs": np.minimum(to_end, FAR).ravel().tolist(),
            "first_turn": None if none else int(known.iloc[0]), "last_turn": None if none else int(known.iloc[-1]), "turns": int(known.nunique()), "first": initials[0], "last": initials[-1], "blank": blank, "duplicate": duplicate,
            "truncated": sum(s.isupper() for s in signs), "illegal": _illegal(initials) + sum(extras),
        }])

    blocks, _ = stored(_stepped(slim, ["conv_id", "block"], summed, summary), "repair-blocks")

    def joined(pdf):
        """Costs behind each block, and the conversation's counts on its first one."""
        pdf = pdf.sort_values("block").reset_index(drop=True)
        behind, out = np.array(ENDED, np.int64), [None] * len(pdf)
        for i in range(len(pdf) - 1, -1, -1):
            out[i] = behind.tolist()
            behind = np.minimum((np.array(pdf["costs"][i]).reshape(4, 4) + behind[None, :]).min(axis=1), FAR)
        pdf["behind"], pdf["is_last"] = out, [i == len(pdf) - 1 for i in range(len(pdf))]
        known = pdf.dropna(subset=["first_turn"])
        shared = int((known["first_turn"].to_numpy()[1:] == known["last_turn"].to_numpy()[:-1]).sum())
        gaps = 0 if known.empty else int(known["last_turn"].iloc[-1]) - int(known["first_turn"].iloc[0]) + 1 - (int(known["turns"].sum()) - shared)
        between = _illegal_between(pdf["last"].tolist(), pdf["first"].tolist())
        for name, value in (("gaps", gaps), ("blank", pdf["blank"].sum()), ("duplicate", pdf["duplicate"].sum()), ("truncated", pdf["truncated"].sum()), ("illegal", pdf["illegal"].sum() + between), ("cost", behind[START])):
            pdf[name] = int(value)
        pdf["order"] = range(len(pdf))
        return pdf[["conv_id", "block", "order", "behind", "is_last", *COUNTS]]

    plan, _ = stored(_stepped(blocks, ["conv_id"], joined, f"conv_id {conv}, block bigint, order bigint, behind array<bigint>, is_last boolean, " + ", ".join(f"{c} bigint" for c in COUNTS)), "repair-plan")
    told = plan.select(F.col("conv_id").alias("conv_"), F.col("block").alias("block_"), "behind", "is_last")
    with_plan = slim.join(told, F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("block") == F.col("block_"))).select("conv_id", "block", "position", "sign", "copies", "behind", "is_last")

    def traced(pdf):
        """The block's audit from each of the four states."""
        pdf = pdf.sort_values("position")
        signs, extras = pdf["sign"].tolist(), (pdf["copies"] - 1).tolist()
        costs = [np.array(pdf["behind"].iloc[0], np.int64)]
        for kind, extra in zip(reversed(signs), reversed(extras), strict=True):
            costs.append(_before(kind, extra, costs[-1]))
        costs.reverse()
        found = [_block_audit(signs, extras, costs, state, bool(pdf["is_last"].iloc[0])) if costs[0][state] < FAR // 2 else ("", state) for state in range(4)]
        return pd.DataFrame([{"conv_id": _id(pdf), "block": int(pdf["block"].iloc[0]), "audits": [a for a, _ in found], "ends": [int(s) for _, s in found]}])

    parts, _ = stored(_stepped(with_plan, ["conv_id", "block"], traced, f"conv_id {conv}, block bigint, audits array<string>, ends array<bigint>"), "repair-parts")

    def chosen(pdf):
        pdf = pdf.sort_values("block").reset_index(drop=True)
        state, states = START, []
        for ends in pdf["ends"]:
            states.append(state)
            state = int(ends[state])
        pdf["state"] = states
        return pdf[["conv_id", "block", "state"]]

    states = _stepped(parts.select("conv_id", "block", "ends"), ["conv_id"], chosen, f"conv_id {conv}, block bigint, state bigint")
    states = states.select(F.col("conv_id").alias("conv_"), F.col("block").alias("block_"), "state")
    audits, _ = stored(
        parts.join(states, F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("block") == F.col("block_"))).select("conv_id", "block", "state", F.element_at("audits", (F.col("state") + 1).cast("int")).alias("audit")),
        "repair-audits",
    )
    heard = audits.select(F.col("conv_id").alias("conv_"), F.col("block").alias("block_"), "state", "audit")
    texts = flagged.join(heard, F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("block") == F.col("block_"))).select("conv_id", "block", "position", "role", "text", "copies", "state", "audit")

    def turned(pdf):
        pdf = pdf.sort_values("position")
        rows_in_order = ((role, text) for role, text, n in zip(pdf["role"], pdf["text"], pdf["copies"], strict=True) for _ in range(n))
        edited = list(_edited(pdf["audit"].iloc[0], rows_in_order, int(pdf["state"].iloc[0])))
        out = pd.DataFrame(edited, columns=["role", "text"])
        out["conv_id"], out["block"], out["at"] = _id(pdf), int(pdf["block"].iloc[0]), range(len(out))
        return out[["conv_id", "block", "at", "role", "text"]]

    repaired = _stepped(texts, ["conv_id", "block"], turned, f"conv_id {conv}, block bigint, at bigint, role string, text string")
    if with_turns:
        return repaired.select("conv_id", ((F.col("block") * F.lit(1 << 33)) + F.col("at")).alias("position"), "role", "text")

    digest_schema = f"conv_id {conv}, repaired_sha256 string"
    to = to_arrow_schema(T.StructType.fromDDL(digest_schema))

    def hashed(batches):
        current, digest = None, None
        for batch in batches:
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is None or conv_id != current:
                    if digest is not None:
                        yield _batch([(current, digest.hexdigest())], to)
                    current, digest = conv_id, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
        if digest is not None:
            yield _batch([(current, digest.hexdigest())], to)

    stream = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "block", "at").select("conv_id", "role", "text")
    digests = in_arrow(stream, hashed, digest_schema).withColumnRenamed("conv_id", "conv_h")
    whole = audits.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit")).withColumnRenamed("conv_id", "conv_a")
    counts = plan.where("order = 0").select("conv_id", *COUNTS)
    return (
        counts.join(whole, F.col("conv_id").eqNullSafe(F.col("conv_a")))
        .join(digests, F.col("conv_id").eqNullSafe(F.col("conv_h")), "left")
        .select("conv_id", *COUNTS, "audit", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    )


def _illegal_between(last: list[str], first: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(last[:-1], first[1:], strict=True))


# --- interface -----------------------------------------------------------------


def _parted(turns: DataFrame, long_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of short conversations and, where there are any, of long ones."""
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("kind", _kind(F.col("role"), F.col("text")))
    ids = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > long_rows).select(F.col("conv_id").alias("long_id"))
    ids, _ = stored(ids, "repair-long")
    many = ids.count()
    if not many:
        return rows, None
    known = F.broadcast(ids) if many <= BROADCAST_IDS else ids
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return rows.join(known, same, "left_anti"), rows.join(known, same, "left_semi")


def audits(turns: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """One row a conversation of turns (conv_id, turn, role, text): gaps,
    faults, illegal neighbours, cost, audit and the digest of the repair."""
    short, long = _parted(turns, long_rows)
    out = _short(short, with_turns=False)
    return out if long is None else out.unionByName(_long(long, with_turns=False))


def repaired(turns: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """The repaired turns: conv_id, position (ascending, not dense), role, text."""
    short, long = _parted(turns, long_rows)
    out = _short(short, with_turns=True)
    return out if long is None else out.unionByName(_long(long, with_turns=True))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage, with its audit."""
    given = table(spark, sf_dir, "conversations")
    found = audits(damaged(given)).withColumnRenamed("conv_id", "found_id")
    ids = given.select("conv_id").distinct()
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in COUNTS]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    )
