"""Conversation repair against a plain search over all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from verdance.llm import conversation_repair as cr

GRAMMAR = re.compile(r"(s?(ua)+)?")


def plain_rows(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = "".join(c for c in text if c not in ".!?")
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_edit(rows, found, inserts):
    """(cost, audit, repaired) of every sequence of edits with a bounded number of insertions at each place."""
    best = None

    def go(i, cost, audit, built, state):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and state in "0P":
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, list(built))
        nexts = {"0": ("user", "U"), "S": ("user", "U"), "U": ("assistant", "P"), "P": ("user", "U")}
        role_to, to = nexts[state]
        if audit[-inserts:] != "I" * inserts:
            go(i, cost + 3, audit + "I", [*built, (role_to, "")], to)
        if i == len(rows):
            return
        _, _, role, text = rows[i]
        go(i + 1, cost + 4, audit + "D", built, state)
        if found[i] in ("blank", "duplicate"):
            return
        more = 3 * (found[i] == "truncated")
        kept = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "P", ("P", "u"): "U"}.get((state, role[:1]))
        if kept:
            go(i + 1, cost + more, audit + "K", [*built, (role, text)], kept)
        go(i + 1, cost + 3 + more, audit + "R", [*built, (role_to, text)], to)

    go(0, 0, "", [], "0")
    return best


def plain(all_rows):
    out = {}
    for conv in {r[0] for r in all_rows}:
        rows = plain_rows([r for r in all_rows if r[0] == conv])
        found = faults(rows)
        cost, audit, built = every_edit(rows, found, 3)
        assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in built))
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        out[conv] = (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in built).encode()).hexdigest())
    return out


def made(seed, conversations, most):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"])
            text = rng.choice(["One.", "Two", "Three!  ", "  ", "", None, "Four?\n", "é . x", "a\tb.", f"Text {rng.random()}."])
            rows.append((rng.choice([conv, conv, conv, None]) if conv == 3 else conv, rng.choice([turn, turn, turn, None, turn + 2]), role, text))
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def result(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("long_rows", [cr.LONG_ROWS, 2])
def test_all_edits(spark, tmp_path, monkeypatch, long_rows):
    monkeypatch.setattr(cr, "BLOCK_ROWS", 4)
    monkeypatch.setattr(cr, "LONG_ROWS", long_rows)
    rows = made(5, 60 if long_rows > 2 else 25, 6)
    rows += rows[:7]  # repeated rows
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", `copy` string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    want, zero = plain(rows), hashlib.sha256(b"").hexdigest()
    if long_rows > 2:
        got = result(cr.op13_conversation_repair(spark, str(tmp_path)))
    else:
        got = result(cr.audits(cr.damaged(frame), long_rows))
        gone = {c: w for c, w in want.items() if c not in got}
        assert all(w == (0,) * 6 + ("", zero) for w in gone.values())
        want = {c: w for c, w in want.items() if c in got}
    assert got == want


def test_repaired_turns(spark):
    rows = made(11, 30, 7)
    frame = cr.damaged(spark.createDataFrame(rows, SCHEMA))
    for limit in (cr.LONG_ROWS, 3):
        built = {}
        for r in sorted(cr.repaired(frame, limit).collect(), key=lambda r: r["position"]):
            built.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        for conv, found in result(cr.audits(frame, limit)).items():
            assert hashlib.sha256("\n".join(built.get(conv, [])).encode()).hexdigest() == found[-1]
            assert GRAMMAR.fullmatch("".join(line.partition(":")[0][:1] for line in built.get(conv, [])))


def test_long_and_short_ways_agree(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"T{rng.randint(0, 400)}.", "", f"open {t}"])) for c in range(2) for t in range(700)]
    rows += [(0, 5, "user", "Again.")] * 300
    frame = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(cr, "BLOCK_ROWS", 150)
    short, long = result(cr.audits(frame)), result(cr.audits(frame, 100))
    assert short == long and short[0][2] >= 299


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert cr.op13_conversation_repair(spark, str(tmp_path)).collect() == []
    drops = [(c, t, "user", "x.") for c in range(400) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = result(cr.op13_conversation_repair(spark, _written(spark, tmp_path, drops)))
    assert drops and set(got.values()) == {(0,) * 6 + ("", hashlib.sha256(b"").hexdigest())}


def _written(spark, tmp_path, rows):
    at = tmp_path / "dropped"
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(at / "conversations.parquet"))
    return str(at)


def test_short_patterns():
    """align() against the folded states, which take all lengths at once."""
    for size in range(7):
        for pattern in itertools.product("uasxU-" if size < 6 else "uas-", repeat=size):
            costs = [cr.np.array(cr.ENDED, cr.np.int64)]
            for kind in reversed(pattern):
                costs.append(cr._before(kind, 0, costs[-1]))
            costs.reverse()
            audit, _ = cr._block_audit(list(pattern), [0] * size, costs, cr.START, True)
            assert cr.align("".join(pattern)) == (costs[0][cr.START], audit)
