"""Phrase mining against plain counts."""

import random
import re
from collections import Counter

import duckdb
import pytest

from verdance.llm import phrases

SCHEMA = "lang string, text string, phrase string, n string, doc_id bigint"


def plain(rows, least, top):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang, text = "und" if lang is None else lang, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    out = set()
    for lang, found in counts.items():
        good = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in good.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 50 * a for q, b in good.items()):
                continue
            score, k = min((1_000_000 * a * a // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return out


@pytest.mark.parametrize("sample", [1, 4, 1_000_000])
def test_plain_counts(spark, monkeypatch, sample):
    """Whatever the sample misses, further passes find."""
    monkeypatch.setattr(phrases, "SAMPLE_ONE_IN", sample)
    monkeypatch.setattr(phrases, "BUFFER_WORDS", 500)
    rng = random.Random(8)
    words = ["Ab", "cd", "é", "EF", "中文", "x-y", "\x00", "g h"] + [f"w{i}" for i in range(20)]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "!"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, ""])) for _ in range(120)]
    rows += [(None, "en"), ("", None), ("\n\r\x0b\x0c", "xx"), ("one two three " * 40, "fr"), *[("same text again", "fr")] * 12]
    frame = spark.createDataFrame([(lang, text, "p", "n", 1) for text, lang in rows], SCHEMA)
    for parts in (phrases.BROADCAST_PARTS, 0):
        monkeypatch.setattr(phrases, "BROADCAST_PARTS", parts)
        got = {tuple(r) for r in phrases.ranked(phrases.scored(frame), 300).collect()}
        assert got == plain(rows, 10, 300)


def test_large_numbers(spark, monkeypatch):
    """Products of counts that pass 64 bits."""
    big = 3_000_000_000
    found = spark.createDataFrame([("en", b"a", 1, 4 * big), ("en", b"b", 1, 5 * big), ("en", b"a b", 2, 3 * big)], "lang string, phrase binary, size int, n bigint")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, total bigint")
    monkeypatch.setattr(phrases, "frequent", lambda docs, least: (found, totals))
    r = phrases.scored(None).first()
    assert (r["a"], r["l"], r["r"], r["score"]) == (3 * big, 4 * big, 5 * big, 1_000_000 * 9 // 20)


def test_hashes_are_sparks(spark):
    from pyspark.sql import functions as F

    words = [b"", b"a", "é 中".encode(), b"x" * 100]
    got = [r[0] % (1 << 64) for r in spark.createDataFrame([(bytearray(w),) for w in words], "w binary").select(F.xxhash64(F.lit("und"), "w")).collect()]
    assert got == phrases._hashes(words, b"und").tolist()


def test_bitmap(spark):
    rows = spark.createDataFrame([("en", f"w{i}".encode(), 1) for i in range(500)], "lang string, phrase binary, size int")
    found = phrases.bitmap(rows)
    assert found.holds(phrases._hashes([f"w{i}".encode() for i in range(500)], b"en")).all()
    assert found.holds(phrases._hashes([f"v{i}".encode() for i in range(5_000)], b"en")).mean() < 0.01
    pairs = phrases.bitmap(spark.createDataFrame([("en", f"w{i} é{i + 1}".encode(), 2) for i in range(500)], "lang string, phrase binary, size int"))
    mixed = phrases._mixed(phrases._hashes([f"w{i}".encode() for i in range(500)], b"en"), phrases._hashes([f"é{i + 1}".encode() for i in range(500)], b"en"))
    assert pairs.holds(mixed).all() and pairs.holds(mixed[::-1] + phrases.np.uint64(1)).mean() < 0.01


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert phrases.op12_phrases(spark, str(tmp_path)).collect() == []


def test_sql(spark):
    with duckdb.connect() as db:
        db.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
        want = sorted(db.sql(phrases.OP12_SQL).fetchall())
    assert sorted(tuple(r) for r in phrases.op12_phrases(spark, "/root/testdata/sf0.001").collect()) == want


def test_many_parts_are_not_gathered_in_the_driver(spark, tmp_path, monkeypatch):
    """parts that were dealt out 16 times were sized as before and broadcast, 4 GB of them on half a GB of texts."""
    rows = [("en", f"w{i % 7}".encode(), 1, 90) for i in range(7)] + [("en", f"w{i} w{j}".encode(), 2, 20) for i in range(7) for j in range(7)] + [("en", f"w{i} w{j} w3".encode(), 3, 11) for i in range(7) for j in range(5)]
    spark.createDataFrame(rows, "lang string, phrase binary, size int, n bigint").write.parquet(str(tmp_path / "found"))
    totals = spark.createDataFrame([("en", 900)], "lang string, total bigint")
    monkeypatch.setattr(phrases, "frequent", lambda docs, least: (spark.read.parquet(str(tmp_path / "found")), totals))
    few = phrases.scored(None)
    monkeypatch.setattr(phrases, "BROADCAST_PARTS", 0)
    many = phrases.scored(None)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") >= 3  # the totals of each lang alone
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) != []
