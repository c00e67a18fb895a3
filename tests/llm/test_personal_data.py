"""Personal data: patterns against their plain form, the model's gradients, decoding and held-out spans."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from verdance.llm import personal_data as pd

FOLDER = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(text):
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("a.b@-1+9 0(4)5é%2") for _ in range(rng.randint(0, 30)))
        assert pd.base_spans(text) == plain_spans(text), text
    assert pd.base_spans("4111 1111 1111 1111 and 256.1.1.1 and 1.2.3.4") == [(1, 38, 45), (2, 0, 19)]
    for hostile in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + " " * 300_000, "+" * 300_000, "a.@b" * 80_000):
        pd.base_spans(hostile)


@pytest.fixture(scope="module")
def model(spark):
    return pd.train(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_gradients():
    rng = np.random.default_rng(0)
    windows = [("ab 12.3.4.5 x", [(1, 3, 11)]), ("tel +1 (2) 34", [(3, 4, 13)])]
    model = pd.fit(windows, epochs=0)
    model.weights = {n: v.astype(np.float64) for n, v in model.weights.items()}
    ids = np.stack([pd.signs(t) for t, _ in windows], axis=1)
    gold = np.stack([pd.tags(len(t), s) for t, s in windows], axis=1)

    def loss():
        """Minus the mean log probability, by the sum over all paths."""
        w, total = model.weights, 0.0
        scores = model.emissions(ids).astype(np.float64)
        for k in range(len(windows)):
            a = w["start"] + scores[0, k]
            path = w["start"][gold[0, k]] + scores[0, k, gold[0, k]]
            for t in range(1, len(ids)):
                every = np.where(pd.ALLOWED, a[:, None] + w["moves"], -np.inf)
                a = np.log(np.exp(every - every.max()).sum(axis=0)) + every.max() + scores[t, k]
                path += w["moves"][gold[t - 1, k], gold[t, k]] + scores[t, k, gold[t, k]]
            total += np.log(np.exp(a - a.max()).sum()) + a.max() - path
        return total / len(windows)

    found = pd._gradients(model, ids, gold)
    for name, weights in model.weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in weights.shape)
            if name.startswith("w"):
                at = (int(ids[rng.integers(0, len(ids)), 0]), at[1])
            was, step = weights[at], 1e-2
            weights[at] = was + step
            up = loss()
            weights[at] = was - step
            down = loss()
            weights[at] = was
            assert abs((up - down) / (2 * step) - found[name][at]) < 3e-3, (name, at)


def test_best_path():
    rng = np.random.default_rng(1)
    scores, moves, start = rng.normal(size=(4, 3, pd.TAGS)).astype(np.float32), rng.normal(size=(pd.TAGS, pd.TAGS)).astype(np.float32), rng.normal(size=pd.TAGS).astype(np.float32)
    got = pd.best_tags(scores, moves, start)
    marginal = pd._posteriors(scores, moves, start)[0]
    for k in range(3):
        value = lambda p, k=k: start[p[0]] + scores[0, k, p[0]] + sum((moves[a, b] if pd.ALLOWED[a, b] else -1e9) + scores[t + 1, k, b] for t, (a, b) in enumerate(itertools.pairwise(p)))
        paths = list(itertools.product(range(pd.TAGS), repeat=4))
        values = np.array([value(p) for p in paths], np.float64)
        assert tuple(got[:, k]) == paths[int(values.argmax())]
        weight = np.exp(values - values.max())
        first = np.array([sum(w for p, w in zip(paths, weight, strict=True) if p[1] == tag) for tag in range(pd.TAGS)])
        assert np.allclose(marginal[1, k], first / weight.sum(), atol=1e-4)


def test_reconciled():
    rng = random.Random(4)
    for _ in range(300):
        found = []
        for _ in range(rng.randint(0, 7)):
            a = rng.randint(0, 12)
            found.append((rng.choice([0.9, 0.95, 0.97, 1.0]), rng.randint(0, 3), a, a + rng.randint(1, 6)))
        best = max((sum({f[1:]: f[0] for f in sorted(pick)}.values()) for n in range(len(found) + 1) for pick in itertools.combinations(found, n) if all(x[3] <= y[2] or y[3] <= x[2] for x, y in itertools.combinations({f[1:]: f for f in pick}.values(), 2))), default=0)
        got = pd.reconciled(found)
        worth = {}
        for p, *s in found:
            worth[tuple(s)] = max(p, worth.get(tuple(s), 0))
        assert abs(sum(worth[s] for s in got) - best) < 1e-9


def test_held_out_spans(spark, model):
    """Spans of other forms put into documents that training doesn't see."""
    rng = np.random.default_rng(1234)
    texts = [r["text"][:260] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(400).collect() if r["text"]]
    found, all_of, wrong = [0] * 4, [0] * 4, 0
    for i, text in enumerate(texts):
        kind, at = i % 4, text.find(" ", len(text) // 2) + 1
        put = pd.MAKERS[kind](rng)
        whole = text[:at] + put + " " + text[at:]
        base = pd.base_spans(whole)
        spans = set(base) | {s for s in pd.model_spans(model, [whole])[0] if all(s[2] <= a or b <= s[1] for _, a, b in base)}
        all_of[kind] += 1
        found[kind] += (kind, at, at + len(put)) in spans
        wrong += sum(not (at < b and a < at + len(put)) for _, a, b in spans - set(pd.base_spans(text)) - set(base))
    assert all(f >= 0.7 * n for f, n in zip(found, all_of, strict=True)), (found, all_of)
    assert wrong <= 4


def test_skipped_windows_hold_nothing(model, monkeypatch):
    texts = ["plain words only " * 60 + "jo.an (at) mail (dot) org" + " and more words" * 60, "nothing here", "call 030 1234567 now " * 3 + "é" * 700, ""]
    quick = pd.model_spans(model, texts)
    monkeypatch.setattr(pd, "_HINT", re.compile(r"[0-9@]|[(\[{<]\s?at\s?[)\]}>]|\bdot\b|\w|\s", re.IGNORECASE))
    assert pd.model_spans(model, texts) == quick


def test_windows_and_long_texts(model):
    put = "jo.an (at) mail (dot) org"
    for shift in range(0, 400, 7):
        text = "word " * (shift // 5) + "x" * (shift % 5) + " " + put + " some words follow here" * 30
        at = text.index(put)
        assert (0, at, at + len(put)) in pd.model_spans(model, [text])[0]


def test_query(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "a@b.co"), (3, "mail a@b.co, ip 10.0.0.1, 4111 1111 1111 1111, +1 (555) 555-1234 é"), (3, "mail a@b.co"), (4, "x" * 200_000 + " a@b.co")]
    frame = spark.createDataFrame([(i, t, "k", "s") for i, t in rows], "doc_id bigint, text string, spans string, n_email string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = pd.op11_personal_data(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        base = plain_spans(text or "")
        want = (*(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(pd.named(base).encode()).hexdigest())
        assert any(r["doc_id"] == doc_id and (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == want for r in got)
    assert pd.masked(rows[3][1], pd.base_spans(rows[3][1])) == "mail [email], ip [ip], [card], [phone] é"


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert pd.op11_personal_data(spark, str(tmp_path)).collect() == []
