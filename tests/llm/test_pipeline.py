"""The pipeline's stages against plain versions, each on its own input."""

import hashlib
import re

import public_tokenizers
import sentencepiece

import corpus_pipeline
from verdance.llm import toxicity

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]


def plain_lines(texts):
    """The texts that the line stage leaves, by loops over lines."""
    template_docs, run_docs, cut = {}, {}, {}
    for i, text in texts.items():
        cut[i] = []
        for line in (text or "").split("\n"):
            masked = re.sub(r"[^ \t\r\x0b\f]*[0-9][^ \t\r\x0b\f]*", "<*>", line.lower())
            cut[i].append([w for w in re.split(r"[ \t\r\x0b\f]+", masked) if w])

    def templates(w):
        n, step = len(w), -(-max(len(w) - 3, 0) // 3)
        out = [(n, -1, *w)]
        if n >= 12:
            out += [(n, k, *w[:3], *w[3 : 3 + k * step], None, *w[3 + (k + 1) * step :]) for k in range(3)]
        elif n >= 6:
            out += [(n, k, *w[: 3 + k], None, *w[4 + k :]) for k in range(n - 3)]
        return out

    def runs(i):
        rows, end = [], 0
        for at, w in enumerate(cut[i]):
            if w:
                rows.append((at, end, end := end + len(w)))
        for at, begin, stop in rows:
            for inside in ([r for r in rows if begin <= r[1] < begin + 20], [r for r in rows if stop - 20 < r[2] <= stop]):
                span = inside[0][0], inside[-1][0]
                if end < 20:
                    yield ("text", texts[i]), span
                elif sum(r[2] - r[1] for r in inside) >= 20:
                    yield tuple(tuple(cut[i][r[0]]) for r in inside), span

    for i in texts:
        for w in cut[i]:
            for t in templates(w) if len(w) >= 4 else []:
                template_docs.setdefault(t, set()).add(i)
        for key, _ in runs(i):
            run_docs.setdefault(key, set()).add(i)
    out = {}
    for i, text in texts.items():
        lost = {}
        for at, w in enumerate(cut[i]):
            for t in templates(w) if len(w) >= 4 else []:
                ids = template_docs[t]
                if len(ids) >= (2 if len(w) >= 20 else 5) and min(ids) != i:
                    lost.setdefault(at, set()).add(min(ids))
        for key, (a, b) in runs(i):
            if len(run_docs[key]) >= 2 and min(run_docs[key]) != i:
                for at in range(a, b + 1):
                    lost.setdefault(at, set()).add(min(run_docs[key]))
        lines, kept = (text or "").split("\n"), None
        if lost and any(line.strip() for at, line in enumerate(lines) if at not in lost):
            worth = {}
            for at, firsts in lost.items():
                for f in firsts:
                    worth[f] = worth.get(f, 0) + 1
            of = max(worth, key=lambda f: (worth[f], f))
            a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (re.split(r"[ \t\n\r\x0b\f]+", texts[j].lower().strip(" \t\n\r\x0b\f")) for j in (i, of)))
            if text != texts[of] and a and b and 100 * len(a & b) >= 80 * len(a | b):
                kept = text
        kept = kept if kept is not None else "\n".join(line for at, line in enumerate(lines) if at not in lost)
        if not lost or kept.strip():
            out[i] = text if not lost else kept
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_templates", "near_duplicates", "decontamination", "piece_codec"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if name != "piece_codec":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = {r["doc_id"]: r for r in docs.collect()}
        if name == "toxicity":
            labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
            model = toxicity.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels)
            assert set(rows) == {i for i, t in before.items() if model.score(t) < toxicity.THRESHOLD}
        if name == "line_templates":
            assert {i: r["text"] for i, r in rows.items()} == plain_lines(previous)
        if name == "near_duplicates":
            sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, r in rows.items() if (w := (r["text"] or "").encode().lower().split())}
            ids = sorted(sets)
            for x, a in enumerate(ids):
                for b in ids[x + 1 :]:
                    both = len(sets[a] & sets[b])
                    assert 100 * both < 80 * (len(sets[a]) + len(sets[b]) - both)
        if name == "decontamination":
            grams = set()
            for item in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
                w = words(item["text"])
                grams |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9)) if w}
            for i in before:
                if i in previous:
                    w = words(previous[i])
                    hit = any(tuple(w[k : k + 10]) in grams for k in range(max(1, len(w) - 9)))
                    assert hit == (i not in rows)
        if name == "piece_codec":
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert set(rows) == set(previous)
            for i, r in rows.items():
                ids = library.encode(previous[i] or "")
                assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        else:
            previous = {i: r["text"] for i, r in rows.items()}


def test_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing names of columns, and no rows at all."""
    long = " ".join(f"w{k}" for k in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two three."), (4, "One two three."), (None, "no id here"), (None, None), (5, long), (6, long), (7, "x" * 200_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "a", 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _id string, _hash int, drop_at int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        got = [r["doc_id"] for r in out.select("doc_id").collect()]
        if name == "toxicity":
            model = toxicity.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
            assert sorted(got, key=str) == sorted((i for i, t in rows if model.score(t) < toxicity.THRESHOLD), key=str) and got.count(None) == 2
        elif name in ("line_templates", "near_duplicates"):
            assert sorted(got, key=str) == sorted((i for i, _ in rows if i != 6), key=str)
        else:
            assert len(got) == len(rows)
        assert name == "piece_codec" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_near_copies_stay_whole_until_they_are_judged(spark):
    """Copies with an edit a line keep no fragments; a shared passage alone goes."""
    lines = [" ".join(f"w{chr(97 + i)}{chr(97 + k)}x" for k in range(22)) for i in range(10)]
    edited = [line if i % 5 else line.replace("w" + chr(97 + i) + "gx", "other").replace("w" + chr(97 + i) + "tx", "others") for i, line in enumerate(lines)]
    passage = " ".join(f"p{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines)), (3, "\n".join(edited)), (4, passage + "\nhere are some words of its own to keep"), (5, "quite another beginning of a text\n" + passage), (6, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_recurring_lines(spark, docs, FOLDER).collect()}
    assert got == plain_lines(dict(rows)) == {1: rows[0][1], 3: rows[2][1], 4: rows[3][1], 5: "quite another beginning of a text"}
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(sorted(got.items()), "doc_id long, text string"), FOLDER)
    assert {r["doc_id"] for r in left.collect()} == {1, 4, 5}
