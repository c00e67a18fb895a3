"""Personal data: patterns, and a character model of two LSTMs with CRF transitions.

The four patterns are the base. A bidirectional LSTM over characters with a
conditional random field over begin and inside tags of the four kinds, trained
here in numpy, adds spans that are written in other ways (``name (at) host
(dot) org``, spaced or bracketed addresses, IPv6, cards and phones with other
separators). It learns from a bounded sample of windows of the documents,
labelled by the base spans, and from spans of many forms that are put into such
windows, whose labels are known.

A text is decoded in overlapping windows; the spans of all its windows, each
with its posterior, are reconciled over the whole text by the greatest total
posterior of spans that don't overlap. A span of the model must then be valid
for its kind (digits, check sum, address) and must not overlap a base span. A
valid span holds a digit, an at-sign, a bracketed ``at`` or the word ``dot``;
a window without any of these therefore isn't run, with the same result.

Defined results: a null or empty text has no spans; a null doc_id is kept;
repeated rows each get a row; texts of any length are read whole; spans of
equal posterior that overlap: the earlier one stays; a posterior that is the
threshold exactly counts; an empty table gives no rows; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table

KINDS = ["email", "ip", "card", "phone"]
#: Windows of the documents that the model learns from at most: with and without a base span's signs.
TRAIN_SIGNED, TRAIN_PLAIN, TRAIN_CHARS = 500, 1_500, 64
HIDDEN, EPOCHS, BATCH, RATE, SEED = 16, 8, 128, 0.03, 7
#: Training windows with something put in, dealt out over the windows of the documents.
PUT_IN = 5_000
#: Characters of a window that are its own, and of the overlap on either side.
CORE, OVERLAP = 192, 64
#: Windows that are run at once, and the least posterior of a span of the model.
AT_ONCE, LEAST = 256, 0.9

# --- base ------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match from within a run of digits succeeds only if one from its start does.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches by their at-signs, so that long runs take linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            end = domain.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [(0, *span) for span in emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


# --- characters and tags -------------------------------------------------------

_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SIGNS = ["\n", " ", "0", *"abcdefghijklmnopqrstuvwxyz", *_PUNCTUATION, "other"]
_SIGN_OF = np.full(128, len(_SIGNS) - 1, np.int16)
for _i, _s in enumerate(_SIGNS[:-1]):
    _SIGN_OF[ord(_s)] = _SIGN_OF[ord(_s.upper())] = _i
_SIGN_OF[48:58], _SIGN_OF[9] = 2, 1
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def signs(text: str) -> np.ndarray:
    """A class a code point: letters without case, digits alike, other scripts alike."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(codes), len(_SIGNS) - 1, np.int16)
    plain = codes < 128
    out[plain] = _SIGN_OF[codes[plain]]
    return out


def tags(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(length, np.int16)
    for kind, a, b in spans:
        out[a:b] = 2 + 2 * kind
        out[a] = 1 + 2 * kind
    return out


#: Inside follows begin or inside of its own kind only.
ALLOWED = np.array([[b == 0 or b % 2 == 1 or (a and (a - 1) // 2 == (b - 1) // 2) for b in range(TAGS)] for a in range(TAGS)], bool)


# --- the model -------------------------------------------------------------------


@dataclass
class Model:
    """Weights by name; ``w`` and ``u`` of both directions, ``out``, ``bias``, ``moves``, ``start``."""

    weights: dict[str, np.ndarray]

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores of tags for windows of signs, both time first."""
        w = self.weights
        ahead, _ = _lstm(ids, w["w0"], w["u0"])
        back, _ = _lstm(ids[::-1], w["w1"], w["u1"])
        return np.concatenate([ahead, back[::-1]], axis=2) @ w["out"] + w["bias"]


def _lstm(ids: np.ndarray, w: np.ndarray, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    steps, many = ids.shape
    size = u.shape[0]
    h, c = np.zeros((many, size), np.float32), np.zeros((many, size), np.float32)
    out, kept = np.empty((steps, many, size), np.float32), []
    for t in range(steps):
        z = h @ u
        z += w[ids[t]]
        np.tanh(z, out=z)
        gates = z[:, : 3 * size]  # sigmoids, as tanh of weights that stand for halves
        gates *= 0.5
        gates += 0.5
        before, state = c, h
        c = z[:, size : 2 * size] * c + z[:, :size] * z[:, 3 * size :]
        squashed = np.tanh(c)
        h = z[:, 2 * size : 3 * size] * squashed
        out[t] = h
        if keep:
            kept.append((z, before, state, squashed))
    return out, kept


def _lstm_back(ids: np.ndarray, u: np.ndarray, kept: list, outer: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of w and u."""
    steps, many = ids.shape
    size = u.shape[0]
    dz_all = np.empty((steps, many, 4 * size), np.float32)
    du = np.zeros_like(u)
    dh, dc = np.zeros((many, size), np.float32), np.zeros((many, size), np.float32)
    for t in range(steps - 1, -1, -1):
        z, before, state, squashed = kept[t]
        i, f, o, g = (z[:, k * size : (k + 1) * size] for k in range(4))
        dh = dh + outer[t]
        dc = dc + dh * o * (1 - squashed**2)
        dz = dz_all[t]
        dz[:, :size] = dc * g * 2 * i * (1 - i)
        dz[:, size : 2 * size] = dc * before * 2 * f * (1 - f)
        dz[:, 2 * size : 3 * size] = dh * squashed * 2 * o * (1 - o)
        dz[:, 3 * size :] = dc * i * (1 - g**2)
        du += state.T @ dz
        dh, dc = dz @ u.T, dc * f
    hot = np.zeros((steps * many, vocabulary), np.float32)
    hot[np.arange(steps * many), ids.ravel()] = 1
    return hot.T @ dz_all.reshape(steps * many, -1), du


def _posteriors(scores: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of tags by scaled sums forward and backward, with what gradients need."""
    steps = len(scores)
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    m = np.exp(moves) * ALLOWED
    ahead, back = np.empty_like(e), np.empty_like(e)
    scale = np.empty(e.shape[:2], e.dtype)
    a = np.exp(start) * e[0]
    for t in range(steps):
        if t:
            a = (ahead[t - 1] @ m) * e[t]
        scale[t] = a.sum(axis=1)
        ahead[t] = a / scale[t][:, None]
    b = np.ones_like(e[0])
    back[-1] = b
    for t in range(steps - 2, -1, -1):
        b = (back[t + 1] * e[t + 1] / scale[t + 1][:, None]) @ m.T
        back[t] = b
    return ahead * back, ahead, back, e / scale[:, :, None], m


def _gradients(model: Model, ids: np.ndarray, gold: np.ndarray) -> dict[str, np.ndarray]:
    w = model.weights
    steps, many = ids.shape
    ahead, kept0 = _lstm(ids, w["w0"], w["u0"], keep=True)
    back, kept1 = _lstm(ids[::-1], w["w1"], w["u1"], keep=True)
    both = np.concatenate([ahead, back[::-1]], axis=2)
    marginal, fore, aft, e, m = _posteriors(both @ w["out"] + w["bias"], w["moves"], w["start"])
    hot = np.eye(TAGS, dtype=np.float32)[gold]
    d = (marginal - hot) / many
    pairs = sum(fore[t - 1].T @ (aft[t] * e[t]) for t in range(1, steps)) * m
    taken = sum(hot[t - 1].T @ hot[t] for t in range(1, steps))
    size = w["u0"].shape[0]
    d_both = d @ w["out"].T
    g = {"out": both.reshape(-1, 2 * size).T @ d.reshape(-1, TAGS), "bias": d.sum(axis=(0, 1)), "moves": (pairs - taken) / many, "start": d[0].sum(axis=0)}
    g["w0"], g["u0"] = _lstm_back(ids, w["u0"], kept0, d_both[:, :, :size], len(_SIGNS))
    g["w1"], g["u1"] = _lstm_back(ids[::-1], w["u1"], kept1, d_both[::-1, :, size:], len(_SIGNS))
    return g


def fit(windows: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = EPOCHS) -> Model:
    """A model from (text, spans) pairs, by Adam on batches of equal length."""
    rng = np.random.default_rng(SEED)
    length = max(len(text) for text, _ in windows)  # about TRAIN_CHARS and a span
    ids, gold = np.zeros((length, len(windows)), np.int16), np.zeros((length, len(windows)), np.int16)
    for k, (text, spans) in enumerate(windows):
        ids[: len(text), k], gold[: len(text), k] = signs(text), tags(len(text), spans)
    scale = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
    w = {"w0": scale(len(_SIGNS), 4 * HIDDEN), "u0": scale(HIDDEN, 4 * HIDDEN), "w1": scale(len(_SIGNS), 4 * HIDDEN), "u1": scale(HIDDEN, 4 * HIDDEN), "out": scale(2 * HIDDEN, TAGS), "bias": scale(TAGS), "moves": scale(TAGS, TAGS), "start": scale(TAGS)}
    for name in ("w0", "w1"):
        w[name][:, HIDDEN : 2 * HIDDEN] += 0.5  # remember at first
    model = Model(w)
    mean, square, at = {n: np.zeros_like(v) for n, v in w.items()}, {n: np.zeros_like(v) for n, v in w.items()}, 0
    all_steps = epochs * -(-len(windows) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for first in range(0, len(order), BATCH):
            batch = order[first : first + BATCH]
            at += 1
            rate = RATE * min(1, at / 20) * (1 - 0.95 * at / all_steps)
            g = _gradients(model, ids[:, batch], gold[:, batch])
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            for n, v in g.items():
                v = v * min(1, 5 / (norm + 1e-9))
                mean[n] = 0.9 * mean[n] + 0.1 * v
                square[n] = 0.99 * square[n] + 0.01 * v**2
                w[n] -= (rate * (mean[n] / (1 - 0.9**at)) / (np.sqrt(square[n] / (1 - 0.99**at)) + 1e-6)).astype(np.float32)
    return model


def best_tags(scores: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The Viterbi path of each window, time first."""
    steps, many, _ = scores.shape
    score = np.where(ALLOWED, moves, -1e9).astype(np.float32)
    came = np.empty((steps, many, TAGS), np.int8)
    a = start + scores[0]
    for t in range(1, steps):
        every = a[:, :, None] + score
        came[t] = every.argmax(axis=1)
        a = every.max(axis=1) + scores[t]
    out = np.empty((steps, many), np.int8)
    out[-1] = a.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = came[t, np.arange(many), out[t]]
    return out


# --- examples whose labels are known -------------------------------------------------

_SYLLABLES = ["an", "be", "cor", "da", "el", "fi", "go", "hu", "in", "jo", "ka", "lu", "mi", "no", "or", "pe", "ri", "sa", "to", "ve"]


def _word(rng, low: int = 1, high: int = 4) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.integers(low, high)))


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _email(rng) -> str:
    local = rng.choice([".", "_", "-", ""]).join(_word(rng) for _ in range(rng.integers(1, 3))) + (_digits(rng, rng.integers(1, 4)) if rng.random() < 0.4 else "")
    if rng.random() < 0.2:
        local += "." + _digits(rng, 2)
    host = [*(_word(rng) for _ in range(rng.integers(1, 3))), str(rng.choice(["com", "org", "net", "de", "fr", "es", "co", "io"]))]
    at = rng.choice(["@", "@", "@", " at ", " (at) ", "(at)", " [at] ", "[at]", " AT ", " @ ", "{at}"])
    dot = rng.choice([" dot ", " (dot) ", "(dot)", " [dot] ", "[dot]", "[.]"]) if at.strip() != "@" and (rng.random() < 0.7 or at == " at " or at == " AT ") else rng.choice([".", ".", ".", "[.]"]) if at == "@" else "."
    return local + at + dot.join(host)


def _ip(rng) -> str:
    if rng.random() < 0.3:
        groups = [format(int(g), "x") for g in rng.integers(1, 65536, 8)]
        return ":".join(groups) if rng.random() < 0.5 else ":".join(groups[:3]) + "::" + ":".join(groups[3 : 3 + rng.integers(1, 3)])
    return str(rng.choice([".", ".", "[.]", " . ", "(.)", " dot ", "[dot]"])).join(map(str, rng.integers(0, 256, 4)))


def _card(rng) -> str:
    n = int(rng.choice([16, 16, 16, 15, 19]))
    body = str(rng.choice(["4", "5", "37", "6"])) + _digits(rng, n)
    body = body[: n - 1]
    digits = next(body + str(d) for d in range(10) if luhn(body + str(d)))
    mark = str(rng.choice(["", " ", "-", ".", "  ", " - ", "/", "_"]))
    sizes = [4, 6, 5] if n == 15 else [4] * 5
    parts, at = [], 0
    for size in sizes:
        if at < n:
            parts.append(digits[at : at + size])
            at += size
    return mark.join(parts)


def _phone(rng) -> str:
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    two = [_digits(rng, 2) for _ in range(4)]
    return str(rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{two[0]} {a} {b}{c}", f"00{two[0]} {a} {b} {c}", f"0{two[0][0]} {' '.join(two)}", f"+33 {two[0][0]} {' '.join(two)}", f"(+1) {a} {b} {c}", f"1-{a}-{b}-{c}", f"0{a}/{b}{c}", f"0{a} {b}{c}"]))


def _other(rng) -> str:
    """What looks like personal data and isn't."""
    year, part = rng.integers(1900, 2100), rng.integers(1, 29)
    return str(rng.choice([
        f'token = "{"".join(rng.choice(list("0123456789abcdef"), 40))}"', f"{year}-{part % 12 + 1:02d}-{part:02d}", f"{part}/{part % 12 + 1}/{year}", f"{part % 24:02d}:{part * 2:02d}:{part:02d}", f"${_digits(rng, 2)},{_digits(rng, 3)}.{_digits(rng, 2)}",
        f"Version {part}.{part % 7}.", f"v{part}.{part % 7}.{part % 5}", _digits(rng, rng.integers(1, 8)), f"{_digits(rng, 3)}-{_digits(rng, 3)}", f"http://www.{_word(rng)}.com/{_word(rng)}/{_digits(rng, 5)}", f"#{_digits(rng, 5)}", f"{_digits(rng, 1)}.{_digits(rng, 6)}",
        f"at {_word(rng)}", f"dot {_word(rng)}", f"a dot at {_word(rng)}", f"{_word(rng)} at {_word(rng)}", f"@{_word(rng)}", f"{_digits(rng, 4)} {_digits(rng, 4)}", f"{_digits(rng, 3)} | {_digits(rng, 4)} | {_digits(rng, 2)}", f"{_digits(rng, 3)}, {_digits(rng, 3)}, {_digits(rng, 3)}, {_digits(rng, 4)}", f"AKIA{_word(rng).upper()}{_digits(rng, 8)}",
        f"ISBN {_digits(rng, 3)}-{_digits(rng, 1)}-{_digits(rng, 5)}", f"{_digits(rng, 4)}-{_digits(rng, 4)}", f"{_digits(rng, 2)}.{_digits(rng, 3)}.{_digits(rng, 3)}", f"[{_digits(rng, 1)}]", f"({_digits(rng, 3)})", f"{_digits(rng, 3)}.{_digits(rng, 3)} {_word(rng)}",
        f'password: "{_word(rng)}{_digits(rng, 4)}"', f"{_word(rng)}{_digits(rng, 2)}: {_digits(rng, 3)} {_word(rng)}", f"§ {_digits(rng, 2)}.{_digits(rng, 1)}.{_digits(rng, 1)}", "".join(rng.choice(list("0123456789abcdef"), 32)),
    ]))


MAKERS = [_email, _ip, _card, _phone]


def examples(texts: list[str]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with base spans as they are, and PUT_IN windows with something put in at a space."""
    rng = np.random.default_rng(SEED)
    texts = [t[:TRAIN_CHARS] for t in texts if len(t) > 1] or [" ".join(_word(rng) for _ in range(10)) for _ in range(400)]
    known = [_without_overlap(base_spans(t)) for t in texts]
    out = [(t, spans) for t, spans in zip(texts, known, strict=True) if spans]
    for i in range(PUT_IN):
        text, spans = texts[i % len(texts)], known[i % len(texts)]
        gaps = [m.start() for m in re.finditer(r" ", text) if not any(a <= m.start() < b for _, a, b in spans)]
        at = int(rng.choice(gaps)) + 1 if gaps else 0
        kind = int(rng.integers(0, 4)) if rng.random() < 0.7 else None
        put = _other(rng) if kind is None else MAKERS[kind](rng)
        tail = str(rng.choice([" ", " ", ". ", ", ", "\n", "### ", ") "]))
        moved = [(k, a, b) if b <= at else (k, a + len(put) + len(tail), b + len(put) + len(tail)) for k, a, b in spans]
        if kind is not None:
            moved.append((kind, at, at + len(put)))
        out.append((text[:at] + put + tail + text[at:], _without_overlap(moved)))
    return out


def _without_overlap(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans of different kinds that overlap, the first in the order of kinds."""
    out: list[tuple[int, int, int]] = []
    for k, a, b in sorted(spans):
        if all(b <= x or y <= a for _, x, y in out):
            out.append((k, a, b))
    return out


def train(documents: DataFrame) -> Model:
    """A model from at most TRAIN_SIGNED + TRAIN_PLAIN windows of TRAIN_CHARS
    characters: those of the least hashes of their texts, at a place that the
    hash decides or about the first sign of a base span."""
    signed = r"[0-9]\.[0-9]+\.|@[A-Za-z0-9]|[0-9]{8}|\+[0-9]"
    rows = documents.select("text", F.xxhash64("text").alias("h")).where("text is not null and text <> ''")
    anywhere = rows.select("h", F.substring("text", 1 + F.pmod("h", F.greatest(F.lit(1), F.length("text") - TRAIN_CHARS)).cast("int"), F.lit(TRAIN_CHARS)).alias("w"))
    about = rows.where(F.col("text").rlike(signed)).select("h", F.substring("text", F.greatest(F.lit(1), F.instr("text", F.regexp_substr("text", F.lit(signed))) - F.pmod("h", F.lit(40)).cast("int")), F.lit(TRAIN_CHARS)).alias("w"))
    texts = []
    for frame, most in ((about, TRAIN_SIGNED), (anywhere, TRAIN_PLAIN)):
        texts += [r["w"] for r in frame.dropDuplicates(["h"]).orderBy("h", "w").limit(most).collect()]
    return fit(examples(texts))


# --- decoding --------------------------------------------------------------------

_HINT = re.compile(r"[0-9@]|[(\[{<]\s?at\s?[)\]}>]|\bdot\b", re.IGNORECASE)
_AT = re.compile(r"\s?[(\[{<]\s?at\s?[)\]}>]\s?|\sat\s|\s?@\s?", re.IGNORECASE)
_DOT = re.compile(r"\s?[(\[{<]\s?(?:dot|\.)\s?[)\]}>]\s?|\sdot\s|\s\.\s", re.IGNORECASE)
_EMAIL = re.compile(r"[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def valid(kind: int, text: str) -> bool:
    """Whether a span of the model can be of its kind; any valid span matches _HINT."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == 0:
        return bool(_HINT.search(text)) and bool(_EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", text))))
    if kind == 1:
        try:
            found = ipaddress.ip_address(_DOT.sub(".", text))
        except ValueError:
            return False
        return bool(digits) and (found.version == 4 or text.count(":") >= 3)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9]+(?:[ ./_-]{1,3}[0-9]+)*", text))
    return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]{0,2}[0-9][0-9 ()./-]*[0-9]", text)) and len(re.findall(r"[^0-9]+", text)) >= 1 + (not text.startswith("0"))


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in " \t\n.,;:":
        a += 1
    while b > a and text[b - 1] in " \t\n.,;:":
        b -= 1
    return a, b


def _windows(length: int) -> Iterator[tuple[int, int]]:
    for first in range(0, max(length, 1), CORE):
        yield max(0, first - OVERLAP), min(length, first + CORE + OVERLAP)


def reconciled(found: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (posterior, kind, start, end) of all windows, the spans without overlap of the greatest total."""
    merged: dict[tuple[int, int, int], float] = {}
    for p, k, a, b in found:
        merged[k, a, b] = max(p, merged.get((k, a, b), 0.0))
    spans = sorted(merged, key=lambda s: (s[2], s[1], s[0]))
    ends, totals, came = [s[2] for s in spans], [0.0], []
    for i, (k, a, b) in enumerate(spans):
        before = bisect.bisect_right(ends, a, 0, i)
        with_it = totals[before] + merged[k, a, b]
        came.append(before if with_it > totals[-1] else None)
        totals.append(max(with_it, totals[-1]))
    out, i = [], len(spans)
    while i:
        if came[i - 1] is None:
            i -= 1
        else:
            out.append(spans[i - 1])
            i = came[i - 1]
    return out[::-1]


def model_spans(model: Model, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Valid spans that the model finds in each text."""
    found: list[list] = [[] for _ in texts]
    todo: list[tuple[int, int, int]] = []
    for n, text in enumerate(texts):
        hints = [m.start() for m in _HINT.finditer(text)]
        if not hints:
            continue
        at = np.array(hints)
        for a, b in _windows(len(text)):
            if np.searchsorted(at, b) > np.searchsorted(at, a):
                todo.append((n, a, b))
    for first in range(0, len(todo), AT_ONCE):
        part = todo[first : first + AT_ONCE]
        ids = np.zeros((max(b - a for _, a, b in part), len(part)), np.int16)
        for k, (n, a, b) in enumerate(part):
            ids[: b - a, k] = signs(texts[n][a:b])
        scores = model.emissions(ids)
        marginal = _posteriors(scores, model.weights["moves"], model.weights["start"])[0]
        some = np.flatnonzero((marginal[:, :, 0].min(axis=0)) < 0.5)
        if not len(some):
            continue
        paths = best_tags(scores[:, some], model.weights["moves"], model.weights["start"])
        for column, k in enumerate(some):
            n, a, b = part[k]
            found[n] += _spans(paths[: b - a, column], marginal[: b - a, k], a, texts[n], b < len(texts[n]))
    return [reconciled(f) for f in found]


def _spans(path: np.ndarray, marginal: np.ndarray, shift: int, text: str, cut: bool) -> list[tuple[float, int, int, int]]:
    """Posterior, kind, start and end of one window's valid spans; one that touches a cut belongs to another window."""
    out, t = [], 0
    while t < len(path):
        if not path[t]:
            t += 1
            continue
        kind, end = (int(path[t]) - 1) // 2, t + 1
        while end < len(path) and path[end] == 2 + 2 * kind:
            end += 1
        whole = not (t == 0 and shift) and not (end == len(path) and cut)
        inside = marginal[t:end, 1 + 2 * kind] + marginal[t:end, 2 + 2 * kind]
        a, b = _trimmed(text, shift + t, shift + end)
        free = (a == 0 or not text[a - 1].isalnum()) and (b >= len(text) or not text[b].isalnum())
        if whole and a < b and free and inside.mean() >= LEAST and valid(kind, text[a:b]):
            out.append((float(inside.mean()), kind, a, b))
        t = end
    return out


def personal_data(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, base and added spans of each document as ``kind:start:end`` lists."""
    doc_id = documents.schema["doc_id"].dataType.simpleString()
    held = documents.sparkSession.sparkContext.broadcast(model)

    def function(batches):
        model = held.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            added = model_spans(model, texts)
            fresh = [[s for s in more if all(s[2] <= x or y <= s[1] for _, x, y in known)] for known, more in zip(base, added, strict=True)]
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([named(s) for s in base]), pa.array([named(s) for s in fresh]), pa.array([named(s + m) for s, m in zip(base, fresh, strict=True)])], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "added", "spans"])

    return in_arrow(documents.select("doc_id", "text"), function, f"doc_id {doc_id}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base string, added string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets."""
    for kind, a, b in sorted(_without_overlap(spans), key=lambda s: -s[1]):
        text = f"{text[:a]}[{KINDS[kind]}]{text[b:]}"
    return text


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    documents = table(spark, sf_dir, "documents")
    found = personal_data(documents, train(documents))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
