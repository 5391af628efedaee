"""Personal data by a character BiLSTM with CRF transitions, in numpy.

Rules give the base spans: e-mail addresses, IP addresses, card numbers and
phone numbers of a fixed form. They label a bounded sample of documents, and in
copies of these the same data is rewritten in forms that the rules don't know:
spelled out, spaced, bracketed, without a country code. Both train the model:
character classes go through a forward and a backward LSTM into emissions, and a
linear-chain CRF scores whole tag sequences. What it finds is added to the base
spans, which always stay.

All text is read, in overlapping windows; their emissions are averaged where
windows overlap, and one Viterbi pass over the whole text decides, so that no
window edge splits a span. Stretches where no tag but "outside" can be on the
best path are found first, by bounds, and left out of the pass; its result is
the same.

Null and empty texts have no spans; texts may be of any length; rows that are
equal or repeat an id are each looked at; of equally good tag sequences the one
with the lower tags wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.llm.textops import first_by_hash

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
#: Documents that the model learns from, at most, and windows from each.
MAX_TRAIN, TRAIN_WINDOWS = 600, 4
WIDTH, STRIDE, HIDDEN, BATCH = 1072, 1024, 8, 512
STEPS = 600

# The forms of the base spans.
FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _holds(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))
    digits = "".join(c for c in match if "0" <= c <= "9")
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start; code points, end exclusive."""
    if not _TRIGGER.search(text):
        return []
    return [(k, m.start(), m.end()) for k, kind in enumerate(KINDS) if kind != "email" or "@" in text for m in FORMS[kind].finditer(text) if _holds(kind, m.group())]


def plausible(kind: int, text: str, start: int, end: int) -> bool:
    """Whether a span that the model finds could be of its kind, in any notation, and isn't a slice of a longer run of digits.

    A card's digits must pass Luhn, which a network cannot add up.
    """
    piece = text[start:end]
    digits, parts = re.sub("[^0-9]", "", piece), re.findall("[0-9]+", piece)
    if KINDS[kind] == "email":
        word = lambda w, sign: re.search(rf"{sign}|(?<![A-Za-z]){w}(?![A-Za-z])", piece, re.IGNORECASE)
        return bool(word("at", "@") and word("dot", r"\."))
    if not digits:
        return False
    # What parts its groups of digits, and what parts it from digits before and behind: a like sign makes them one run.
    inner = set(re.findall("(?<=[0-9])[^0-9]+(?=[0-9])", piece)) | {""}
    before, after = re.search("[0-9]([^0-9A-Za-z\n]{0,2})$", text[max(0, start - 3) : start]), re.match("([^0-9A-Za-z\n]{0,2})[0-9]", text[end : end + 3])
    if before and before[1] + re.match("[^0-9]*", piece)[0] in inner or after and re.search("[^0-9]*$", piece)[0] + after[1] in inner:
        return False
    if KINDS[kind] == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if KINDS[kind] == "ip":
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    return 9 <= len(digits) <= 15


#: Other forms of each kind, that training rewrites base spans into: what stands for "@" and ".", or between groups of digits.
WAYS = {
    "email": [
        (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", " . "), (" AT ", "."), ("[at]", "."), ("<at>", "<dot>"), ("(at)", "."),
        (" [at] ", " [dot] "), ("_at_", "_dot_"), (" at ", " . "),
    ],
    "ip": ["[.]", " . ", "(.)", " dot ", "[dot]", "<.>", " (dot) ", ". "],
    "card": [".", "/", "_", " - ", " . ", "..", "//", "__", " / "],
    "phone": ["({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "{0} {1} {2}", "{0}/{1}-{2}", "({0}) {1} {2}", "({0})-{1}-{2}", "({0}).{1}.{2}", "({0}){1} {2}", "[{0}]{1}-{2}"],
}
#: Forms that are kept from training, to see what the model makes of them.
HELD_OUT = {"email": [("{at}", "{dot}"), (" at ", ".")], "ip": ["{.}", "(dot)"], "card": ["  ", "--"], "phone": ["({0}){1}-{2}", "{0} {1}-{2}"]}


def rewritten(kind: str, piece: str, way) -> str:
    """A base span in another form."""
    if kind == "email":
        user, _, name = piece.partition("@")
        return user + way[0] + name.replace(".", way[1])
    digits = re.sub("[^0-9]", "", piece)
    if kind == "ip":
        return piece.replace(".", way)
    if kind == "card":
        return way.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return way.format(digits[-10:-7], digits[-7:-4], digits[-4:])


def variants(text: str, ways: dict) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The text with all its base spans rewritten, once for each of as many ways as a kind has, and where they stand then."""
    spans = sorted(base_spans(text), key=lambda s: s[1])
    spans = [s for i, s in enumerate(spans) if not any(a < s[2] and s[1] < b for _, a, b in spans[:i])]
    out = []
    for turn in range(max((len(ways[KINDS[k]]) for k, _, _ in spans), default=0)):
        made, at, where = "", 0, []
        for k, s, e in spans:
            made += text[at:s]
            piece = rewritten(KINDS[k], text[s:e], ways[KINDS[k]][turn % len(ways[KINDS[k]])])
            where.append((k, len(made), len(made) + len(piece)))
            made, at = made + piece, e
        out.append((made + text[at:], where))
    return out


_SIGNS = "@.+-_%() \n:/=\"',#$&*!?[]{}<>|"
#: Letters that spell a sign out have classes of their own.
_SPELL = "atdo"
_CLASSES = 4 + 10 + len(_SIGNS) + len(_SPELL)
#: Signs that stand for each other: opening and closing brackets, quotes, and the rest.
_ALIKE = ("([{<", ")]}>", "\"'", "#$&*!?|=,")


def _class_table() -> np.ndarray:
    table = np.zeros(128, dtype=np.int64)
    for code in range(128):
        c = chr(code)
        table[code] = 14 + len(_SIGNS) + _SPELL.index(c.lower()) if c.lower() in _SPELL else 1 if c.islower() else 2 if c.isupper() else 4 + int(c) if c.isdigit() else 14 + _SIGNS.index(c) if c in _SIGNS else 0
    for first, *others in _ALIKE:
        table[[ord(c) for c in others]] = table[ord(first)]
    return table


_TABLE = _class_table()


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(codes < 128, _TABLE[np.minimum(codes, 127)], 3)


def _gate(x: np.ndarray) -> np.ndarray:
    """A gate of the LSTM: a straight line from 0 to 1, which costs a tenth of a sigmoid."""
    return 0.5 * (1 + np.clip(x, -1, 1))


def _gate_slope(y: np.ndarray) -> np.ndarray:
    """Half on the line; a little beside it, so that a shut gate can still learn."""
    return 0.5 * ((np.abs(2 * y - 1) < 1) + np.float32(0.02))


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _squash_slope(y: np.ndarray) -> np.ndarray:
    return (1 - np.abs(y)) ** 2


def _lstm(c: np.ndarray, w: np.ndarray, u: np.ndarray, keep: bool):
    """States of an LSTM over class rows c (batch, time); keep: also what backward() needs."""
    n, t, h = c.shape[0], c.shape[1], u.shape[0]
    state, cell, out, trace = np.zeros((n, h), u.dtype), np.zeros((n, h), u.dtype), np.empty((t, n, h), u.dtype), []
    for k in range(t):
        z = w[c[:, k]] + state @ u
        s = _gate(z[:, : 3 * h])
        g = _squash(z[:, 3 * h :])
        i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
        before, past = cell, state
        cell = f * cell + i * g
        tc = _squash(cell)
        state = o * tc
        out[k] = state
        if keep:
            trace.append((i, f, o, g, tc, before, past))
    return out, trace


def _lstm_back(c: np.ndarray, u: np.ndarray, trace: list, d_out: np.ndarray, n_classes: int):
    h = u.shape[0]
    du, every = np.zeros_like(u), np.empty((len(trace), len(c), 4 * h), u.dtype)
    d_state, d_cell = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    for k in range(len(trace) - 1, -1, -1):
        i, f, o, g, tc, before, past = trace[k]
        d = d_out[k] + d_state
        d_cell = d_cell + d * o * _squash_slope(tc)
        dz = np.concatenate([d_cell * g * _gate_slope(i), d_cell * before * _gate_slope(f), d * tc * _gate_slope(o), d_cell * i * _squash_slope(g)], axis=1, out=every[k])
        d_cell = d_cell * f
        d_state = dz @ u.T
        du += past.T @ dz
    rows = c.T.reshape(-1)
    seen = np.zeros((len(rows), n_classes), u.dtype)
    seen[np.arange(len(rows)), rows] = 1
    return seen.T @ every.reshape(len(rows), -1), du


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def _crf_gradient(e: np.ndarray, move: np.ndarray, tags: np.ndarray):
    """Gradients of the CRF's negative log likelihood by emissions (time, batch, tag) and transitions."""
    t, n, k = e.shape
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0]
    for j in range(1, t):
        a[j] = e[j] + _lse(a[j - 1][:, :, None] + move[None], 1)
    for j in range(t - 2, -1, -1):
        b[j] = _lse(move[None] + (e[j + 1] + b[j + 1])[:, None, :], 2)
    z = _lse(a[-1], 1)
    de = np.exp(a + b - z[None, :, None])
    dm = np.zeros_like(move)
    for j in range(1, t):
        dm += np.exp(a[j - 1][:, :, None] + move[None] + (e[j] + b[j])[:, None, :] - z[:, None, None]).sum(axis=0)
    rows = np.arange(n)
    for j in range(t):
        de[j, rows, tags[:, j]] -= 1
        if j:
            np.subtract.at(dm, (tags[:, j - 1], tags[:, j]), 1)
    return de / n, dm / n


@dataclass
class Model:
    """w: class weights, u: state weights of the two directions; out: emissions; move: transitions."""

    w: list[np.ndarray]
    u: list[np.ndarray]
    out: np.ndarray
    move: np.ndarray

    def emissions(self, c: np.ndarray, keep: bool = False):
        ahead, t0 = _lstm(c, self.w[0], self.u[0], keep)
        behind, t1 = _lstm(c[:, ::-1], self.w[1], self.u[1], keep)
        states = np.concatenate([ahead, behind[::-1], np.ones_like(ahead[:, :, :1])], axis=2)
        return states @ self.out, states, (t0, t1)

    def fast(self):
        """A function of class rows (batch, time) to emissions (time, tag, batch), in place and tag by tag."""
        h = HIDDEN
        w, u = [np.ascontiguousarray(x.T) for x in self.w], [np.ascontiguousarray((x * np.float32(0.5)).T) for x in self.u]

        def run(c: np.ndarray) -> np.ndarray:
            n, t = c.shape
            rows = np.ascontiguousarray(c.T)
            total = np.empty((t, TAGS, n), np.float32)
            total[:] = self.out[-1][:, None]
            z, size = np.empty((4 * h, n), np.float32), np.empty((h, n), np.float32)
            gates, new = z[: 3 * h], z[3 * h :]
            into, stay, out_gate = z[:h], z[h : 2 * h], z[2 * h : 3 * h]
            for side in (0, 1):
                state, cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
                out = np.ascontiguousarray(self.out[side * h : (side + 1) * h].T) * np.float32(0.5)
                for k in range(t) if side == 0 else range(t - 1, -1, -1):
                    w[side].take(rows[k], axis=1, out=z, mode="clip")
                    z += u[side] @ state
                    gates.clip(-1, 1, out=gates)
                    gates += 1
                    np.abs(new, out=size)
                    size += 1
                    new /= size
                    # Twice each gate: the cell is halved here, the state in the weights that read it.
                    cell *= stay
                    new *= into
                    cell += new
                    cell *= 0.5
                    np.abs(cell, out=size)
                    size += 1
                    np.divide(cell, size, out=state)
                    state *= out_gate
                    total[k] += out @ state
            return total

        return run


def train(windows: list[tuple[str, list[int]]], steps: int = STEPS, batch: int = 64, seed: int = 7) -> Model | None:
    """Fit by Adam, at a rate that falls to nothing, on windows of text and their tags; None where no window has a span."""
    if not any(any(tags) for _, tags in windows):
        return None
    rng, width = np.random.default_rng(seed), max(len(t) for t, _ in windows)
    c = np.array([np.pad(classes(t), (0, width - len(t)), constant_values=14 + _SIGNS.index(" ")) for t, _ in windows])
    y = np.array([tags + [0] * (width - len(tags)) for _, tags in windows])
    h = HIDDEN
    params: list[np.ndarray] = [*(rng.normal(0, 0.3, (_CLASSES, 4 * h)) for _ in range(2)), *(rng.normal(0, 0.25, (h, 4 * h)) for _ in range(2)), rng.normal(0, 0.3, (2 * h + 1, TAGS)), np.zeros((TAGS, TAGS))]
    params = [p.astype(np.float32) for p in params]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = rng.choice(len(c), min(batch, len(c)), replace=False)
        model = Model(params[:2], params[2:4], params[4], params[5])
        e, states, traces = model.emissions(c[pick], keep=True)
        de, dm = _crf_gradient(e, params[5], y[pick])
        d_states = de @ params[4].T
        dw0, du0 = _lstm_back(c[pick], params[2], traces[0], d_states[:, :, :h], _CLASSES)
        dw1, du1 = _lstm_back(c[pick][:, ::-1], params[3], traces[1], d_states[::-1, :, h : 2 * h], _CLASSES)
        grads = [dw0, dw1, du0, du1, np.einsum("tns,tnk->sk", states, de), dm]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.03 * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(params[:2], params[2:4], params[4], params[5])


def _open(e: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Places (by time) where another tag than O may be on the best path.

    A run of other tags gains at most the sum of its places' margins over O, and
    what the best steps into it, within it and out of it gain over staying at O.
    No place is open where no run across it can gain.
    """
    stay = float(move[0, 0])
    inner, edges = float(move[1:, 1:].max()) - stay, max(0.0, float(move[0, 1:].max()) - stay) + max(0.0, float(move[1:, 0].max()) - stay)
    tight = float(move[0, 1:].max() + move[1:, 0].max()) - 2 * stay
    margin = (e[:, 1:].max(axis=1) - e[:, 0]).astype(np.float64) + inner
    total = np.concatenate([[0.0], np.cumsum(margin)])
    before = total[1:] - np.minimum.accumulate(total[:-1])
    after = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]
    gain = before + after - margin - inner
    # A run at either end of the text has one edge only.
    at_edge = (total[1:] - total[0] + after - margin, before + (total[-1] - total[:-1]) - margin)
    return (gain + tight >= -1e-3) | (np.maximum(*at_edge) - inner + edges >= -1e-3)


def best_tags(emissions: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """Viterbi tags of whole texts. Only stretches of open places are passed through, each between two places that are O; stretches of like length together."""
    out = [np.zeros(len(e), np.int8) for e in emissions]
    pieces = []
    for i, e in enumerate(emissions):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], _open(e, move).astype(np.int8), [0]]))) if len(e) else []
        pieces += [(b - a, i, a, b) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    pieces.sort()
    k = 0
    while k < len(pieces):
        some = [p for p in pieces[k : k + BATCH] if p[0] <= max(64, 2 * pieces[k][0])]
        e = np.zeros((some[-1][0] + 1, len(some), TAGS), np.float32)
        for row, (n, i, a, b) in enumerate(some):
            e[:n, row] = emissions[i][a:b]
            if a:
                e[0, row] += move[0]
            if b < len(emissions[i]):
                e[n, row, 1:] = -1e9
        # Padding past a text's end lets every tag stand, so that it adds nothing to choose by.
        free = np.array([b == len(emissions[i]) for _, i, _, b in some])
        size = np.array([n for n, *_ in some])
        tags = _viterbi(e, move, size, free)
        for row, (n, i, a, b) in enumerate(some):
            out[i][a:b] = tags[:n, row]
        k += len(some)
    return out


def _viterbi(e: np.ndarray, move: np.ndarray, size: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Best tags (time, batch) for emissions (time, batch, tag) of rows of size places; free rows end in any tag, others before an O."""
    t, n, k = e.shape
    back, score, rows = np.zeros((t, n, k), np.int8), e[0].copy(), np.arange(n)
    for j in range(1, t):
        on = (j < size) | ((j == size) & ~free)
        s = score[:, :, None] + move[None]
        back[j] = np.where(on[:, None], s.argmax(axis=1), np.arange(k))
        score = np.where(on[:, None], e[j] + s.max(axis=1), score)
    out = np.empty((t, n), np.int8)
    out[-1] = score.argmax(axis=1)
    for j in range(t - 1, 0, -1):
        out[j - 1] = back[j][rows, out[j]]
    return out


def _decode(model: Model, texts: list[np.ndarray]) -> list[np.ndarray]:
    """Tags of each text: windows of like length together, emissions averaged where they overlap, then the best tags of the whole."""
    at = [(min(WIDTH, len(c) - s), i, s) for i, c in enumerate(texts) for s in range(0, max(1, len(c) - (WIDTH - STRIDE)), STRIDE) if len(c)]
    at.sort()
    total = [np.zeros((TAGS, len(c)), np.float32).T for c in texts]
    run, blank = model.fast(), 14 + _SIGNS.index(" ")
    for k in range(0, len(at), BATCH):
        some = at[k : k + BATCH]
        c = np.full((len(some), some[-1][0]), blank)
        for row, (n, i, s) in enumerate(some):
            c[row, :n] = texts[i][s : s + n]
        e = run(c)
        for row, (n, i, s) in enumerate(some):
            total[i][s : s + n] += e[:n, :, row]
    for e in total:
        # Windows start every STRIDE places, so those between two starts and the last window's end are read twice.
        for s in range(STRIDE, len(e) - (WIDTH - STRIDE), STRIDE):
            e[s : s + WIDTH - STRIDE] *= 0.5
    return best_tags(total, model.move)


def _spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end): a begin tag and the inside tags of its kind that follow."""
    out = []
    for i in np.flatnonzero(tags % 2 == 1).tolist():
        kind, j = int(tags[i] - 1) // 2, i + 1
        while j < len(tags) and tags[j] == 2 * kind + 2:
            j += 1
        out.append((kind, i, j))
    return out


#: Characters that are decoded at once; a longer text is decoded alone.
HELD = 1 << 21


def model_spans(model: Model, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans that the model finds in each text."""
    found: list[list[tuple[int, int, int]]] = []
    k = 0
    while k < len(texts):
        end, size = k, 0
        while end < len(texts) and (end == k or size + len(texts[end]) <= HELD):
            size += len(texts[end])
            end += 1
        for text, tags in zip(texts[k:end], _decode(model, [classes(t) for t in texts[k:end]]), strict=True):
            found.append([(kind, s, e) for kind, s, e in _spans(tags) if plausible(kind, text, s, e)])
        k = end
    return found


def all_spans(model: Model | None, texts: list[str]) -> list[tuple[list, list]]:
    """(base, all) spans of each text. A model span is added where no base span overlaps it."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return [(b, sorted(b)) for b in base]
    return [(b, sorted(b + [m for m in more if not any(a < m[2] and m[1] < z for _, a, z in b)])) for b, more in zip(base, model_spans(model, texts), strict=True)]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


_SAMPLE = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("tags", T.ArrayType(T.IntegerType()))]))
SPANS = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])


def _windows(t: str, spans: list[tuple[int, int, int]], marks: list[int]) -> list[tuple[str, list[int]]]:
    out = []
    for k, mark in enumerate(marks[:: max(1, len(marks) // TRAIN_WINDOWS)][:TRAIN_WINDOWS]):
        a = max(0, mark - 20 - 17 * (k % 3))
        piece, tags = t[a : a + 96], [0] * len(t[a : a + 96])
        for kind, s, e in spans:
            for j in range(max(s, a), min(e, a + len(piece))):
                tags[j - a] = 2 * kind + (1 if j == s else 2)
        out.append((piece, tags))
    return out


def labelled(t: str) -> list[tuple[str, list[int]]]:
    """Windows of a text and their tags: as it stands, and with its personal data rewritten in the forms of WAYS."""
    spans = sorted(base_spans(t), key=lambda s: s[1])
    out = _windows(t, spans, sorted({s[1] for s in spans} or {m.start() for m in _TRIGGER.finditer(t)}))
    for made, where in variants(t, WAYS):
        out += _windows(made, where, [s for _, s, _ in where])[:2]
    return out


@F.pandas_udf(_SAMPLE)
def _labelled(text: pd.Series) -> pd.Series:
    return text.map(labelled)


def learn(docs: DataFrame, text_col: str = "text", max_train: int = MAX_TRAIN) -> Model | None:
    """Train on windows of at most max_train distinct texts, the first by a hash of their text; only these are labelled."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).filter("text RLIKE '[0-9@]'")
    sample = first_by_hash(texts, "text", max_train).select("h", "n", _labelled("text").alias("w"))
    return train([(r["text"], list(r["tags"])) for row in sorted(sample.collect(), key=lambda r: (r["h"], r["n"])) for r in row["w"]])


def finder(model: Model | None):
    """A column function: text -> counts of base spans by kind, base spans and all spans as text."""

    @F.pandas_udf(SPANS)
    def find(text: pd.Series) -> pd.DataFrame:
        values = text.tolist()
        each = list(dict.fromkeys(values))
        made = {t: [*(sum(s[0] == i for s in base) for i in range(len(KINDS))), written(base), written(wide)] for t, (base, wide) in zip(each, all_spans(model, each), strict=True)}
        rows = [made[t] for t in values]
        return pd.DataFrame(rows, columns=[f.name for f in SPANS], index=text.index)

    return find


def find_spans(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "pii") -> DataFrame:
    """docs with a struct column of counts and spans; a column of docs that is called name is replaced. Without a model, the base spans alone."""
    found = finder(model)(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name], found.alias(name))
