"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

The field tags every token of a text as begin, inside or outside of a secret, from the token's shape,
the words and signs around it and features of the whole text. A token's emission is a sum of parts
that belong to it and to each of its neighbours, so parts are kept by token and summed as arrays.
Viterbi decodes the whole chain: tokens that no stretch with a gain over "outside" can contain are
outside in the best path, and the chain falls apart there exactly.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.llm.common import frugal, keyed_texts, slices, table

# The patterns of the base kinds and the least lengths of their matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter matches need not be found to be dropped
LEAST_VALUE, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "crf")
STEMS = ("passw", "secret", "token", "api")

#: Tokens with the white space before them: runs of letters and digits, or one other sign.
TOKEN = re.compile(r"\s*(?:[^\W_]+|[^\w\s]|_)")
CUES = frozenset("password passwd pwd secret token key apikey api auth authorization bearer credential credentials access private signature passphrase".split())
HEADS, WHOLE_HEADS = ("AKIA", "eyJ", "xox"), ("ghp", "sk", "pk")
STEMS_OF_CUES = ("passw", "secret", "token", "apikey")
#: Neighbours whose parts a token's emission has: places left (negative) and right of it.
AROUND = (-4, -3, -2, -1, 1, 2)
#: Columns of a token's parts: three tags for itself and for each neighbour that it is to, and whether white space goes before.
COLUMNS = 3 * (len(AROUND) + 1) + 1
B, I, O = 0, 1, 2
BARRED = -1e4


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """``(kind, start, end, value start)`` of the fixed patterns, in code points."""
    out = []
    low = text.lower()
    if any(s in low for s in STEMS):
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _size(n: int) -> str:
    return "1-3" if n < 4 else "4-7" if n < 8 else "8-11" if n < 12 else "12-15" if n < 16 else "16-23" if n < 24 else "24+"


def _kind(w: str) -> tuple[str, str]:
    digits, upper, lower = any(c.isdigit() for c in w), any(c.isupper() for c in w), any(c.islower() for c in w)
    return ("d" if digits else "") + ("U" if upper else "") + ("l" if lower else "") + ("" if w.isascii() else "x"), _size(len(w))


def _few_vowels(w: str) -> bool:
    return sum(map(w.lower().count, "aeiouy")) * 6 < len(w)


def plain_class(token: str) -> tuple | None:
    """What decides all features of a plain word or number; None for other tokens."""
    w = token.lstrip()
    if w.isdigit():
        return 3, w.isascii(), _size(len(w)), len(w) == len(token)
    if not w.isalpha():
        return None
    kind = 0 if w.islower() else 1 if w[0].isupper() and w[1:].islower() else 2 if w.isupper() else None
    low = w.lower()
    if kind is None or low in CUES or w in WHOLE_HEADS or w.startswith(HEADS) or any(c in low for c in STEMS_OF_CUES):
        return None
    return kind, w.isascii(), _size(len(w)), len(w) == len(token), _few_vowels(w)


def shape(token: str) -> list[str]:
    """Features of the token itself."""
    w = token.lstrip()
    glued = w == token
    if not w[0].isalnum():
        return ["bias", f"sign={w if w.isascii() else 'other'}", f"sign,glued={glued}"]
    kind, size = _kind(w)
    out = ["bias", f"glued={glued}", f"kind={kind}", f"size={size}", f"kind,size={kind},{size}", f"kind,size,glued={kind},{size},{glued}"]
    if not w.isalpha() and not w.isdigit():
        out += [f"entropy={min(4, int(_entropy(w)))},{size}", f"digit turns={min(5, sum(a.isdigit() != b.isdigit() for a, b in zip(w, w[1:])))},{size}"]
    if w.isalpha():
        if kind.startswith("Ul"):
            humps = sum(a.islower() and b.isupper() for a, b in zip(w, w[1:]))
            out.append(f"humps={'many' if humps >= max(2, len(w) // 5) else min(2, humps)},{size}")
        out.append(f"vowels={'few' if _few_vowels(w) else 'some'},{kind},{size}")
    elif not w.isdigit() and all(c in "0123456789abcdefABCDEF" for c in w):
        out.append(f"hex,{size}")
    if w.lower() in CUES:
        out.append("cue")
    out += [f"head={h}" for h in HEADS if w.startswith(h)] + [f"head={h}" for h in WHOLE_HEADS if w == h]
    return out


def outline(token: str) -> list[str]:
    """Features that a token lends to its neighbours."""
    w = token.lstrip()
    glued = w == token
    if not w[0].isalnum():
        return [f"sign={w if w.isascii() else 'other'}", f"sign,glued={w if w.isascii() else 'other'},{glued}"]
    kind, size = _kind(w)
    out = [f"glued={glued}", f"kind,size={kind},{size}", f"kind,size,glued={kind},{size},{glued}"]
    low = w.lower()
    if low in CUES or any(c in low for c in STEMS_OF_CUES):
        out.append("cue")
    return out


def features(token: str) -> list[list[str]]:
    """The named features of a token for itself and for each neighbour that it is to."""
    lent = outline(token)
    return [shape(token), *([f"{k}:{x}" for x in lent] for k in AROUND)]


def file_kind(text: str) -> str:
    """Prose or code, by the density of operators in the whole text."""
    marks = text.count("=") + text.count("{") + text.count(";") + text.count('"')
    return "code" if marks * 50 > len(text) else "mixed" if marks * 400 > len(text) else "prose"


def viterbi(emit: np.ndarray, trans: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[int]:
    """The best tags of a stretch; ``before`` and ``after`` score its first and last tag."""
    score = emit[0] + before
    back = np.empty((len(emit), 3), dtype=np.int8)
    for i in range(1, len(emit)):
        step = score[:, None] + trans
        back[i] = best = step.argmax(axis=0)
        score = step[best, (0, 1, 2)] + emit[i]
    tags = [int((score + after).argmax())]
    for i in range(len(emit) - 1, 0, -1):
        tags.append(int(back[i, tags[-1]]))
    return tags[::-1]


class Field:
    """The trained field: one weight a feature and tag, and transitions."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, trans: np.ndarray):
        self.index, self.weights, self.trans = index, weights, trans
        self._clear()

    def _clear(self) -> None:
        self._row: dict[str, int] = {}  # of a token
        self._row_of: dict[tuple, int] = {}  # of what decides its features
        self._parts = np.zeros((1 << 10, COLUMNS))

    def __getstate__(self):
        return self.index, self.weights, self.trans

    def __setstate__(self, state):
        self.__init__(*state)

    def _new(self, token: str) -> int:
        same = plain_class(token)
        names = None if same else features(token)
        same = same or tuple(map(tuple, names))
        k = self._row_of.get(same)
        if k is None:
            k = self._row_of[same] = len(self._row_of)
            if k == len(self._parts):
                self._parts = np.concatenate([self._parts, np.zeros_like(self._parts)])
            for i, own in enumerate(names or features(token)):
                at = [self.index[x] for x in own if x in self.index]
                self._parts[k, 3 * i : 3 * i + 3] = self.weights[at].sum(axis=0)
            self._parts[k, -1] = token[0].isspace()
        self._row[token] = k
        return k

    def emissions(self, tokens: list[str], kind: str) -> np.ndarray:
        """Scores of the three tags for every token."""
        if len(self._row) > 1 << 16:
            self._clear()
        row, new = self._row, self._new
        ids = np.fromiter((row[t] if t in row else new(t) for t in tokens), dtype=np.int64, count=len(tokens))
        parts = self._parts[ids]
        out = parts[:, :3].copy()
        for i, k in enumerate(AROUND, 1):
            # A neighbour k places away, at i + k, lends its part to i.
            if k < 0:
                out[-k:] += parts[:k, 3 * i : 3 * i + 3]
            else:
                out[:-k] += parts[k:, 3 * i : 3 * i + 3]
        at = self.index.get(f"file={kind}")
        if at is not None:
            out += self.weights[at]
        out[parts[:, -1] > 0, I] += BARRED  # a secret holds no white space
        return out

    def tags(self, emit: np.ndarray) -> list[tuple[int, list[int]]]:
        """The best path of the whole chain: ``(first token, tags)`` of the stretches that may differ from outside."""
        n = len(emit)
        t = self.trans - self.trans[O, O]
        gain = emit - emit[:, O : O + 1]
        first = max(0.0, t[O, B], t[B, B], t[I, B])
        bound = np.maximum(gain[:, B] + first, gain[:, I] + max(t[B, I], t[I, I]))
        leave = max(0.0, t[B, O], t[I, O])
        # The best sums of bounds that end at, and that start from, each token (Kadane).
        total = np.concatenate([[0.0], np.cumsum(bound)])
        ending = total[1:] - np.minimum.accumulate(total[:-1])
        starting = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]
        live = np.flatnonzero(ending + starting - bound + leave >= 0)
        out = []
        for run in np.split(live, np.flatnonzero(np.diff(live) > 1) + 1):
            if len(run):
                a, z = int(run[0]), int(run[-1]) + 1
                before = np.array([0.0, BARRED, 0.0]) if a == 0 else t[O]
                out.append((a, viterbi(gain[a:z], t, before, t[:, O] if z < n else np.zeros(3))))
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        found = []
        for a, tags in self.tags(self.emissions(tokens, file_kind(text))):
            begin = None
            for i, tag in enumerate([*tags, O], a):
                if begin is not None and tag != I:
                    found.append((begin, i))
                    begin = None
                if tag == B:
                    begin = i
        if not found:
            return []
        ends = np.cumsum([len(t) for t in tokens])  # tokens and the space before them leave nothing out but the last space
        starts = lambda i: int(ends[i]) - len(tokens[i].lstrip())
        return [(a, b) for a, b in ((starts(i), int(ends[j - 1])) for i, j in found) if b - a >= LEAST_VALUE]


_HEX, _LOW, _ALNUM = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def sample(n: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Labelled lines made by rule: secrets of common makes, and code-like tokens that are none."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: pick(_LOW, r.randint(2, 9))

    def rich(k, chars=_ALNUM):
        while True:
            s = pick(chars, k)
            if sum(c.isdigit() for c in s) >= 2 and not s.isdigit():
                return s

    upper, mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

    def letters(k):
        while True:
            s = pick(mixed, k)
            if sum(a.islower() and b.isupper() for a, b in zip(s, s[1:])) >= max(2, k // 5):
                return s

    secret = [
        lambda: rich(r.choice([24, 32, 40, 48, 64]), _HEX), lambda: rich(r.choice([32, 40, 64]), _HEX.upper()), lambda: rich(r.randint(20, 48)), lambda: letters(r.randint(16, 40)),
        lambda: "AKIA" + rich(16, upper + "0123456789"), lambda: "ghp_" + rich(36), lambda: f"sk_live_{rich(24)}", lambda: f"xoxb-{pick('0123456789', 11)}-{rich(24)}",
        lambda: rich(20) + "+" + rich(18) + "/" + rich(4) + "=", lambda: f"eyJ{rich(20)}.eyJ{rich(40)}.{rich(43)}",
    ]
    weak = [lambda: rich(r.randint(9, 14)), lambda: word() + pick("0123456789", 4) + word(), lambda: letters(r.randint(12, 20))]
    plain = [
        lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: ".".join(str(r.randint(10, 255)) for _ in range(4)), lambda: pick("0123456789", r.randint(8, 16)),
        lambda: f"555-{r.randint(1000, 9999)}", lambda: f"({r.randint(100, 999)}) {r.randint(100, 999)}-{r.randint(1000, 9999)}", lambda: f"v{r.randint(1, 9)}.{r.randint(10, 99)}.{r.randint(100, 999)}",
        lambda: f"{word()}/{word()}/{r.randint(10, 99999)}.html", lambda: f"{word()}{r.randint(10, 9999)}.{word()}.com", lambda: f"{word()}{r.randint(10, 99)}@{word()}.example.com", lambda: "-".join([rich(8, _HEX), pick(_HEX, 4), pick(_HEX, 4), pick(_HEX, 4), rich(12, _HEX)]),
        lambda: f"{word()}_{word()}_{r.randint(1, 9999)}", lambda: f"ISO-{r.randint(1000, 99999)}", lambda: f"{r.randint(1, 999)},{r.randint(100, 999)}.{r.randint(10, 99)}", lambda: word() + word() + str(r.randint(1, 99)), lambda: f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}.{r.randint(1000, 9999)}Z", lambda: "+" + pick("0123456789", 11), lambda: "-".join(pick("0123456789", 4) for _ in range(4)),
        lambda: word() + word().title() + word().title(), lambda: f"{word()}{word().title()}{word().title()}({word()}{word().title()})", lambda: "".join(word() for _ in range(5)).title(), lambda: word().title() + word().title(), lambda: pick(upper, r.randint(3, 18)), lambda: pick(_LOW, r.randint(10, 24)), lambda: pick(_LOW, r.randint(10, 24)).title(),
        lambda: f"{word()}({word()}, {word()});", lambda: f"{word()}é{word()}", lambda: "=" * r.randint(2, 12), lambda: "-".join(word() for _ in range(r.randint(2, 4))), lambda: f"{pick(upper, 2)}{pick('0123456789', r.randint(2, 8))}",
    ]
    cues = ["password", "secret", "token", "api_key", "API_KEY", "auth", "access key", "credential", "Authorization: Bearer", "private key", "pwd"]
    accents = _LOW + "éèêàñóíüöäßç"
    talk = lambda: " ".join(r.choice([word, word, word, lambda: word() + pick("#*$%&|=", 3), lambda: pick(accents, r.randint(3, 18)), lambda: pick(accents, r.randint(3, 18)).title(), lambda: word() + word(), lambda: "|", lambda: word().title(), lambda: word() + r.choice(",.;:!?"), lambda: r.choice(cues), lambda: str(r.randint(0, 2030))])() for _ in range(r.randint(0, 7)))
    out = []
    for _ in range(n):
        before, after = talk(), talk()
        if r.random() < 0.5:
            s = r.choice(secret)() if r.random() < 0.8 else None
            cue = r.random() < 0.6 or s is None
            s = s or r.choice(weak)()
            lead = r.choice(cues) + r.choice([" = ", "=", ": ", " ", '": "', " is ", " -> "]) if cue else ""
            quote = r.choice(['"', "'", "", ""])
            lead = f"{before} {lead}{quote}"
            out.append((f"{lead}{s}{quote} {after}", [(len(lead), len(lead) + len(s))]))
        else:
            lead = r.choice(["", "", "id ", "ref: ", "see ", "call ", "on ", "at ", "http://", "the token ", "a password: ", "key = "])
            quote = r.choice(['"', "", "", ""])
            out.append((f"{before} {lead}{quote}{r.choice(plain)()}{quote} {after}", []))
    return out


@lru_cache(maxsize=4)
def train(n_lines: int = 2500, seed: int = 7, steps: int = 80, l2: float = 1e-3) -> Field:
    """Fit the field by the likelihood's gradient on ``n_lines`` made lines (a bound that never grows)."""
    index: dict[str, int] = {}
    named: dict[str, list[list[int]]] = {}
    number = lambda names: [index.setdefault(x, len(index)) for x in names]
    rows, seq, pos, tags, spaced = [], [], [], [], []
    for i, (text, gold) in enumerate(sample(n_lines, seed)):
        tokens, at, file = TOKEN.findall(text), 0, number([f"file={file_kind(text)}"])
        for t in tokens:
            if t not in named:
                named[t] = [number(x) for x in features(t)]
        for j, t in enumerate(tokens):
            row = named[t][0] + file
            for k, place in enumerate(AROUND, 1):
                if 0 <= j + place < len(tokens):
                    row = row + named[tokens[j + place]][k]
            end = at + len(t)
            begin = end - len(t.lstrip())
            inside = [g for g in gold if g[0] <= begin and end <= g[1]]
            at = end
            rows.append(row), seq.append(i), pos.append(j), spaced.append(t[0].isspace())
            tags.append(O if not inside else B if inside[0][0] == begin else I)
    seq, pos, tags, spaced = np.array(seq), np.array(pos), np.array(tags), np.array(spaced)
    n, longest, m, most = n_lines, int(pos.max()) + 1, len(index), max(map(len, rows))
    at = np.full((len(rows), most), m)  # the last weight stays zero
    for i, row in enumerate(rows):
        at[i, : len(row)] = row
    real = np.zeros((n, longest), dtype=bool)
    real[seq, pos] = True
    y = np.zeros((n, longest, 3))
    y[seq, pos, tags] = 1
    pairs = np.einsum("ntj,ntk->jk", y[:, :-1], y[:, 1:])
    w, trans = np.zeros((m + 1, 3)), np.zeros((3, 3))
    moment = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    start = np.array([0.0, BARRED, 0.0])
    barred = np.zeros((3, 3))
    barred[O, I] = BARRED
    for step in range(1, steps + 1):
        emit = np.zeros((n, longest, 3))
        emit[seq, pos] = w[at].sum(axis=1)
        emit[seq[spaced], pos[spaced], I] += BARRED
        t = trans + barred
        alpha, beta = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        alpha[:, 0] = emit[:, 0] + start
        for k in range(1, longest):
            a = np.logaddexp.reduce(alpha[:, k - 1, :, None] + t[None], axis=1) + emit[:, k]
            alpha[:, k] = np.where(real[:, k, None], a, alpha[:, k - 1])
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        for k in range(longest - 2, -1, -1):
            b = np.logaddexp.reduce(t[None] + (emit[:, k + 1] + beta[:, k + 1])[:, None, :], axis=2)
            beta[:, k] = np.where(real[:, k + 1, None], b, 0)
        p = np.exp(alpha + beta - total[:, None, None])
        both = real[:, 1:, None, None] * np.exp(alpha[:, :-1, :, None] + t[None, None] + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
        error = (y[seq, pos] - p[seq, pos]) / n
        grad_w = np.stack([np.bincount(at.ravel(), weights=np.repeat(error[:, k], most), minlength=m + 1) for k in range(3)], axis=1) - l2 * w
        grad_w[m] = 0
        grad_t = (pairs - both.sum(axis=(0, 1))) / n - l2 * trans
        for v, g, i, j in ((w, grad_w, 0, 1), (trans, grad_t, 2, 3)):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            moment[j] = 0.99 * moment[j] + 0.01 * g * g
            v += 0.15 * (moment[i] / (1 - 0.9**step)) / (np.sqrt(moment[j] / (1 - 0.99**step)) + 1e-8)
    return Field(index, w[:m], trans + barred)


def scan(text: str, field: Field) -> tuple[list, list]:
    """Base spans, and all spans: the field adds those that overlap no base span."""
    base = base_spans(text)
    extra = [("crf", a, b, a) for a, b in field.spans(text) if not any(a < e and s < b for _, s, e, _ in base)]
    every = sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0])))
    return base, every


SPANS = "array<struct<kind:string,start:int,end:int,value_start:int>>"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, spans)`` per input row, in code points, end exclusive.

    A null text counts as empty and has no spans; repeated rows give equal rows; an empty table
    gives no rows; a null doc_id stays null. One pass, no shuffle.
    """
    field = train()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32())]))
    as_rows = lambda spans: [dict(zip(("kind", "start", "end", "value_start"), s)) for s in spans]

    def run(batches):
        for b in slices(batches):
            found = [scan(t, field) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([as_rows(x[0]) for x in found], kind), pa.array([as_rows(x[1]) for x in found], kind)], ["doc_id", "base", "spans"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(frugal(run), f"doc_id long, base {SPANS}, spans {SPANS}")


def redact(text: str, spans, mask: str = "[SECRET]") -> str:
    """The text with every span's value masked; overlapping spans get one mask."""
    out, at = [], 0
    for a, b in sorted((s[3], s[2]) for s in spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with secrets masked; ``length_col``, if there, is renewed where a text changed.

    Null and empty texts stay as they are, repeated rows change alike, an empty table stays empty. A
    text's tokens are held in a task.
    """
    field = train()
    schema = docs.schema

    def run(batches):
        for b in slices(batches):
            at = b.schema.get_field_index(text_col)
            old = b.column(at).to_pylist()
            new = [t if t is None else redact(t, scan(t, field)[1]) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            k = b.schema.get_field_index(length_col) if length_col else -1
            if k >= 0:
                cols[k] = pa.array([n if o == t else len(t) for n, o, t in zip(cols[k].to_pylist(), old, new)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(frugal(run), schema)


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """Counts, digests and spans of every document's secrets."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
