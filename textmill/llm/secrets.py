"""Secret scans: base patterns and a linear-chain conditional random field over tokens.

Tokens are runs of letters, digits, ``_ - + /`` and single other characters. Their features are shape, the token and its
neighbours (long ones count by shape alone, so that no secret is learnt by heart), whether they touch, how near a word that speaks of secrets stands before, and coarse figures of the whole file. The field has the labels outside, begin and inside; it is trained here by
gradient steps on the exact likelihood over windows of a bounded sample of texts (SAMPLE, SAMPLE_CHARS; of a text the windows of its first three
base spans and two others), labelled by the base patterns, and of invented secrets: of some formats, and of forms that are drawn, prefix, parts and lead words alike, so
that it carries over to formats that it has not seen. Decoding is exact Viterbi over whole texts: a block of texts is cut into rows that run side
by side from each possible label, and the rows are joined by their label-to-label scores.

Spans ``crf`` of the field, which mark the secret itself, stand beside the base spans, which are always there. An exact check
follows: a span of fewer than LEAST characters is dropped, and one without a digit of fewer than LEAST_LETTERS.

Defined results: null and empty texts have no spans; equal texts have
equal spans; columns of the input that are not kept don't matter, kept ones whose names clash with an output column give way to it; an empty table trains on invented secrets alone and gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.shared import map_text, sample_texts

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
LABELS = 3
OUTSIDE, BEGIN, INSIDE = range(LABELS)
WORD_BUCKETS = 1 << 13
SHAPES = 1 << 11
ROW = 128
#: The fit reads at most SAMPLE texts, of each at most SAMPLE_CHARS code points.
SAMPLE = 600
SAMPLE_CHARS = 1 << 15
WINDOW = 48
#: Longer tokens count by their shape alone; a word that holds one of the stems speaks of secrets up to NEAR tokens on.
KNOWN, NEAR = 12, 4
STEMS = re.compile("pass|pwd|secret|token|key|auth|cred|login|bearer|basic|code|api|pin")
#: Spans of the field have so many characters at least; those without a digit so many.
LEAST = 8
LEAST_LETTERS = 10
_BODY = string.ascii_letters + string.digits + "_-+/"
#: By code point below 1024: 0 space, 1 lower, 2 upper, 3 digit, 4 joiner, 5 other. Letters beyond are lower.
CLASS = np.array([0 if chr(c).isspace() else 3 if chr(c) in string.digits else 4 if chr(c) in "_-+/" else 2 if chr(c).isupper() else 1 if chr(c).isalpha() else 5 for c in range(1024)], np.uint8)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Tokens:
    """Tokens of a block of texts joined end to end: start, end, text number, and the feature numbers of each."""

    def __init__(self, texts: list[str]) -> None:
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        kind = CLASS[np.minimum(codes, 1023)]
        body = (kind >= 1) & (kind <= 4)
        first = kind > 0
        first[1:] &= ~(body[1:] & body[:-1])
        edge = self.edges[:-1]
        edge = edge[edge < len(codes)]
        first[edge] = kind[edge] > 0
        self.start = np.flatnonzero(first)
        n = len(self.start)
        if not n:
            self.end, self.doc, self.fresh, self.features = np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool), np.zeros((0, 0), int)
            return
        used = kind > 0
        before = np.concatenate([[0], np.cumsum(used)])
        size = np.diff(np.append(before[self.start], before[-1]))
        self.end = self.start + size
        self.doc = np.searchsorted(self.edges, self.start, side="right") - 1
        self.fresh = np.ones(n, bool)
        self.fresh[1:] = self.doc[1:] != self.doc[:-1]
        total = [np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)]) for k in (1, 2, 3, 4)]
        lower, upper, digit, joiner = (t[self.end] - t[self.start] for t in total)
        change = np.concatenate([[0], np.cumsum(kind[1:] != kind[:-1], dtype=np.int32), [0]])
        turns = change[self.end - 1] - change[self.start]
        log = np.minimum(np.log2(size).astype(np.int64) * 2 + (size * size >= np.exp2(2 * np.log2(size).astype(np.int64) + 1)), 15)
        flags = (upper > 0) + 2 * (lower > 0) + 4 * (digit > 0) + 8 * (joiner > 0)
        shape = (flags * 16 + log) * 8 + np.minimum(4 * digit // size, 3) * 2 + (3 * turns > size)
        shape = np.where(kind[self.start] == 5, SHAPES - 1 - (codes[self.start] % 127), shape).astype(np.int64)
        lowered = np.where(kind == 2, codes + 32, codes) * np.uint32(0x9E3779B1)
        lowered ^= lowered >> np.uint32(15)
        place = np.cumsum(used) - 1
        lead = int(self.start[0])  # blanks before the first token
        until = np.diff(np.append(self.start, len(codes)))
        nth = np.concatenate([np.zeros(lead, np.int64), place[lead:] - np.repeat(before[self.start], until)]).astype(np.uint32)
        value = np.where(used, (lowered * (nth * np.uint32(0x85EBCA6B) + np.uint32(1))), 0).astype(np.uint32)
        word = np.add.reduceat(value, self.start).astype(np.uint32)
        word = ((word ^ (word >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(19)).astype(np.int64) % WORD_BUCKETS
        word = np.where(size > KNOWN, 0, word)
        docs = len(texts)
        tokens = np.bincount(self.doc, minlength=docs)
        per = np.maximum(tokens, 1)
        share = lambda flag: np.minimum((np.bincount(self.doc, flag, docs) * 8 / per).astype(int), 3)
        file = share(digit > 0) * 8 + share(kind[self.start] == 5) * 2 + (tokens > 200)
        bias = file[self.doc] * 16 + log
        # tokens since a word that speaks of secrets, 0 beyond NEAR; which sides touch a neighbour
        speaks = np.zeros(n, bool)
        lower_text = "".join(c if len(c) == 1 else c[0] for c in map(str.lower, joined)) if not joined.isascii() else joined.lower()
        at = np.array([m.start() for m in STEMS.finditer(lower_text)], np.int64)
        speaks[np.searchsorted(self.start, at, side="right") - 1] = True
        speaks &= size <= KNOWN
        latest = np.maximum.accumulate(np.where(speaks, np.arange(n), -NEAR - 1))
        latest = np.concatenate([[-NEAR - 1], latest[:-1]])
        since = np.arange(n) - latest
        since = np.where((since <= NEAR) & (self.doc[np.maximum(latest, 0)] == self.doc), since, 0)
        touch = np.zeros(n + 1, np.int64)
        touch[1:-1] = (self.end[:-1] == self.start[1:]) & ~self.fresh[1:]
        # a coarse shape, which other formats share: kinds of signs, size in four steps, whether kinds change often
        form = flags * 8 + np.digitize(size, (8, 16, 32)) * 2 + (4 * turns > size)
        near, glued = since * 128 + form, (touch[:-1] * 2 + touch[1:]) * 128 + form
        self.parts = [(shape, 0), (word, 0), (word, 1), (word, 2), (word, -1), (shape, 1), (shape, -1), (bias, 0), (near, 0), (glued, 0)]

    WIDTHS = (SHAPES, WORD_BUCKETS, WORD_BUCKETS, WORD_BUCKETS, WORD_BUCKETS, SHAPES, SHAPES, 512, (NEAR + 1) * 128, 4 * 128)
    FEATURES = sum(WIDTHS)

    def columns(self) -> list[np.ndarray]:
        """Feature numbers, one column after the other; neighbours in other texts count as number 0."""
        out, offset = [], 0
        for (value, back), width in zip(self.parts, self.WIDTHS):
            shifted = value
            if back:
                shifted = np.roll(value, back)
                same = np.roll(self.doc, back) == self.doc
                if back > 0:
                    same[:back] = False
                else:
                    same[back:] = False
                shifted = np.where(same, shifted, 0)
            out.append(shifted + offset)
            offset += width
        return out


class Field:
    """weights: features x labels; moves: label to label; enter: first label of a text."""

    def __init__(self) -> None:
        self.weights = np.zeros((Tokens.FEATURES, LABELS), np.float32)
        self.moves = np.zeros((LABELS, LABELS), np.float32)
        self.moves[OUTSIDE, INSIDE] = -1e4
        self.enter = np.array([0, 0, -1e4], np.float32)

    def scores(self, tokens: Tokens) -> np.ndarray:
        total = np.zeros((len(tokens.start), LABELS), np.float32)
        for column in tokens.columns():
            total += self.weights[column]
        return total

    def decode(self, score: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """The best labels of all texts; fresh marks first tokens."""
        n = len(score)
        rows = -(-n // ROW)
        wide = np.zeros((rows * ROW, LABELS), np.float32)
        wide[:n] = score
        start = np.ones(rows * ROW, bool)
        start[:n] = fresh
        wide, start = wide.reshape(rows, ROW, LABELS), start.reshape(rows, ROW)
        best = np.full((rows, LABELS, LABELS), -1e9, np.float32)
        best[:, range(LABELS), range(LABELS)] = 0
        back = np.zeros((ROW, rows, LABELS, LABELS), np.uint8)
        for t in range(ROW):
            move = np.where(start[:, t, None, None], self.enter, self.moves)
            step = best[:, :, :, None] + move[:, None]
            best = step[:, :, 0]
            arg = np.zeros(best.shape, np.uint8)
            for i in range(1, LABELS):
                more = step[:, :, i] > best
                best = np.where(more, step[:, :, i], best)
                arg[more] = i
            back[t] = arg
            best = best + wide[:, t, None, :]
            best -= best.max(axis=(1, 2), keepdims=True) if t % 32 == 31 else 0
        into = np.zeros((rows, LABELS), np.uint8)
        now = [0.0, -1e9, -1e9]
        for r, cell in enumerate(best.tolist()):
            after = []
            for j in range(LABELS):
                options = [now[i] + cell[i][j] for i in range(LABELS)]
                top = max(options)
                into[r, j] = options.index(top)
                after.append(top)
            high = max(after)
            now = [x - high for x in after]
        first, last = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        label = int(np.argmax(now))
        for r in range(rows - 1, -1, -1):
            last[r] = label
            label = int(into[r, label])
            first[r] = label
        out = np.zeros((rows, ROW), np.uint8)
        label, at = last, np.arange(rows)
        for t in range(ROW - 1, -1, -1):
            out[:, t] = label
            label = back[t, at, first, label].astype(np.int64)
        return out.reshape(-1)[:n]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(start, end) of every begin and its insides, in code points, by text."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        tokens = Tokens(texts)
        if not len(tokens.start):
            return out
        label = self.decode(self.scores(tokens), tokens.fresh)
        begins = np.flatnonzero(label == BEGIN)
        stop = np.flatnonzero(np.append((label != INSIDE) | tokens.fresh, True))
        ends = stop[np.searchsorted(stop, begins + 1)] - 1
        for b, e in zip(begins.tolist(), ends.tolist()):
            d = int(tokens.doc[b])
            out[d].append((int(tokens.start[b] - tokens.edges[d]), int(tokens.end[e] - tokens.edges[d])))
        return out


#: Invented phrases; a secret is between brackets.
INVENTED = (
    "Authorization: Bearer [{b}]", "x-api-key [{a}]", "client_secret => '[{b}]'", "pwd [{m}] ", "login with [sk_live_{a}]", "use [ghp_{a}] for the clone", "hook [xoxb-{d}-{a}]",
    "credentials are [{m}] since", "export AUTH=[{b}]", "private key id [{h}]", "access code [{m}].", 'token = "[{h}]"', "password: [{m}]", "session [{h}]", "AWS [AKIA{u}] and", "key [AKIA{u}]",
    "password is [{l}]", "pwd: [{l}]", "passphrase [{l}] for", "client_secret => '[{l}]'", "api_key=[{a}]", "[{h}]", "[AKIA{u}]",
)
PLAIN = (
    "order {d}", "card {c}", "call +1 ({t}) {t}-{f}", "from {i} at", "commit {s}", "on 2024-0{t}", "page {t} of {f}", "mail {w}.{t}@{w}.example.com", "version 1.{t}.0",
    "http://{w}.org/{w}/{t}", "the password of {w}", "a {w}-{w}-{w} word", "{w}_{w}_{w}", "{v}", "{v}, {v}", "the {v} key", "token {w}", "secret {v} of {w}", "# {w} = {w}",
)


def invented(rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A phrase and the spans of its secrets."""
    draw = lambda alphabet, a, b: "".join(rng.choice(alphabet) for _ in range(rng.randint(a, b)))
    both = string.ascii_letters + string.digits
    fill = {
        "a": draw(both, 20, 40), "b": draw(both + "_-", 24, 60), "m": draw(string.ascii_letters, 5, 5) + draw(string.digits, 4, 4) + draw(string.ascii_letters, 5, 5),
        "l": draw(string.ascii_letters, 12, 24), "h": draw("0123456789abcdef", 40, 40), "u": draw(string.ascii_uppercase + string.digits, 16, 16), "d": draw(string.digits, 6, 12),
        "c": draw(string.digits, 16, 16), "t": draw(string.digits, 3, 3), "f": draw(string.digits, 4, 4), "i": ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "s": draw("0123456789abcdef", 7, 7), "w": draw(string.ascii_lowercase, 3, 9), "v": draw(string.ascii_lowercase, 10, 24),
    }
    if rng.random() < 0.5:
        return rng.choice(PLAIN).format(**fill), []
    lead, inner = rng.choice(INVENTED).split("[", 1)
    key, after = inner.rsplit("]", 1)
    lead, key = lead.format(**fill), key.format(**fill)
    return lead + key + after.format(**fill), [(len(lead), len(lead) + len(key))]


LEADS = ("password", "passwd", "pwd", "secret", "token", "api key", "apikey", "key", "auth", "credential", "login", "bearer", "access token", "user password", "signing key", "db_password")
LINKS = (": ", " = ", "=", " is ", " ", ' "', " => ", ":", " was ", " '")
NAMES = ("request", "order", "session of", "page", "file", "build", "item", "trace", "user", "run", "batch", "document")


def composed(rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A phrase whose form is drawn too, and the spans of its secrets; half of them have none."""
    draw = lambda alphabet, a, b: "".join(rng.choice(alphabet) for _ in range(rng.randint(a, b)))
    both, lower, hexes = string.ascii_letters + string.digits, string.ascii_lowercase, "0123456789abcdef"
    uuid = "-".join(draw(hexes, n, n) for n in (8, 4, 4, 4, 12))
    word = lambda: draw(lower, 2, 9)
    if rng.random() < 0.5:
        camel = "".join(word().capitalize() for _ in range(rng.randint(2, 5)))
        return rng.choice((
            f"{rng.choice(NAMES)} {uuid}", f"{rng.choice(NAMES)} id {uuid}", f"the {rng.choice(LEADS)} is {word()} {word()}", f"{rng.choice(LEADS)} {word()}-{word()} and {word()}", f"{word()}{camel}({word()})",
            f"{camel}.{word()}.{word()}", f"/{word()}/{word()}/{word()}-{draw(string.digits, 2, 6)}.{word()}", f"{word().upper()}-{draw(string.digits, 3, 8)}-{draw(string.ascii_uppercase, 1, 3)}",
            f"{rng.choice(NAMES)} {draw(string.digits, 6, 20)}", f"{word()}-{word()}-{word()}-{word()}-{word()}", f"{rng.choice(LEADS)}: {word()}", f"code {draw(string.digits, 3, 6)}", f"{draw(string.digits, 1, 3)}.{draw(string.digits, 1, 3)}.{draw(string.digits, 1, 4)}",
            f"{word()}_{word()}_{word()}_{word()}", f"{camel}{camel}", f"{word()}={draw(string.digits, 1, 9)}&{word()}={word()}",
        )), []
    lead = rng.choice(LEADS)
    lead = rng.choice((lead, lead.upper(), lead.title(), f"{word()}_{lead}", f"the {lead} of {word()}", f"{lead} {word()}", f"{word()} {lead} {word()}")) + rng.choice(LINKS)
    bare = rng.random() < 0.4
    kind = rng.randrange(4 if bare else 7)
    if kind == 0:
        prefix = draw(rng.choice((lower, string.ascii_uppercase, string.ascii_letters)), 2, 6)
        middle = rng.choice(("_", "-", "", f"_{word()}_", "-v1-", f"-{word()}-{word()}-"))
        key = prefix + (middle.upper() if prefix.isupper() else middle) + draw(rng.choice((both, both, hexes, string.ascii_uppercase + string.digits)), 20, 70)
    elif kind == 1:
        key = ".".join([draw(both + "_-", rng.choice((4, 16)), 60) for _ in range(rng.randint(2, 3))])
        key = rng.choice((key, draw(string.ascii_letters, 2, 4) + "." + draw(both, 20, 24) + "." + draw(both + "_-", 30, 44)))
    elif kind == 2:
        key = draw(both + "+/", 24, 90)
    elif kind == 3:
        key = draw(hexes, 32, 72)
    elif kind == 4:
        key = uuid
    elif kind == 5:
        key = draw(rng.choice((lower, string.ascii_letters)), 2, 6) + draw(string.digits, 2, 5) + draw(rng.choice((string.ascii_uppercase, lower, string.ascii_letters)), 0, 6)
        key += draw(string.digits, 8 - len(key), 8 - len(key)) if len(key) < 8 else ""
    else:
        key = draw(string.ascii_letters, 2, 4) + draw(string.digits, 1, 3) + rng.choice("!@#$%^&*?") + draw(both, 3, 7)
    lead = rng.choice(("", f"{word()} ", f"{word()} {word()} ", f"{word()}: ", f"{word()}=")) if bare else lead
    after = rng.choice(("", "", " ", ".", ",", '"', "'", ";", "=", "==") if kind == 2 else ("", "", " ", ".", ",", '"', "'", ";"))
    return f"{lead}{key}{after}", [(len(lead), len(lead) + len(key))]


def examples(texts: list[str], windows: int, seed: int) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Pieces of texts with the values of base matches as spans, and with invented phrases put in."""
    rng = random.Random(seed)
    pieces, spans = [], []
    for text in texts:
        marks = []
        for s, kind, e in base_spans(text):
            marks.append((ASSIGN.match(text, s).span(2) if kind == 0 else (s, e)))
        marks.sort()
        for a in [max(0, m[0] - 120) for m in marks[:3]] + [rng.randrange(max(1, len(text))) for _ in range(2)]:
            b = a + 300
            pieces.append(text[a:b])
            spans.append([(x - a, y - a) for i, (x, y) in enumerate(marks) if x >= a and y <= b and (not i or x >= marks[i - 1][1])])
    plain = [p for p, s in zip(pieces, spans) if not s] or [""]
    for _ in range(windows):
        left, right = (" ".join(rng.choice(plain).split()[: rng.randint(0, 12)]) for _ in range(2))
        text, inner = invented(rng) if rng.random() < 0.5 else composed(rng)
        pieces.append(f"{left} {text} {right}")
        spans.append([(a + len(left) + 1, b + len(left) + 1) for a, b in inner])
    return pieces, spans


def train(texts: list[str], invented_windows: int = 9000, rounds: int = 12, rate: float = 0.1, seed: int = 5) -> Field:
    """Adagrad on the exact log-likelihood of windows of at most WINDOW tokens."""
    pieces, spans = examples(texts, invented_windows, seed)
    tokens = Tokens(pieces)
    gold = np.zeros(len(tokens.start), np.int64)
    for d, marks in enumerate(spans):
        lo, hi = np.searchsorted(tokens.doc, [d, d + 1])
        for a, b in marks:
            inside = np.flatnonzero((tokens.start[lo:hi] >= tokens.edges[d] + a) & (tokens.end[lo:hi] <= tokens.edges[d] + b)) + lo
            gold[inside] = INSIDE
            gold[inside[:1]] = BEGIN
    columns = np.stack(tokens.columns(), 1)
    begin = np.searchsorted(tokens.doc, np.arange(len(pieces)))
    size = np.minimum(np.diff(np.append(begin, len(gold))), WINDOW)
    begin, size = begin[size > 0], size[size > 0]
    field, rng = Field(), np.random.default_rng(seed)
    sums = [np.full_like(x, 1e-3) for x in (field.weights, field.moves, field.enter)]
    for _ in range(rounds):
        order = rng.permutation(len(begin))
        for part in np.array_split(order, max(1, len(order) // 200)):
            n, length = len(part), int(size[part].max())
            at = np.minimum(begin[part][:, None] + np.arange(length), len(gold) - 1)
            live = np.arange(length) < size[part][:, None]
            feature, y = columns[at], gold[at]
            score = field.weights[feature].sum(2).astype(np.float64)
            moves, enter = field.moves.astype(np.float64), field.enter.astype(np.float64)
            alpha, beta = np.zeros((n, length, LABELS)), np.zeros((n, length, LABELS))
            lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
            alpha[:, 0] = score[:, 0] + enter
            for t in range(1, length):
                new = lse(alpha[:, t - 1, :, None] + moves, 1) + score[:, t]
                alpha[:, t] = np.where(live[:, t, None], new, alpha[:, t - 1])
            for t in range(length - 2, -1, -1):
                new = lse(moves + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(live[:, t + 1, None], new, 0)
            z = lse(alpha[:, -1], 1)
            node = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
            gradient = (np.eye(LABELS)[y] * live[:, :, None] - node) / n
            pair = np.exp(alpha[:, :-1, :, None] + moves + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
            both = live[:, 1:]
            seen = np.zeros((LABELS, LABELS))
            np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
            grads = [np.zeros_like(field.weights, dtype=np.float64), (seen - pair.sum((0, 1))) / n, (np.bincount(y[:, 0], minlength=LABELS) - node[:, 0].sum(0)) / n]
            for k in range(feature.shape[2]):
                for label in range(LABELS):
                    grads[0][:, label] += np.bincount(feature[:, :, k].ravel(), gradient[:, :, label].ravel(), Tokens.FEATURES)
            grads[0] -= 1e-5 * field.weights
            for value, grad, total in zip((field.weights, field.moves, field.enter), grads, sums):
                total += grad**2
                value += rate * grad / np.sqrt(total)
            field.moves[OUTSIDE, INSIDE] = field.enter[INSIDE] = -1e4
    return field


def fit(df: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Field:
    return train(sample_texts(df, text, key, sample, SAMPLE_CHARS))


def likely_secrets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that pass the exact check."""
    kept = []
    for a, b in spans:
        least = LEAST if any(c in string.digits for c in text[a:b]) else LEAST_LETTERS
        if b - a >= least:
            kept.append((a, b))
    return kept


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(df: DataFrame, field: Field, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and n_assign, n_access, n_hex, n_crf, base_sha256, spans and secrets (an array of kind, start, end)."""
    shared = df.sparkSession.sparkContext.broadcast(field)
    kind_type = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def make():
        f = shared.value

        def block(column: pa.Array) -> list:
            texts = [t or "" for t in column.to_pylist()]
            counts, digests, joined, lists = [], [], [], []
            for text, found in zip(texts, f.spans(texts)):
                base = base_spans(text)
                every = sorted(base + [(a, KINDS.index("crf"), b) for a, b in likely_secrets(text, found)])
                counts.append([sum(k == i for _, k, _ in every) for i in range(len(KINDS))])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                joined.append(written(every))
                lists.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in every])
            table = np.array(counts, np.int64).reshape(-1, len(KINDS))
            return [*table.T.copy(), pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(lists, pa.list_(kind_type))]

        return block

    out = "n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string, secrets array<struct<kind:string,start:bigint,end:bigint>>"
    return map_text(df, make, out, text, list(keep))


def without(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with ``mark`` for each run of overlapping spans."""
    made, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            made += [text[at:s], mark]
        at = max(at, e)
    return "".join(made) + text[at:]


def redact(df: DataFrame, field: Field, text: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """df with every secret of its texts, of base patterns and field, replaced by ``mark``; same columns, null texts stay null."""
    columns = df.columns
    shared = df.sparkSession.sparkContext.broadcast(field)

    def make():
        f = shared.value

        def block(column: pa.Array) -> list:
            texts = column.to_pylist()
            out = []
            for text, found in zip(texts, f.spans([t or "" for t in texts])):
                if text is not None:
                    text = without(text, [(s, e) for s, _, e in base_spans(text)] + likely_secrets(text, found), mark)
                out.append(text)
            return [pa.array(out, pa.string())]

        return block

    return map_text(df, make, f"`{text}` string", text, [c for c in columns if c != text]).select(*[F.col(f"`{c}`") for c in columns])
