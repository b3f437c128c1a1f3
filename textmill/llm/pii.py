"""Personal data: base patterns and a character-level bidirectional LSTM with CRF transitions.

Every whole text is cut into segments, and each is read in a window that overlaps its neighbours by MARGIN characters on
either side; windows of a block run side by side. The outputs of both LSTM directions give each character of a segment scores for the labels outside,
email, ip, card and phone; in an overlap the window counts whose edge is farther. Viterbi then finds the best
labels of the whole text under the CRF transitions (a kind is entered from outside only), also across segments: each
segment is decoded from every label that may come before it, and the tables of a text's segments are joined in order. A segment is scored if it or a neighbour holds
a sign that every span has which passes the check below (a figure, an @ or a spelled one); others are outside, as a span there would have to reach over a whole segment without such a sign. Runs of a label become spans
``lstm_*``; an exact check follows: a span must have the figures of its kind (Luhn digits, address parts, number of
digits). They stand beside the base spans, which are always there; the network finds most of those too, and others. One that overlaps a base span of its kind without
being that span is a piece of it and is dropped.

The network is trained here, in numpy with Adam on the exact CRF likelihood, from windows of a bounded sample of texts (SAMPLE, SAMPLE_CHARS)
labelled by the base patterns (of a text, the windows of its first four base spans and one other) and from invented phrases with their spans: of some forms, and of forms whose
groups, separators, brackets and lead words are drawn too, most of which the patterns don't match.

Defined results: null and empty texts have no spans; equal texts have equal spans; columns of the input that are not kept don't matter, kept ones whose names
clash with an output column give way to it; an empty table trains on invented phrases alone and gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textmill.llm.shared import map_text, sample_texts

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
HIDDEN = 10
#: A segment of text is read with MARGIN characters on either side; BATCH segments run side by side.
SEGMENT = 224
MARGIN = 16
BATCH = 2048
#: The fit reads at most SAMPLE texts, of each at most SAMPLE_CHARS code points.
SAMPLE = 600
SAMPLE_CHARS = 1 << 15
NEVER = -1e4
#: Character numbers: printable ASCII, then space-like, lower letter, upper letter, digit, other.
SPACE, LOWER, UPPER, DIGIT, OTHER, PAD = range(95, 101)
VOCABULARY = 101


def _code(c: str) -> int:
    o = ord(c)
    return o - 33 if 33 <= o < 127 else SPACE if c.isspace() else DIGIT if c.isdigit() else UPPER if c.isupper() else LOWER if c.isalpha() else OTHER


CODES = np.array([_code(chr(i)) for i in range(1024)], np.uint8)
#: Kinds of characters: what one sign of a kind has taught holds for its others. Digits, letters, blanks, joiners, brackets, other signs.
SIGN_KINDS = (string.digits, string.ascii_lowercase, string.ascii_uppercase, ".", "@", "+", "-_/~:", "([{<", ")]}>", "\"'`", ",;!?")
SIGN = np.array([next((k for k, signs in enumerate(SIGN_KINDS) if chr(i + 33) in signs), len(SIGN_KINDS)) for i in range(94)] + [0] * 7, np.int64)
SIGN[[94, SPACE, LOWER, UPPER, DIGIT, OTHER, PAD]] = len(SIGN_KINDS), len(SIGN_KINDS) + 1, 1, 2, 0, len(SIGN_KINDS) + 2, len(SIGN_KINDS) + 3
SIGNS = len(SIGN_KINDS) + 4
#: The base patterns; an email is found from its @.
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"[0-9]+")
ANY_DIGIT = re.compile(r"[0-9]")
ENDS = frozenset(" \t\n\r.,;:")
#: Addresses whose signs may be spelled or bracketed.
SPELLED = re.compile(r"[^\s@()\[\]{}<>]+(?:\s?[\[({<]?@[\])}>]?\s?|\s?[\[({<_]at[\])}>_]\s?|\sat\s)(?:[^\s@()\[\]{}<>]+?(?:\.|\s?[\[({<_]dot[\])}>_]\s?|\sdot\s))+[^\W\d_]{2,}", re.I)

#: Where an address may be spelled without an @.
SPELLED_AT = re.compile(r"[\[({<_]at[\])}>_]|\sat\s[^\s@()\[\]{}<>]+(?:\.[^\W\d_]|\s?[\[({<_]dot|\sdot\s)", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start."""
    found = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not ANY_DIGIT.search(text):
        return found
    if "." in text:
        for m in DOTTED.finditer(text):
            parts = [p.span() for p in NUMBER.finditer(text, *m.span())]
            for i in range(0, len(parts) - 3, 4):
                if all(e - s < 4 or not text[s : e - 3].strip("0") for s, e in parts[i : i + 4]) and all(int(text[max(s, e - 3) : e]) < 256 for s, e in parts[i : i + 4]):
                    found.append((1, parts[i][0], parts[i + 3][1]))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in string.digits for c in m[0]) <= 15]
    return found


def plausible(kind: int, span: str) -> bool:
    """The exact check of a span that the network adds."""
    digits = "".join(c for c in span if c in string.digits)
    if kind == 0:
        return bool(SPELLED.fullmatch(span))
    if kind == 1:
        parts = re.split(r"\s?[.,:]\s?|[\[({<]\.[\])}>]|\s", span)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p[-4:]) < 256 and len(p) < 4 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and any(c in span for c in "()-./ ") and bool(re.fullmatch(r"[0-9+(][0-9\s().\-/]+[0-9]", span))


def beside(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans of the network that are base spans or lie apart from those of their kind."""
    known = set(base)
    return [x for x in more if x in known or not any(k == x[0] and s < x[2] and x[1] < e for k, s, e in base)]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + 0.5


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    high = x.max(axis, keepdims=True)
    return high.squeeze(axis) + np.log(np.exp(x - high).sum(axis))


class Network:
    """Two LSTM directions, gate-major (input, forget, output, candidate), an output layer and CRF transitions."""

    def __init__(self, seed: int = 3, hidden: int = HIDDEN) -> None:
        g, h = np.random.default_rng(seed), hidden
        self.hidden = h
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = g.normal(0, 0.3, (4 * h, VOCABULARY))
            self.p[f"h{d}"] = g.normal(0, 0.3, (4 * h, h))
            self.p[f"x{d}"][h : 2 * h] += 1
        self.p["o"] = g.normal(0, 0.3, (LABELS, 2 * h))
        self.p["b"] = np.zeros(LABELS)
        self.p["b"][0] = 1
        self.p["t"] = np.zeros((LABELS, LABELS))
        self.allowed = np.eye(LABELS, dtype=bool)
        self.allowed[0] = self.allowed[:, 0] = True

    def moves(self) -> np.ndarray:
        return np.where(self.allowed, self.p["t"], NEVER)

    def ready(self) -> "Network":
        """Single-precision copies for scoring; a sigmoid is half a tanh of half the sum, so those gates are halved."""
        half = np.ones((4 * self.hidden, 1))
        half[: 3 * self.hidden] = 0.5
        self.fast = {k: np.ascontiguousarray((v * half if k[0] in "xh" else v).astype(np.float32)) for k, v in self.p.items()}
        self.fast["t"] = self.moves().astype(np.float32)
        return self

    def direction(self, d: str, codes: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Hidden values (time, hidden, windows) of codes (time, windows); at each time the first ``live`` windows have not ended."""
        length, n = codes.shape
        h = self.hidden
        x, w = self.fast[f"x{d}"], self.fast[f"h{d}"]
        out = np.zeros((length, h, n), np.float32)
        c = np.zeros((h, n), np.float32)
        prev = np.zeros((h, n), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            k = int(live[t])
            gates = np.take(x, codes[t, :k], axis=1, mode="clip")
            gates += w @ prev[:, :k]
            np.tanh(gates, out=gates)
            sig = gates[: 3 * h]
            sig *= 0.5
            sig += 0.5
            cell = c[:, :k]
            cell *= gates[h : 2 * h]
            cell += gates[:h] * gates[3 * h :]
            np.multiply(gates[2 * h : 3 * h], np.tanh(cell), out=out[t, :, :k])
            prev = out[t]
        return out

    def emissions(self, codes: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Scores (time, LABELS, windows) of windows of so many characters, descending."""
        o = self.fast["o"]
        live = np.searchsorted(-width, -np.arange(len(codes)))
        score = np.matmul(o[:, : self.hidden], self.direction("f", codes, live))
        score += np.matmul(o[:, self.hidden :], self.direction("b", codes, live))
        score += self.fast["b"][:, None]
        return score

    def tables(self, score: np.ndarray, width: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi of segments from each label before them.

        score: (time, LABELS, segments); width: of each segment, descending; first: whether nothing comes before. Returns the best scores
        (label before, last label, segments), of first segments all in row 0, and the ways back (time, label before, segments): bit k - 1 is set where kind k is entered
        from outside, the bits above tell where outside comes from.
        """
        length, _, n = score.shape
        move = self.fast["t"]
        stay, enter, leave = np.diag(move).copy()[1:, None], move[0, 1:, None], move[1:, 0, None]
        best = move[:, :, None] + score[0]
        best[0] = np.where(first, score[0], best[0])
        back = np.zeros((length, LABELS, n), np.uint8)
        bits = (1 << np.arange(LABELS - 1)).astype(np.uint8)[:, None]
        back[0] = ((0 == np.arange(LABELS)) * np.uint8((1 << (LABELS - 1)) - 1))[:, None] | (np.arange(LABELS) << (LABELS - 1)).astype(np.uint8)[:, None]
        for t in range(1, length):
            k = int(np.searchsorted(-width, -t))  # so many segments are longer than t
            now = best[:, :, :k]
            kinds, outside = now[:, 1:], now[:, 0]
            out_of = kinds + leave
            top, zero = out_of.max(1), outside + move[0, 0]
            fresh = outside[:, None] + enter
            same = kinds + stay
            entered = fresh > same
            way = (entered * bits).sum(1, dtype=np.uint8)
            left = top > zero
            if left.any():
                way |= (np.where(left, out_of.argmax(1) + 1, 0) << (LABELS - 1)).astype(np.uint8)
            back[t, :, :k] = way
            np.maximum(same, fresh, out=now[:, 1:])
            np.maximum(zero, top, out=now[:, 0])
            now += score[t, :, :k]
        return best, back

    @staticmethod
    def joined(best: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For segments in order of text: the label before each and its last label, on the best way through each text."""
        n = len(doc)
        before, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
        cells = best.transpose(2, 0, 1).tolist()
        a = 0
        while a < n:
            b = a
            now = [0.0] + [NEVER * NEVER] * (LABELS - 1)
            into = []
            while b < n and doc[b] == doc[a]:
                cell = cells[b]
                options = [[now[i] + cell[i][j] for i in range(LABELS)] for j in range(LABELS)]
                high = [max(o) for o in options]
                into.append([o.index(h) for o, h in zip(options, high)])
                top = max(high)
                now = [h - top for h in high]
                b += 1
            label = now.index(max(now))
            for k in range(b - 1, a - 1, -1):
                last[k] = label
                before[k] = label = into[k - a][label]
            a = b
        return before, last

    def labels(self, texts: list[str], everywhere: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The best labels of all characters of the texts, end to end, and where each text begins; without ``everywhere`` only of segments near a sign of a span."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = CODES[np.minimum(codes, 1023)]
        size = np.array([len(t) for t in texts], np.int64)
        edge = np.concatenate([[0], np.cumsum(size)])
        found = np.zeros(len(codes), np.uint8)
        count = -(-size // SEGMENT)
        doc = np.repeat(np.arange(len(texts)), count)
        if not len(doc):
            return found, edge
        begin = edge[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
        width = np.minimum(edge[doc + 1] - begin, SEGMENT)
        if not everywhere:
            signs = (codes >= _code("0")) & (codes <= _code("9")) | (codes == _code("@"))
            signs[[m.start() for m in SPELLED_AT.finditer(joined)]] = True
            before = np.concatenate([[0], np.cumsum(signs)])
            near = before[np.minimum(begin + width + SEGMENT, edge[doc + 1])] > before[np.maximum(begin - SEGMENT, edge[doc])]
            doc, begin, width = doc[near], begin[near], width[near]
            if not len(doc):
                return found, edge
        # segments that follow one another are decoded together; what is not scored is outside
        chain = np.cumsum(np.append(True, (doc[1:] != doc[:-1]) | (begin[1:] != begin[:-1] + width[:-1])))
        order = np.argsort(-width, kind="stable")
        best = np.empty((LABELS, LABELS, len(doc)), np.float32)
        ways = []
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            steps = np.arange(-MARGIN, int(width[part[0]]) + MARGIN)[:, None] + begin[part]
            inside = (steps >= edge[doc[part]]) & (steps < edge[doc[part] + 1])
            window = np.where(inside, codes[np.clip(steps, 0, len(codes) - 1)], np.uint8(PAD))
            score = self.emissions(window, width[part] + 2 * MARGIN)[MARGIN : len(window) - MARGIN]
            best[:, :, part], back = self.tables(score, width[part], begin[part] == edge[doc[part]])
            ways.append(back)
        before, last = self.joined(best, chain)
        for a, back in zip(range(0, len(order), BATCH), ways):
            part = order[a : a + BATCH]
            label, start, at = last[part], before[part], np.arange(len(part))
            for t in range(len(back) - 1, -1, -1):
                k = int(np.searchsorted(-width[part], -t))
                now = label[:k]
                found[begin[part[:k]] + t] = now
                way = back[t, start[:k], at[:k]].astype(np.int64)
                label[:k] = np.where(now == 0, way >> (LABELS - 1), now * (1 - (way >> np.maximum(now - 1, 0) & 1)))
        return found, edge

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) of every run of a label, by text."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        label, edge = self.labels(texts, False)
        place = np.flatnonzero(label)
        if not len(place):
            return out
        owner = np.searchsorted(edge, place, side="right") - 1
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (label[place[1:]] != label[place[:-1]]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(new)
        for s, e in zip(starts.tolist(), np.append(starts[1:], len(place)).tolist()):
            d = int(owner[s])
            out[d].append((int(label[place[s]]) - 1, int(place[s] - edge[d]), int(place[e - 1] - edge[d]) + 1))
        return out

    def added(self, text: str, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Runs that pass the exact check, without blanks and closing signs at their ends."""
        made = []
        for kind, a, b in runs:
            while a < b and text[a] in ENDS:
                a += 1
            while a < b and text[b - 1] in ENDS:
                b -= 1
            if a < b and plausible(kind, text[a:b]):
                made.append((kind, a, b))
        return made

    def gradient(self, codes: np.ndarray, gold: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log-likelihood of gold labels (time, windows)."""
        length, n = codes.shape
        h, p, move = self.hidden, self.p, self.moves()
        saved, hidden = {}, {}
        for d in "fb":
            kind = p["o"].dtype
            prev, c = np.zeros((h, n), kind), np.zeros((h, n), kind)
            out = np.empty((length, h, n), kind)
            for t in range(length) if d == "f" else range(length - 1, -1, -1):
                z = p[f"x{d}"][:, codes[t]] + p[f"h{d}"] @ prev
                gates, g = sigmoid(z[: 3 * h]), np.tanh(z[3 * h :])
                before, c = c, gates[h : 2 * h] * c + gates[:h] * g
                tc = np.tanh(c)
                saved[d, t] = (gates, g, before, tc, prev)
                prev = out[t] = gates[2 * h :] * tc
            hidden[d] = out
        both = np.concatenate([hidden["f"], hidden["b"]], 1)
        score = np.matmul(p["o"], both) + p["b"][:, None]
        alpha, beta = np.empty_like(score), np.zeros_like(score)
        alpha[0] = score[0]
        for t in range(1, length):
            alpha[t] = log_sum(alpha[t - 1][:, None] + move[:, :, None], 0) + score[t]
        for t in range(length - 2, -1, -1):
            beta[t] = log_sum(move[:, :, None] + (score[t + 1] + beta[t + 1])[None], 1)
        z = log_sum(alpha[-1], 0)
        ds = -np.exp(alpha + beta - z)
        ds[np.arange(length)[:, None], gold, np.arange(n)] += 1
        ds /= n
        pair = np.exp(alpha[:-1, :, None] + move[None, :, :, None] + (score[1:] + beta[1:])[:, None] - z).sum((0, 3))
        seen = np.zeros_like(move)
        np.add.at(seen, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        grad = {"t": (seen - pair) / n * self.allowed, "o": np.einsum("tln,thn->lh", ds, both, optimize=True), "b": ds.sum((0, 2))}
        one = np.eye(VOCABULARY, dtype=p["o"].dtype)
        for d, rows in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            outer = np.matmul(p["o"][:, rows].T, ds)
            dh, dc = np.zeros((h, n), ds.dtype), np.zeros((h, n), ds.dtype)
            dx, dw = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"h{d}"])
            for t in range(length - 1, -1, -1) if d == "f" else range(length):
                gates, g, before, tc, prev = saved[d, t]
                i, f, o = gates[:h], gates[h : 2 * h], gates[2 * h :]
                dh = dh + outer[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)])
                dx += dz @ one[codes[t]]
                dw += dz @ prev.T
                dh, dc = p[f"h{d}"].T @ dz, dc * f
            grad[f"x{d}"], grad[f"h{d}"] = dx, dw
        return grad


#: Invented phrases; a span is between brackets. Small letters stand for drawn parts, see ``invented``.
PHRASES = (
    "mail [{w}.{n}@{w}.example.com]", "[{w}@{w}.org]", "[{w}.{t}@{w}{n}.{w}.net]", "[{w}_{w}@{w}.{w}.com]", "[{w}.ü{w}@{w}.de]", "[{w} (at) {w}.net]", "[{w}[at]{w}.com]",
    "ip [{i}]", "host [{i}]", "[{i}]", "[{i}]", "[{o} . {o} . {o} . {o}]",
    "card [{c}]", "[{c}]", "[{c}]", "card [{cs}]", "[{cs}]", "card [{cd}]",
    "call [{p}]", "tel [{q}]", "[{p}]", "[{q}]", "fon [{r}]",
)
PLAIN = (
    "order {x}", "{x}", "on 2024-03-{o}", "version 2.{n}.1", "page {n} of {n}", "token = \"{h}\"", "commit {h}", "price {n}.{n}", "at {n}:{n}",
    "{n} {n}", "{w} @ {w}", "{w}_{n}", "{w}.{w}", "{w}, {n}",
)


def invented(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A phrase and its spans."""
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    body = draw(string.digits, 15)
    card = next(body + c for c in string.digits if luhn(body + c))
    quarters = [card[k : k + 4] for k in (0, 4, 8, 12)]
    octet = lambda: str(rng.randint(0, 255))
    area, line = draw(string.digits, 3), draw(string.digits, 4)
    fill = {
        "i": ".".join(octet() for _ in range(4)), "c": card, "cs": rng.choice(" -").join(quarters), "cd": ".".join(quarters),
        "p": f"+{rng.randint(1, 99)} ({area}) {draw(string.digits, 3)}-{line}", "q": f"({area}) {draw(string.digits, 3)}-{line}", "r": f"0{draw(string.digits, 2)}/{line}-{area}",
        "x": draw(string.digits, rng.randint(5, 12)), "h": draw("0123456789abcdef", 40), "t": draw(string.digits, 2),
    }

    def drawn(m: re.Match) -> str:
        if m[1] == "w":
            return draw(string.ascii_lowercase, rng.randint(2, 9))
        if m[1] == "n":
            return draw(string.digits, rng.randint(1, 3))
        return octet() if m[1] == "o" else fill[m[1]]

    named = rng.random() < 0.6
    form = rng.choice(PHRASES if named else PLAIN)
    if not named:
        return re.sub(r"\{(\w+)\}", drawn, form), []
    kind = 0 if "{w}" in form else 1 if "{i}" in form or "{o}" in form else 2 if "{c" in form else 3
    lead, inner = form.split("[", 1)
    text = lead + re.sub(r"\{(\w+)\}", drawn, inner[: inner.rindex("]")])
    return text, [(kind, len(lead), len(text))]


LEADS = ("mail", "write to", "contact", "e-mail", "reach", "ask", "address")
CALLS = ("call", "tel", "phone", "fon", "dial", "tel.", "fax", "number", "reach me on")
PAID = ("card", "paid with", "visa", "charge", "number", "account")
HOSTS = ("ip", "host", "server", "from", "login from", "address")


def composed(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A phrase whose form is drawn too, and its spans; of ten, four have none."""
    digits = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9)))
    octet = lambda: str(rng.randint(0, 255))
    kind = rng.randrange(-3, 4)
    if kind < 0:
        return rng.choice((
            f"{word()} at {word()}. {word().title()}", f"look at {word()}.{word()} and", f"{word()} [{word()}] {word()}.{word()}", f"{word()} (at {word()}) {word()}", f"{digits(4)}-{digits(2)}-{digits(2)}",
            f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(rng.randint(1, 3))}.{digits(rng.randint(1, 3))}.{digits(rng.randint(1, 3))}", f"no. {digits(rng.randint(9, 16))}",
            f"{digits(3)}-{digits(4)}", f"({digits(rng.randint(1, 4))}) {digits(rng.randint(1, 5))}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", f"{word()}-{digits(3)}-{digits(3)}",
            f"the dot {word()} at {word()}", f"{digits(4)} {digits(4)}", f"pages {digits(3)}-{digits(3)}", f"{word()}_{word()}_{digits(2)}",
        )), []
    if kind == 0:
        at = rng.choice(("@", "@", " @ ", "(at)", " (at) ", "[at]", " [at] ", "<at>", " <at> ", " at ", "_at_", "(@)", "[@]"))
        dot = rng.choice((".", ".", ".", " (dot) ", "(dot)", "[dot]", " [dot] ", "<dot>", " dot ", "_dot_"))
        name = rng.choice((word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}-{word()}", f"{word()}_{digits(1)}"))
        span, lead = name + at + dot.join([word() for _ in range(rng.randint(1, 2))] + [rng.choice(("com", "org", "net", "de", "info", word()[:3]))]), rng.choice(LEADS)
    elif kind == 1:
        dot = rng.choice((".", "[.]", "<.>", " . ", ". ", "[.]"))
        span, lead = dot.join(octet() for _ in range(4)), rng.choice(HOSTS)
    elif kind == 2:
        body = digits(15)
        card = next(body + c for c in string.digits if luhn(body + c))
        apart = rng.choice(("", " ", "-", ".", ":", "~", "  ", " - ", "+"))
        span, lead = apart.join(card[k : k + 4] for k in (0, 4, 8, 12)), rng.choice(PAID)
    else:
        # groups of a number, with blanks, hyphens or slashes between them, the first of them perhaps in brackets with a blank behind
        first = rng.choice(("", "", "0", f"+{rng.randint(1, 99)} ", f"00{rng.randint(1, 99)} ", f"+{rng.randint(1, 99)}-", "0"))
        sizes = rng.choice(((3, 3, 4), (3, 3, 3), (2, 4, 4), (3, 2, 2, 2), (4, 3, 3), (2, 3, 4), (3, 4, 3), (5, 5), (2, 2, 2, 2, 2), (3, 6), (4, 2, 4), (2, 7), (1, 3, 3, 4)[1:]))
        apart = rng.choice((" ", "-", "/", " - ", " / ", "-", " "))
        groups = [digits(n) for n in sizes]
        area = rng.random()
        span = first + (f"({groups[0]}) " if area < 0.25 else groups[0] + apart) + apart.join(groups[1:])
        lead = rng.choice(CALLS)
    lead = rng.choice((f"{lead} ", f"{lead}: ", f"{word()} ", f"{lead} {word()} ", ""))
    return lead + span, [(kind, len(lead), len(lead) + len(span))]


def examples(texts: list[str], count: int, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and labels (time, windows): at most five windows of a text, and invented phrases between words of the texts, ``count`` at least."""
    rng = random.Random(seed)
    windows: list[tuple[str, list[tuple[int, int, int]]]] = []
    plain: list[str] = []
    for text in texts:
        base = base_spans(text)
        starts = [max(0, s - rng.randint(4, max(5, length - min(length - 5, e - s)))) for _, s, e in base[:4]]
        if text:
            starts.append(rng.randrange(len(text)))
        windows += [(text[a : a + length], [(k, x - a, y - a) for k, x, y in base]) for a in starts]
        plain += text.split()[:200]
    plain = plain or ["and", "of"]
    while len(windows) < count:
        text, spans = invented(rng) if rng.random() < 0.5 else composed(rng)
        left = " ".join(rng.choice(plain) for _ in range(rng.randint(0, 4)))
        left = (left + " ")[-rng.randint(1, 24) :]
        right = rng.choice([" ", " ", " ", ". ", ", ", "\n", ") ", '" ', rng.choice("!?#*%$&|") * rng.randint(1, 3) + " "]) + " ".join(rng.choice(plain) for _ in range(6))
        windows.append(((left + text + right)[:length], [(k, a + len(left), b + len(left)) for k, a, b in spans]))
    rng.shuffle(windows)
    codes, gold = np.full((length, len(windows)), PAD, np.int64), np.zeros((length, len(windows)), np.int64)
    for i, (text, spans) in enumerate(windows):
        pad = rng.choice([0, 0, min(MARGIN, length - len(text))])
        codes[pad : pad + len(text), i] = [_code(c) for c in text]
        for k, a, b in spans:
            gold[max(a, 0) + pad : max(b, 0) + pad, i] = k + 1
        gold[pad + len(text) :, i] = 0
    return codes, gold


def train(texts: list[str], windows: int = 9000, length: int = 64, steps: int = 700, batch: int = 200, rate: float = 0.03, seed: int = 3) -> Network:
    """Adam on the likelihood of drawn windows. A character's input weights are those of its kind (SIGN), and its own, which start near nothing and learn slowly."""
    codes, gold = examples(texts, windows, length, seed)
    net, rng = Network(seed), np.random.default_rng(seed)
    net.p = {k: v.astype(np.float32) for k, v in net.p.items()}
    kinds = np.eye(SIGNS, dtype=np.float32)[SIGN]
    free = {k: v.copy() for k, v in net.p.items()}
    for d in "fb":
        whole = free.pop(f"x{d}")
        free[f"kind{d}"] = (whole @ kinds) / np.maximum(kinds.sum(0), 1) * np.sqrt(np.maximum(kinds.sum(0), 1))
        free[f"own{d}"] = whole * np.float32(0.1)
    first, second = ({k: np.zeros_like(v) for k, v in free.items()} for _ in range(2))
    for step in range(1, steps + 1):
        for d in "fb":
            net.p[f"x{d}"] = free[f"own{d}"] + free[f"kind{d}"] @ kinds.T
        net.p |= {k: v for k, v in free.items() if k in net.p}
        part = rng.integers(0, codes.shape[1], batch)
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        grad = net.gradient(codes[:, part], gold[:, part])
        for d in "fb":
            grad[f"own{d}"] = grad.pop(f"x{d}")
            grad[f"kind{d}"] = grad[f"own{d}"] @ kinds
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            pace = now * (0.5 if k.startswith("own") else 1.0)
            free[k] += pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    for d in "fb":
        net.p[f"x{d}"] = free[f"own{d}"] + free[f"kind{d}"] @ kinds.T
    net.p |= {k: v for k, v in free.items() if k in net.p}
    return net.ready()


def fit(df: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Network:
    return train(sample_texts(df, text, key, sample, SAMPLE_CHARS))


def written(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{name}:{s}:{e}" for _, s, e, name in spans)


def find(df: DataFrame, net: Network, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and n_email, n_ip, n_card, n_phone (base), n_lstm, base_sha256, spans and found (an array of kind, start, end)."""
    shared = df.sparkSession.sparkContext.broadcast(net)
    kind_type = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def make():
        network = shared.value

        def block(column: pa.Array) -> list:
            texts = [t or "" for t in column.to_pylist()]
            counts, digests, joined, lists = [], [], [], []
            for text, runs in zip(texts, network.spans(texts)):
                known = base_spans(text)
                base = [(k, s, e, KINDS[k]) for k, s, e in known]
                more = [(k + len(KINDS), s, e, f"lstm_{KINDS[k]}") for k, s, e in beside(known, network.added(text, runs))]
                every = sorted(base + more)
                counts.append([sum(k == i for k, *_ in base) for i in range(len(KINDS))] + [len(more)])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                joined.append(written(every))
                lists.append([{"kind": name, "start": s, "end": e} for _, s, e, name in every])
            table = np.array(counts, np.int64).reshape(-1, len(KINDS) + 1)
            return [*table.T.copy(), pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(lists, pa.list_(kind_type))]

        return block

    out = "n_email long, n_ip long, n_card long, n_phone long, n_lstm long, base_sha256 string, spans string, found array<struct<kind:string,start:bigint,end:bigint>>"
    return map_text(df, make, out, text, list(keep))
