"""The methods themselves: cuts, fields and networks against enumeration, components of long chains, held-out figures."""

import itertools
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textmill.llm import htmltext, neardup, pii, quality, secrets

SF = "/root/testdata/sf0.01"


def split(rows, key):
    """Rows in two halves, by a hash of their key."""
    halves = [], []
    for r in rows:
        halves[zlib.crc32(str(r[key]).encode()) % 2].append(r)
    return halves


@pytest.fixture(scope="module")
def texts():
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return tuple([r["text"] or "" for r in half] for half in split(rows, "doc_id"))


# --- main text -------------------------------------------------------------------------------------------------------


def test_minimum_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 11)
        draw = rng.choice([lambda: rng.choice([-2.0, -1.0, 0.0, 1.0, 2.0]), lambda: rng.uniform(-3, 3)])
        excess = [draw() for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), abs(draw())) for _ in range(rng.randint(0, 2 * n))]
        cost = lambda side: sum(-e if s else e for e, s in zip(excess, side)) / 2 + sum(w for a, b, w in edges if side[a] != side[b])
        best = min(map(cost, itertools.product((False, True), repeat=n)))
        assert cost(htmltext.minimum_cut(excess, edges)) == pytest.approx(best, abs=1e-9)


def f1(pairs):
    hit, other = sum(a and b for a, b in pairs), sum(a != b for a, b in pairs)
    return 2 * hit / max(1, 2 * hit + other)


def test_cut_on_held_out_pages():
    train, test = split(pq.read_table(f"{SF}/pages.parquet").to_pylist(), "page_id")
    model = htmltext.train([r["html"] or "" for r in train])
    seen, plain, threshold, turned = [], [], [], 0
    for r in test:
        blocks = htmltext.read_blocks(r["html"] or "")
        known = [htmltext.known(b) for b in blocks]
        single = [c > 0 for c in htmltext.costs(blocks, model, hidden=True)]
        cut = htmltext.cut(blocks, model, hidden=True)
        for k, s, c, whole in zip(known, single, cut, htmltext.cut(blocks, model)):
            if k:
                seen.append((whole, k > 0))
                plain.append((c, k > 0))
                threshold.append((s, k > 0))
                turned += s != c
    # with the names of elements hidden, the edges turn blocks, and rightly
    assert len(seen) > 1000 and f1(seen) > 0.995 and f1(plain) > 0.99 and f1(plain) > f1(threshold) and turned > 0


def test_edges_turn_a_block():
    page = "<body><div>" + "<p>A long paragraph, with stops and commas, that says what it has to say at some length.</p>" * 3 + "<p>So.</p>" + "<p>Another one, as long as the first, with some more stops; and commas, too.</p>" * 3 + "</div></body>"
    model = htmltext.train([])
    blocks = htmltext.read_blocks(page)
    model.weights[0] -= htmltext.costs(blocks, model)[3] + 0.5  # now the short one looks like boilerplate
    assert [c > 0 for c in htmltext.costs(blocks, model)] == [True] * 3 + [False] + [True] * 3
    text, n, content, turned = htmltext.main_text(page, model)
    assert (n, content, turned) == (7, 7, 1) and "\nSo.\n" in text


def test_main_text_roles():
    model = htmltext.train([])
    page = """<body><header><a href=/>Site</a></header><div class="cookie-notice"><p>We use cookies, as everyone does, to make this better.</p></div>
<div class="post-content"><h1>Title of it</h1><p>First paragraph, of some length, with more than one clause in it.</p><p>Second paragraph, of some length; with more than one clause in it.</p></div>
<aside><p>Read this too, it is good for you, really.</p></aside><div id="comments"><p>I, a reader, have long disagreed with all of this.</p></div><form>Your mail</form><footer>Imprint, and so on.</footer></body>"""
    assert htmltext.main_text(page, model)[0].split("\n") == ["Title of it", "First paragraph, of some length, with more than one clause in it.", "Second paragraph, of some length; with more than one clause in it."]
    deep = "<div>" * 20000 + "<p>Some text, deep down, is still read in time and without trouble.</p>"
    assert htmltext.main_text(deep, model)[1] == 1


# --- personal data ---------------------------------------------------------------------------------------------------


def tiny_network():
    net = pii.Network(seed=1)
    for p in net.p.values():
        p *= 3
    return net.ready()


def plain_labels(net, text):
    """A plain forward pass over the text's windows and a plain Viterbi over all of it."""
    h, p = net.hidden, net.p
    move = net.moves()
    codes = [pii._code(c) for c in text]
    scores = []
    for begin in range(0, len(text), pii.SEGMENT):
        width = min(pii.SEGMENT, len(text) - begin)
        window = [codes[i] if 0 <= i < len(codes) else pii.PAD for i in range(begin - pii.MARGIN, begin + width + pii.MARGIN)]
        out = {}
        for d in "fb":
            prev, c, values = np.zeros(h), np.zeros(h), []
            for code in window if d == "f" else window[::-1]:
                z = p[f"x{d}"][:, code] + p[f"h{d}"] @ prev
                i, f, o = (1 / (1 + np.exp(-z[k * h : k * h + h])) for k in range(3))
                c = f * c + i * np.tanh(z[3 * h :])
                prev = o * np.tanh(c)
                values.append(prev)
            out[d] = values if d == "f" else values[::-1]
        scores += [p["o"] @ np.concatenate([a, b]) + p["b"] for a, b in zip(out["f"], out["b"])][pii.MARGIN : pii.MARGIN + width]
    best, back = scores[0], []
    for s in scores[1:]:
        step = best[:, None] + move
        back.append(step.argmax(0))
        best = step.max(0) + s
    label = [int(best.argmax())]
    for b in reversed(back):
        label.append(int(b[label[-1]]))
    path = label[::-1]
    value = lambda l: sum(s[x] for s, x in zip(scores, l)) + sum(move[a, b] for a, b in itertools.pairwise(l))
    return path, value


def test_network_decodes_whole_texts():
    net = tiny_network()
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab 1.@+-9Zü(") for _ in range(n)) for n in (1, 3, 223, 224, 225, 448, 449, 1500, 0, 700)]
    label, edge = net.labels(texts)
    for k, text in enumerate(texts):
        got = label[edge[k] : edge[k + 1]].tolist()
        if text:
            want, value = plain_labels(net, text)
            assert value(got) == pytest.approx(value(want), rel=1e-4), (k, got, want)
            assert all(a == b or 0 in (a, b) for a, b in itertools.pairwise(got))  # the transitions hold across segments
    assert len(set(label.tolist())) > 2


def test_network_gradient():
    rng = np.random.default_rng(5)
    net = pii.Network(seed=2, hidden=3)
    codes, gold = rng.integers(0, pii.VOCABULARY, (6, 4)), np.zeros((6, 4), np.int64)
    gold[2:4, :2] = 2

    def likelihood():
        move, total = net.moves(), 0.0
        for w in range(4):
            out = {}
            for d in "fb":
                h, prev, c, values = net.hidden, np.zeros(3), np.zeros(3), []
                for code in codes[:, w] if d == "f" else codes[::-1, w]:
                    z = net.p[f"x{d}"][:, code] + net.p[f"h{d}"] @ prev
                    i, f, o = (1 / (1 + np.exp(-z[k * h : k * h + h])) for k in range(3))
                    c = f * c + i * np.tanh(z[3 * h :])
                    prev = o * np.tanh(c)
                    values.append(prev)
                out[d] = values if d == "f" else values[::-1]
            s = [net.p["o"] @ np.concatenate(v) + net.p["b"] for v in zip(out["f"], out["b"])]
            value = lambda l: sum(x[y] for x, y in zip(s, l)) + sum(move[a, b] for a, b in itertools.pairwise(l))
            every = [value(l) for l in itertools.product(range(pii.LABELS), repeat=6)]
            total += value(gold[:, w]) - np.logaddexp.reduce(every)
        return total / 4

    grad = net.gradient(codes, gold)
    for name in ("xf", "hb", "o", "b", "t"):
        at = tuple(int(rng.integers(0, n)) for n in net.p[name].shape) if name != "t" else (0, 2)
        at = (at[0], int(codes[2, 0])) if name == "xf" else at
        net.p[name][at] += 1e-5
        up = likelihood()
        net.p[name][at] -= 2e-5
        slope = (up - likelihood()) / 2e-5
        net.p[name][at] += 1e-5
        assert grad[name][at] == pytest.approx(slope, rel=1e-3, abs=1e-6)


def test_network_finds_held_out_data(texts):
    net = pii.train(texts[0])
    found = base = other = 0
    for text, runs in zip(texts[1], net.spans(texts[1])):
        want, got = set(pii.base_spans(text)), set(net.added(text, runs))
        base, found, other = base + len(want), found + len(want & got), other + len(got - want)
    assert base > 20 and found / base > 0.8 and other <= 0.2 * base
    rng = random.Random(77)
    phrases = [pii.invented(rng) for _ in range(400)]
    lines = [f"the words before {text} and after it" for text, _ in phrases]
    want = [{(k, a + 17, b + 17) for k, a, b in spans} for _, spans in phrases]
    got = [set(net.added(line, runs)) for line, runs in zip(lines, net.spans(lines))]
    hits = sum(len(w & g) for w, g in zip(want, got))
    assert hits / sum(map(len, want)) > 0.9 and hits / sum(map(len, got)) > 0.95
    beyond = sum(len(g - set(pii.base_spans(line))) for line, g in zip(lines, got))
    assert beyond > 20  # forms that no base pattern matches


# --- secrets ---------------------------------------------------------------------------------------------------------


def test_field_decodes_as_plain_viterbi():
    rng = np.random.default_rng(3)
    field = secrets.Field()
    field.moves += rng.normal(0, 2, field.moves.shape).astype(np.float32)
    field.moves[secrets.OUTSIDE, secrets.INSIDE] = -1e4
    for sizes in ([1], [5, 1, 3], [127, 1, 128], [400, 2, 129, 256]):
        n = sum(sizes)
        score = rng.normal(0, 2, (n, secrets.LABELS)).astype(np.float32)
        fresh = np.zeros(n, bool)
        fresh[np.cumsum([0, *sizes[:-1]])] = True
        got = field.decode(score, fresh).tolist()
        for a, b in itertools.pairwise(np.append(np.flatnonzero(fresh), n).tolist()):
            best, back = field.enter + score[a], []
            for s in score[a + 1 : b]:
                step = best[:, None] + field.moves
                back.append(step.argmax(0))
                best = step.max(0) + s
            label = [int(best.argmax())]
            for w in reversed(back):
                label.append(int(w[label[-1]]))
            assert got[a:b] == label[::-1]


def test_field_finds_held_out_secrets(texts):
    field = secrets.train(texts[0])
    found = base = other = 0
    for text, runs in zip(texts[1], field.spans(texts[1])):
        want, got = secrets.base_spans(text), secrets.likely_secrets(text, runs)
        touches = lambda a, b: a[0] < b[1] and b[0] < a[1]
        base += len(want)
        found += sum(any(touches((s, e), g) for g in got) for s, _, e in want)
        other += sum(not any(touches((s, e), g) for s, _, e in want) for g in got)
    assert base > 10 and found / base > 0.9 and other <= 0.05 * base
    rng = random.Random(55)
    phrases = [secrets.invented(rng) for _ in range(1000)]
    lines = [f"the words before {text} and after it" for text, _ in phrases]
    want = [{(a + 17, b + 17) for a, b in spans} for _, spans in phrases]
    got = [set(secrets.likely_secrets(line, runs)) for line, runs in zip(lines, field.spans(lines))]
    hits = sum(len(w & g) for w, g in zip(want, got))
    assert hits / sum(map(len, want)) > 0.95 and hits / sum(map(len, got)) > 0.95
    letters = [(w, g) for w, g, line in zip(want, got, lines) if any(line[a:b].isalpha() for a, b in w)]
    assert len(letters) > 20 and sum(w == g for w, g in letters) / len(letters) > 0.8


# --- near duplicates -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("order", ["ascending", "shuffled"])
def test_components_of_a_long_chain(spark, order):
    ids = list(range(1001))
    if order == "shuffled":
        random.Random(6).shuffle(ids)
    links = [tuple(sorted(p)) for p in itertools.pairwise(ids)] + [(5000, 5001), (5001, 5002), (6000, 6009), (6001, 6009), (6002, 6009)]
    labels, rounds = neardup.contracted(spark.createDataFrame(links, "a long, b long").repartition(4))
    got = dict(map(tuple, labels.collect()))
    assert got == {**{i: 0 for i in ids}, 5000: 5000, 5001: 5000, 5002: 5000, **{i: 6000 for i in (6000, 6001, 6002, 6009)}}
    assert rounds <= 20


def test_blocks_of_a_bucket_meet_once(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join(words[: 200 + i])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketched = neardup.sketch_documents(docs, "text", "doc_id", 85).withColumnRenamed("doc_id", "node")
    facts = neardup.cut_lineage(sketched.select("node", "n_shingles", *neardup.FACTS))
    members = spark.createDataFrame([(1, i, i % 3, 60) for i in range(60)], "bucket long, node long, component long, n long")
    one = sorted(map(tuple, neardup.cross_pairs(members, facts, 85).collect()))
    monkeypatch.setattr(neardup, "BLOCK", 7)
    many = sorted(map(tuple, neardup.cross_pairs(members, facts, 85).collect()))
    assert many == one and len(set(one)) == len(one) > 300 and all(a < b and a % 3 != b % 3 for a, b in one)


# --- quality ---------------------------------------------------------------------------------------------------------


def numpy_estimate(x, subset=quality.SUBSET, steps=quality.STEPS):
    """Minimum covariance determinant with the fixed floor, from the two starts."""
    floor = np.diag(np.square(quality.FLOOR))
    far = lambda x, m, c: np.round(np.log(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + floor), x - m) + 1e-6), 3)
    middle = np.percentile(np.round(x, 3), 50, axis=0)
    mad = np.percentile(np.round(np.abs(x - middle), 3), 50, axis=0)
    found = []
    for m, c in ((middle, np.diag((1.4826 * mad) ** 2)), (x.mean(0), np.diag(x.var(0)))):
        for _ in range(steps):
            d = far(x, m, c)
            near = x[d <= np.percentile(d, 100 * subset) + 1e-12]
            m, c = near.mean(0), np.cov(near.T, bias=True)
        found.append((np.linalg.slogdet(c + floor)[1], m, c))
    _, m, c = min(found, key=lambda f: f[0])
    d = far(x, m, c)
    scale = np.exp(np.percentile(d, 50)) / quality.CHI_MEDIAN
    near = x[np.exp(d) <= quality.CHI_975 * max(scale, 1e-6)]
    m, c = near.mean(0), np.cov(near.T, bias=True)
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + floor), x - m)


@pytest.mark.parametrize("groups", [quality.BROADCAST_GROUPS, 0])
def test_quality_against_numpy(spark, monkeypatch, groups):
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", groups)  # 0: salted joins
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    third = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    lang = F.when(third < 6, F.lit("en")).when(third < 8, F.lit("")).otherwise(F.lit(None).cast("string"))
    docs = docs.withColumns({"lang": lang, "source": F.when(third < 8, F.lit("s"))})
    judged = {r.doc_id: r for r in quality.judge(docs).collect()}
    stats = quality.statistics(F.col("text"))
    rows = docs.select("doc_id", "lang", F.inline(F.array(stats))).select("*", quality.base_failed().alias("failed"), *quality.features()).collect()
    for name in ("en", "", None):
        group = [r for r in rows if r.lang == name and not r.failed]
        want = numpy_estimate(np.array([[r[f] for f in quality.FEATURES] for r in group]))
        got = np.array([judged[r.doc_id].distance for r in group])
        assert len(group) > quality.LEAST and np.allclose(got, want, rtol=1e-6, atol=1e-9)
        assert [judged[r.doc_id].kept for r in group] == [bool(d <= quality.CUTOFF) for d in want]


def test_repeated_words_of_colliding_and_long_texts(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (0, 2, 3, 4, 20, 200)] + [" ".join(f"w{i % 37}" for i in range(100)), " ".join(map(str, range(500)))]

    def count(text):
        w = text.split()
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        return len({j for starts in at.values() if len(starts) > 1 for i in starts for j in range(i, i + 3)})

    frame = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    run = lambda: {r.i: r.n for r in frame.select("i", quality.statistics(F.col("text"))["n_repeat_words"].alias("n")).collect()}
    want = {i: count(t) for i, t in enumerate(texts)}
    assert run() == want
    monkeypatch.setattr(quality, "PACKED", 3)
    assert run() == want
    monkeypatch.setattr(quality, "PACKED", 1 << 24)
    monkeypatch.setattr(quality, "POSITION_BITS", 60)  # only four bits of a hash sort the windows
    assert run() == want


def test_language_fit_drops_no_language(spark):
    from textmill.llm import langid

    rows = [(i, "some words of text here", "abc"[min(i % 4, 2)]) for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), block=2)
    assert model.languages == ["a", "b", "c"] and model.log_prob.shape == (langid.BUCKETS, 3)
