"""Dictionary automaton and fuzzy index against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.operators import fuzzy, terms


def occurrences(text, term):
    return sum(text.startswith(term, i) for i in range(len(text) - len(term) + 1))


@pytest.mark.parametrize("seed", range(4))
def test_automaton(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(terms, "LANE", 7)
    alphabet = "ab" if seed < 2 else "abcé漢"
    known = sorted({"".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(40)})
    texts = ["".join(rng.choices(alphabet, k=rng.choice([0, 1, 5, 40, 200]))) for _ in range(60)]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    at, end, term = terms.Automaton([k.encode() for k in known]).places(offsets, np.frombuffer(b"".join(raw), np.uint8))
    got = Counter(zip(at.tolist(), term.tolist()))
    assert got == Counter({(i, j): n for i, t in enumerate(texts) for j, k in enumerate(known) if (n := occurrences(t, k))})
    assert all(b"".join(raw)[: e].endswith(known[j].encode()) for e, j in zip(end.tolist(), term.tolist()))


def test_scan_in_several_passes(spark):
    texts = [(1, "She sells Sea shells"), (2, None), (3, ""), (4, "ushers HE"), (4, "x" * 5000 + "hers"), (None, "he"), (5, "nothing")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("term", F.lit(1)).repartition(3)
    known = ["he", "she", "hers", "his", "", None, "he", "sea s", "x" * 300]
    want = Counter((k, t, n) for k, x in texts for t in {t for t in known if t} if (n := occurrences((x or "").lower(), t)))
    for most in (1, 8, 1 << 20):
        assert Counter(tuple(r) for r in terms.scan(df, known, "text", "doc_id", term_bytes=most).collect()) == want
    assert terms.scan(df, [], "text", "doc_id").count() == 0 and terms.scan(df.limit(0), known, "text", "doc_id").count() == 0


def test_many_terms(spark):
    """A hundred thousand terms in one pass."""
    rng = random.Random(3)
    known = sorted({"".join(rng.choices("abcdefghij", k=rng.randint(5, 9))) for _ in range(104_000)})
    assert len(known) > 100_000
    text = "".join(rng.choices("abcdefghij", k=20_000))
    rows = terms.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), known, "text", "doc_id").collect()
    have = {text[i : i + n] for n in range(5, 10) for i in range(len(text))}
    assert {r.term for r in rows} == have & set(known)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a, b):
    return 1.0 if not a and not b else 1 - distance(a, b) / max(len(a), len(b))


def damaged(rng, name):
    out = list(name)
    for _ in range(rng.randint(0, 1 + len(name) // 4)):
        at = rng.randint(0, len(out))
        kind = rng.randint(0, 2)
        if kind == 0:
            out.insert(at, rng.choice("abc"))
        elif out and at < len(out):
            out[at : at + 1] = [] if kind == 1 else [rng.choice("abc")]
    return "".join(out)


@pytest.mark.parametrize("least", [0.8, 0.5, 1.0])
@pytest.mark.parametrize("block", [1, 2000])
def test_best_name(spark, least, block):
    rng = random.Random(least * 10)
    known = ["", "a", "ab", "aaaa", "aaab"] + ["".join(rng.choices("abc", k=rng.randint(1, 22))) for _ in range(80)]
    values = [damaged(rng, rng.choice(known)) for _ in range(150)] + [None, "", "zzz", known[7], known[7]]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "id long, name string, length string").repartition(3)
    got = {r.id: r.matched for r in fuzzy.best_name(df, "name", spark.createDataFrame([(k,) for k in [*known, known[3], None]], "known string"), "known", least, block=block).collect()}
    for i, v in enumerate(values):
        scored = sorted((-similarity(v, k), k) for k in known) if v is not None else [(0, None)]
        assert got[i] == (scored[0][1] if -scored[0][0] >= least else v), v


def test_candidates_are_few(spark):
    """Against 20,000 names only a small share of the pairs is measured."""
    rng = random.Random(9)
    known = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=rng.randint(12, 20))) for _ in range(20_000)})
    df = spark.createDataFrame([(k[:3] + "#" + k[4:],) for k in known[:500]], "name string")
    names = spark.createDataFrame([(k,) for k in known], "known string")
    assert fuzzy.candidate_count(df, "name", names, "known") < 0.02 * len(known) * 500
    assert [r.matched for r in fuzzy.best_name(df, "name", names, "known").orderBy("matched").collect()] == known[:500]
