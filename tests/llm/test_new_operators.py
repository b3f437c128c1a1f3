"""Prefix trie, fill-in-middle and token counts against brute force, on given tables and on small ones with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tests.compare import differences
from textmill.llm import fim, queries, tokencount, trie

SF = "/root/testdata/sf0.01"
TEXTS = [
    None, "", " ", "a", "ab cd", "Ünï 漢字 é \U0001f600 don't I'LL we'Ve x's'sand", "<P> marked", "x<S>", "<M", "z" * 70_000, "word " * 3000, "  \n\t\x0b\x1c\x85\xa0 ", "½ ² ٣ Ⅷ 1234",
    "a <|endoftext|> b<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "İstanbul ΣΑΣ ǅ ﬁ ́ͅ", "’s 's 'S 're're", "__a_b__ !!'s !?", "\U0001f600" * 300, "\x00\x01ab\x7f",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, "a", "x", "y"), (None, "no key at all", "x", "y"), (-7, "minus seven", "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, form string").repartition(3)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_fill_in_middle"])
def test_same_as_sql(spark, name):
    assert differences(spark, SF, queries.QUERIES[name], queries.SQL[name]) == []


def brute_trie(rows, heads=6, every=100):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = int(c / every) * every
        paths[c] = own.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    digest = lambda k, m: hashlib.sha256(",".join(str(c) for c in m if len(paths[c]) == len(k)).encode()).hexdigest()
    return Counter((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], digest(k, m)) for k, m in members.items())


def drawn(seed, convs, longest, words):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-350, 900), convs) + [0, 100]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, longest])):
            rows.append((c, rng.choice([turn, turn, turn, None, 2]), rng.choice(["user", None]), rng.choice(words)))
    first = [(1000 + i, t, "user", f"same {t}") for i in range(90) for t in range(8)]  # copies
    stem = [(2000 + i, t, "user", f"same {t}" if t < 5 else f"own {i}") for i in range(60) for t in range(7)]  # one stem, many ways
    # rows that share conversation and turn are in an order of their own: they are made equal here
    kept = {(c, t): r for c, t, *r in rows}
    return [(c, t, *kept[c, t]) for c, t, *_ in rows] + first + stem + [(3001, t, "a", f"{t % 3}") for t in range(300)] + [(3002, t, "a", f"{t % 3}") for t in range(299)] + [(None, 1, "a", "x")]


@pytest.mark.parametrize("seed, shard, upper", [(1, 1 << 16, 1 << 20), (2, 5, 1 << 20), (3, 40, 7), (4, 0, 3)])
def test_trie(spark, seed, shard, upper):
    rows = drawn(seed, 120, 9, ["", None, "yes", "no", "é\U0001f600", "long " * 50])
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, k1 string").repartition(5)
    got = trie.nodes(trie.rebuilt(df), shard, upper)
    order = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got, want = Counter(tuple(r) for r in got.select(*order).collect()), brute_trie(rows)
    assert sum(got.values()) == sum(want.values())
    assert (got - want, want - got) == (Counter(), Counter())


def test_trie_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.nodes(trie.rebuilt(df)).count() == 0


def test_trie_blocks_hold_whole_shards(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 2)
    rows = drawn(7, 100, 6, ["yes", "no", "x"])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = trie.rebuilt(df)
    want = Counter(tuple(r) for r in trie.nodes(made, 30).collect())
    monkeypatch.setattr(trie, "BLOCK", 10)
    assert Counter(tuple(r) for r in trie.nodes(made, 30).collect()) == want


def test_louds_against_a_plain_tree():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 3000):
        parent = np.array([-1] + [int(rng.integers(max(0, i - 40), i)) for i in range(1, n)])
        level = np.zeros(n, np.int64)
        for i in range(1, n):
            level[i] = level[parent[i]] + 1
        key = rng.integers(-(2**62), 2**62, (n, 2))
        t = trie.Louds(level, key, np.where(parent[:, None] >= 0, key[parent], 0))
        up = t.parents()
        assert [(-1 if u < 0 else t.order[u]) for u in up] == parent[t.order].tolist()
        total = np.ones(n, np.int64)
        t.rollup(total)
        size = np.ones(n, np.int64)
        for i in range(n - 1, 0, -1):
            size[parent[i]] += size[i]
        assert total.tolist() == size[t.order].tolist() and (t.labels == key[t.order]).all()


def test_rank_select():
    rng = np.random.default_rng(1)
    for n, share in ((0, 0.5), (1, 1.0), (511, 0.0), (512, 1.0), (5000, 0.03), (100_000, 0.7)):
        bits = rng.random(n) < share
        v = fim.RankSelect(bits)
        before = np.concatenate([[0], np.cumsum(bits)])
        assert (v.rank(np.arange(n + 1)) == before).all()
        assert v.select(np.arange(bits.sum() + 2)).tolist() == [*np.flatnonzero(bits).tolist(), n, n]


def brute_fim(key, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text, text
    spm = h[3] % 100 < 20
    return key, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text


def test_fill_in_middle(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    every = docs.sparkSession.createDataFrame(rows + [(1000 + i, f"Ünit {i} of x{i}\n—{'ab ' * i}") for i in range(300)], "doc_id long, text string")
    made = fim.transform(every)
    got = made.withColumn("back", fim.restored(made.output, made.form)).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_fim(r.doc_id, r.text) for r in every.collect())
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0


def test_token_counts(spark, docs, tmp_path):
    real = pq.read_table(f"{SF}/documents.parquet").to_pylist()[:300]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(r["doc_id"], r["text"]) for r in real]
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string()), "n_bytes": ["x"] * len(rows)}), tmp_path / "documents.parquet")
    library = Tokenizer.from_file(queries.WORD_TOKENIZER)
    want = Counter()
    for k, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[k, len((t or "").encode()), n, n > 2048] += 1
    got = queries.op13_token_counts(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert Counter(tuple(r) for r in got.collect()) == want
    # a table of other words, or of none, changes nothing
    table = tokencount.frequent(docs, queries.WORD_TOKENIZER, most=5)
    for small in (table, (b"", np.zeros(0, np.int64), np.zeros(0, np.int32))):
        counts = tokencount.count_tokens(docs, queries.WORD_TOKENIZER, small, keep=("doc_id", "n_tokens"))
        assert counts.columns == ["doc_id", "n_tokens", "over_limit"]
        assert Counter((r.doc_id, r.n_tokens) for r in counts.collect()) == Counter((k, len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in rows[: len(TEXTS) + 3])
    assert tokencount.count_tokens(docs.limit(0), queries.WORD_TOKENIZER, table).count() == 0


def test_pretokens_of_every_code_point():
    """Both ways of splitting give what the library gives, for each code point beside letters and blanks."""
    library, ours = Tokenizer.from_file(queries.WORD_TOKENIZER), tokencount.counter(queries.WORD_TOKENIZER)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = [" ".join(f"a{c}b'{c}s 1{c}{c}" for c in points[i : i + 64]) for i in range(0, len(points), 64)] + [f"Ab{c}C {c}'s_{c}" for c in points[:0x250]]
    for text, made in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        words, added = ours.split(text)
        assert sum(ours.lengths(words)) + added == len(made.ids), text
    assert public_tokenizers.path("word_bpe_49k.json") == queries.WORD_TOKENIZER
