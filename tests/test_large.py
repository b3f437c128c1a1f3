"""Steps that grew faster than their input: same results as plain Python, and no more work than needed."""

import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.compare import differences
from textmill.functions import articles, grams
from textmill.operators import dedup, extract, terms
from textmill.plans.annotation_queries import token_masks
from textmill.plans.article_queries import news_pages
from textmill.plans.curriculum_queries import difficulty_v2
from textmill.plans.text_queries import TOKENS, grams as grams_sql, ttr_by_group

ODD_TEXTS = ["", "a", "-a/b-9 9a", "x" * 37 + " y", "é1a éa-", "---", "12", "the cat/the-cat 3", "Ab", "a\nb", "9", "z" * 8 + " " + "z" * 9 + " " + "z" * 16]


def test_terms_are_those_of_the_pattern():
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ODD_TEXTS))), pa.array([t.encode() for t in ODD_TEXTS])], names=["k", "t"])
    for limit in (1, 40, 1 << 20):
        got, hashes = [], {}
        for block, offsets, data in grams.text_blocks(iter([batch.slice(0, 5), batch.slice(5)]), 1, limit):
            row, start, end = grams.runs(offsets, data, extract.LETTERS, extract.INNER)
            for r, a, b, h in zip(row, start, end, grams.word_hashes(data, start, end)):
                word = data[a:b].tobytes().decode()
                got.append((block.column(0)[int(r)].as_py(), word))
                assert hashes.setdefault(word, h) == h
        assert got == [(i, w) for i, t in enumerate(ODD_TEXTS) for w in re.findall("[a-z][a-z0-9/-]*", t)]
        assert len(set(hashes.values())) == len(hashes)


def test_hashes_of_words_differ():
    words = [str(i).encode() for i in range(100_000)] + [b"x" * i for i in range(1, 300)]
    ends = np.cumsum([len(w) for w in words])
    data = np.append(np.frombuffer(b"".join(words), np.uint8), np.zeros(8, np.uint8))
    assert len(np.unique(grams.word_hashes(data, ends - [len(w) for w in words], ends))) == len(words)


def test_term_weights_keep_no_words(spark):
    """No word stays with a worker behind its block."""
    df = spark.createDataFrame([(i, f"w{i}q both v{i}q both") for i in range(50)], "doc_id long, text string")
    extract.tfidf(df, longest=2, most_df=1.0).collect()

    def kept(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(f"w{i}q" in grams._known for i in range(50))] * len(batch))], names=["n"])

    assert sum(r.n for r in df.select("doc_id").mapInArrow(kept, "n long").collect()) == 0


def test_top_terms_shuffle_only_what_may_be_kept(spark):
    rows = [(1, "a", 0.1000001), (1, "b", 0.0999996), (1, "c", 0.1000004), (1, "d", 0.5), (1, "e", 0.0999994), (2, "a", 0.1), (2, "b", 0.02), (3, "z", 0.9)]
    df = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    made = extract.top_terms(df)
    got = sorted((r.doc_id, r.term, r["rank"]) for r in made.collect())
    assert got == [(1, "a", 2), (1, "c", 4), (1, "d", 1), (3, "z", 1)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Filter.*round\(weight", plan[plan.index("Window [") :].partition("\n")[2])


ARTICLE_PIECES = (
    "a", "Ab", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", "\u00a0", "\r\n", "\u2028", "\u200b", "\ufeff", "21°42′N", "72°32′E", "1.5°N", "2.25°E", "/", "3.5; -4.5", "/ 1.5; 2.5", "(French: x)", "(Арa)", "(verify)", "(Citation  Needed)",
    "/ˈəb/", '"', "'", "‘", "„", "«", "»", "\\n", "\\N", "{{c}}", "[[a|b]]", "[[a]]", "[http://x y]", "[HTTP://x]", "<ref a>", "</ref>", "<REF/>", "<b>", "&nbsp;", "&AMP;", "&lt;", "&#12;", "&quot;", "[3]", "â€™", "â€œ", "â€", 'Â€"', "Â", "â", "â€¦", "12", ".",
)


def test_article_patterns_are_left_out_only_where_they_change_nothing(spark):
    draws = np.random.default_rng(7).integers(0, len(ARTICLE_PIECES), (3000, 9))
    texts = [*ARTICLE_PIECES, *("".join(ARTICLE_PIECES[i] for i in d[: 1 + j % 9]) for j, d in enumerate(draws))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    plain = articles.replaced(F.col("t"), articles.ARTICLE)
    assert df.where(~articles.substituted(F.col("t")).eqNullSafe(plain)).select("t").collect() == []
    assert sum((patterns for patterns, _ in articles.grouped()), ()) == articles.ARTICLE
    for patterns, needed in articles.grouped():
        assert df.where((articles.replaced(F.col("t"), patterns) != F.col("t")) & ~needed(F.col("t"))).select("t").collect() == [], patterns


def test_masks_are_drawn_once_for_a_token(spark, tmp_path):
    texts = [None, "", " \t\n", "one", "a b c d e f g", "  x\x0by"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = token_masks(spark, str(tmp_path))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("conv(") == 1
    want = {}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for j, t in enumerate(list(words)):
            u = (int(hashlib.md5(f"{i}/{j}:42".encode()).hexdigest()[:8], 16) + 1) / (1 << 32) / 0.15
            words[j] = "[MASK]" if u <= 0.8 else re.findall(r"[^\x20\x09-\x0D]+", text)[(j * 7 + 3) % len(words)] if u <= 0.9 else t
        if words:
            want[i] = (hashlib.md5(" ".join(words).encode()).hexdigest(), words.count("[MASK]"))
    assert {r.doc_id: (r.masked, r.masks) for r in made.collect()} == want


def test_contamination_keeps_no_words(spark):
    words = lambda t: re.findall(r"[^ \t\n\x0b\f\r]+", (t or "").lower())
    item = "Aq ΟΔΟΣ\u00a0x c\x1cd E\tf g, h\x0bi"
    texts = [None, "", item, "zz " + item + " yy", item.replace(" ", "\r\n"), item.replace("\u00a0", " "), " ".join(f"once{i}q" for i in range(40)), item + " " + item]
    bench = [(1, item), (2, "a b c"), (3, None), (4, item + " one more")]
    grams_of = lambda t, n=6: {tuple(words(t)[i : i + n]) for i in range(len(words(t)) - n + 1)}
    want = {}
    for i, t in enumerate(texts):
        shared = [grams_of(t) & grams_of(b) for _, b in bench]
        if any(shared):
            want[i] = (sum(map(bool, shared)), len(set().union(*shared)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = dedup.contaminated(df, spark.createDataFrame(bench, "item_id long, text string"), size=6)
    assert {r.doc_id: (r["items"], r.shared) for r in made.collect()} == want and len(want) == 5

    def kept(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(f"once{i}q" in grams._known for i in range(40))] * len(batch))], names=["n"])

    assert sum(r.n for r in df.select("doc_id").mapInArrow(kept, "n long").collect()) == 0


def test_difficulty_counts_texts_once(spark):
    made = difficulty_v2(spark, "/root/testdata/sf0.001")
    assert "regexp_count" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_news_pages_are_dealt_out(spark):
    assert news_pages(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism


def test_terms_of_a_row_are_one_list(spark, monkeypatch):
    known = ["a", "ab", "bab", "é", "x" * 70, "b", "", None, "ab", "aab"]
    texts = [None, "", "ABAB", "é" * 3 + "x" * 100, "aab" * 3000, "zz", "c\u00e8aab"]
    want = {i: sorted(k for k in {k for k in known if k} if k in (t or "").lower()) for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.terms for r in terms.listed(df, known, "text", "doc_id").collect()} == {i: x for i, x in want.items() if x}
    cut = terms.listed(df, known, "text", "doc_id", term_bytes=4).groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list("terms"))).alias("terms"))
    assert {r.doc_id: r.terms for r in cut.collect()} == {i: x for i, x in want.items() if x}
    # with and without the table of states
    raw = [(t or "").encode() for t in texts]
    offsets, data = np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)
    own = [k.encode() for k in dict.fromkeys(filter(None, known))]
    quick = terms.Automaton(own)
    monkeypatch.setattr(terms, "TABLE", 0)
    slow = terms.Automaton(own)
    assert quick.table is not None and slow.table is None
    assert sorted(zip(*map(np.ndarray.tolist, quick.places(offsets, data)))) == sorted(zip(*map(np.ndarray.tolist, slow.places(offsets, data))))


SIGNS = ["", "a", "-", "_", "__", "a_b", "a\x0bb", "!!", "é!È a\u0301", "İİ x", "ΟΔΟΣ οδοσ.", "日本 語", "𝒳y 😀😀z", "a\u00a0b", "€", "x€", "!\u2028 ", "", "a\n\nb\t\f\rc", "$ ~^ `a`", "Ⅷ Ⓐ ²", "e" * 40]


def test_tokens_of_bytes_are_those_of_sql():
    texts = SIGNS + ["".join(map(chr, range(i, i + 500))) for i in range(1, 0x3001, 500)]
    con = duckdb.connect()
    con.register("t", pa.table({"i": range(len(texts)), "text": texts}))
    want = [(i, x) for i, tokens in con.execute(f"SELECT i, {TOKENS} FROM t ORDER BY i").fetchall() for x in tokens]
    # one letter newer than some tables
    texts = [t.replace("\u1c89", "") for t in texts]
    want = [(i, x.replace("\u1c89", "")) for i, x in want]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])
    for limit in (1, 40, 1 << 20):
        got = []
        for block, offsets, data in grams.text_blocks(grams.lowered(iter([batch.slice(0, 5), batch.slice(5)]), 1), 1, limit):
            for r, a, b in zip(*grams.token_runs(offsets, data)):
                got.append((block.column(0)[int(r)].as_py(), data[a:b].tobytes().decode()))
        assert got == want


def test_sets_of_grams_in_any_cut(monkeypatch):
    """Sets of few tokens, and parts that go on in the next batch, count as one set does."""
    rng = np.random.default_rng(3)
    rows = [([None, "a", "b"][int(rng.integers(3))], rng.integers(0, 9, int(rng.integers(0, 12))).astype(np.uint64) * grams.ODD) for _ in range(300)]
    want = {}
    for name, tokens in rows:
        for n in (1, 2, 3):
            want.setdefault((name, n), []).extend(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))
    want = {k: (len(set(v)), len(v)) for k, v in want.items()}
    for limit, cut in ((1, 1), (100, 7), (1 << 20, 1 << 20)):
        monkeypatch.setattr(grams, "SET_TOKENS", limit)
        monkeypatch.setattr(grams, "HELD_GRAMS", limit)
        blocks = [(pa.array([x[0] for x in some], pa.string()), np.array([len(x[1]) for x in some]), np.concatenate([x[1] for x in some]), None) for some in (rows[i : i + 20] for i in range(0, 300, 20))]
        table = pa.Table.from_batches(grams.sets(iter(blocks), 3)).sort_by([("group", "ascending"), ("n", "ascending"), ("part", "ascending")]).combine_chunks()
        got = {}
        for made in grams.set_sizes(iter([*table.slice(0, 0).to_batches(), *table.to_batches(max_chunksize=cut)])):
            for r in made.to_pylist():
                kinds, total = got.get((r["group"], r["n"]), (0, 0))
                got[r["group"], r["n"]] = kinds + r["kinds"], total + r["total"]
        assert got == want


def test_ratios_of_groups_on_odd_texts(spark, tmp_path):
    """Groups and texts that are null, texts of no token or one, groups of one or two tokens: as SQL has it, across texts too."""
    texts = [*SIGNS, None, "to be or not to be", "be", "to", "or not", *"abcab", None, "one", "two words", "end"]
    rows = [(i * 1500, t, None, [None, "x", "y"][i * 7 % 3]) for i, t in enumerate(texts)]
    rows += [(100_001, "single", None, "p"), (100_002, "two two", None, "q"), (100_003, "", None, "r"), (None, "the last", None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert not differences(spark, str(tmp_path), ttr_by_group, grams_sql("source") + ", round((d1 + d2 + d3) / 3, 6) AS mean_ttr FROM r", con)


def test_ratios_of_groups_find_tokens_in_bytes(spark):
    """No tokens are made in the plan, and n-grams are shuffled by parts of sets, not one by one."""
    plan = ttr_by_group(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and plan.count("grams#") > 0
