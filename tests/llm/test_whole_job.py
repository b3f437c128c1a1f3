"""What the operators must do beyond their common cases."""

import random

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from textmill.llm import mpeg, neardup, packing, quality, queries

SF = "/root/testdata/sf0.01"


def test_quality_of_small_groups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(4)
    own = [F.col(c) for c in ("doc_id", "text", "lang", "source")]
    # one more language and source, with rows of a large one: too few for an estimate of the source or the language
    rare = docs.where("lang = 'en'").orderBy("doc_id").limit(40).select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("rare").alias("source"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels = labels.union(labels.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    judged = quality.judge(docs.select(*own).union(rare)).where("not base_failed")
    assert docs.groupBy("lang", "source").count().agg(F.max("count")).first()[0] < quality.LEAST
    assert judged.where("distance is null").isEmpty()
    got = {(r.rare, r.quality): (r.n, r.kept) for r in judged.join(labels, "doc_id").groupBy((F.col("doc_id") >= 1_000_000).alias("rare"), "quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()}
    assert got[False, 0][0] > 20 and got[False, 0][1] == 0
    assert all(n == kept > 0 for (_, good), (n, kept) in got.items() if good == 1)


def test_quality_of_a_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("lang = 'en'")
    judged = quality.judge(docs).where("not base_failed").select("doc_id")
    few = docs.join(judged, "doc_id", "left_semi")
    few = spark.createDataFrame(few.where("quality = 1").orderBy("doc_id").limit(20).collect() + few.where("quality = 0").orderBy("doc_id").limit(3).collect(), docs.schema)
    got = quality.judge(few).join(few, "doc_id").groupBy("quality", "kept").count().collect()
    assert {tuple(r) for r in got} == {(1, True, 20), (0, False, 3)}


def test_language_stage_rejects_and_corrects(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 300")
    real = {r.doc_id: r for r in docs.collect()}
    rng = random.Random(1)
    noise = lambda: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(80))
    other = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 3
    first = next(r for r in real.values() if r.lang == "en")
    plant = lambda i, text, lang: first.asDict() | {"doc_id": 900_000 + i, "text": text, "lang": lang, "n_chars": len(text)}
    planted = [plant(i, noise(), "en") for i in range(20)] + [plant(20, other, "en"), plant(21, first.text, "de"), plant(22, first.text, None)]
    out = corpus_pipeline.language_id(spark, docs.union(spark.createDataFrame(planted, docs.schema)), SF)
    got = {r.doc_id: r.lang for r in out.select("doc_id", "lang").collect()}
    assert {k: v for k, v in got.items() if k >= 900_000} == {900_021: "en", 900_022: "en"}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()} & set(real)
    assert len(good) > 200 and all(got.get(k) == real[k].lang for k in good)


def test_mpeg_payload_like_a_tag(spark):
    texts = {i: "x" * (192 * i + 65) + "TAG" + "y" * 30 for i in range(3)}
    media = mpeg.write_mpeg(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    rows = {r.doc_id: r for r in mpeg.read_mpeg(media).collect()}
    for i, text in texts.items():
        assert bytes(rows[i].payload) == text.encode().ljust(192 * (i + 1)) and rows[i].n_frames == i + 1 and rows[i].skipped_bytes == 0 and "ID3v1" not in rows[i].tags
    tag = b"TAG" + b"title".ljust(125, b"\0")
    plain = bytes(media.where("doc_id = 2").first()["media"]).replace(b"TAG", b"tag")
    early = bytes(mpeg.write_mpeg(spark.createDataFrame([(1, "x" * (192 * 2 + 121) + "TAG")], "doc_id long, text string")).first()["media"])
    # a real tag after whole frames, after a frame that is cut off, after bytes that are no frame; a cut last frame behind a payload like a tag; only a tag
    data = [(1, plain + tag), (2, plain[:-80] + tag), (3, plain + b"junk" * 9 + tag), (4, early + early[-216:-160]), (5, tag)]
    got = {r.doc_id: r for r in mpeg.read_mpeg(spark.createDataFrame(data, "doc_id long, media binary")).collect()}
    assert [got[i].tags.get("ID3v1") for i in (1, 2, 3, 4, 5)] == ["title", "title", "title", None, "title"]
    assert [got[i].n_frames for i in (1, 2, 3, 4, 5)] == [3, 2, 3, 3, 0] and got[3].skipped_bytes == 36


def test_near_dedup_stage_from_80_percent(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    rows = []
    for i in range(300):  # a text and its beginning: similarities of 0.75 to 0.90
        n = rng.randint(60, 400)
        words = [word() for _ in range(n)]
        cut = round(n * rng.uniform(0.75, 0.90))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:cut]))]
    sets = {k: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)} for k, t in rows}
    close = {i for i in range(300) if 100 * len(sets[2 * i] & sets[2 * i + 1]) >= 80 * len(sets[2 * i] | sets[2 * i + 1])}
    between = {i for i in close if 100 * len(sets[2 * i] & sets[2 * i + 1]) < 85 * len(sets[2 * i] | sets[2 * i + 1])}
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert len(between) > 60 and {r.doc_id for r in out.collect()} == {k for k, _ in rows} - {2 * i + 1 for i in close}


def test_bands_and_agreement_follow_from_the_similarity():
    for percent in (50, 70, 80, 85, 90, 100):
        rows, bands = neardup.banding(percent)
        s = min(percent / 100, 0.99)
        assert (1 - s**rows) ** bands <= neardup.MISS and rows * bands <= neardup.MOST_COORDS
    assert neardup.banding(80) == (6, 50) and neardup.sign_agree(80) == 174


def test_packing_ids_of_an_added_token(spark):
    end = "<|endoftext|>"
    texts = [end, f"a text{end}another one", f"  {end} {end}{end}\n\nx", "<|endoftext| >", f"don't{end}'s 12{end[:5]}", "plain words only"]
    theirs = Tokenizer.from_file(queries.TOKENIZER)
    want = {i: theirs.encode(t, add_special_tokens=False).ids + [packing.END_ID] for i, t in enumerate(texts)}
    got = {}
    for r in sorted(packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.TOKENIZER, with_ids=True).collect(), key=lambda r: r.start):
        got[r.doc_id] = got.get(r.doc_id, []) + r.ids
    assert got == want and 50256 in got[0]
