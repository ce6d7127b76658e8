"""The pipeline's stages, each alone and all together, on small tables with planted cases."""

import random

import pytest

import corpus_pipeline
from newsdigest.llm import nbsvm, packing, secrets, spaced_seeds

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _gone int, _STAY string"
KEY = "k9fQ2xLw7Zr4TnB8vYc1HdPs6GmJ3u"


def prose(rng, n):
    return " ".join(f"word{rng.randrange(300)}" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, base = random.Random(21), tmp_path_factory.mktemp("pipeline")
    good = [prose(rng, rng.randrange(40, 120)) for _ in range(120)]
    junk = ["$$$ *** ###" * 3 + " " + " ".join(rng.choice(["$$$", "%%%", "buy", "###"]) for _ in range(60)) for _ in range(60)]
    item = prose(rng, 25)
    rows = {i: t for i, t in enumerate(good)} | {200 + i: t for i, t in enumerate(junk)}
    words = good[0].split()
    rows[400] = good[0]                                                   # a copy
    rows[401] = " ".join(words[:-1] + ["other"])                          # a near copy
    rows[402] = good[1] + " " + item + " " + good[2][:80]                 # holds a benchmark item
    rows[403] = prose(rng, 40) + f" key {KEY} " + prose(rng, 20)          # holds a secret
    docs = [(i, t, "en", f"s{i % 4}", len(t), "mine", 7, "also mine") for i, t in rows.items()]
    docs += [docs[5], (None, good[3], "en", None, None, None, None, None), (None, None, "en", "s", 0, "", 0, ""), (500, "", "en", "s", 0, "", 0, "")]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(200 + i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), docs, item


def staged(spark, tables, name, docs=None):
    base, rows, _ = tables
    frame = spark.createDataFrame(rows if docs is None else docs, SCHEMA)
    return dict(corpus_pipeline.STAGES)[name](spark, frame, base), frame


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "best_fit_packing"]


def test_classifier_stage_keeps_good_rows_whole(spark, tables):
    base, rows, _ = tables
    kept, frame = staged(spark, tables, "quality_classifier")
    assert kept.columns == frame.columns
    model = nbsvm.train(frame, spark.read.parquet(f"{base}/labels.parquet"))
    want = sorted(str(tuple(r)) for r in frame.withColumn("s", nbsvm.scores(frame, model)).filter("s >= 0.5").drop("s").collect())
    assert sorted(str(tuple(r)) for r in kept.collect()) == want
    ids = [r.doc_id for r in kept.collect()]
    assert not [i for i in ids if i is not None and 200 <= i < 260] and set(range(120)) <= set(ids)


def test_join_stage_keeps_one_of_each_group_and_all_columns(spark, tables):
    _, rows, _ = tables
    kept, frame = staged(spark, tables, "ngram_jaccard_join")
    got = kept.collect()
    assert kept.columns == frame.columns and {tuple(r) for r in got} <= set(rows)
    ids = sorted(r.doc_id for r in got if r.doc_id is not None)
    assert 0 in ids and 400 not in ids and 401 not in ids and ids.count(5) == 1
    # the null id's text stands at id 3, so id 3 stays; the null text has no words and stays
    assert [r.text for r in got if r.doc_id is None] == [None] and 3 in ids


def test_decontamination_stage_drops_only_documents_with_an_item(spark, tables):
    _, rows, item = tables
    kept, frame = staged(spark, tables, "benchmark_decontamination")
    assert kept.columns == frame.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r in rows if r[0] != 402)
    # rows of one id, or without one, are judged each by its own text
    more = [(None, f"x {item} y", "en", "s", 1, "", 0, ""), (None, "clean text", "en", "s", 1, "", 0, ""), (7, item, "en", "s", 1, "", 0, ""), (7, "clean", "en", "s", 1, "", 0, "")]
    kept, _ = staged(spark, tables, "benchmark_decontamination", more)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("7", "clean"), ("None", "clean text")]


def test_leaks_of_rows_without_ids_are_judged_by_their_texts(spark, tables):
    base, _, item = tables
    rows = [(None, f"{i} {item}") for i in range(40)] + [(None, f"clean {i}") for i in range(40)] + [(1, item)] * 3
    found = spaced_seeds.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{base}/benchmark.parquet"))
    assert sorted((str(r.doc_id), r.item_id, r.matched) for r in found.collect()) == [("1", 9, 25), ("None", 9, 25)]


def test_secret_stage_replaces_secrets_only(spark, tables):
    _, rows, _ = tables
    kept, frame = staged(spark, tables, "secret_scan")
    assert kept.columns == frame.columns
    want = sorted(str((r[0], None if r[1] is None else secrets.redact(r[1], secrets.scan(r[1])[1]))) for r in rows)
    got = kept.collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert not [r for r in got if KEY in (r.text or "")] and [r.text for r in got if r.doc_id == 403][0].count("[secret]") == 1


def test_packing_equals_a_plain_best_fit_in_every_shard(spark, tables):
    """Each piece goes to the fullest bin that has room and no conflict; a new bin if there is none."""
    _, rows, _ = tables
    about = {r[0]: (r[3], r[1]) for r in rows if r[0] is not None}
    packed = packing.pack(spark.createDataFrame([r for r in dict((r[0], r) for r in rows).values() if r[0] is not None], SCHEMA), capacity=300).collect()
    assert {r.doc_id for r in packed} == set(about)
    bins = {}
    for r in sorted(packed, key=lambda r: (-r.n_tokens, r.doc_id, r.copy, r.piece)):
        source, text = about[r.doc_id]
        room = {k: 300 - sum(n for n, _, _ in b) for k, b in bins.items() if source not in [s for _, s, _ in b] and text not in [t for _, _, t in b]}
        fits = [n for n in room.values() if n >= r.n_tokens]
        assert (r.bin in bins) == bool(fits) and (not fits or room[r.bin] == min(fits))
        bins.setdefault(r.bin, []).append((r.n_tokens, source, text))


def test_all_stages(spark, tables):
    base, _, _ = tables
    packed = corpus_pipeline.run(spark, base).collect()
    ids = {r.doc_id for r in packed}
    assert {0, 1, 2, 403} <= ids and not ids & {400, 401, 402, *range(200, 260)}
    load = {}
    for r in packed:
        load[r.bin] = load.get(r.bin, 0) + r.n_tokens
    assert max(load.values()) <= 2048


def test_all_stages_on_an_empty_table(spark, tables, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_classifier_with_repeated_ids_long_texts_and_other_columns(spark, tables):
    rng = random.Random(3)
    rows = [(i % 20, prose(rng, 60) if i % 2 else "$$$ *** " * 40, "x", 1.0) for i in range(200)] + [(999, "word1 " * 200000, "x", 1.0), (None, None, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(0, 0), (None, 1)], "doc_id long, quality int")
    first, again = (sorted((str(r.doc_id), r.held_out, round(r.score, 9), r.predicted) for r in nbsvm.classify(
        docs.repartition(n), labels, sample_rows=60).collect()) for n in (3, 5))
    assert len(first) == len(rows) and first == again
    model_rows, marks = nbsvm.training_rows(docs, labels, 60, sample_bytes=2000)
    assert 0 < len(model_rows) < 60 and sum(x.nbytes for x in model_rows) <= 2000 and len(marks) == len(model_rows)
