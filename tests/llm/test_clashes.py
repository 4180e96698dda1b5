"""Every stage and operator on documents whose extra columns have the names that operators use inside."""

import random

import pytest

import corpus_pipeline
from sparkloom.llm import decontaminate, licenses, mixing, quality, simhash, suffix

NAMES = ["y", "q", "_q", "_t", "_d", "_tid", "tid", "id", "n", "keys", "least", "digest", "packed", "hash", "at", "spans", "_spans", "kept", "copies", "gram", "kind", "size", "fp", "text_hash", "_h", "scores", "score", "item_id", "sh", "m", "_w", "_rid", "_n", "_s", "_text", "n_words", "a.b"]


@pytest.fixture(scope="module")
def crowd(spark):
    rnd = random.Random(9)
    say = lambda n: " ".join(rnd.choice(["river", "stone", "of", "the", "cloud", "meadow", "grey"]) + str(rnd.randint(0, 50)) for _ in range(n))
    passage, leaked = say(60), say(30)
    texts = [None, "", say(100), say(2), say(40) + " " + passage + " " + say(40), say(50) + " " + passage + " " + say(20), say(30) + " " + leaked + " " + say(20)]
    texts += [texts[2], texts[2] + " end", say(30_000)]
    rows = [(i, t, "en", "s" if i % 2 else None, len(t or ""), *([i] * len(NAMES))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in NAMES))
    items = spark.createDataFrame([(1, leaked), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(i, int(i != 5), 0) for i in range(7)], "doc_id long, quality int, toxic int")
    return docs, items, labels, passage


def test_stages(crowd):
    docs, items, labels, passage = crowd
    assert quality.keep_good(docs, labels).columns == docs.columns and quality.score_documents(docs, labels).count() == docs.count()
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4, 5, 6, 9] and all(r["digest"] == r.doc_id for r in kept.collect())
    cut = suffix.drop_repeats(docs)
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns and passage not in got[4].text and len(got[4].text) > 200 and got[2].text == "" == got[0].text and got[9].n_chars == got[9]["n_chars"] == len(got[9].text) > 10**5
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(10)) - {6}
    assert mixing.mix_sources(docs).count() == suffix.repeats_digest(docs).count() == simhash.near_duplicates(docs).count() == licenses.scan(docs).count() == docs.count()


def test_ids_of_any_type(crowd):
    docs, _, labels, _ = crowd
    named = docs.select(docs.doc_id.cast("string").alias("doc_id"), "text", "n_chars")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(named).collect()) == ["0", "2", "3", "4", "5", "6", "9"]
    assert quality.keep_good(named, labels.select(labels.doc_id.cast("string").alias("doc_id"), "quality", "toxic")).columns == named.columns


def test_pipeline(spark, crowd, tmp_path):
    docs, items, labels, passage = crowd
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.where("doc_id <> 5").write.parquet(f"{tmp_path}/labels.parquet")  # no bad ones, so all are kept
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 2, 3, 4, 5, 9} and got[9]["size"] == 30_000 and got[4]["size"] <= 81
    empty = tmp_path / "empty"
    for name, frame in (("documents", docs), ("benchmark", items), ("labels", labels)):
        frame.limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
