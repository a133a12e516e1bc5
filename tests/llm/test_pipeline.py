"""The stages one after another, each against what it promises."""

import random
import weakref

import corpus_pipeline
import pytest

from palimpsest.llm import common, near_dedup, packing, toxicity


def test_stages_on_the_smallest_tables(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        m = docs.count()
        assert (m == n) if name == "line_dedup" else (0.5 * n < m <= n), name
        n = m
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_run_and_registration(spark, sf):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert corpus_pipeline.run(spark, sf).count() > 0


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean documents, copies, toxic ones and junk, with labels for some."""
    folder = tmp_path_factory.mktemp("planted")
    rnd = random.Random(11)
    words = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(3000)]
    text = lambda n: "\n".join(" ".join(rnd.choice(words) for _ in range(12)).capitalize() + "." for _ in range(n))
    bad = ["idiot", "moron", "scum", "trash"]
    rows, labels = [], []
    for i in range(400):
        t, quality, toxic = text(rnd.randint(3, 14)), 1, 0
        if i % 10 == 1:
            ws = t.split(" ")
            for k in range(5, len(ws), 7):
                ws[k] = rnd.choice(bad)
            t, toxic = " ".join(ws), 1
        elif i % 10 == 2:
            t, quality = " ".join(w.upper() + "!!" for w in t.split()), 0
        elif i % 40 == 3:
            t = rows[0][1]
        elif i % 40 == 13:
            t = rows[0][1].replace(rows[0][1].split()[4], "changed", 1)
        rows.append((i, t))
        labels += [(i, quality, toxic)] if i % 2 or i % 10 == 2 else []
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", f"src{i % 4}", len(t)) for i, t in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_planted_cases(spark, planted, tmp_path):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, planted).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    junk, toxic = {i for i in range(400) if i % 10 == 2}, {i for i in range(400) if i % 10 == 1}
    copies = {i for i in range(400) if i % 10 not in (1, 2) and i % 40 in (3, 13)}
    clean = set(range(400)) - junk - toxic - copies
    assert not left["quality"] & junk and clean <= left["quality"]
    assert not left["toxicity"] & toxic and clean <= left["toxicity"]
    assert clean <= left["near_dedup"]


def test_copies_go(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    kept = {r.doc_id for r in near_dedup.stage(spark, docs, planted).collect()}
    copies = {i for i in range(400) if i % 10 not in (1, 2) and i % 40 in (3, 13)}
    assert 0 in kept and not kept & copies


def test_toxic_stage_keeps_the_rest(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    kept = {r.doc_id for r in toxicity.stage(spark, docs, planted).collect()}
    assert {i for i in range(400) if i % 10 not in (1, 2)} <= kept


def test_workers_hold_models_of_one_operator():
    """A worker process lives through all stages; what a stage loaded goes when the next one loads its own."""
    scorer = toxicity._scorer(toxicity.Model().to_json())
    assert toxicity._scorer(toxicity.Model().to_json()) is scorer
    sampler = near_dedup.sampler()
    assert near_dedup.sampler() is sampler
    encoder = common.id_encoder(packing.default_tokenizer(), False)
    assert common.id_encoder(packing.default_tokenizer(), False) is encoder
    held = [weakref.ref(x) for x in (scorer, sampler, encoder)]
    del scorer, sampler, encoder
    assert [r() is None for r in held] == [True, True, False]
    near_dedup.sampler()
    assert held[2]() is None
