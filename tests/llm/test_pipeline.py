"""The pipeline against brute force, on documents of the smallest table and planted ones."""

import importlib.util
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import decontaminate, mixing, quality_rules
from tests.llm.test_near_dedup import brute as near_groups
from tests.llm.test_quality_rules import counts
from tests.llm.test_secret_scan import brute as spans_of


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 6)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    items = [(i, fresh(20)) for i in range(5)]
    docs = [(i, fresh(rng.randint(55, 160)), "en", f"s{i % 3}", 1) for i in range(60)]
    docs += [(100, docs[3][1], "en", "s0", 1), (101, docs[4][1] + " tail", "en", None, 1), (102, fresh(40) + " " + items[2][1] + " " + fresh(40), "en", "s1", 1), (103, "too short", "en", "s1", 1), (104, None, None, "s1", 1), (105, fresh(60) + " password: hunter2hunter2", "de", "s2", 1)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs, items


def test_every_stage(spark, folder):
    path, docs, items = folder
    rows, frame = {d[0]: d for d in docs}, spark.read.parquet(f"{path}/documents.parquet")
    got = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, path)
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got.append({r.doc_id: r.text for r in frame.collect()})
    base = {i for i, d in rows.items() if (c := counts(d[1]))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    assert set(got[0]) == base  # too few labels for any cutoff
    groups = near_groups([(i, rows[i][1]) for i in base])
    assert set(got[1]) == {i for i, g in groups.items() if g[2]} and not {100, 101} & set(got[1])
    assert set(got[2]) == set(got[1]) - {102}
    assert set(got[3]) == set(got[2]) and got[3][105].endswith("[secret]")
    assert all(spans_of(t)[1] == "" for t in got[3].values())


def test_run(spark, folder):
    path, _, _ = folder
    out = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in out} >= {0, 1, 2, 105} and not {100, 101, 102, 103, 104} & {r.doc_id for r in out}
    assert all(r.taken <= 2 * r["size"] for r in out)
    assert abs(sum(r.taken for r in out) - 1.5 * sum(r["size"] for r in out)) <= 4 * mixing.BLOCK
    assert sorted(out) == sorted(corpus_pipeline.run(spark, path).collect())


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "mixing"]
    assert quality_rules.RISK == 0.01 and decontaminate.ALLOWED == 4
    entry = importlib.util.spec_from_file_location("entry", pathlib.Path(corpus_pipeline.__file__).with_name("__spark_entry__.py"))
    module = importlib.util.module_from_spec(entry)
    entry.loader.exec_module(module)
    assert {f"op{i}" for i in range(1, 11)} <= {q.split("_")[0] for q in module.queries()} and "pipeline" in module.queries()


def test_stages_on_odd_tables(spark, folder):
    """Null ids, texts, languages and sources, repeated rows, a very long text, an empty table, columns of any name."""
    path, docs, items = folder
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(60_000))
    odd = [(None, docs[5][1], None, None, 1), (None, None, None, None, None), (5, docs[5][1], "en", "s2", 1), (5, docs[5][1], "en", "s2", 1), (6, docs[9][1], "en", "s1", 1), (7, "", "en", "s1", 0), (8, " \n", "de", None, 2), (9, long, "en", "s1", 1), (10, long + " tail", "xx", "s1", 1)]
    frame = spark.createDataFrame([*docs[:5], *docs[10:20], *odd], "doc_id long, text string, lang string, source string, n_chars long")
    names = ["_hit", "_kept", "_q_n_words", "_stratum", "_spans", "_base_spans", "wanted", "place", "q_n_words", "setting", "stratum", "kept", "cuts", "spans", "base_spans", "size", "start", "target", "n", "f1", "a.b", "a b"]
    frame = frame.selectExpr("*", *(f"{i} AS `{n}`" for i, n in enumerate(names))).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, path)
        assert out.schema.simpleString() == frame.schema.simpleString(), name
        rows = out.collect()
        assert all(r["cuts"] == names.index("cuts") and r["a.b"] == names.index("a.b") and r["m"] == {"k": r.doc_id} for r in rows), name
        ids = sorted(r.doc_id for r in rows if r.doc_id is not None)
        nameless = sum(r.doc_id is None for r in rows)
        if name == "quality_rules":
            assert ids == sorted([*range(5), *range(10, 20), 5, 5, 6, 9, 10]) and nameless == 1
        if name == "near_dedup":
            assert 10 not in ids and ids.count(5) == 1 and nameless == 2 and 9 in ids and len(ids) == len(set(ids)) and {7, 8} <= set(ids)
        if name in ("decontamination", "secret_scan"):
            assert len(rows) == frame.count()
        assert stage(spark, frame.where("false"), path).count() == 0, name
    mixed = corpus_pipeline.STAGES[-1][1](spark, frame, path)
    assert mixed.count() == frame.count() and corpus_pipeline.STAGES[-1][1](spark, frame.where("false"), path).count() == 0
    assert {r.taken for r in mixed.collect() if r["size"] == 0} == {0}


def test_nothing_is_left_but_the_result(spark, folder):
    path, _, _ = folder
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir())
    out = corpus_pipeline.run(spark, path)
    left = {p.name.rpartition("-")[0] for p in set(shared.iterdir()) - before if "-" in p.name and not (p / "rdd-0").exists()}
    assert {n for n in left if n.startswith(("near", "leak", "quality", "mix", "pipeline"))} == {"pipeline-mixing"} and out.count() > 0
