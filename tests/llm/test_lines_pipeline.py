"""Line dedup on odd rows, and the stages of the pipeline on columns named like their own."""

import random

from pyspark.sql import functions as F

from millrace.llm import shared
from millrace.llm.templates import dedup_lines

SCHEMA = "doc_id long, text string, lang string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))


def test_lines_of_odd_tables(spark):
    common = "one line that all of them hold"
    many = "\n".join([common] * 3000)
    rows = [(i, f"{common}\n{chr(97 + i)} own", "en") for i in range(6)] + [(9, many, "en"), (10, None, "en"), (11, "", None), (None, common, None), (12, common, None), (12, common, None)]
    names = {"__row": F.lit(1), "__drops": F.array(F.lit("x")), "row": F.lit(2), "template": F.lit(3), "n_lines": F.lit(4), "leaf": F.lit(5)}
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA).withColumns(names)).collect()
    assert len(got) == len(rows) and {r["__row"] for r in got} == {1} and {tuple(r["__drops"]) for r in got} == {("x",)}
    by = {r.doc_id: r for r in got}
    assert by[0].n_dropped == 0 and by[5].text == "f own" and (by[9].text, by[9].n_lines, by[9].n_dropped) == ("", 3000, 3000)
    assert by[10].text is None and by[11].text == "" and by[None].text == "" and by[12].text == ""


def test_small_tables_of_many_partitions_are_few_files(spark, tmp_path, monkeypatch):
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    name = lambda i: "".join("abcdefghij"[int(d)] for d in str(i))
    rows = [(i, f"{name(i // 5)} is what five documents hold\n{name(i)} own", "en") for i in range(600)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(got) == 600 and all(r.text == (f"{name(r.doc_id)} own" if r.doc_id % 5 else rows[r.doc_id][1]) for r in got)
    files = {d.name.split("-")[0]: len(list(d.glob("part-*"))) for d in tmp_path.iterdir()}
    assert {"leaves", "dropped", "drops"} <= set(files) and max(files.values()) <= 32, files


def test_stages_pass_columns_of_any_name(spark):
    import corpus_pipeline

    rng = random.Random(2)
    rows = [(i, words(rng, 40), "en") for i in range(6)] + [(None, words(rng, 40), "en"), (1, words(rng, 30), "de"), (7, None, "en")]
    names = ["score", "lang_pred", "ambiguous", "__row", "__text", "__c0", "row", "root", "node", "doc", "key"]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(k) for k, n in enumerate(names)})
    for stage in (corpus_pipeline.language_stage, corpus_pipeline.near_copy_stage):
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns and all([r[n] for n in names] == list(range(len(names))) for r in kept.collect())
    assert corpus_pipeline.near_copy_stage(spark, docs, "").count() == len(rows)
    assert corpus_pipeline.near_copy_stage(spark, docs.limit(0), "").count() == 0


def test_language_stage_sends_the_text_to_python_once(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(4)
    docs = spark.createDataFrame([(i, words(rng, 40), "en") for i in range(6)], SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    kept, identify = [], corpus_pipeline.identify
    monkeypatch.setattr(corpus_pipeline, "identify", lambda *a, keep, **k: kept.append(len(keep)) or identify(*a, keep=keep, **k))
    raw = docs.withColumn("text", F.encode("text", "utf-8"))
    for frame in (docs, raw):  # a text of another type keeps it
        out = corpus_pipeline.language_stage(spark, frame, "")
        assert out.dtypes == frame.dtypes and sorted(out.collect()) == sorted(frame.collect())
    assert kept == [3, 4]


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    try:
        shared.shared_dir(Session())
    except ValueError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError("not refused")
