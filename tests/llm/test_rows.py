"""Fitted models and the pipeline's stages on nulls, repeated rows, empty tables and clashing columns; held-out accuracy."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_llm import LONG, groups_by_similarity

import corpus_pipeline
from lithoscope.llm import common, language, toxicity

MIDDLE = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["score", "spans", "lang_pred", "fp", "th", "set_id", "kept", "n_words", "component_id"]


def table(spark, rows, extra=True):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(3)
    return docs.withColumns({c: F.lit(7) for c in EXTRA}) if extra else docs


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet").where("crc32(cast(doc_id as string)) % 5 <> 0"))


def test_toxicity_held_out(spark):
    found = toxicity.op1_toxicity(spark, MIDDLE).where("held_out").join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in found}
    assert n.get((0, 1), 0) <= 1 and n[0, 0] >= 60 and n[1, 1] >= n.get((1, 0), 0)


def test_fitted_toxicity_on_odd_rows(spark, model):
    bad = next(f for f in model.vocabulary if f.startswith("="))[1:]
    rows = [(1, None), (2, ""), (3, "  \n"), (4, LONG), (5, f"{LONG} {bad} {bad}"), (5, "x"), (None, bad), (6, "!!")]
    out = toxicity.score_documents(table(spark, rows + rows[:1]), model).collect()
    assert len(out) == len(rows) + 1 and all(0 <= r["score"] <= 1 for r in out)
    base = {r["score"] for r in out if not (r["text"] or "").strip()}
    assert len(base) == 1 and base.pop() < 0.5
    spans = {r["doc_id"]: [r["text"][s["start"] : s["end"]].lower() for s in r["spans"]] for r in out if r["spans"]}
    assert all(bad in x for own in spans.values() for x in own)
    assert len({r["score"] for r in out if r["doc_id"] == 1}) == 1


def test_calibration_does_not_shift_with_the_cap(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    whole, thin = toxicity.fit(docs, labels), toxicity.fit(docs, labels, per_class=60)
    assert abs(whole.base - thin.base) < 0.05
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(150).collect()]
    clean = [(whole.score(t)[0], thin.score(t)[0]) for t in texts if not whole.tag(t)[0] and not thin.tag(t)[0]]
    assert clean and all(abs(a - b) < 0.1 for a, b in clean)


ROWS = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "only null id here now"), (None, "only null id here now"), (3, None), (4, ""), (5, "g h i j k l m"), (5, "n o p q r s t"), (9, "Only NULL id here now"), (None, "two null rows of one text"), (7, "A b c d e f")]


def test_one_row_of_each_group_stays(spark):
    kept = corpus_pipeline.keep_one_of_each_group(spark, table(spark, ROWS), SMALL)
    assert kept.columns == table(spark, ROWS).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(1, "a b c d e f"), (9, "Only NULL id here now"), (3, None), (5, "g h i j k l m"), (5, "n o p q r s t"), (None, "two null rows of one text")], key=str)
    nobody = [(None, "x y z"), (None, "x y z"), (None, "X y z"), (None, "other words")]
    assert corpus_pipeline.keep_one_of_each_group(spark, table(spark, nobody), SMALL).count() == 2
    assert corpus_pipeline.keep_one_of_each_group(spark, table(spark, []), SMALL).count() == 0


def test_first_stages_by_force(spark):
    """Stages 1 and 2 keep what the models, applied row by row on the driver, accept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    own = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = docs.collect()
    clean = corpus_pipeline.drop_toxic(spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in rows if own.score(r["text"])[0] < corpus_pipeline.TOXIC_FROM)
    profiles = language.fit(docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    lang, score = profiles.predict([r["text"] for r in rows])
    known = corpus_pipeline.drop_unknown_language(spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in known.collect()) == sorted(r["doc_id"] for r, x, s in zip(rows, lang, score) if x != "und" and s >= corpus_pipeline.LANGUAGE_FROM)


@pytest.mark.parametrize("rows", [[], ROWS + [(11, " ".join(f"{t}" for _, t in ROWS if t) * 900)]])
def test_pipeline_on_odd_tables(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    ids = {p["doc_id"] for p in pieces}
    assert ids == ({1, 9, 5, None, 11} if rows else set())


def test_no_folder_of_one_machine_on_a_cluster(spark):
    class Far:
        class sparkContext:
            master, applicationId = "spark://far:7077", "app-1"

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError):
        common.shared_dir(Far)
