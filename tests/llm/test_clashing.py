"""Names that operators use themselves, as columns of the input, through the operators that give all columns back and the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, pii, simhash, toxicity

from .test_toxicity import ROWS

NAMES = ["score", "_score", "items", "_items", "items_0", "_items0", "_id", "_h", "_spans", "pii_id", "pii_hash", "pii_spans", "kept_id", "kept_n", "_n", "th", "key", "uid", "fp", "root", "h"]


@pytest.fixture(scope="module")
def clashing(make_docs):
    rows = [(1, "a clean text about rivers and mills"), (2, "mail x@y.zz now"), (3, None), (4, ""), (5, "a clean text about rivers and mills"), (None, "no id"), (2, "mail x@y.zz now")]
    return make_docs(rows).withColumns({n: F.lit(1) for n in NAMES})


def test_toxicity(clashing, make_docs, spark):
    scorer = toxicity.learn(ROWS)
    out = toxicity.score(clashing, scorer)
    assert out.columns[:-1] == clashing.columns and out.columns[-1] == "__score"
    assert all(r["score"] == 1 and r["_score"] == 1 and 0 <= r["__score"] < 0.5 for r in out.collect())
    assert toxicity.score(clashing.select("doc_id", "text"), scorer).columns[-1] == "score"


def test_decontaminate(clashing, spark):
    items = spark.createDataFrame([(1, "a clean text about rivers and mills")], "item_id long, text string")
    out = decontaminate.contaminated_pairs(clashing, items)
    assert out.columns[:-1] == clashing.columns
    assert sorted((r.doc_id, len(r[-1])) for r in out.collect() if r.doc_id) == [(1, 1), (2, 0), (2, 0), (3, 0), (4, 0), (5, 1)]


def test_masked_and_keep_one(clashing):
    out = pii.masked(clashing)
    assert out.columns == clashing.columns and sum(r.text == "mail <EMAIL> now" for r in out.collect()) == 2 and out.count() == 7
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3]


def test_stages(spark, clashing, make_docs, tmp_path):
    folder = f"file://{tmp_path}"
    rows = clashing.unionByName(make_docs([(100 + i, t) for i, (t, _) in enumerate(ROWS)]).withColumns({n: F.lit(1) for n in NAMES}))
    rows.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(100 + i, y) for i, (_, y) in enumerate(ROWS)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "nothing that any document has in it at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == rows.columns, name
        ids[name] = [r.doc_id for r in docs.collect()]
    assert {1, 2, 3, 4, 5, None} <= set(ids["toxicity"]) and not {100 + i for i, (_, y) in enumerate(ROWS) if y} & set(ids["toxicity"])
    assert {1, 2, 3, None} <= set(ids["simhash_near_dedup"]) and not {4, 5} & set(ids["simhash_near_dedup"])
    assert sorted(map(str, ids["pii"])) == sorted(map(str, ids["simhash_near_dedup"]))


def test_empty_documents(spark, make_docs, tmp_path):
    folder = f"file://{tmp_path}"
    make_docs([]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
