import json

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from .test_toxicity import ROWS


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, make_docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    items = [(1, prose(900, 30)), (2, prose(901, 30)), (3, None)]
    docs = [(i, t) for i, (t, _) in enumerate(ROWS)]
    docs += [(1000 + i, prose(i)) for i in range(20)]
    docs += [(1100 + i, prose(i)) for i in range(5)]  # copies
    docs += [(1200, prose(50, 60) + " " + items[0][1].upper() + " " + prose(51, 60)), (1201, prose(52) + " mail x@y.zz or 1.2.3.4 " + prose(53)), (1202, None), (1203, ""), (1203, ""), (None, prose(60))]
    make_docs(docs).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, (_, y) in enumerate(ROWS)], "doc_id long, toxic int").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = docs.collect()
    ids = {k: [r.doc_id for r in v] for k, v in seen.items()}
    toxic = {i for i, (_, y) in enumerate(ROWS) if y}
    assert not toxic & set(ids["toxicity"]) and {1000, 1200, 1201, 1202, 1203, None} <= set(ids["toxicity"])
    kept = ids["simhash_near_dedup"]
    assert set(range(1000, 1020)) <= set(kept) and not set(range(1100, 1105)) & set(kept) and kept.count(1202) == 1 and 1203 not in kept and None in kept
    assert set(kept) - set(ids["benchmark_decontamination"]) == {1200}
    final = {r.doc_id: r for r in seen["pii"]}
    assert set(final) == set(ids["benchmark_decontamination"]) and final[1201].text == prose(52) + " mail <EMAIL> or <IP> " + prose(53) and final[1201].n_chars == len(final[1201].text)
    assert final[1000].text == prose(0) and final[1202].text is None
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(p.length for p in pieces) == sum(len(tk.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in final.values())
    whole = corpus_pipeline.run(spark, folder)
    key = lambda rows: sorted(json.dumps(r.asDict(), sort_keys=True) for r in rows)
    assert key(whole.select("doc_id", "start", "length", "doc_tokens").collect()) == key([p for p in corpus_pipeline.STAGES[-1][1](spark, docs, folder).select("doc_id", "start", "length", "doc_tokens").collect()])


def test_stages_gather_small_partitions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(40)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism, name
