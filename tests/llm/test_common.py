import pyarrow as pa
import pytest

from tessera.llm import _common as C


def test_run_folders_are_removed(spark, monkeypatch):
    monkeypatch.setattr(C, "_made", [])
    df = C.written(spark.range(3), C.run_dir(spark, "some"))
    C.run_dir(spark, "never-written")
    assert df.count() == 3 and C.remove_runs(spark) == 1 and C.remove_runs(spark) == 0
    with pytest.raises(Exception, match="(?i)not exist|FILE_NOT_EXIST|Path"):
        df.count()


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Far:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        C.shared_root(Far)


def test_slices_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", "", "bbbb", "c" * 9, "d"])], ["t"])
    parts = [p.column("t").to_pylist() for p in C.by_bytes(batch, "t", 5)]
    assert parts == [["aa", ""], ["bbbb"], ["c" * 9], ["d"]] and list(C.by_bytes(batch.slice(0, 0), "t", 5)) == []


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "Score int, _score int")
    assert C.fresh(df, "score") == "__score" and C.fresh(df, "other") == "other"


def test_small_tables_are_few_files(spark, monkeypatch):
    from tessera.llm import simhash

    made = []
    real = simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, path, *a: made.append((path, real(df, path, *a))) or made[-1][1])
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.range(400).selectExpr("id AS a", "id + 1000 AS b")
        assert simhash.components(edges, "few").where("root >= 1000").count() == 0
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    files = [len(df.inputFiles()) for path, df in made if "few-labels" in path]
    assert files and max(files) <= spark.sparkContext.defaultParallelism


def test_fingerprints_and_links_are_few_files(spark, monkeypatch):
    from tessera.llm import simhash

    made = []
    real = simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, path, *a: made.append((path, real(df, path, *a))) or made[-1][1])
    had = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        fps = real(spark.range(600).selectExpr("id", "xxhash64(id div 2) ^ (id % 2) AS fp"), C.run_dir(spark, "some-fps"))
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = fps.join(simhash.linked(fps), "fp").where("component_id <> id - id % 2").count()
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)
    files = [len(df.inputFiles()) for path, df in made if "simhash-distinct" in path or "simhash-links" in path]
    assert got == 0 and len(files) == 2 and max(files) <= spark.sparkContext.defaultParallelism


def test_workers_keep_no_dictionary_for_the_next_stage(spark, make_docs):
    import public_tokenizers

    from tessera.llm import _tokens, near_copies, toxicity

    path = public_tokenizers.path("word_bpe_49k.json")

    def after(stage):
        """Units that a worker holds once it has run a stage's function after filling its dictionary."""

        def work(batches):
            batches = list(batches)
            had = _tokens.WordUnits.of(path).ids(["some words"])
            list(stage(iter(batches)))
            held = sum(map(len, _tokens._loaded.values()))
            assert _tokens.WordUnits.of(path).ids(["some words"]) == had
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64())], ["held"])

        return work

    class Rows:
        """Catches the function that a stage hands to mapInArrow."""

        def __init__(self, df):
            self.df, self.schema, self.columns = df, df.schema, df.columns

        def select(self, *cols):
            return Rows(self.df.select(*cols))

        def mapInArrow(self, work, schema):  # noqa: N802
            return self.df.coalesce(1).mapInArrow(after(work), "held long")

    docs = make_docs([(1, "some words of a text"), (2, None)])
    scorer = toxicity.learn([("bad words", 1), ("good words", 0)])
    assert [r[0] for r in near_copies.keyed(Rows(docs), "doc_id", "text").collect()] == [0]
    assert [r[0] for r in toxicity.score(Rows(docs), scorer).collect()] == [0]
