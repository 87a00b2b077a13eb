import corpus_pipeline as C
from ..conftest import SF
from .test_operators import table

DIR = SF.replace("0.001", "0.01")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(C.STAGES):
        before = docs
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() > 0.7 * before.count()
        if k < 4:
            assert docs.columns == columns
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert docs.columns[: len(columns)] == columns
    near = C.STAGES[2][1](spark, before, DIR)
    assert near.count() == before.count()  # nothing near is left after its stage
    assert C.benchmark_stage(spark, before, DIR).count() == before.count()


def test_run_again_and_again(spark):
    """Runs in one session give the same rows, and of the tables that they settle only those that the result reads are left."""
    from gridmill.llm import kernels

    got = []
    for _ in range(3):
        before = len(kernels._MADE)
        out = C.run(spark, SF)
        made = kernels._MADE[before:]
        got.append(sorted((r.doc_id, r.copy, r.slot) for r in out.select("doc_id", "copy", "slot").collect()))
        left = [p for p in made if (lambda fs, at: fs.exists(at))(*kernels._path(spark, p))]
        assert len(left) < len(made) / 3 and set(left) >= {p for p in made if any(p in f for f in out.inputFiles())}
    assert len(got[0]) > 0 and got[0] == got[1] == got[2]


def test_stages_on_awkward_input(spark):
    docs = table(spark, (1, None, None, None), (None, "", "en", "a"), (2, "x y z", "en", "a"), (2, "x y z", "en", "a"), (3, "q " * 30000, "en", ""))
    for rows_ in (docs, docs.limit(0)):
        for name, stage in C.STAGES:
            out = stage(spark, rows_, SF)
            out.count()
            assert out.columns == (docs.columns if name != "mixing" else [*docs.columns, "copy_", "slot", "n_tokens"])
