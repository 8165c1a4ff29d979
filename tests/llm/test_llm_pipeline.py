import corpus_pipeline
import __spark_entry__ as entry
from brute import components, contaminated
from flowsentry.functions.session import materialise


def test_stages_keep_what_they_should(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialise(stage(spark, seen[-1], sf_dir), "stage"))
    assert all(frame.columns == names for frame in seen[:-1])
    counts = [frame.count() for frame in seen]
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] == counts[-2]
    before, after = seen[2].collect(), {r.doc_id for r in seen[3].collect()}
    # Of every group of near copies the first stays, and nothing else goes.
    assert after == {c for _, _, c in components([(r.doc_id, r.text) for r in before])}
    dirty = {r[0] for r in contaminated([(r.doc_id, r.text) for r in seen[3].collect()], bench) if r[-1]}
    assert {r.doc_id for r in seen[4].collect()} == after - dirty


def test_pipeline_on_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_every_query_is_registered():
    found = entry.queries()
    assert all(any(name.startswith(f"op{n}_") for name in found) for n in range(1, 11)) and "pipeline" in found
