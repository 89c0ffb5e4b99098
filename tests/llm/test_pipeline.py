import corpus_pipeline
from terrane.llm.ngram_join import near_copy_components
from terrane.llm.pii import span_report
from tests.llm.data import empty

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
            break
        assert out.columns == names
        before, after = ({r.doc_id: r for r in d.collect()} for d in (docs, out))
        assert after.keys() <= before.keys()
        if name == "exact_dedup":
            assert len({" ".join((r.text or "").split()) for r in before.values()}) == len(after)
        if name == "near_dedup":
            comps = {r.component_id for r in near_copy_components(docs).collect()}
            assert after.keys() == comps
        if name == "personal_data":
            assert after.keys() == before.keys()
            assert sum(r.n_email + r.n_ip + r.n_phone for r in span_report(out).collect()) == 0
        docs = out


def test_run_and_empty_input(spark, tmp):
    assert corpus_pipeline.run(spark, SF).count() > 0
    empty(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp}/labels.parquet")
    assert corpus_pipeline.run(spark, tmp).count() == 0
