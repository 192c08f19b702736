import sys

import corpus_pipeline
from molgrid.llm import decontaminate, packing, pii, simhash, toxicity
from molgrid.llm.registry import PSEUDONYM_KEY, VOCABULARY, oracle_sql, queries


def test_each_stage_takes_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    labels, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    bad = {r.doc_id for r in toxicity.report(docs, labels).where("predicted = 1").collect()}
    left = docs.where(~docs.doc_id.isin(*bad, -1))
    twins = {r.doc_id for r in simhash.report(left).where("doc_id != component_id").collect()}
    left = left.where(~left.doc_id.isin(*twins, -1))
    leaked = {r.doc_id for r in decontaminate.report(left, items).where("contaminated").collect()}
    kept = set(rows) - bad - twins - leaked
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == kept and twins and leaked
    encode = packing.encoder(VOCABULARY)
    for r in out[:40]:
        if r.piece == 0 and r.length < 1024:
            assert r.length <= len(encode(pii.rewrite(rows[r.doc_id], PSEUDONYM_KEY)[0])) // 4 + 1


def test_stage_contract(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "decontamination", "pii", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_every_operator_has_one_query():
    names = list(queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(oracle_sql()) <= set(names)


def test_nothing_else_imports_the_subpackage():
    import subprocess

    code = "import sys; sys.modules['molgrid.llm'] = None; import molgrid.plans.queries"
    subprocess.run([sys.executable, "-c", code], check=True)
