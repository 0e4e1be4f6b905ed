from pyspark.sql import functions as F

import corpus_pipeline
from docketry.llm import language_id, line_dedup, minhash, mixing
from docketry.llm.nbest import Lattice
from docketry.llm.queries import tokenizer_path
from docketry.session import materialize


def test_stages_and_columns(spark, sf, docs, odd):
    for frame in (docs, odd, odd.where("false")):
        now = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = materialize(stage(spark, now, sf), name)
            assert now.columns == frame.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, now, sf)
        assert last.count() == now.count() and last.where("not round_trip").count() == 0


def test_run_equals_its_operators(spark, sf, docs):
    known = language_id.identify(docs, language_id.learn(docs.where(~language_id.held_out()))).where("lang_pred <> 'und'").select(*docs.columns)
    lines = line_dedup.dedup_lines(known).withColumn("text", F.col("kept_text")).select(*docs.columns)
    kept = [r["id"] for r in minhash.near_duplicates(lines).where("kept").collect()]
    times = {r["id"]: r["times"] for r in mixing.mixed(lines.where(F.col("doc_id").isin(kept))).collect()}
    lattice = Lattice(tokenizer_path(), 4)
    text = {r["doc_id"]: r["text"] for r in lines.collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    count = {}
    for r in got:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
        assert r["piece_ids"] == lattice.encode(text[r["doc_id"]])[1].tolist()
    assert count == {k: n for k, n in times.items() if n}
