import corpus_pipeline
from tests.llm import brute
from verdigris.llm.tokenizer import default_path
from verdigris.session import materialize

from .test_operators import check_packing


def test_pipeline(spark, sf_dir, duck):
    """Each stage on its own input: the columns stay, its decisions hold, clean documents stay as they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = materialize(stage(spark, docs, sf_dir), name)
        if name == "packing":
            check_packing(out.collect(), [(i, r.text) for i, r in before.items()], default_path("word_bpe_49k.json"), 4096)
            final = out
            break
        assert out.columns == docs.columns
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and len(after) > 0.5 * len(before)
        if name == "toxicity":
            assert all(after[i] == before[i] for i in after) and len(after) < len(before)
        if name == "near_dedup":
            _, label = brute.near_groups([(i, r.text) for i, r in before.items()])
            assert set(after) == {i for i in label if label[i] == i} and all(after[i] == before[i] for i in after)
        if name == "decontamination":
            for i, r in before.items():
                n, hit, found = brute.matches(r.text, items)
                assert (i in after) == (len(found) <= 1 and hit <= 0.5 * n)
                if i in after:
                    assert not brute.matches(after[i].text, items)[2]
                    assert after[i] == r or found
        docs = out
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect())) == sorted(map(str, final.drop("sequence_id", "offset").collect()))
