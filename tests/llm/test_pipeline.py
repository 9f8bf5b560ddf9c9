"""The pipeline's stages: columns, decisions, and the whole run against brute force on a small table."""
import hashlib

import pandas as pd
import pytest

import corpus_pipeline
from papyrine.llm import queries, toxicity
from papyrine.llm.common import materialise
from tests.llm.test_operators import brute_repeats, near_groups


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "t")
        out.append(docs.toPandas())
    return out


def test_columns(spark, sf_dir, stages):
    names = pd.read_parquet(f"{sf_dir}/documents.parquet").columns.tolist()
    assert all(s.columns.tolist() == names for s in stages[:-1])
    assert len(corpus_pipeline.STAGES) == 5


def test_toxic_documents_go(spark, sf_dir, stages):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    want = scored.filter(~toxicity.is_rejected(scored["severity"])).toPandas().doc_id
    assert set(stages[0].doc_id) == set(want) and 0 < len(want) < docs.count()


def test_one_of_each_group_stays(stages):
    before, after = stages[0], stages[1]
    groups = near_groups(before.text.tolist(), before.doc_id.tolist())
    assert sorted(after.doc_id) == sorted(set(groups.values()))


def test_repeats_go(stages):
    before, after = stages[1], stages[2].set_index("doc_id")
    for i, text, want in zip(before.doc_id, before.text, brute_repeats(before.text), strict=True):
        kept = after.text[i].encode()
        if want[1] == 0:
            assert after.text[i] == text
        elif hashlib.sha256(kept).hexdigest() != want[3]:  # a cut inside a character takes it whole
            assert 0 <= want[0] - want[1] - len(kept) <= 6 * want[2]
        assert after.n_chars[i] == len(after.text[i])


def test_benchmark_items_go(spark, sf_dir, stages):
    from papyrine.llm import decontaminate
    from tests.harness import connect

    before, after = stages[2], stages[3]
    duck = connect(sf_dir)
    duck.execute("drop view documents")
    duck.register("documents", before)
    dirty = set(duck.execute(decontaminate.oracle()).df().doc_id)
    assert set(after.doc_id) == set(before.doc_id) - dirty


def test_last_stage_encodes(stages):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    texts, last = stages[3].set_index("doc_id").text, stages[4].set_index("doc_id")
    assert set(texts.index) == set(last.index)
    for i, t in texts.items():
        ids = lib.encode(t, add_eos=True)
        assert last.n_tokens[i] == len(ids) and last.ids_sha256[i] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run_and_empty_table(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == len(stages[-1])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    assert docs.count() == 0


def test_stages_on_odd_rows(spark, sf_dir):
    """Null and repeated ids, null, empty and long texts, repeated rows, an extra column: every stage decides by the text."""
    import numpy as np

    rng = np.random.default_rng(31)
    unique = [" ".join(f"x{rng.integers(10**7)}" for _ in range(90)) for _ in range(5)]
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet").text.tolist()[:2]
    big = 10**9
    odd = [(None, unique[0]), (None, unique[1]), (big, unique[2]), (big, unique[3]), (big + 1, None), (big + 1, ""), (big + 2, unique[4]), (big + 2, unique[4]), (big + 3, "palabra unica " * 5000), (None, items[0]), (big, items[1] + " " + unique[0][:40])]
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("node", docs["n_chars"])
    out = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "node"]
        out.append(sorted(str(r["text"]) for r in docs.collect()))
    assert out[0] == sorted(str(t) for _, t in odd)
    rest = [*unique, items[0], items[1] + " " + unique[0][:40]]
    assert [t for t in out[1] if t not in ("None", "")] == sorted([*rest, "palabra unica " * 5000]) and len(out[1]) == 9
    assert out[2] == sorted([*rest, "", ""])
    assert out[3] == sorted([*unique, "", ""])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == 7
