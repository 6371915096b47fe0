import corpus_pipeline
import pytest
from latticelu.llm import packing, queries
from latticelu.llm.common import materialize


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages_keep_columns_and_clean_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, total = docs.columns, docs.count()
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    linked = {r.doc_id: r.component_id for r in queries.op3_simhash(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    leaked = {r.doc_id for r in queries.op5_decontamination(spark, sf_dir).collect()}
    assert len(left[0]) == total  # every document has letters and a language
    sets = {d: shingles(t) for d, t in texts.items()}
    pairs = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in sets for b in sets if a < b]
    assert left[1] <= set(linked.values())
    assert not [p for p in pairs if p[2] >= 0.8 and p[0] in left[1] and p[1] in left[1]]
    near = {b for _, b, j in pairs if j >= 0.6} | {d for d, c in linked.items() if d != c}
    assert total - len(left[1]) > 5 and set(texts) - left[1] <= near  # nothing else goes
    assert left[2] == left[1] - leaked and leaked
    packed = corpus_pipeline.pack(spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == left[2]
    want = packing.tokenize(docs, queries.tokenizer_path()).count()
    assert len(packed) == want and corpus_pipeline.run(spark, sf_dir).count() == want


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_nulls_clashing_names_and_empty_tables(spark, sf_dir, stage):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_rejected int, fp int, _bad int"
    rows = [(1, None, None, None, None, 1, 1, 1), (2, "the cat and the dog sat there", "en", "s", 5, None, None, None), (2, "the cat and the dog sat there", "en", "s", 5, None, None, None), (None, "", "en", None, 0, 1, 1, 1), (3, "the " * 40_000, "en", "s", 1, 0, 0, 0)]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, sf_dir)
    if stage is not corpus_pipeline.pack:
        assert out.columns == docs.columns
    assert out.count() >= 1
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None
