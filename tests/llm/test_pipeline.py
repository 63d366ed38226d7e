"""The stages beside a plain version of each on small data."""

import corpus_pipeline
from creditfeat.llm import attention, mixing, near_dedup, piece_sampling, secrets
from creditfeat.llm.common import stage, table
from tests.llm.data import documents, empty

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    vocabulary = piece_sampling.load_vocabulary()
    for name, step in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(step(spark, docs, SF), "test")
        after = docs.collect()
        if "classifier" in name:
            model = attention.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
            scores = {r.doc_id: r.score for r in attention.score(table(spark, SF, "documents"), model).collect()}
            assert {r.doc_id for r in after} == {r.doc_id for r in before if scores[r.doc_id] >= 0.3}
        elif "dedup" in name:
            from tests.llm.test_operators import brute_components

            root = brute_components([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in after} == {r.doc_id for r in before if root[r.doc_id][1] == r.doc_id}
        elif "secret" in name:
            masked = {r.doc_id: secrets.masked(r.text, secrets.find_spans(r.text)) for r in before}
            assert {r.doc_id: r.text for r in after} == masked
            assert all(r.n_chars == len(r.text) for r in after)
        elif "mixing" in name:
            assert {r.doc_id for r in after} <= {r.doc_id for r in before} and after
        else:
            texts = {r.doc_id: r.text for r in before}
            content = {i: t.replace("▁", " ").encode() for t, i, _ in vocabulary.pieces}
            content |= {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
            assert len(after) == len(before) and all(r.lossless for r in after)
            assert all(b"".join(content[i] for i in r.ids).decode() == " " + texts[r.doc_id] for r in after)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns


def test_stages_on_awkward_and_empty_tables(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (documents(spark).select(names), empty(documents(spark).select(names))):
        for _, step in corpus_pipeline.STAGES:
            docs = stage(step(spark, docs, SF), "test")
        docs.collect()
    assert mixing.TARGETS and near_dedup.Sketch().registers == 125
