import corpus_pipeline
import pytest
from tidewatt.llm import common, decontaminate, jaccard_join, pii, queries, quality_rules

from . import test_bpe, test_decontaminate, test_jaccard_join, test_pii

SMALL = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    docs = common.read_table(spark, SMALL, "documents")
    columns = docs.columns
    after = [docs]
    for name, stage in corpus_pipeline.STAGES:
        after.append(common.store(stage(spark, after[-1], SMALL), "test"))
    assert all(d.columns == columns for d in after[:-1])
    rows = [[(r.doc_id, r.text) for r in d.collect()] for d in after[:-1]]
    good = {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}
    assert {d for d, _ in rows[1]} == good
    parts = {c for _, _, c in test_jaccard_join.plain(rows[1])} | {d for d, n, _ in test_jaccard_join.plain(rows[1]) if not n}
    assert {d for d, _ in rows[2]} == parts
    items = [(r.item_id, r.text) for r in common.read_table(spark, SMALL, "benchmark").collect()]
    assert {d for d, _ in rows[3]} == {d for d, *_, bad in test_decontaminate.plain(rows[2], items) if not bad}
    clean = dict(rows[4])
    assert set(clean) == {d for d, _ in rows[3]}
    assert not any(test_pii.plain(t) for t in clean.values())
    assert all(clean[d] == t for d, t in rows[3] if not test_pii.plain(t) and "@" not in t and not any(c.isdigit() for c in t))
    final = after[-1].collect()
    assert {r.doc_id for r in final} == set(clean)
    import numpy as np
    assert all(np.frombuffer(bytes(r.ids), "<u4").tolist() == test_bpe.LIBRARY.encode(clean[r.doc_id], add_special_tokens=False).ids for r in final)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(clean)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES])
def test_queries_return_the_contract(spark, name):
    found = queries.QUERIES[name](spark, SMALL)
    wanted = {2: "doc_id n_email n_ip n_card n_phone base_sha256 spans", 3: "doc_id n_words n_hit n_items items_sha256 contaminated",
              4: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", 5: "doc_id n_bytes n_removed n_spans kept_sha256",
              6: "doc_id held_out n_tokens n_known train_tokens base_score score", 7: "doc_id n_tokens ids_sha256 decoded_sha256", 8: "doc_id n_shingles component_id",
              9: "page_id payload_bytes payload_digest record_type refers_to", 10: "doc_id held_out score predicted", 1: "doc_id license",
              11: "lang source part item value rank", 12: "doc_id held_out score predicted",
              13: "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256"}[int(name[2:].split("_")[0])]
    assert set(wanted.split()) <= set(found.columns)
    if name.startswith("op13_"):
        assert found.count() == common.read_table(spark, SMALL, "conversations").select("conv_id").distinct().count()
    elif not name.startswith(("op1_", "op11_")):
        table = "pages" if name.startswith("op9") else "documents"
        assert found.count() == common.read_table(spark, SMALL, table).count()


def test_digests_of_personal_data(spark):
    import hashlib
    texts = {r.doc_id: r.text for r in common.read_table(spark, SMALL, "documents").collect()}
    kinds = ["email", "ip", "card", "phone"]
    for r in queries.op2_skip_chain_pii(spark, SMALL).collect():
        spans = test_pii.plain(texts[r.doc_id])
        named = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        every = [x for x in r.spans.split(",") if x]
        assert set(named.split(",")) - {""} <= set(every)
        assert every == sorted(every, key=lambda x: (int(x.split(":")[1]), kinds.index(x.split(":")[0])))


def test_digests_of_tokens(spark):
    import hashlib

    import numpy as np
    texts = {r.doc_id: r.text for r in common.read_table(spark, SMALL, "documents").collect()}
    for r in queries.op7_transducer_bpe(spark, SMALL).collect():
        ids = test_bpe.LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(test_bpe.LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
