"""Each query against a plain version of what it must return, over the smallest tables and over edge cases."""

import re
import zlib

import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tokenizers

import by_hand
import corpus_pipeline
from pageloom.llm import pieces
from pageloom.llm.queries import QUERIES


@pytest.fixture(scope="module", params=["given", "edges"])
def data(request, spark, folder, edge_folder):
    return request.param, folder if request.param == "given" else edge_folder


def run(spark, folder, number):
    name = next(k for k in QUERIES if k.startswith(f"op{number}_"))
    found = QUERIES[name](spark, folder).toArrow().to_pylist()
    return sorted(found, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))


def documents(folder):
    rows = pd.read_parquet(f"{folder}/documents.parquet", dtype_backend="pyarrow").to_dict("records")
    return sorted([{k: None if v is pd.NA else v for k, v in r.items()} for r in rows], key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def together(spark, data, number, value):
    """Rows of the query beside what ``value`` makes of each document, as sorted pairs (id, values)."""
    found = run(spark, data[1], number)
    wanted = [(d["doc_id"], *value(d)) for d in documents(data[1])]
    assert len(found) == len(wanted)
    return found, wanted


def same(got, wanted):
    assert sorted(map(str, got)) == sorted(map(str, wanted))


def test_sentencepiece(spark, data):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)

    def value(d):
        if d["text"] is None:
            return None, -1, None
        ids = model.encode(d["text"])
        return ids, len(ids), by_hand.sha(model.decode(ids))
    found, wanted = together(spark, data, 1, value)
    same([(r["doc_id"], r["ids"], -1 if r["ids"] is None else r["n_ids"], r["decoded_sha256"]) for r in found], wanted)


def test_toxicity(spark, data):
    found, wanted = together(spark, data, 2, lambda d: (by_hand.crc(d["doc_id"]) % 5 == 0,))
    same([(r["doc_id"], r["held_out"]) for r in found], wanted)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)


def test_simhash(spark, data):
    docs = documents(data[1])
    fps = [by_hand.simhash(d["text"]) for d in docs]
    roots = by_hand.groups(fps)
    wanted = [(d["doc_id"], "%016x" % fp, docs[r]["doc_id"]) for d, fp, r in zip(docs, fps, roots)]
    same([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in run(spark, data[1], 3)], wanted)


def test_secrets(spark, data):
    def value(d):
        spans = by_hand.base_spans(d["text"])
        kinds = [sum(k == n for _, k, _ in spans) for n in range(3)]
        return *kinds, by_hand.sha(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans))
    found, wanted = together(spark, data, 4, value)
    same([(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in found], wanted)
    for r in found:     # the base spans are among all spans
        assert sum(not s.startswith("random") for s in r["spans"].split(",") if s) == r["n_assign"] + r["n_access"] + r["n_hex"]
    if data[0] == "edges":
        assert next(r for r in found if r["doc_id"] == 11)["spans"] == "random:0:32"


def test_token_counts(spark, data):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    found, wanted = together(spark, data, 5, lambda d: (None if d["text"] is None else len(model.encode(d["text"])),))
    same([(r["doc_id"], r["n_tokens"]) for r in found], wanted)


def test_multiset_fingerprints(spark, data):
    docs = documents(data[1])
    found = run(spark, data[1], 6)
    assert len(found) == len(docs)
    assert all(r["n_chars"] in {len(d["text"] or "") for d in docs if d["doc_id"] == r["doc_id"]} for r in found)
    if data[0] == "given":
        for r, d, following in zip(found, docs, [*docs[1:], docs[0]]):
            assert r["edited_sha256"] == by_hand.sha(by_hand.edited(d["text"], following["text"]))
        assert sum(r["near_edited"] > r["near_next"] for r in found) > 0.95 * len(found)
    else:
        # null ids come first, so they follow the last id; among equal ids the order is fixed but not by the text itself
        by_id = {r["doc_id"]: r for r in found}
        assert by_id[6]["edited_sha256"] == by_hand.sha("x")
        last = {by_hand.sha(by_hand.edited(docs[-3]["text"], d["text"])) for d in docs if d["doc_id"] is None}
        assert by_id[12]["edited_sha256"] in last
    texts = {}
    for r, d in zip(found, docs):
        if data[0] == "given":
            assert texts.setdefault(d["text"], r["fingerprint"]) == r["fingerprint"]
    if data[0] == "given":
        assert len(set(texts.values())) == len(texts)


def test_line_dedup(spark, data):
    docs = documents(data[1])
    found = run(spark, data[1], 7)
    assert len(found) == len(docs)
    if data[0] == "given":
        seen = set()
        for r, d in zip(found, docs):
            kept, at = [], 0
            for start, end in by_hand.line_chunks(d["text"]):
                if d["text"][start:end] in seen:
                    kept.append(d["text"][at:start])
                    at = end
                seen.add(d["text"][start:end])
            assert r["text"] == "".join(kept) + d["text"][at:]
    else:
        by_id = {r["doc_id"]: r for r in found}
        assert by_id[1]["text"] == docs[0]["text"] and by_id[3]["text"] is None and by_id[4]["text"] == ""
        assert [r["text"] for r in found if r["doc_id"] == 2] == ["", ""]
        assert by_id[8]["text"].endswith("five") and len(by_id[8]["text"]) < 200


def test_language_id(spark, data):
    found, wanted = together(spark, data, 8, lambda d: (by_hand.crc(d["doc_id"]) % 3 == 1,))
    same([(r["doc_id"], r["held_out"]) for r in found], wanted)
    assert all(0 <= r["score"] <= 1 for r in found)
    if data[0] == "given":
        truth = {d["doc_id"]: d["lang"] for d in documents(data[1])}
        assert all(r["lang_pred"] == truth[r["doc_id"]] for r in found if r["held_out"])
    else:
        nothing = {d["doc_id"] for d in documents(data[1]) if not re.search(r"[^\W\d_]", d["text"] or "")} - {None}
        assert {r["doc_id"] for r in found if r["lang_pred"] == "und" and r["doc_id"] is not None} == nothing


def test_shards(spark, data):
    docs = documents(data[1])
    found, wanted = together(spark, data, 9, lambda d: (len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())))
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in found], wanted)
    by_shard = {}
    for r in found:
        by_shard.setdefault(r["shard"], []).append(r)
    assert set(by_shard) <= set(range(16))
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in by_shard.values())
    if data[0] == "given":
        sizes = [sum(r["size"] for r in rows) for rows in by_shard.values()]
        assert max(sizes) - min(sizes) < 0.05 * max(sizes)
        text = {d["doc_id"]: d["text"] for d in docs}
        homes = {}
        for r in found:
            homes.setdefault(text[r["doc_id"]], set()).add(r["shard"])
        assert all(len(h) == 1 for h in homes.values())


def test_decontamination(spark, data):
    items = pd.read_parquet(f"{data[1]}/benchmark.parquet", dtype_backend="pyarrow")
    wins = by_hand.windows([tuple(None if v is pd.NA else v for v in r) for r in items[["item_id", "text"]].itertuples(index=False)])
    found, wanted = together(spark, data, 10, lambda d: by_hand.contamination(d["text"], wins))
    same([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found], wanted)
    assert any(r["contaminated"] for r in found)


def test_hard_negatives(spark, data):
    rows = pq.read_table(f"{data[1]}/embeddings.parquet").to_pylist()
    found = QUERIES["op11_hard_negatives"](spark, data[1]).collect()
    wanted = by_hand.hard_negatives([(r["vec_id"], r["label"], r["embedding"]) for r in rows])
    same([tuple(r) for r in found], wanted)
    assert found


def test_merge_codec(spark, data):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

    def value(d):
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        return len(ids), by_hand.sha(" ".join(map(str, ids))), by_hand.sha(library.decode(ids, skip_special_tokens=False))
    found, wanted = together(spark, data, 12, value)
    same([(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found], wanted)


def test_phrases(spark, data):
    found = QUERIES["op13_phrases"](spark, data[1]).collect()
    same([tuple(r) for r in found], by_hand.collocations([(d["lang"], d["text"]) for d in documents(data[1])]))
    assert found


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_documents(spark, empty_folder, name):
    assert QUERIES[name](spark, empty_folder).count() == 0


def test_pipeline_stages(spark, data):
    """Each stage on its own input, judged by the plain versions."""
    docs = spark.read.parquet(f"{data[1]}/documents.parquet")
    columns = docs.columns
    items = pd.read_parquet(f"{data[1]}/benchmark.parquet", dtype_backend="pyarrow")
    wins = by_hand.windows([tuple(None if v is pd.NA else v for v in r) for r in items[["item_id", "text"]].itertuples(index=False)])
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toArrow().to_pylist()
        docs = spark.createDataFrame(stage(spark, docs, data[1]).toArrow())
        after = docs.toArrow().to_pylist()
        if name == "encoding":
            assert [r["doc_id"] for r in before if r["text"] is not None and by_hand.sha(r["text"].replace("▁", " ")) not in {x["decoded_sha256"] for x in after}] == []
            assert len(after) == len(before)
            continue
        assert docs.columns == columns
        if name == "line_dedup":
            assert len(after) == len(before)
        if name == "near_dedup":
            rows = sorted(before, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
            roots = by_hand.groups([by_hand.simhash(r["text"]) for r in rows])
            assert len(after) == len(set(roots))
            same([r["doc_id"] for r in after], [rows[k]["doc_id"] for k in set(roots)])
        if name == "decontamination":
            same(after, [r for r in before if not by_hand.contamination(r["text"], wins)[-1]])


def test_pipeline_without_documents(spark, empty_folder):
    assert corpus_pipeline.run(spark, empty_folder).count() == 0


def test_pipeline_is_registered(spark, folder):
    import __spark_entry__
    assert "pipeline" in __spark_entry__.queries()
    assert corpus_pipeline.run(spark, folder).count() > 0
