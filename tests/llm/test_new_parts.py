"""Parts of the operators on vectors, merges and phrases, by themselves."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tokenizers
from pyspark.sql import functions as F

import by_hand
from pageloom.llm import hard_negatives, line_dedup, merge_codec, multiset_hash, phrases, sharding, toxicity


@pytest.fixture(scope="module")
def codec():
    return merge_codec.Codec(merge_codec.load())


def ids_of(codec, text):
    return codec.encode(codec.chunks(pa.array([text])).flatten().to_pylist())[0].tolist()


def test_merges_equal_the_library(codec):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    draw = random.Random(5)
    bits = ["a", "b", "the", "'", "s", " ", "\n", "1", "e\u0301", "\u00e9", "\u017f", "<|endoftext|>", "<|", "\U0001f600", "ing", "\u0130", "\u03a3",
            "\x1c", "\x85", "\u3000", "\x00", "<|startoftext|>", "'ll", "A", "\u1c89", "\u0558"]
    texts = ["", " ", "a" * 3000, "ab" * 2000, "it's 'S don't--'s", "\u00e9<|endoftext|>\u0301x", "\u03b1\u03a3 \u03a3\u03a3", *(chr(c) + "a" for c in range(0x20, 0x3000, 7))]
    texts += ["".join(draw.choice(bits) for _ in range(draw.randrange(1, 40))) for _ in range(1500)]
    for text in texts:
        assert ids_of(codec, text) == library.encode(text, add_special_tokens=False).ids, text


def test_one_long_word(codec):
    """A megabyte without a blank is one word; it is cut only where no token reaches across."""
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    draw = random.Random(6)
    text = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000)) + "a" * 300_000
    assert ids_of(codec, text) == library.encode(text, add_special_tokens=False).ids


def test_rules_out_of_order_are_refused(tmp_path):
    import json
    said = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    said["model"]["merges"].reverse()
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(said), encoding="utf-8")
    with pytest.raises(ValueError):
        merge_codec.load(str(path))


def test_curve_makes_single_steps():
    side = 1 << hard_negatives.PLANES
    cells = np.array([(x, y) for x in range(side) for y in range(side)], dtype=float) - (side - 1) / 2
    keys = hard_negatives.hilbert_keys(cells, (side - 1) / 2)
    order = sorted(range(len(keys)), key=keys.__getitem__)
    assert len(set(keys)) == len(keys) and np.abs(np.diff(cells[order], axis=0)).sum(axis=1).max() == 1


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_zones_lose_nothing(spark, monkeypatch, scale):
    """Clustered rows in small blocks: many blocks needn't be read, and the rows are those of brute force. Large values are scored as whole numbers."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(12, 6))
    rows = [(int(k), int(k % 4), (scale * (centres[k % 12] + 0.1 * draw.normal(size=6))).tolist()) for k in range(1200)]
    rows += [(2000 + k, 1, [float(scale)] * 6) for k in range(300)]      # a large group of copies
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    given = frame.select("vec_id", label.alias("label"), "embedding")
    found = hard_negatives.mined(given, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, found)) == sorted(by_hand.hard_negatives(rows))
    if scale == 1.0:
        layout = hard_negatives.Layout(given, F.col("vec_id") % 50 == 0)
        anchors = layout.anchors()
        zones = hard_negatives.visited(F.lit(0), 0, layout.blocks, "body", "ids", "places")
        chosen = hard_negatives.met(zones, hard_negatives.visited(F.lit(0), 1, anchors.drop("anchor_id"), "ids", "places")).mapInArrow(
            hard_negatives._choose(layout.width, True, True), hard_negatives.VISIT).count()
        assert chosen < 0.6 * anchors.count() * layout.blocks.count() / 4


def test_scores_beyond_64_bits_are_refused(spark):
    frame = spark.createDataFrame([(0, 1, [1e18, 1.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(ValueError):
        hard_negatives.mined(frame, F.col("vec_id") % 50 == 0)


@pytest.mark.parametrize("bits", [1 << 26, 64, 1 << 12])
def test_borders_that_fail_are_counted(spark, monkeypatch, bits):
    """A sample that proposes little, and tables full of collisions: counts are exact all the same."""
    monkeypatch.setattr(phrases, "BITS", bits)
    monkeypatch.setattr(phrases, "RATE", 50)
    draw = random.Random(9)
    docs = [(k, draw.choice(["en", "de", None]), " ".join(draw.choice(["a", "b", "c", "dd", "e,", "f\n", "g"]) for _ in range(60))) for k in range(60)]
    docs += [(100 + k, "en", "once upon a time there was one") for k in range(35)] + [(200, "en", None), (201, "xx", ""), (202, "en", " ;; ")]
    frame = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    found = phrases.collocations(frame, least=8).collect()
    assert sorted(map(tuple, found)) == sorted(by_hand.collocations([d[1:] for d in docs], least=8))
    assert len(found) > 20


def test_counts_beyond_64_bits(spark):
    """Scores stay whole where products pass 64 bits."""
    big = 10 ** 15
    found = spark.createDataFrame([("en", 1, "a", 3 * big), ("en", 1, "b", 2 * big), ("en", 2, "a b", big), ("en", 1, "c", big + 1), ("en", 2, "b c", big),
                                   ("en", 3, "a b c", big - big // 5)], "lang string, size int, phrase string, f long")
    rows = {r["phrase"]: (r["a"], r["l"], r["r"], r["score"]) for r in phrases.scored(found).collect()}
    assert rows == {"a b c": (big - big // 5, 3 * big, big, 2000000 * (big - big // 5) // (4 * big))}


def test_a_pair_is_learned_end_to_end(spark):
    """Two words, each in half of the texts, toxic if just one of them is there: no term tells the labels apart by itself."""
    pick = random.Random(4)
    vocabulary = ["".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(3, 9))) for _ in range(2000)]
    rows, labels = [], []
    for k in range(3000):
        one, two = pick.random() < 0.5, pick.random() < 0.5
        words = [pick.choice(vocabulary) for _ in range(40)] + ["kettle"] * one + ["violin"] * two
        pick.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(one != two)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs.where("doc_id % 5 > 0"), marks)
    found = toxicity.scored(docs.where("doc_id % 5 = 0"), model, ["doc_id"]).select("row.doc_id", "score").toArrow().to_pylist()
    assert sum((r["score"] >= 0.5) == bool(labels[r["doc_id"]][1]) for r in found) > 0.95 * len(found)


@pytest.mark.parametrize("times", [20_000, 33_000, 70_000])
def test_a_passage_repeated_many_times_is_like_itself(times):
    text = "one two three four " * times
    own, new = multiset_hash.fingerprints([text]), multiset_hash.fingerprints([multiset_hash.edited(text, "something else")])
    half = multiset_hash.fingerprints([multiset_hash.edited(text, "other words of another text here " * times)])
    assert multiset_hash.likeness(own, new)[0] > 0.4 and multiset_hash.likeness(own, half)[0] > 0.4
    more = multiset_hash.added(own[0], multiset_hash.fingerprints(["a paragraph"])[0])
    assert (more == multiset_hash.fingerprints([text + "\na paragraph"])[0]).all()
    assert (multiset_hash.removed(more, multiset_hash.fingerprints(["a paragraph"])[0]) == own[0]).all()


def test_many_empty_texts_are_cut_for_numbering(spark):
    """A third of all rows is empty: next to no bytes, but rows that one task must not number alone."""
    docs = spark.range(60_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN '' ELSE concat(repeat('some text ', 40), id) END AS text")
    placed = sharding.assign(docs)
    rows = placed.toArrow().to_pandas()
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    marked = sharding.measured(docs)
    large = marked.groupBy("grp").count().where("count * 2048 >= 60000").collect()
    assert [r["count"] for r in large] == [20_000]
    sizes = rows.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() < 0.02 * sizes.max()


def test_chunks_of_lines(folder):
    """The vectorised rules against the same said line by line."""
    pick = random.Random(3)
    bits = ["word ", "x. ", "W\u00f6rter! ", "\u3002", "\u65e5\u672c\u8a9e\u306e", "\n", "\n\n", "a b c d e f g " * 10, "? ", " ", "\u2026", "long" * 30 + " ", "\u65e5\u672c" * 60]
    texts = ["".join(pick.choice(bits) for _ in range(pick.randrange(0, 60))) for _ in range(1500)]
    texts += [t for t in pq.read_table(f"{folder}/documents.parquet")["text"].to_pylist() if t and len(t) < 20_000]
    for text in texts:
        assert [c[:2] for c in line_dedup.chunks_of(text)] == by_hand.line_chunks(text), text[:200]


def test_merge_codec_merges_a_word_once(codec, monkeypatch):
    """Chunks that differ share words; each word is merged once, and results are those of one chunk at a time."""
    seen, real = [], merge_codec.merge
    monkeypatch.setattr(merge_codec, "merge", lambda rules, known, symbols, ends: seen.append(len(symbols)) or real(rules, known, symbols, ends))
    chunks = ["wording", "wording,", "Wording.", "(wording)", "l'été", "été,", "ß́x", "́x", "it's", "a1b2", "", "été"]
    ids, sizes = codec.encode(chunks)
    letters = {w: len(w.encode()) for w in ("wording", ",", ".", "(", ")", "l", "'", "été", "ß́x", "́", "x", "it", "'s", "a", "1", "b", "2")}
    assert sum(seen) <= sum(letters.values()) + 4
    alone = [merge_codec.Codec(codec.rules).encode([c]) for c in chunks]
    assert sizes.tolist() == [int(n.sum()) for _, n in alone]
    assert ids.tolist() == [i for found, _ in alone for i in found.tolist()]
