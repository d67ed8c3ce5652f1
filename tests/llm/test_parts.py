"""The operators' own parts, on made cases."""

import random
import string
import uuid

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

import by_hand
import corpus_pipeline
from pageloom.llm import (decontaminate, language_id, line_dedup, multiset_hash, piece_codec, pieces, secrets_scan, sharding,
                          simhash, token_counts, toxicity)

LETTERS = "abcdefghij tion the   \n\t.,éèñß日本語中😀▁x()=>_0123456789THE"


def made_texts(n, seed=3, most=80):
    pick = random.Random(seed)
    texts = ["".join(pick.choice(LETTERS) for _ in range(pick.randint(0, most))) for _ in range(n)]
    return texts + [" " * k + "a" + " " * (k // 2) for k in range(40)] + ["=" * k for k in range(1, 70)] + ["日" * 300]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def ids_of(vocabulary, encoder, store, texts):
    index, distinct, ends = pieces.units_of(vocabulary, texts, encoder.words)
    ids, sizes = store.gather(store.look_up(distinct, encoder.encode)[index])
    ends = np.concatenate(([0], np.cumsum(sizes)))[ends]
    return [ids[s:e].tolist() for s, e in zip(ends, ends[1:])]


@pytest.mark.parametrize("most", [10, 300_000])
def test_pieces_equal_the_library(vocabulary, most):
    """However much the store holds."""
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    encoder, store = piece_codec.Encoder(vocabulary, piece_codec.Merges(vocabulary)), pieces.Store(most)
    texts = [*made_texts(400), "\x00 with \x01 marks", "plain words only", ""]
    for part in (texts[:100], texts[100:], texts[-3:]):
        ids = ids_of(vocabulary, encoder, store, part)
        assert ids == model.encode(part)
        back = encoder.decode(pa.array([*ids, None], pa.list_(pa.int32())))
        assert back == [*model.decode(ids), None] == [*[t.replace("▁", " ") for t in part], None]


def test_two_passes_give_the_same(spark, folder, vocabulary):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(20)
    two = piece_codec.decoded(piece_codec.encoded(docs, vocabulary, ["doc_id"]), vocabulary)
    assert sorted(two.collect()) == sorted(piece_codec.there_and_back(docs, vocabulary, ["doc_id"]).collect())


def test_unigram_counts_equal_the_library(vocabulary):
    """The same pieces and scores as a model of type unigram; unit by unit, as the library adds in single precision."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(pieces.MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    unigram = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    trie = token_counts.VocabularyTrie(vocabulary, piece_codec.Merges(vocabulary))
    words = sorted({w for t in made_texts(400) for w in t.replace("▁", "").split()})
    _, best, _ = trie.forward([pieces.SPACE + w for w in words])
    assert best.tolist() == [len(unigram.encode(w)) for w in words]


def test_search_finds_every_occurrence():
    pick = random.Random(1)
    for _ in range(100):
        items = [(str(i), " ".join(pick.choice("abc") for _ in range(pick.randint(0, 9)))) for i in range(4)]
        text = " ".join(pick.choice("abc") for _ in range(60))
        wins, spans, names = by_hand.windows(items, 5), [], set()
        for p in decontaminate.compile_patterns(items, 5):
            for end, of in p.search(decontaminate.words_of(text)):
                spans.append((end - p.length, end))
                names |= of
        n, hit, n_items, digest, _ = by_hand.contamination(text, wins)
        assert sum(e - s for s, e in decontaminate.merged(spans)) == hit
        assert by_hand.sha(",".join(sorted(names))) == digest


def test_a_benchmark_in_slices_gives_the_same(spark, folder):
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = decontaminate.find_windows(docs, bench, ["doc_id"]).orderBy("row.doc_id").collect()
    assert decontaminate.find_windows(docs, bench, ["doc_id"], limit=2_000).orderBy("row.doc_id").collect() == whole


def test_gray_index_joins_what_is_near():
    pick = np.random.default_rng(0)
    for _ in range(15):
        fps = set()
        for centre in pick.integers(0, 2 ** 63, 5).tolist():
            for _ in range(pick.integers(1, 80)):
                for bit in pick.integers(0, 64, pick.integers(0, 6)).tolist():
                    fps.add(centre ^ (1 << bit))
                    centre = centre ^ (1 << bit) if pick.random() < 0.2 else centre
        f = np.array(sorted(fps), dtype=np.uint64)
        rank = f.copy()
        for k in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(k)
        a, b = simhash.local_links(f[np.argsort(rank)], np.zeros(len(f), dtype=np.int64))
        root = dict(zip(a.tolist(), b.tolist()))
        assert [root.get(x, x) for x in f.tolist()] == [int(f[k]) for k in by_hand.groups(f.tolist())]


def test_cut_buckets_lose_no_link(spark):
    """Every bucket is cut into chunks, as a hot one is."""
    pick = np.random.default_rng(2)
    fps = [int(x) for x in pick.integers(0, 2 ** 63, 40)]
    fps += [x ^ (1 << int(b)) ^ (1 << int(c)) for x in fps[:8] for b, c in pick.integers(0, 63, (30, 2))]
    nodes = spark.createDataFrame([(x,) for x in set(fps)], "fp long")
    found = {limit: sorted(simhash.components(simhash.near_links(nodes, limit)).collect()) for limit in (4, 200_000)}
    assert found[4] == found[200_000]
    f = sorted(set(fps))
    roots = by_hand.groups(f)
    assert [(r["a"], r["b"]) for r in found[4]] == [(x, f[k]) for x, k in zip(f, roots) if f[k] != x]


def test_near_copies_go(spark):
    """Of each group linked by SimHash (four-word shingles, four bits) the smallest doc_id stays, and nothing else goes."""
    pick = random.Random(12)
    texts = []
    for _ in range(15):
        words = [sentence(pick, 1, 1) for _ in range(400)]
        for changes in (0, 1, 2, 40):
            at = set(pick.sample(range(0, 400, 8), changes))
            texts.append(" ".join("other" + str(pick.random()) if k in at else w for k, w in enumerate(words)))
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, None, 1), (99, "", 1)], "doc_id long, text string, row int")
    found = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert found.columns == docs.columns
    stay = {r["doc_id"] for r in found.collect()}
    roots = by_hand.groups([by_hand.simhash(t) for t in texts])
    assert stay == set(roots) | {99} and len(set(roots)) < 60      # 99 and the null text are of one group


def test_a_long_chain_is_one_component(spark):
    links = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r["b"] for r in simhash.components(links).collect()} == {0}


def test_pairs_of_terms_say_what_neither_says():
    """Label 1 just if both terms are there: no sum of two weights tells the four cases apart with this bias alone."""
    pick = np.random.default_rng(1)
    first, second = pick.random(2000) < 0.5, pick.random(2000) < 0.5
    label = (first != second).astype(float)
    docs = np.concatenate((np.flatnonzero(first), np.flatnonzero(second)))
    term = np.concatenate((np.zeros(first.sum(), int), np.ones(second.sum(), int)))
    order = np.argsort(docs, kind="stable")
    model = toxicity.fit(docs[order], term[order], label, 2, steps=600, decay=0.0, pair_decay=0.0)
    odds, _ = toxicity.machine(docs[order], term[order], 2000, model)
    assert ((odds > 0) == (label == 1)).all()


def test_toxicity_on_held_out_rows(spark):
    from pageloom.llm.queries import QUERIES
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op2_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((rows.predicted == 0) | (rows.toxic == 1)).mean() > 0.995
    assert (rows.predicted[rows.toxic == 1] == 1).mean() > 0.85


def test_battery_tells_random_from_written():
    pick = random.Random(5)
    for _, alphabet in secrets_scan.ENCODINGS:
        runs = ["".join(pick.choice(alphabet) for _ in range(40)) for _ in range(300)]
        judged = [j for r in runs if (j := secrets_scan.battery(r))]
        assert len(judged) > 250
        assert np.mean([p < 0.001 for _, p in judged]) < 0.06
    for written in ("aaaaaaaaaaaaaaaaaaaaaaaaa1", "0000000000000000000000000000a", "path/to/some/file/name/version1/version1/version1",
                    "abcabcabcabcabcabcabc123123123123"):
        assert secrets_scan.battery(written)[1] < 0.01
    assert secrets_scan.battery("onlylettersinthisverylongword") is None


def test_a_token_joined_to_a_path_is_a_candidate():
    pick = random.Random(6)
    for around in ("/v1/web-hook/{}", "/etc/my_app/{}", "sk-live/{}", "a+b_c/{}-d", "{}"):
        for alphabet in ("", "+", "-_"):
            token = "a1" + "".join(pick.choice(string.ascii_letters + string.digits + alphabet) for _ in range(38))
            text = "x " + around.format(token) + " y"
            (_,), (candidates,) = secrets_scan.scan([text])
            at = text.index(token)
            assert any(s <= at and e >= at + 40 for s, e, *_ in candidates)


def test_tokens_in_paths_are_found(spark):
    pick = random.Random(7)
    tokens = ["".join(pick.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(60)]
    texts = [(k, f"see {('/v1/web-hook/', '/etc/my_app/', 'sk-live/')[k % 3]}{t} there") for k, t in enumerate(tokens)]
    found = secrets_scan.find_secrets(spark.createDataFrame(texts, "doc_id long, text string"), ["doc_id"]).collect()
    hits = 0
    for r in found:
        text, token = texts[r["row"]["doc_id"]][1], tokens[r["row"]["doc_id"]]
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        hits += any(s <= text.index(token) and e >= text.index(token) + 40 for s, e in spans)
    assert hits >= 57


def test_longest_of_overlapping_runs():
    assert secrets_scan.longest([(0, 20), (0, 41), (21, 41), (30, 60), (60, 80), (100, 120)]) == [(0, 41), (60, 80), (100, 120)]


def test_reports_follow_the_share_of_ordinary_runs():
    made = {200: 900, 40: 90, 10: 10}
    assert secrets_scan.reported_bins({200: 500, 40: 20}, made) == -1         # as ordinary runs are
    assert secrets_scan.reported_bins({200: 500, 3: 200}, made) == 3
    assert secrets_scan.reported_bins({3: 1}, made) == 3
    assert secrets_scan.reported_bins({3: 1}, {}) == secrets_scan.reported_bins({}, made) == -1


def test_ordinary_strings_are_not_reported(spark):
    """Names of capitalised words and a number, paths, identifiers and versions stay; tokens of 40 characters are found."""
    pick = random.Random(8)
    words = ("get user account name value list index table query manager factory builder handler service request response error message file path cache "
             "session config option parser reader writer buffer stream socket client server thread pool worker event").split()
    ordinary = ["".join(pick.choice(words).capitalize() for _ in range(pick.randint(4, 6))) + str(pick.randrange(100)) for _ in range(1400)]
    ordinary += ["/".join(pick.choice(words) for _ in range(5)) + str(pick.randrange(10)) for _ in range(300)]
    ordinary += [str(uuid.UUID(int=pick.getrandbits(128))) for _ in range(200)]
    ordinary += [f"{pick.choice(words)}-{pick.choice(words)}-{pick.randrange(2000, 2030)}-{pick.randrange(1, 13):02d}-{pick.choice(words)}" for _ in range(100)]
    tokens = ["a1" + "".join(pick.choice(string.ascii_letters + string.digits) for _ in range(38)) for _ in range(200)]
    rows = [(k, f"the {' '.join(pick.choice(words) for _ in range(20))} {run} of it") for k, run in enumerate(ordinary + tokens)]
    found = secrets_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()
    reported = {r["row"]["doc_id"] for r in found if any(s["kind"] == "random" for s in r["spans"])}
    assert sum(k < len(ordinary) for k in reported) <= 0.05 * len(ordinary)
    assert sum(k >= len(ordinary) for k in reported) >= 0.95 * len(tokens)


def test_multiset_hash_moves_with_paragraphs():
    one, two, both, swapped = multiset_hash.fingerprints(["a first one", "the other", "a first one\nthe other", "the other\na first one"])
    assert (both == swapped).all() and (multiset_hash.added(one, two) == both).all() and (multiset_hash.removed(both, two) == one).all()
    assert (multiset_hash.read(multiset_hash.written(both)) == both).all()
    assert multiset_hash.likeness(both[None], swapped[None])[0] == 1.0
    assert not (one == two).all()


def sentence(pick, least=4, most=12):
    return " ".join("".join(pick.choice(string.ascii_lowercase) for _ in range(pick.randint(2, 8))) for _ in range(pick.randint(least, most))).capitalize() + "."


@pytest.mark.parametrize("shape", ["a paragraph", "several lines", "within a paragraph"])
def test_long_shared_passages_go(shape):
    pick = random.Random(9)
    gone = whole = 0
    for _ in range(40):
        parts = [sentence(pick) for _ in range(9)]
        passage = ("\n" if shape == "several lines" else " ").join(parts)
        seen, first = set(), True
        for _ in range(3):
            before, after = (" ".join(sentence(pick) for _ in range(pick.randint(2, 6))) for _ in range(2))
            glue = " " if shape == "within a paragraph" else "\n"
            text = glue.join([before, passage, after])
            chunks = [text[s:e] for s, e, _ in line_dedup.chunks_of(text)]
            cut = sum(len(c) for c in chunks if c in seen)
            assert all(c.strip() in passage for c in chunks if c in seen)       # nothing else goes
            seen |= set(chunks)
            if not first:
                gone, whole = gone + cut, whole + len(passage)
            first = False
    assert gone > {"a paragraph": 0.95, "several lines": 0.9, "within a paragraph": 0.4}[shape] * whole


ROW = {"one sentence": 40, "no sentence ends": 40, "list row": 40, "no blanks": 40}


@pytest.mark.parametrize("place", ["a line", "between blank lines", "a sentence of a paragraph", "within a long line"])
@pytest.mark.parametrize("shape", list(ROW))
def test_long_lines_go(shape, place):
    """Passages of 51 to 60 words (or 110 letters without blanks) without a sentence end in them."""
    pick = random.Random(4)

    def words(n):
        if shape == "no blanks":
            return "".join(chr(pick.randint(0x4E00, 0x9FFF)) for _ in range(2 * n))
        own = ["".join(pick.choice(string.ascii_lowercase) for _ in range(pick.randint(2, 8))) for _ in range(n)]
        return (" | " if shape == "list row" else " ").join(own)

    stop = "。" if shape == "no blanks" else ". "
    gone = whole = untouched = 0
    for _ in range(ROW[shape]):
        passage, seen = words(pick.randint(51, 60)), set()
        for k in range(4):
            near = [words(pick.randint(4, 12)) for _ in range(6)]
            text = {"a line": "\n".join([*near[:3], passage, *near[3:]]),
                    "between blank lines": "\n\n".join([*near[:3], passage, *near[3:]]),
                    "a sentence of a paragraph": stop.join([*near[:3], passage, *near[3:]]) + stop,
                    "within a long line": (" " * (shape != "no blanks")).join([words(90), passage, words(90)])}[place]
            chunks = [text[s:e] for s, e, _ in line_dedup.chunks_of(text)]
            cut = sum(len(c) for c in chunks if c in seen)
            assert all(c.strip(" |\n。.") in passage for c in chunks if c in seen)
            seen |= set(chunks)
            if k:
                gone, whole, untouched = gone + cut, whole + len(passage), untouched + (not cut)
    assert gone > (0.35 if place == "within a long line" else 0.99) * whole
    assert untouched <= (0.1 if place == "within a long line" else 0) * 3 * ROW[shape]


def test_chunks_cover_in_order():
    for text in made_texts(200, most=400):
        at = 0
        for start, end, _ in line_dedup.chunks_of(text):
            assert at <= start < end <= len(text)
            at = end


def test_a_group_larger_than_a_shard_is_dealt(spark):
    big = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text in a third of all rows").otherwise(
        F.concat(F.lit("another text, number "), F.col("id").cast("string"))).alias("text"))
    rows = sharding.assign(big).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert len(rows) == 16
    assert max(r["bytes"] for r in rows) < 1.1 * min(r["bytes"] for r in rows)
    assert all(r["last"] == r["n"] - 1 for r in rows)


def test_letters_of_any_script():
    table = language_id.alpha_table()
    codes, starts = language_id.letters(["", "Ab 1!c", "日本", "..."], table)
    assert [chr(c) for c in codes] == [" ", "a", "b", " ", "c", " ", "日", "本", " ", " "]
    assert starts.tolist() == [0, 1, 6, 9]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * k for k in (0, 5, 100, 1, 1, 50)] + [None]})
    from pageloom.llm.batches import slices
    assert [t for s in slices([batch], limit=60) for t in s.column("text").to_pylist()] == batch.column("text").to_pylist()
