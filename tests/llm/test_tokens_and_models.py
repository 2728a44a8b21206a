import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from selroute.llm import bpe_chunks, ngram_trie, packing, pu_quality, token_counts
from selroute.llm.common import held_out
from selroute.llm.tokenizing import BYTE_BPE, split_safely, tokenizer

LIBRARY = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
ODD = ["", " ", "  a  b\n\n c ", "x<|endoftext|>y z <|endoftext|>", "日本語 テキスト abc", "a b  c", "don't   stop\t\n x", "😀 hi 😀😀", "é à ñ 12 ¼", "x" * 3000 + " y"]


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("mean_cuts", [1, 3, 128])
def test_chunks_equal_the_library(mean_cuts):
    encoder = bpe_chunks.ChunkEncoder(BYTE_BPE, mean_cuts=mean_cuts, store_bytes=20_000)
    rng = random.Random(4)
    texts = ODD + [(o + " and more. ") * 40 for o in ODD] + ["".join(rng.choice("ab é\n\t .,'s1日 ") for _ in range(rng.randrange(400))) for _ in range(300)]
    for text in texts:
        ids = encoder.encode(text)
        assert ids.tolist() == expected(text)
        assert encoder.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False) == text
    assert encoder.held <= 20_000 + 4 * 3100


def test_shared_chunks_are_encoded_once():
    encoder = bpe_chunks.ChunkEncoder(BYTE_BPE, mean_cuts=16)
    rng = random.Random(1)
    shared = " ".join(f"word{rng.randrange(999)}" for _ in range(600))
    encoder.encode("Something before. " + shared)
    before = encoder.encoded
    encoder.encode("Quite another start, longer than the first one. " + shared)
    assert encoder.reused > 20 and encoder.encoded - before <= 4


def test_bad_joins_are_repaired(monkeypatch):
    """Cuts inside words give joins that disagree; these chunks are encoded as one."""
    monkeypatch.setattr(bpe_chunks, "cut_points", lambda data, mean_cuts: list(range(3, len(data), 7)))
    encoder = bpe_chunks.ChunkEncoder(BYTE_BPE)
    text = "the quick brown foxes jumped over unbelievably lazy dogs. " * 5
    assert encoder.encode(text).tolist() == expected(text) and encoder.repaired


def test_token_digests_and_counts(messy, messy_rows, crowded, nothing):
    want = Counter()
    for doc_id, text, *_ in messy_rows:
        ids = expected(text)
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want[(doc_id, len(ids), sha, hashlib.sha256((text or "").encode()).hexdigest())] += 1
    got = bpe_chunks.token_digests(messy).collect()
    assert Counter((r.id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    counted = token_counts.count_tokens(messy, limit=100).collect()
    assert Counter((r.id, r.n_bytes, r.n_tokens, r.over_limit) for r in counted) == Counter(
        (d, len((t or "").encode()), len(expected(t)), len(expected(t)) > 100) for d, t, *_ in messy_rows
    )
    checked = bpe_chunks.encode_checked(crowded)
    assert checked.columns[-3:] == ["n_tokens", "ids", "round_trip"] and checked.filter("not round_trip").count() == 0
    assert bpe_chunks.token_digests(nothing).count() == token_counts.count_tokens(nothing).count() == bpe_chunks.encode_checked(nothing).count() == 0
    back = bpe_chunks.decode_ids(bpe_chunks.encode_texts(messy.select("doc_id", "text")).withColumnRenamed("text", "source"))
    assert back.filter(F.coalesce("source", F.lit("")) != F.col("text")).count() == 0


def test_other_tokenizers_count_whole_texts(messy):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    small = messy.filter("doc_id < 20")
    got = {r.id: r.n_tokens for r in token_counts.count_tokens(small, name="piece_bpe_32k.model").collect()}
    assert got == {r.doc_id: len(model.encode(r.text)) for r in small.collect()}
    assert tokenizer("word_bpe_49k.json").encode("Some words") == Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode("Some words", add_special_tokens=False).ids


def test_safe_splits_keep_counts():
    for text in ODD + [" ".join(ODD) * 30]:
        for size in (1, 7, 50):
            parts = split_safely(text, size)
            assert "".join(parts) == text and sum(len(expected(p)) for p in parts) == len(expected(text))


def test_lines_without_blanks_are_split_safely():
    rng = random.Random(9)
    for letters in ("日本語漢字仮名かなカナ", "한국어문장", "かなab漢"):
        text = "".join(rng.choice(letters * 4 + "、。！？，；: \n'x") for _ in range(4000)) + "<|endoftext|>" + letters
        parts = split_safely(text, 100)
        assert "".join(parts) == text and len(parts) > 20 and sum(len(expected(p)) for p in parts) == len(expected(text))


def test_lengths_come_from_batch_calls_on_runs_of_equal_bytes(messy, monkeypatch):
    t = tokenizer(BYTE_BPE)
    texts = [o * k for o in ODD for k in (1, 7)]
    assert t.lengths(texts) == [len(expected(x)) for x in texts] and t.lengths([]) == []
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        other = tokenizer(name)
        assert other.lengths(texts) == [len(other.encode(x)) for x in texts]
    pieces = [(i, x) for i, x in enumerate(["é" * 30, "a" * 60, "日" * 20, "b"] * 50)]
    runs = list(token_counts.balanced(pieces, 600))
    sizes = [sum(len(p.encode()) + 1 for _, p in run) for run in runs]
    assert [p for run in runs for p in run] == pieces and all(600 <= n < 661 for n in sizes[:-1])


def test_counts_with_clashing_names_and_small_batches(crowded, messy_rows, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE_CHARS", 50)
    counted = crowded.select("doc_id", "text", "n_tokens", token_counts.token_lengths(F.col("text"), batch_bytes=300).alias("found")).collect()
    assert Counter((r.doc_id, r.found) for r in counted) == Counter((d, len(expected(t))) for d, t, *_ in messy_rows)
    assert Counter(r.n_tokens for r in token_counts.count_tokens(crowded).collect()) == Counter(len(expected(t)) for _, t, *_ in messy_rows)


def slow_best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        rooms = [k for k in range(len(free)) if free[k] >= n]
        if rooms:
            free[min(rooms, key=lambda k: free[k])] -= n
        else:
            free.append(capacity - n)
    return sorted(free)


def test_best_fit_decreasing_matches_brute_force():
    rng = random.Random(8)
    for capacity in (1, 7, 50, 64):
        for _ in range(80):
            lengths = np.array([rng.randint(1, capacity) for _ in range(rng.randrange(1, 60))])
            rows, used = packing.best_fit_decreasing(lengths, capacity)
            assert sorted(capacity - np.bincount(rows, weights=lengths, minlength=used)) == slow_best_fit(lengths.tolist(), capacity)


def test_packed_rows_give_all_documents_back(messy, messy_rows, nothing):
    unique = messy.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = [r.asDict() for r in packing.pack_texts(unique, capacity=64).collect()]
    documents = packing.unpack(rows)
    texts = {d: t for d, t, *_ in messy_rows if d is not None}
    assert {d: x.tolist() for d, x in documents.items()} == {d: expected(t) for d, t in texts.items() if expected(t)}
    for r in rows:
        ends, positions = r["cu_seqlens"], np.frombuffer(r["positions"], "<u2")
        assert len(r["ids"]) == 128 and ends[0] == 0 and ends[-1] == r["n_tokens"] <= 64 and len(ends) == len(r["doc_ids"]) + 1
        for a, b in zip(ends, ends[1:], strict=False):
            assert a < b and positions[a:b].tolist() == list(range(b - a))
    assert len({(r["part"], r["block"], r["row"]) for r in rows}) == len(rows)
    assert packing.digests(packing.pack_texts(nothing)).count() == 0


def test_elias_fano_finds_and_gives_every_value(tmp_path):
    rng = np.random.default_rng(2)
    for k, (n, universe) in enumerate([(0, 10), (1, 1), (5, 10**6), (3000, 4000), (2000, 1 << 50), (900, 901)]):
        values = np.sort(rng.choice(universe, n, replace=False)) if universe < 10**7 else np.unique(rng.integers(0, universe, n))
        coded = ngram_trie.EliasFano.write(values, universe, str(tmp_path), f"list{k}")
        i = np.arange(len(values))
        assert (coded.get(i) == values).all() and (coded.find(values.astype(np.uint64)) == i).all()
        other = np.setdiff1d(rng.integers(0, universe, 500), values)
        assert (coded.find(other.astype(np.uint64)) == -1).all()
    pointers = np.array([0, 0, 3, 3, 3, 9])
    assert (ngram_trie.EliasFano.write(pointers, 10, str(tmp_path), "pointers").get(np.arange(6)) == pointers).all()


def slow_scores(rows, is_train):
    texts = [((t or "").encode().lower().split()) + ["end"] for _, t, *_ in rows]
    one, two = Counter(), Counter()
    for (doc_id, *_), w in zip(rows, texts, strict=True):
        if is_train(doc_id):
            one.update(w)
            two.update(zip(["start", *w], w))
    n, v = sum(one.values()), len(one)
    before = Counter(one) + Counter({"start": one["end"]})
    for (doc_id, *_), w in zip(rows, texts, strict=True):
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10((two[(a, x)] + 100 * (one[x] + 1) / (n + v + 1)) / (before[a] + 100)) for a, x in zip(["start", *w], w))
        yield doc_id, not is_train(doc_id), len(w), sum(one[x] > 0 for x in w), n, base, score


def test_scores_match_brute_force(messy, messy_rows, nothing, monkeypatch):
    monkeypatch.setattr(ngram_trie, "BLOCK_BYTES", 20_000)
    want = sorted(slow_scores(messy_rows, lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2), key=repr)
    for shard_tokens in (ngram_trie.SHARD_TOKENS, 3_000):
        got = ngram_trie.score_texts(messy, held_out("doc_id", 7, 2), shard_tokens=shard_tokens).collect()
        got = sorted((tuple(r) for r in got), key=repr)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-12)
        assert max(abs(g[6] - w[6]) / w[2] for g, w in zip(got, want, strict=True)) < 1e-3
    assert ngram_trie.score_texts(nothing, held_out("doc_id", 7, 2)).count() == 0
    none = ngram_trie.score_texts(messy, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.held_out for r in none)


def test_answers_of_shards_stay_below_the_tokens(messy, messy_rows, monkeypatch):
    """Hundreds of shards over a few blocks: a shard answers for documents it met only, and the scores stay the same."""
    monkeypatch.setattr(ngram_trie, "BLOCK_BYTES", 60_000)
    rows = messy.select(F.col("doc_id").alias("id"), "text", held_out("doc_id", 7, 2).alias("held_out"))
    sums, n, _ = ngram_trie.shard_sums(rows, shard_tokens=120)
    tokens = sum(len((t or "").split()) + 1 for _, t, *_ in messy_rows)
    found = sums.collect()
    heads, answers = [r for r in found if r.n_tokens is not None], [r for r in found if r.n_tokens is None]
    assert sum(len(r.ids) for r in heads) == len(messy_rows) and len(heads) == len({r.block for r in found}) < 20 < len(answers)
    entries = [len(r.docs) // 2 for r in answers]
    assert sum(entries) <= tokens and all(len(r.score) == len(r.base) == 8 * k and len(r.known) == 4 * k for r, k in zip(answers, entries, strict=True))
    assert min(entries) > 0 and 0 < n <= tokens
    got, want = (
        sorted((tuple(r) for r in ngram_trie.score_texts(messy, held_out("doc_id", 7, 2), shard_tokens=k).collect()), key=repr) for k in (120, 10**6)
    )
    assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-3)


def quality_rows(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    for i in range(n):
        good = rng.random() < 0.8
        body = [word() for _ in range(rng.randint(20, 120))]
        yield i, " ".join(body) + "." if good else " ".join(w.upper() + rng.choice(["!!", "***", "$$$"]) for w in body), int(good)


def test_held_out_accuracy(spark):
    rows = list(quality_rows(1200))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2], "doc_id long, quality int")
    model = pu_quality.fit_model(docs, labels, ~held_out("id", 3, 1))
    assert 0.65 < model.prior < 0.95
    scored = docs.select("doc_id", pu_quality.score_column(F.col("text"), model).alias("score")).collect()
    truth = {r[0]: r[2] for r in rows}
    unseen = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in unseen]) > 0.97
    assert all(0 <= r.score <= 1 for r in scored)


def test_labels_of_zero_and_held_out_labels_change_nothing(spark):
    rows = list(quality_rows(300))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    some = [(r[0], r[2]) for r in rows if r[2]]
    changed = [(i, 0 if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in some] + [(r[0], 0) for r in rows if not r[2]]
    models = [
        pu_quality.fit_model(docs, spark.createDataFrame(x, "doc_id long, quality int"), ~held_out("id", 3, 1)) for x in (some, changed)
    ]
    assert np.allclose(models[0].weights, models[1].weights)


def test_quality_of_messy_and_empty_tables(spark, messy, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = pu_quality.fit_model(messy, none, ~held_out("id", 3, 1))
    assert model is None
    assert {r.s for r in messy.select(pu_quality.score_column(F.col("text"), model).alias("s")).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (5, None, None)], none.schema)
    model = pu_quality.fit_model(messy, labels, ~held_out("id", 3, 1))
    scores = [r.s for r in messy.select(pu_quality.score_column(F.col("text"), model).alias("s")).collect()]
    assert len(scores) == messy.count() and all(0 <= s <= 1 for s in scores)
    assert nothing.select(pu_quality.score_column(F.col("text"), model).alias("s")).count() == 0
