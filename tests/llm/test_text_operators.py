"""Operators 1, 2, 4, 5, 6, 7, 8, 10 against plain versions on a table with odd rows."""

import base64
import collections
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from vitrine.llm import arrow_output, byte_bpe, chunks, histogram_shards, packing, quality, simhash, suffix_dedup, suffix_sort, suffix_tree_lm
from vitrine.llm.common import bucketed
from vitrine.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# operator 1


def check_repeats(spark, rows, docs, length=200, **options):
    found = suffix_dedup.repeats(docs, length=length, **options).collect()
    want = brute.repeats([(r[1] or "").encode() for r in rows], length)
    expected = collections.Counter((r[0], len((r[1] or "").encode()), tuple(s), k) for r, (s, k) in zip(rows, want))
    assert collections.Counter((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in found) == expected
    return want


def test_repeats(spark, rows, docs, none):
    want = check_repeats(spark, rows, docs)
    assert sum(e - s for spans, _ in want for s, e in spans) > 1000
    assert suffix_dedup.repeats(none).count() == 0


def test_repeats_with_groups_that_no_task_may_gather(spark, rows, docs):
    check_repeats(spark, rows, docs, group=1)


def test_repeats_of_common_lines_and_short_windows(spark):
    rng = random.Random(9)
    line = "the very same line of text that many documents share, "
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))) + line * rng.randint(1, 3) + "".join(rng.choice("abc ") for _ in range(rng.randint(0, 90))) for _ in range(60)]
    texts += ["a" * 300, "ab" * 200, "aab" * 100]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for group in (20000, 2):
        check_repeats(spark, rows, docs, 50, gram=16, group=group)


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    rng = random.Random(4)
    a = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, a), (2, "".join(rng.choice("abcdefgh ") for _ in range(3000)) + a[100:4900])]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 2], pa.int32()), pa.array([r[1] for r in rows])], names=["h", "g", "text"])
    found = pa.Table.from_batches(suffix_dedup._anchor_rows(iter([batch]), 200, 32)).to_pylist()
    for doc, (_, text) in enumerate(rows, 1):  # every window belongs to one anchor
        starts = [s for r in found if r["h"] == doc for s in range(r["place"] - r["left"], r["place"] + r["right"] - 199)]
        assert sorted(starts) == list(range(len(text) - 199))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 3 for x in b)), max_size=40))
def test_sorting(strings):
    order, shared = suffix_sort.sort_strings(strings)
    assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
    for i in range(1, len(order)):
        a, b = strings[order[i - 1]], strings[order[i]]
        n = shared[i]
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


# operator 2


def test_language_model(spark, rows, docs, none):
    learn = (F.col("doc_id") % 4 != 0) & F.col("doc_id").isNotNull()
    found = suffix_tree_lm.score_texts(docs, learn).collect()
    data = [(r[0], r[1] or "", r[0] is not None and r[0] % 4 != 0) for r in rows]
    want = collections.Counter()
    for (key, _, _), (tokens, known, total, score) in zip(data, brute.base_scores(data)):
        want[key, tokens, known, total, round(score, 6)] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    assert all(r["score"] <= 1e-9 for r in found)
    assert suffix_tree_lm.score_texts(none, F.lit(True)).count() == 0
    untrained = suffix_tree_lm.score_texts(docs, F.lit(False)).collect()
    assert all(r["base_score"] == r["score"] == 0 for r in untrained)


def test_language_model_learns_contexts(spark):
    rng = random.Random(8)
    follow = {w: rng.sample("abcdefghij", 2) for w in "abcdefghij"}
    texts = []
    for _ in range(400):
        out = [rng.choice("abcdefghij")]
        for _ in range(60):
            out.append(rng.choice(follow[out[-1]]))
        texts.append(" ".join(out))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sums = suffix_tree_lm.score_texts(docs, F.col("doc_id") % 4 != 0).where("doc_id % 4 = 0").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert sums[2] / sums[0] > -0.40 and sums[1] / sums[0] < -0.85  # a choice of two against one of ten


# operators 4 and 5


def test_language_model_keeps_contexts_of_a_large_corpus(spark):
    # "mu nu" occurs 12 times among 1.2 million tokens: once a share of the corpus, now a number of occurrences
    rows = [(i, "filler " * 20_000) for i in range(60)] + [(100 + i, "mu nu") for i in range(13)] + [(200, "xi nu")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in suffix_tree_lm.score_texts(docs, F.col("doc_id") < 112).where("doc_id >= 112").collect()}
    # after "mu", "nu" has (12 - 0.75) / 12 and more: its part of the score is almost 0
    assert found[112]["score"] > found[112]["base_score"] + 4 and found[200]["score"] < -9


def test_word_hashes():
    texts = ["", "A b  a\n", "Äb äB", "\x0b\x0c", "x" * 3000, "a\x00b \x00 a"]
    found, sizes = suffix_tree_lm.word_hashes(texts)
    want = [[*brute.words(t), None] for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    names = {}
    for h, w in zip(found.tolist(), [w for x in want for w in x]):
        assert names.setdefault(h, w) == w
    assert len(names) == len(set(names.values())) == len({w for x in want for w in x})


@pytest.mark.parametrize(("depth", "least", "chars"), [(3, 2, 4_000_000), (5, 3, 2_000)])
def test_language_model_equals_a_plain_tree(spark, docs, rows, depth, least, chars):
    learn = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    found = suffix_tree_lm.score_texts(docs, learn, depth=depth, least=least, chunk_chars=chars).collect()
    data = [(r[0], r[1] or "", r[0] is None or r[0] % 3 != 0) for r in rows]
    want = sorted((r[0] or -1, len(brute.words(r[1])) + 1, score) for r, score in zip(data, brute.tree_scores(data, depth, least)))
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["score"]) for r in found)
    assert [w[:2] for w in want] == [g[:2] for g in got]
    # a token's logarithm is rounded once for each length
    assert all(abs(w[2] - g[2]) <= w[1] * depth / 2 / suffix_tree_lm.LOG_STEPS + 1e-9 for w, g in zip(want, got))
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found) + 1000


def test_language_model_knows_texts_that_occur_twice(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:10]])), "doc_id long, text string")
    found = {r["doc_id"]: r["score"] / r["n_tokens"] for r in suffix_tree_lm.score_texts(docs, F.lit(True)).collect()}
    assert min(found[i] for i in range(10)) > -1 > -1.5 > max(found[i] for i in range(10, 60))


def test_packing(spark, rows, docs, none, tokenizer):
    found = packing.pack(docs, PATH, capacity=256).collect()
    want = collections.Counter()
    for key, text in ((r[0], r[1] or "") for r in rows):
        want[key, tuple(tokenizer.encode(text, add_special_tokens=False).ids + [1])] += 1
    pieces = collections.defaultdict(list)
    for r in found:
        ids = tuple(np.frombuffer(r["ids"], dtype="<u4").tolist())
        assert len(ids) == r["length"]
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
    for (key, n), got in pieces.items():
        same = [(i, c) for (k, i), c in want.items() if k == key and len(i) == n]
        assert collections.Counter(got) == sum((collections.Counter({p: c for p in _cut(i, got)}) for i, c in same), collections.Counter()) or _covers(got, same)
    assert {k for k, _ in want} == {k for k, _ in pieces}
    sequences = brute.grouped([r.asDict() for r in found], "sequence_id").values()
    for s in sequences:
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256 and (at == 256 or at & at - 1 == 0)
    assert packing.pack(none, PATH).count() == 0


def _cut(ids, got):
    return [(s, p) for s, p in got if ids[s : s + len(p)] == p]


def _covers(got, same):
    """Whether pieces make up the documents as often as they occur."""
    total = sum(len(i) * c for i, c in same)
    return sum(len(p) for _, p in got) == total and all(any(i[s : s + len(p)] == p for i, _ in same) for s, p in got)


def test_closest_fill_is_the_best_subset_sum():
    rng = random.Random(1)
    for _ in range(200):
        counts = collections.Counter(rng.randint(1, 40) for _ in range(rng.randint(0, 8)))
        room = rng.randint(0, 80)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        chosen, slack = packing.closest_fill(counts, room)
        assert slack == room - max(sums) and sum(x * k for x, k in chosen.items()) == max(sums)
        assert all(k <= counts[x] for x, k in chosen.items())


def test_remainders_without_a_partner_do_not_pile_up(monkeypatch):
    monkeypatch.setattr(packing, "BATCH_PIECES", 50)
    monkeypatch.setattr(packing, "MOST_WAITING", 120)
    packer, most = packing._Packer(2048, 0), 0
    for i in range(2000):
        packer.add(i, bytes(4 * 1500))
        if packer.fresh >= 50:
            packer.fill()
        most = max(most, packer.held)
    packer.close()
    lengths = collections.Counter()
    for row in packer.rows:
        lengths[row[5]] += row[2]
    assert most <= 170 and sum(r[2] for r in packer.rows) == 3_000_000
    assert sum(n != 2048 for n in lengths.values()) <= 11 and all(n & n - 1 == 0 for n in lengths.values())


def test_special_tokens_are_ordinary_text(tokenizer):
    text = "a <|endoftext|> b"
    found = np.frombuffer(chunks.library_encoder(PATH).encode([text])[0], dtype="<u4").tolist()
    assert found == tokenizer.encode(text, add_special_tokens=False).ids and 50256 not in found
    assert Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids == [64, 220, 50256, 275]  # the difference that README states


def test_arrow_files(spark, rows, docs, none, tokenizer):
    manifest = arrow_output.write_sequences(docs, PATH, length=64)
    found = sorted(arrow_output.read_documents(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    at = 0
    for r in found:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    want = collections.Counter((r[0], brute.crc(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in rows)
    assert collections.Counter((r["doc_id"], zlib.crc32(r["ids"])) for r in found) == want
    for m in manifest.collect():
        reader = arrow_output.ShardReader(m["folder"], m["name"])
        n = -(-m["ids"] // 64)
        parts = [reader.sequence(i) for i in range(n)]
        assert all(len(ids) == len(mask) == 64 for ids, mask in parts)
        for i, (ids, mask) in enumerate(parts):
            seen, bits = reader.views(i)
            assert (seen == ids).all() and (np.unpackbits(bits, bitorder="little").astype(bool) == mask).all()
            assert not seen.flags.owndata and not bits.flags.owndata and not bits.flags.writeable
        flat, mask = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        assert mask.sum() == m["ids"] and mask[: m["ids"]].all()
        assert flat[: m["ids"]].astype("<u4").tobytes() == reader.span(0, m["ids"])
    assert arrow_output.read_documents(arrow_output.write_sequences(none, PATH)).count() == 0


# operator 6


def test_shards(spark, rows, docs, none):
    found = histogram_shards.shard_rows(docs, 5).collect()
    assert collections.Counter((r["row"]["doc_id"], r["row"]["text"]) for r in found) == collections.Counter((r[0], r[1]) for r in rows)
    for shard in brute.grouped([r.asDict() for r in found], "shard").values():
        assert sorted(r["slot"] for r in shard) == list(range(len(shard)))
    assert all(r["size"] == len((r["row"]["text"] or "").encode()) + 16 for r in found)
    assert histogram_shards.shard_rows(none).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_shard_sizes(spark, hot):
    text = F.when(F.col("id") % 3 == 0, "a third of all rows are equal") if hot else F.lit(None)
    df = spark.range(30000).select(F.when(F.lit(hot), F.lit(5)).otherwise(F.col("id")).alias("doc_id"), F.coalesce(text, F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("text"))
    sizes = [r["b"] for r in histogram_shards.shard_rows(df, 7).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 0.002 * sum(sizes) / 7 + 2 * 66


# operator 7


def test_quality_scores_equal_a_plain_discriminant(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join("word" * rng.integers(1, 4) + "s" * rng.integers(0, 3) for _ in range(rng.integers(5, 90))) + "!" * (i % 7) for i in range(260)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 < 4)) for i in range(260)], "doc_id long, quality int")
    stats = quality.with_statistics(table)
    model = quality.fit(quality.training_rows(stats, labels, F.col("doc_id") % 5 != 0), "label", 0.5, 0.01)
    found = {r["doc_id"]: r["score"] for r in quality.scored(stats, model).collect()}
    want = brute.discriminant([quality.statistics(t) for t in texts], [int(i % 7 < 4) if i % 5 else None for i in range(260)], 0.5, 0.01)
    assert max(abs(found[i] - w) for i, w in enumerate(want)) < 1e-6


def test_quality(spark, docs, none):
    rng = random.Random(2)
    good = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 300))) + "." for _ in range(300)]
    bad = [t.upper().replace(" ", "!! ") if i % 2 else " ".join([t.split()[0]] * 50) for i, t in enumerate(good[:100])]
    data = [(i, t) for i, t in enumerate(good + bad)]
    table = spark.createDataFrame(data, "doc_id long, text string").unionByName(docs.select("doc_id", "text").withColumn("doc_id", F.lit(None).cast("long")))
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(400)] + [(1, None), (2, 5), (2, 1)], "doc_id long, quality int")
    stats = quality.with_statistics(table)
    model = quality.fit(quality.training_rows(stats, labels, F.col("doc_id") % 5 != 0), "label")
    found = quality.scored(stats, model).collect()
    assert len(found) == table.count() and all(0 <= r["score"] <= 1 for r in found)
    held = [(r["score"] >= 0.3) == (r["doc_id"] < 300) for r in found if r["doc_id"] is not None and r["doc_id"] % 5 == 0]
    assert sum(held) / len(held) > 0.97
    kept = quality.accepted(table, labels, F.col("doc_id") % 5 != 0)
    assert kept.columns == table.columns and kept.where("doc_id >= 300").count() <= 3 and kept.where("doc_id < 300").count() >= 290
    assert quality.with_statistics(none).count() == 0
    assert quality.accepted(none, labels, F.lit(True)).count() == 0


# operator 8


def test_simhash(spark, rows, docs, none):
    found = simhash.near_duplicates(docs).collect()
    prints = [(r[0], brute.fingerprint(r[1])) for r in rows]
    sets = brute.Sets()
    different = sorted({fp for _, fp in prints})
    for i, a in enumerate(different):
        for b in different[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                sets.join(a, b)
    least = {}
    for key, fp in prints:
        root = sets.root(fp)
        least[root] = min((x for x in (least.get(root), key) if x is not None), default=None)
    want = collections.Counter((key, fp, least[sets.root(fp)]) for key, fp in prints)
    assert collections.Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component"]) for r in found) == want
    assert simhash.near_duplicates(none).count() == 0


def test_one_of_each_group_of_similar_texts(spark, rows, docs, none):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(brute.similar_groups([r[1] or "" for r in rows])))
    assert simhash.one_of_each(none).count() == 0


@pytest.mark.parametrize("limit", [2048, 4])
def test_edited_copies_are_grouped_by_similarity(spark, limit):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    texts = []
    for _ in range(40):
        own = [rng.choice(words) for _ in range(rng.randint(60, 500))]
        texts.append(" ".join(own))
        for share in (0.003, 0.006, 0.01, 0.015, 0.02, 0.03, 0.05, 0.1):  # similarities from 0.98 down to 0.4
            texts.append(" ".join(rng.choice(words) if rng.random() < share else w for w in own))
    want = brute.similar_groups(texts)
    staged, _ = bucketed(spark.createDataFrame(list(enumerate(texts)), "row long, text string"), "texts", "row")
    found = {r["row"]: r["root"] for r in simhash.similar_groups(staged, limit=limit).collect()}
    missed = sum(want[i] != found[i] for i in range(len(texts)) if i in found)
    assert 45 < len(set(want)) < 300 and missed <= 1  # a pair at the threshold may share no shard


@pytest.mark.parametrize("limit", [4096, 3])
def test_bk_tree_shards_lose_no_link(spark, limit):
    rng = random.Random(3)
    values = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(15):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    want, got = brute.Sets(), brute.Sets()
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                want.join(a, b)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    for r in simhash.linked(spark.createDataFrame(signed, "fp long"), 4, limit).collect():
        got.join(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1)
    assert [want.root(v) for v in values] == [got.root(v) for v in values]


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    sets = brute.Sets()
    for a, b in edges:
        sets.join(a, b)
    found = components(spark.createDataFrame(edges + [(7, None)], "a long, b long")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in found} == {x: sets.root(x) for x in linked} and len(found) == len(linked)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_id_names_with_a_space(spark, docs):
    some = docs.limit(5).withColumnRenamed("doc_id", "my id")
    assert byte_bpe.decode(byte_bpe.encode(some, RANKS, public_tokenizers.PATTERN, "my id"), RANKS, public_tokenizers.PATTERN, "my id").columns[0] == "my id"
    assert packing.pack(some, PATH, id_col="my id").select("my id").count() >= 5
    assert simhash.with_fingerprints(some, id_col="my id").count() == 5 and quality.with_statistics(some, id_col="my id").count() == 5


# operator 10


def test_bpe(spark, rows, docs, none, reference):
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    want = collections.Counter((r[0], tuple(reference.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in back) == want
    assert byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t\r\x1c\x85 　abcteh'sS12!?éß漢😀")), max_size=40))
def test_ids_equal_the_libraries(text):
    _, memo, _ = byte_bpe.loaded(RANKS, public_tokenizers.PATTERN)
    if not hasattr(test_ids_equal_the_libraries, "made"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
        library = Tokenizer.from_file(PATH)
        library.encode_special_tokens = True
        test_ids_equal_the_libraries.made = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), library
    reference, library = test_ids_equal_the_libraries.made
    assert np.frombuffer(memo.encode([text])[0], dtype="<u4").tolist() == reference.encode_ordinary(text)
    assert np.frombuffer(chunks.library_encoder(PATH).encode([text])[0], dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_each_different_chunk_of_a_batch_is_looked_up_once(tokenizer):
    """400 texts of 500 words, of which 50 differ; before, each word was looked up, twice where a text had a new one."""
    seen = []
    encoder = chunks.ChunkEncoder(chunks.library_encoder(PATH).encode_parts, chunks.library_encoder(PATH).encode_text)

    class Counted(type(encoder.memo)):
        def get(self, key, *other):
            seen.append(key)
            return super().get(key, *other)

        def __getitem__(self, key):
            seen.append(key)
            return super().__getitem__(key)

    encoder.memo = Counted()
    texts = [" ".join(f"w{(i * j) % 50}," for j in range(500)) for i in range(400)]
    found = encoder.encode(texts)
    assert len(seen) < 1000
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in found[:3]] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[:3]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["the", "Éa", "x!", "x", "\n", "\n\n", " ", "\t", "\tab", "it's", "漢字", "😀.", "y" * 70, "y" * 70 + ".", "\u2009" + "z" * 70, "\x00", "12"]), max_size=12).map(" ".join), max_size=8))
def test_batches_of_texts_equal_the_library(texts):
    """Mixed batches, as a list and as a column, with a memo of two halves that is full after three chunks."""
    made = chunks.library_encoder(PATH)
    encoder = chunks.ChunkEncoder(made.encode_parts, made.encode_text, entries=3)
    want = [made.encode_text(t).tolist() for t in texts]
    for given_as in (texts, pa.array(["other", *texts], pa.string())[1:], pa.array(texts, pa.large_string())):
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode(given_as)] == want
    assert all(len(c) <= chunks.MEMO_CHARS for c in {**encoder.memo, **encoder.older})


def test_a_column_is_encoded_in_pieces_of_bounded_bytes():
    texts = pa.array(["é" * n for n in (0, 3, 50, 1, 1, 0, 200, 2, 0)])
    found = list(chunks.pieces(texts, 100))
    assert [i for a, b in found for i in range(a, b)] == list(range(9))
    assert all(sum(len(t.as_py().encode()) for t in texts[a : b - 1]) < 100 for a, b in found) and found[0] == (0, 3)
    assert list(chunks.pieces(texts[:0])) == [] and list(chunks.pieces(texts[5:6])) == [(0, 1)]
