"""The registered queries of operators 2 and 4 to 10, with their contracts' columns, against plain versions on the smallest
tables."""

import base64
import collections
import hashlib
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tables import SF
from tokenizers import Tokenizer
from vitrine.llm import queries


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: r["text"] or "" for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_op2(spark, texts):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    want = brute.base_scores([(i, t, not held[i]) for i, t in texts.items()])
    found = {r["doc_id"]: r for r in queries.op2_suffix_tree_lm(spark, SF).collect()}
    assert len(found) == len(texts)
    for (i, _), (n, known, total, score) in zip(texts.items(), want):
        r = found[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], n, known, total) and r["base_score"] == pytest.approx(score, abs=1e-6)
    # learnt texts must be far likelier with their contexts, and held-out ones no worse than by single words
    for part in (True, False):
        score, base, n = (sum(found[i][c] for i in texts if held[i] == part) for c in ("score", "base_score", "n_tokens"))
        assert score / n > base / n - (0.02 if part else -0.1)


def test_op4(spark, texts, library):
    found = queries.op4_packing(spark, SF).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids, at = [*library.encode(text, add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0 and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    used = padded = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else 2048)
    assert used / padded > 0.99


def test_op5(spark, texts, library):
    found, start = {r["doc_id"]: r for r in queries.op5_arrow_output(spark, SF).collect()}, 0
    assert len(found) == len(texts)
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        assert tuple(found[i][c] for c in ("start", "n_tokens", "ids_crc32")) == (start, len(ids), crc(ids))
        start += len(ids)


def test_op6(spark, texts):
    found = queries.op6_sharding(spark, SF).collect()
    sizes = {i: len(t.encode()) + 16 for i, t in texts.items()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in found} == {i: (sizes[i], zlib.crc32(t.encode())) for i, t in texts.items()} and len(found) == len(texts)
    shards = collections.defaultdict(list)
    for r in found:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 40
        shards[r["shard"]].append(r)
    mean = sum(sizes.values()) / 40
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in shards.values())
    assert all(abs(sum(r["size"] for r in rows) - mean) <= 0.001 * mean + 2 * max(sizes.values()) for rows in shards.values())
    order = [texts[r["doc_id"]] for r in sorted(found, key=lambda r: (r["shard"], r["slot"]))]
    assert sum(a != b for a, b in zip(order, order[1:])) == len(set(order)) - 1  # equal texts are neighbours


def test_op7(spark, texts):
    found = {r["doc_id"]: r for r in queries.op7_quality(spark, SF).collect()}
    assert set(found) == set(texts)
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    judged = [i for i in marks if i in found and marks[i] is not None]
    assert np.mean([found[i]["predicted"] == marks[i] for i in judged]) > 0.9


def test_op8(spark, texts):
    prints = {i: brute.fingerprint(t) for i, t in texts.items()}
    sets, ids = brute.Sets(), sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                sets.join(a, b)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash(spark, SF).collect()}
    assert found == {i: (f"{prints[i]:016x}", sets.root(i)) for i in ids}


def test_op9(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    found = collections.defaultdict(list)
    for r in queries.op9_projected_search(spark, SF).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found[r["query_id"]]) + 1
        assert r["score"] == pytest.approx(float(vectors[r["query_id"]] @ vectors[r["vec_id"]]), abs=1e-12)
        found[r["query_id"]].append((-r["score"], r["vec_id"]))
    asked = [i for i in vectors if i % 20 == 0]
    assert sorted(found) == sorted(asked)
    hits = 0
    for q in asked:
        want = sorted((-float(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:20]
        assert found[q] == sorted(found[q]) and len(found[q]) == len(want)
        hits += len({i for _, i in want} & {i for _, i in found[q]})
    assert hits >= 0.9 * sum(min(20, len(vectors) - 1) for _ in asked)


def test_op10(spark, texts):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.op10_byte_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    want = {i: plain.encode_ordinary(t) for i, t in texts.items()}
    assert found == {i: (len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[i].encode())) for i, ids in want.items()}
