"""Operators 11 to 13 against plain versions."""

import base64
import collections
import hashlib
import heapq
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tables import SF
from vitrine.llm import conversation_repair, queries, ranked_search, secret_scan

# operator 11

ROWS = "conv_id long, turn long, role string, text string, c string, n int, gone string, cost long, edits string"
BLANK = " \t\n\x0b\x0c\r"


def initials_fit(roles):
    return re.fullmatch(r"(s?(ua)+)?", "".join(x[:1] or "-" for x in roles)) is not None


def faults_of(rows):
    """Rows (turn, role, text) in order -> the first fault of each."""
    seen, out = set(), []
    for _, role, text in rows:
        kept = text.rstrip(BLANK)
        out.append("b" if not kept else "d" if (role, text) in seen else "t" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, lines) by a uniform-cost search over (cost, audit): the first end that it takes out is the answer."""
    steps = {0: "u", 1: "u", 2: "a", 3: "u"}
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    name = {"u": "user", "a": "assistant"}
    queue, best = [(0, "", 0, 0, ())], {}
    while queue:
        cost, audit, i, q, lines = heapq.heappop(queue)
        if i == len(rows) and q in (0, 3):
            return cost, audit, lines
        if (i, q) in best:
            continue
        best[i, q] = cost
        push = lambda *x: heapq.heappush(queue, x)
        push(cost + 5, audit + "I", i, after[q, steps[q]], (*lines, f"{name[steps[q]]}:"))
        if i < len(rows):
            _, role, text = rows[i]
            push(cost + 2, audit + "D", i + 1, q, lines)
            if faults[i] not in ("b", "d"):
                more = 5 if faults[i] == "t" else 0
                if (q, role[:1]) in after:
                    push(cost + more, audit + "K", i + 1, after[q, role[:1]], (*lines, f"{role}:{text}"))
                push(cost + more + 1, audit + "R", i + 1, after[q, steps[q]], (*lines, f"{name[steps[q]]}:{text}"))


def damage(rows):
    """(conversation, turn, role, text) -> rows by conversation, after the contract's damage."""
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        out[conv] += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, rs in out.items()}


def repaired(conversations):
    out = {}
    for conv, rows in conversations.items():
        faults = faults_of(rows)
        cost, audit, lines = cheapest(rows, faults)
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        counts = [faults.count(x) for x in "bdt"]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(rng, n):
    """Conversations of all sorts, among them long ones, null ids and turns, odd roles, repeated rows and blank texts."""
    rows = []
    for conv in [None, *range(n)]:
        long = 60 if conv in (3, 4) else 9
        for turn in range(rng.randint(1, long)):
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", "u", None]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(["", " \t\n", None, "no end", "end. ", "漢字。", "Why?\n", "x" * 3000 + "!"]) if rng.random() < 0.4 else f"Text {rng.randint(0, 40)}."
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 2]), role, text))
    return rows


@pytest.mark.parametrize("block", [256, 7, 1])
def test_repair(spark, block):
    rows = conversations(random.Random(block), 60)
    df = spark.createDataFrame([(*r, "x", 1, "g", 2, "e") for r in rows], ROWS).repartition(3)
    found = conversation_repair.repair(conversation_repair.damaged(df), dropped_rows=conversation_repair.F.col("gone"), block=block).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == repaired(damage(rows)) and len(found) == 61


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], ROWS)
    assert conversation_repair.repair(conversation_repair.damaged(none)).count() == 0


def test_registered_repair(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    found = queries.op11_conversation_repair(spark, SF).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == repaired(damage([tuple(r) for r in rows]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suat"), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=9))
def test_search_is_cheapest_and_first(rows):
    cost, audit, lines = cheapest([(None, r, "") for r, _ in rows], ["\0bdt"[f].strip("\0") for _, f in rows])
    assert conversation_repair.Search(rows, conversation_repair.CLOSED).cheapest(0) == (cost, audit)
    assert initials_fit([x.split(":")[0] for x in lines])


# operator 12


def plain_ranking(docs, items, k=10):
    """docs: (id, text), items: (id, text) -> rows (item, rank, id, score) with every document scored."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bodies = [(i, collections.Counter(split(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in bodies), sum(c.total() for _, c in bodies)
    df = collections.Counter(t for _, c in bodies for t in c)
    out = []
    for item, text in set(items):
        asked, scored = split(text), []
        for doc, c in bodies:
            if c:
                m = 100 - 75 + (75 * c.total() * n) // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked)
                if score > 0:
                    scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_ranked_search(spark, rows, docs, none, block_bytes):
    asked = [(i, r[1]) for i, r in enumerate(rows[:40]) if r[1] and len(r[1]) < 3000] + [(None, rows[5][1]), (7, "nothing like it"), (7, None), (8, "b B 漢字 ß"), (8, "b B 漢字 ß"), (1, "cödé a")]
    items = spark.createDataFrame([(i, t, 1, "r") for i, t in asked], "item_id long, text string, score int, rank string")
    found = ranked_search.search(docs, items, block_bytes=block_bytes).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain_ranking([(r[0], r[1]) for r in rows], [(i, t or "") for i, t in asked])
    assert ranked_search.search(none, items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0


def test_sketches_bound_every_score():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 50, 9000]))) for _ in range(60)]
    asked = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(15)]
    total = sum(len(t.split()) for t in texts)
    df = collections.Counter(w for t in texts for w in set(t.encode().split()))
    items = ranked_search.Items(asked, len(texts), df)
    counts = [collections.Counter(ranked_search.terms(t)) for t in texts]
    parts = [ranked_search.length_part(c.total(), len(texts), total) for c in counts]
    sketch = ranked_search.sketches(counts, parts, ranked_search._Coordinates())
    for item, bound in items.bounds(sketch):
        assert all(bound[d] >= items.score(item, counts[d], parts[d]) for d in range(len(texts)))
    best = ranked_search.Best(len(asked), 3)
    needed = ranked_search.searched(items, best, list(range(len(texts))), texts, len(texts), total, ranked_search._Coordinates())
    assert needed < len(texts) * len(asked)
    assert np.all([len(k) == 3 for k in best.kept])


# operator 13


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2)) + body


def field(body):
    return len(body).to_bytes(4) + body


def planted(rng):
    """(name, bytes, whether they are a private key)."""
    number = lambda n: der(2, b"\0" + rng.randbytes(n))
    rsa = der(0x30, der(2, b"\0") + number(128) + b"".join(number(64) for _ in range(7)))
    oid = der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01")
    ec = der(0x30, der(2, b"\1") + der(4, rng.randbytes(32)) + der(0xA0, der(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")))
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4) + field(rng.randbytes(51)) + field(rng.randbytes(136))
    return [
        ("rsa", rsa, True),
        ("pkcs8", der(0x30, der(2, b"\0") + der(0x30, oid + der(5, b"")) + der(4, rsa)), True),
        ("encrypted", der(0x30, der(0x30, oid + der(0x30, der(4, b"salt"))) + der(4, rng.randbytes(300))), True),
        ("ec", ec, True),
        ("openssh", ssh, True),
        ("public", der(0x30, der(0x30, oid + der(5, b"")) + der(3, b"\0" + rng.randbytes(140))), False),
        ("cut", rsa[:-3], False),
        ("lengthened", rsa + b"\0", False),
        ("wrong nested length", rsa[:6] + bytes([rsa[6] ^ 1]) + rsa[7:8] + bytes([9]) + rsa[9:], False),
        ("noise", b"\x30\x82" + rng.randbytes(500), False),
    ]


def test_keys_are_confirmed_by_structure():
    rng = random.Random(13)
    for name, data, is_key in planted(rng):
        for sep in ("", "\n", "\r\n", "\\n"):
            flat = base64.b64encode(data).decode()
            body = sep.join(flat[i : i + 64] for i in range(0, len(flat), 64)) if sep else flat
            text = f"é secret -----BEGIN-----{sep}{body}{sep}-----END----- of it"
            at = text.index(body)
            keys = [(s, e) for s, k, e in secret_scan.secrets(text) if k == 3]
            assert keys == ([(at, at + len(body))] if is_key else []), (name, sep)
        for digits in (data.hex(), data.hex().upper()):
            keys = [(s, e) for s, k, e in secret_scan.secrets(f"x {digits} y") if k == 3]
            assert keys == ([(2, 2 + len(digits))] if is_key else []), name


def test_tokens_are_confirmed_by_structure():
    rng = random.Random(14)
    part = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    for alg, n, signed in (("HS256", 32, True), ("HS256", 31, False), ("none", 32, False), ("RS256", 256, True), ("ES512", 132, True), (5, 32, False)):
        token = ".".join([part(json.dumps({"alg": alg}).encode()), part(b'{"sub":"x"}'), part(rng.randbytes(n))])
        found = [(s, e) for s, k, e in secret_scan.secrets(f"Bearer {token}, then") if k == 4]
        assert found == ([(7, 7 + len(token))] if signed else [])
    assert not secret_scan.secrets("eyes.wide.open and ewe.are.here " + part(b"{not json}") + ".a.b")


def plain_base(text):
    out = []
    assign = r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)"
    for m in re.finditer(assign, text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, "assign", m.end()))
    for kind, (name, pattern, least) in enumerate([("access", r"AKIA[A-Z0-9]+", 18), ("hex", r"[0-9a-f]+", 16)], 1):
        out += [(m.start(), kind, name, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [(name, s, e) for s, _, name, e in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "api_key", "APIKEY", "secret", "ſecret", "toKen", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH1234567", "0123456789abcdef", "deadbeef", "é", "\n", "x.y/z-", "MIIB"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert [(secret_scan.KINDS[k], s, e) for s, k, e in secret_scan.secrets(text) if k < 3] == plain_base(text)


def test_scan(spark, rows, docs, none):
    found = secret_scan.scan(docs).collect()
    want = collections.Counter((r[0], tuple((k, s, e) for k, s, e in plain_base(r[1] or ""))) for r in rows)
    assert collections.Counter((r["doc_id"], tuple((x["kind"], x["start"], x["end"]) for x in r["spans"])) for r in found) == want
    assert secret_scan.scan(none).count() == 0


def test_registered_scan(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op13_secret_scan(spark, SF).collect():
        base = plain_base(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[0] == kind for x in base) for kind in ("assign", "access", "hex"))
        shown = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest() and r["spans"] == shown


def test_long_texts_take_linear_time():
    for text in ("MIIE" * 100_000, "MIIE\n" * 50_000, "eyJ" * 60_000 + ".", "\n3082" * 60_000, "token " + " " * 300_000, "AKIA" * 50_000):
        secret_scan.secrets(text)
