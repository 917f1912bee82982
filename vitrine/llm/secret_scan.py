"""Operator 13: secret scans with structural confirmation.

Three base kinds are plain patterns.  Two more kinds are reported only where their structure confirms them: a base64 or
hexadecimal run is decoded and must be a whole private key (``key``: nested DER lengths that fit to the last byte, or
the length-prefixed fields of an OpenSSH key), and a dotted token (``signed``) must have a JSON header that names an
algorithm and a signature of that algorithm's length.  Certificates, public keys, digests and plain identifiers decode
to something else and are left alone.

Each text is scanned by itself, whole, in time that grows with its length: candidates begin where a run begins, and a
key's first bytes say how many characters it has.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.chunks import slices
from vitrine.llm.common import whole_text

KINDS = ("assign", "access", "hex", "key", "signed")
BASE_KINDS = 3

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
#: Longest runs of a class, so that asking for the least length finds what dropping short matches would leave.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

#: First characters of an encoded key: a DER sequence, or the mark of an OpenSSH key.
_BASE64_START = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\n))(?:M[A-P][A-Za-z0-9+/]{2}|b3BlbnNzaC1rZXktdjEA)")
_HEX_START = re.compile(r"(?<![0-9A-Fa-f])(?:30[0-8][0-9A-Fa-f]|6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]763100)")
#: Base64 characters over several lines; line ends may be escaped, as in JSON.
_LINES = re.compile(r"(?:[A-Za-z0-9+/]++(?:[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*+)?+)++={0,2}")
_DIGITS = re.compile(r"[0-9A-Fa-f]++")
_BETWEEN = re.compile(r"[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*")
_TOKEN = re.compile(r"(?:(?<![A-Za-z0-9_-])|(?<=\\n))(e[yw][A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)")

_OPENSSH = b"openssh-key-v1\0"
#: A key's encoding has at most so many bytes; RSA keys of 16,384 bits need under 10,000.
KEY_BYTES = 65_535
#: Bytes of a signature by algorithm; RSA signatures have their modulus' length, 1,024 bits at least.
_SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
_RSA = {"RS256", "RS384", "RS512", "PS256", "PS384", "PS512"}


def _der_head(data: bytes, at: int) -> tuple[int, int] | None:
    """(where the content starts, where it ends) of the DER element at ``at``; None where the length is not definite, not
    the shortest form, or longer than a key's."""
    if at + 2 > len(data):
        return None
    first = data[at + 1]
    if first < 0x80:
        return at + 2, at + 2 + first
    n = first - 0x80
    if n not in (1, 2) or at + 2 + n > len(data):
        return None
    length = int.from_bytes(data[at + 2 : at + 2 + n])
    return (at + 2 + n, at + 2 + n + length) if length >= (0x80, 0x100)[n - 1] else None


def _der_parts(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill ``start`` to ``end``; None where their lengths do not fit exactly."""
    parts = []
    while start < end:
        head = _der_head(data, start)
        if head is None or head[1] > end:
            return None
        parts.append((data[start], *head))
        start = head[1]
    return parts


def _is_der_key(data: bytes) -> bool:
    """Whether DER bytes are one private key: RSA, DSA, elliptic curve, or PKCS 8 plain or encrypted."""
    whole = _der_parts(data, 0, len(data))
    if not whole or len(whole) != 1 or whole[0][0] != 0x30:
        return False
    parts = _der_parts(data, *whole[0][1:])
    if not parts or len(parts) < 2:
        return False
    tags = [p[0] for p in parts]
    first = data[parts[0][1] : parts[0][2]]
    if tags[0] == 0x02 and first in (b"\0", b"\1"):
        if all(t == 0x02 for t in tags[:9]) and len(tags) in (6, 9) or len(tags) == 10 and tags == [0x02] * 9 + [0x30]:
            return parts[1][2] - parts[1][1] >= 64  # a modulus or prime of 512 bits at least
        if tags[1] == 0x04:
            return first == b"\1" and all(t in (0xA0, 0xA1) for t in tags[2:]) and 20 <= parts[1][2] - parts[1][1] <= 66
        if tags[1:3] == [0x30, 0x04] and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:]):
            return _names_algorithm(data, parts[1])
        return False
    return tags == [0x30, 0x04] and _names_algorithm(data, parts[0])


def _names_algorithm(data: bytes, part: tuple[int, int, int]) -> bool:
    """Whether a sequence begins with an object identifier and its other lengths fit."""
    inner = _der_parts(data, part[1], part[2])
    return bool(inner) and inner[0][0] == 0x06 and inner[0][2] > inner[0][1]


def _openssh_end(data: bytes) -> int | None:
    """Where an OpenSSH private key ends: after its mark, three strings, a count, so many public keys, the private part."""
    at = len(_OPENSSH)

    def skipped(at: int | None) -> int | None:
        if at is None or at + 4 > len(data):
            return None
        after = at + 4 + int.from_bytes(data[at : at + 4])
        return after if after <= len(data) else None

    for _ in range(3):
        at = skipped(at)
    if at is None or at + 4 > len(data):
        return None
    keys = int.from_bytes(data[at : at + 4])
    if not 1 <= keys <= 16:
        return None
    at += 4
    for _ in range(keys):
        at = skipped(at)
    before, at = at, skipped(at)
    return at if at is not None and at - before >= 36 else None


def _key_length(data: bytes) -> int | None:
    """Bytes of the key whose encoding begins with ``data``, if its outermost lengths can be read."""
    if data.startswith(_OPENSSH):
        return _openssh_end(data)
    head = _der_head(data, 0) if data[:1] == b"\x30" else None
    return head[1] if head and head[1] <= KEY_BYTES else None


def _confirmed_key(data: bytes) -> bool:
    return data.startswith(_OPENSSH) and _openssh_end(data) == len(data) or _is_der_key(data)


def _base64_key(text: str, start: int) -> int | None:
    """The end of the base64 key that starts at ``start``, or None."""
    head = text[start : start + 8]
    if head[0] == "M":  # the DER length says how many characters there are
        try:
            size = _key_length(base64.b64decode(head + "=" * (-len(head) % 4)))
        except (binascii.Error, ValueError):
            return None
        if size is None:
            return None
        limit = -(-size // 3) * 4
    else:
        size, limit = None, -(-KEY_BYTES // 3) * 4
    # line ends at most every 16 characters
    run = _LINES.match(text, start, min(len(text), start + limit + limit // 2 + 64))
    if run is None:
        return None
    body = run[0]
    kept = _BETWEEN.sub("", body).rstrip("=")
    if size is None:
        raw = base64.b64decode(kept[: len(kept) // 4 * 4])
        size = _key_length(raw) or (_key_length(base64.b64decode(kept + "=" * (-len(kept) % 4))) if len(kept) % 4 != 1 else None)
        if size is None:
            return None
    chars = -(-size * 8 // 6)
    if len(kept) < chars:
        return None
    data = base64.b64decode(kept[:chars] + "=" * (-chars % 4))
    if not _confirmed_key(data):
        return None
    end, left = start, chars
    for part in re.finditer(r"[A-Za-z0-9+/]+|[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*", body):
        if not _BETWEEN.fullmatch(part[0]):
            taken = min(left, len(part[0]))
            left -= taken
            end = start + part.start() + taken
            if not left:
                if taken < len(part[0]):  # the run goes on: not this key's end
                    return None
                break
    for _ in range(-chars % 4):
        end += text[end : end + 1] == "="
    return end


def _hex_key(text: str, start: int) -> int | None:
    """The end of the hexadecimal key that starts at ``start``, or None."""
    run = _DIGITS.match(text, start, min(len(text), start + 2 * KEY_BYTES + 16))
    if run is None or (run.end() - start) % 2:
        return None
    data = bytes.fromhex(run[0])
    return run.end() if _confirmed_key(data) else None


def _decoded(part: str) -> bytes | None:
    """The bytes of an unpadded URL-safe base64 part, if it is one in its only form."""
    if len(part) % 4 == 1:
        return None
    data = base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))
    return data if base64.urlsafe_b64encode(data).rstrip(b"=").decode() == part else None


def _is_signed(header: str, payload: str, signature: str) -> bool:
    """Whether three parts are a signed token."""
    head, signed = _decoded(header), _decoded(signature)
    if head is None or signed is None or _decoded(payload) is None:
        return False
    try:
        fields = json.loads(head)
    except (ValueError, RecursionError):
        return False
    name = fields.get("alg") if isinstance(fields, dict) else None
    if not isinstance(name, str):
        return False
    return len(signed) >= 128 if name in _RSA else len(signed) == _SIGNATURE.get(name)


def secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every span, in order; positions in characters, ends exclusive."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for starts, confirmed in ((_BASE64_START, _base64_key), (_HEX_START, _hex_key)):
        covered = 0
        for m in starts.finditer(text):
            if m.start() >= covered and (end := confirmed(text, m.start())) is not None:
                found.append((m.start(), 3, end))
                covered = end
    found += [(m.start(), 4, m.end()) for m in _TOKEN.finditer(text) if _is_signed(*m.groups())]
    found.sort()
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The secrets of every whole text: (id, spans array<struct<kind, start, end>>), one row for each input row.

    Spans are ordered by start, then by kind as in ``KINDS``; positions are code points, ends exclusive.  A null or empty
    text has none; repeated rows and ids are scanned each for itself; a null id stays null; other columns are not carried.
    The same place may be of several kinds (a password of hexadecimal digits is two).
    """
    type_ = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in secrets(t)] for t in texts[a:b]]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(spans, type_)], names=["id", "spans"])

    kept = docs.select(F.col(f"`{id_col}`").alias("id"), whole_text(f"`{text_col}`").alias("text"))
    found = kept.mapInArrow(run, f"id {dict(kept.dtypes)['id']}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return found.select(F.col("id").alias(id_col), "spans")
