"""Secret scans: patterns, and candidates that are decoded and whose structure is confirmed."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_batches, arrow_rows

FLAGS = re.IGNORECASE | re.ASCII
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", FLAGS)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Kinds in the order that breaks ties of start: fixed values.
BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("pem_key", "der_key", "ssh_key", "signed_token")

# Runs are taken whole or not at all (possessive quantifiers), so that a long one costs time in proportion.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----([A-Za-z0-9+/=\s]++)-----END \1-----")
RUN64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}")
RUN16 = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}+")
DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]{20,}+")
SSH_MAGIC = b"openssh-key-v1\x00"
#: Where a key may begin inside a run: sequences of two or three bytes of length, the shortest key, OpenSSH's magic.
BEGIN64 = re.compile("MI[GHIJ]|MC4|b3BlbnNzaC1rZXktdjEA")


def decode64(run: str) -> bytes | None:
    """The bytes of a base64 run of either alphabet, or None."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the items that fill data[start:end] exactly, or None if their lengths don't nest."""
    out = []
    while start < end:
        if start + 2 > end:
            return None
        tag, size, start = data[start], data[start + 1], start + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or start + n > end:
                return None
            size, start = int.from_bytes(data[start : start + n], "big"), start + n
            if size < 0x80:
                return None  # a short length in the long form
        if start + size > end:
            return None
        out.append((tag, start, start + size))
        start += size
    return out


def is_der_key(data: bytes) -> bool:
    """A private key's encoding: one sequence that fills the data, a small version, then a key's parts.

    PKCS#1 has nine integers, SEC1 an octet string after version 1, PKCS#8 an algorithm sequence that starts
    with an object identifier and then an octet string.
    """
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der_items(data, top[0][1], top[0][2])
    if not parts or len(parts) < 2 or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    tags, version = [p[0] for p in parts], data[parts[0][1]]
    if tags == [0x02] * 9:
        return version in (0, 1)
    if version == 1 and tags[1] == 0x04 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return parts[1][2] - parts[1][1] >= 16
    if version in (0, 1) and tags[1:3] == [0x30, 0x04]:
        algorithm = der_items(data, parts[1][1], parts[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06 and parts[2][2] > parts[2][1]
    return False


def _der_size(head: bytes) -> int | None:
    """Bytes of the sequence that ``head`` begins, its header included; None where it begins none."""
    if len(head) < 2 or head[0] != 0x30:
        return None
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or len(head) < 2 + n or head[1] == 0x80:
        return None
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def _ssh_fields(size: int, read: Callable[[int, int], bytes]) -> bool:
    """OpenSSH's private form in ``size`` bytes, of which ``read(at, n)`` gives n: only lengths are read.

    Magic, three length-prefixed strings, a count of keys, then as many strings and one more.
    """
    if read(0, len(SSH_MAGIC)) != SSH_MAGIC:
        return False
    at, fields = len(SSH_MAGIC), 0
    keys, want = None, 3
    while fields < want:
        if at + 4 > size:
            return False
        at += 4 + int.from_bytes(read(at, 4), "big")
        fields += 1
        if at > size:
            return False
        if fields == 3 and keys is None:
            if at + 4 > size:
                return False
            keys = int.from_bytes(read(at, 4), "big")
            at += 4
            if not 1 <= keys <= 16:
                return False
            want = 3 + keys + 1
    return at == size


def is_ssh_key(data: bytes) -> bool:
    return _ssh_fields(len(data), lambda at, n: data[at : at + n])


def key_kind(run: str, start: int) -> int | None:
    """The rank of the kind of key that run[start:] encodes in base64, or None; it is decoded whole only where its lengths fit."""
    body = len(run.rstrip("=")) - start
    if body % 4 == 1:
        return None
    size = body * 3 // 4

    def read(at: int, n: int) -> bytes:
        first = at // 3
        part = run[start + first * 4 : start + min(body, -(-(at + n) // 3) * 4)]
        return (decode64(part) or b"")[at - first * 3 :][:n]

    if _der_size(read(0, 6)) == size:
        return 4 if is_der_key(decode64(run[start:]) or b"") else None
    return 5 if _ssh_fields(size, read) else None


def is_signed_token(header: str, claims: str, signature: str) -> bool:
    """A header object with an algorithm and a claims object, both base64url JSON; signed unless the algorithm is none."""
    parts = []
    for run in (header, claims):
        data = decode64(run)
        try:
            parts.append(json.loads(data.decode()) if data else None)
        except (UnicodeDecodeError, ValueError, RecursionError):
            return False
    if not all(isinstance(p, dict) for p in parts) or not isinstance(parts[0].get("alg"), str):
        return False
    return bool(signature) or parts[0]["alg"].lower() == "none"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the patterns' matches that pass their length."""
    out = []
    if ":" in text or "=" in text:
        out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of candidates whose decoded structure is that of a secret.

    A base64 run may have letters before it (a key=value); only runs that decode as a whole count, or the part
    from where a sequence or the magic begins in base64. Time grows with the text's length, whatever its runs are.
    """
    out = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = decode64("".join(m[2].split()))
            if data and (is_der_key(data) or is_ssh_key(data)):
                out.append((m.start(), 3, m.end()))
    for m in RUN64.finditer(text):
        run = m[0]
        for at in dict.fromkeys((0, *(x.start() for x in BEGIN64.finditer(run)))):
            kind = key_kind(run, at)
            if kind is not None:
                out.append((m.start() + at, kind, m.end()))
                break
    for m in RUN16.finditer(text):
        if len(m[0]) % 2 == 0:
            data = bytes.fromhex(m[0])
            if is_der_key(data):
                out.append((m.start(), 4, m.end()))
            elif is_ssh_key(data):
                out.append((m.start(), 5, m.end()))
    if "eyJ" in text or "ewo" in text or "eyA" in text:
        out += [x for m in DOTTED.finditer(text) for x in _tokens(m[0], m.start())]
    return sorted(out)


def _tokens(run: str, begin: int) -> Iterator[tuple[int, int, int]]:
    """Signed tokens among the parts between a run's dots; each part is decoded at most twice."""
    parts, at, skip = run.split("."), begin, 0
    for i, part in enumerate(parts[:-2]):
        claims, signature = parts[i + 1], parts[i + 2]
        if skip:
            skip -= 1
        elif part[:1] == "e" and len(part) >= 12 and len(claims) >= 4 and is_signed_token(part, claims, signature):
            yield at, 6, at + len(part) + len(claims) + len(signature) + 2
            skip = 2
        at += len(part) + 1


def _named(spans: list[tuple[int, int, int]]) -> str:
    kinds = (*BASE_KINDS, *ADDED_KINDS)
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def secret_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_confirmed, base_sha256, spans) for every row of ``docs`` (doc_id, text).

    Base spans are the matches of three patterns; confirmed ones (kinds ``ADDED_KINDS``) are base64 or hex
    candidates that decode to a private key whose nested lengths fit exactly, or tokens whose header and claims
    parse. ``spans`` lists all as kind:start:end by start, then kind, in code points with the end exclusive.
    Null and empty texts have none; very long ones are scanned whole, in linear time. Repeated rows get equal results; an empty table gives no rows; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("n_confirmed", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, text in arrow_rows(batches, "doc_id", "text"):
                base = base_spans(text or "")
                more = confirmed_spans(text or "")
                kinds = [k for _, k, _ in base]
                yield doc_id, kinds.count(0), kinds.count(1), kinds.count(2), len(more), hashlib.sha256(_named(base).encode()).hexdigest(), _named(sorted(base + more))

        yield from arrow_batches(rows(), schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string")
