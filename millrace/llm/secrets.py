"""Operator 3: secrets, with structural confirmation.

Base spans come from three plain patterns.  Besides, every base64 or hex candidate is decoded and reported only if
the bytes parse as what they claim to be: a signed token whose header is a JSON object with an algorithm (or an
encrypted one of five parts), an ASN.1 key whose lengths agree at every depth, an SSH key of length-prefixed fields, or
an armoured key block around one of these.  Of candidates that overlap, the more structured kind is reported.

All passes are linear in the text's length; texts are read whole.  A null or empty text has no spans.  Repeated rows
are judged alike, each by itself; an empty table gives no rows.  Input columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import documents
from .pii import digest
from .spans import SPAN_TYPE, to_arrow

KINDS = ("assign", "access", "hex", "armour", "token", "der", "sshkey")
_ASSIGN = re.compile(r"(?ai:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]*+)-----END \1-----")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,4}+")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9a-f]{64,}|[0-9A-F]{64,})(?![0-9A-Fa-f])")


def _decode64(text: str) -> bytes | None:
    text = re.sub(r"[\s=]+", "", text).replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(part: str) -> dict | None:
    try:
        found = json.loads((_decode64(part) or b"").decode())
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_signed_token(header: str, body: str, signature: str) -> bool:
    """A header that names its algorithm, a body that is a JSON object, and a signature (none if the algorithm is none)."""
    head = _object(header)
    if head is None or not isinstance(head.get("alg"), str):
        return False
    if not signature and head["alg"].lower() != "none":
        return False
    return _object(body) is not None and (not signature or _decode64(signature) is not None)


def is_encrypted_token(parts: list[str]) -> bool:
    """Five parts: a header that names both algorithms, a key (may be empty), and a vector, a text and a tag."""
    head = _object(parts[0])
    named = head is not None and isinstance(head.get("alg"), str) and isinstance(head.get("enc"), str)
    return named and all(_decode64(x) is not None for x in parts[1:]) and all(parts[2:])


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first content byte, end) of the ASN.1 element at a place, if its length fits."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end:
            return None
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The ASN.1 elements that fill a range, or None if they do not."""
    out = []
    while at < end:
        part = _tlv(data, at, end)
        if part is None:
            return None
        out.append(part)
        at = part[2]
    return out


def is_asn1_key(data: bytes) -> bool:
    """A sequence that fills the bytes, whose constructed elements are filled at every depth, led by a version or a key
    algorithm, with key material."""
    top = _elements(data, 0, len(data))
    if top is None or len(data) < 24 or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = _elements(data, *top[0][1:])
    if parts is None:
        return False
    todo = [p for p in parts if p[0] & 0x20]
    while todo:
        inner = _elements(data, *todo.pop()[1:])
        if inner is None:
            return False
        todo += [p for p in inner if p[0] & 0x20]
    tags, longest = [p[0] for p in parts], max((p[2] - p[1] for p in parts), default=0)
    return len(tags) >= 2 and tags[0] in (0x02, 0x30) and longest >= 16 and bool({0x02, 0x03, 0x04} & set(tags[1:]))


def _field(data: bytes, at: int) -> tuple[bytes, int] | None:
    """(a field led by its four-byte length, its end)."""
    end = at + 4 + int.from_bytes(data[at : at + 4], "big")
    return (data[at + 4 : end], end) if at + 4 <= len(data) and end <= len(data) else None


def _fields(data: bytes) -> list[bytes] | None:
    """The fields that fill the bytes."""
    at, out = 0, []
    while at < len(data):
        got = _field(data, at)
        if got is None:
            return None
        out.append(got[0])
        at = got[1]
    return out


_SSH_TYPE = re.compile(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+\Z")
_SSH_MAGIC = b"openssh-key-v1\0"


def _is_ssh_public(data: bytes) -> bool:
    fields = _fields(data)
    return fields is not None and len(fields) >= 2 and _SSH_TYPE.match(fields[0]) is not None


def _is_ssh_private(data: bytes) -> bool:
    """Behind the magic: cipher, key derivation and its options, a number of public keys, that many of them, and one
    private part, which fill the bytes; the two check numbers of a part that is not encrypted agree."""
    at, head = len(_SSH_MAGIC), []
    for _ in range(3):
        got = _field(data, at)
        if got is None:
            return False
        head.append(got[0])
        at = got[1]
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not head[0].isascii() or not head[0] or not 1 <= count <= len(data):
        return False
    for _ in range(count):
        got = _field(data, at)
        if got is None or not _is_ssh_public(got[0]):
            return False
        at = got[1]
    got = _field(data, at)
    if got is None or got[1] != len(data) or len(got[0]) < 8:
        return False
    return head[0] != b"none" or got[0][:4] == got[0][4:8]


def is_ssh_key(data: bytes) -> bool:
    """A private key behind its magic, or a public one: fields that fill the bytes, of which the first names a key type."""
    return _is_ssh_private(data) if data.startswith(_SSH_MAGIC) else _is_ssh_public(data)


def _confirmed(data: bytes | None) -> str | None:
    if not data or len(data) < 24:
        return None
    if data[0] == 0x30 and is_asn1_key(data):
        return "der"
    return "sshkey" if (data[:4] == b"\0\0\0\x07" or data[:3] == b"\0\0\0" or data[:4] == b"open") and is_ssh_key(data) else None


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """All spans of a text, as (kind, start, end, base), by start and then kind."""
    if not text:
        return []
    found = [("assign", m.start(), m.end(), True) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [("access", m.start(), m.end(), True) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    found += [("hex", m.start(), m.end(), True) for m in _HEX.finditer(text)]
    inside: list[tuple[int, int]] = []  # what is reported already: in order, without overlaps

    def add(kind: str, start: int, end: int) -> None:
        k = bisect_left(inside, (start, start))
        if (k == 0 or inside[k - 1][1] <= start) and (k == len(inside) or end <= inside[k][0]):
            inside.insert(k, (start, end))
            found.append((kind, start, end, False))

    if "PRIVATE KEY-----" in text:
        for m in _ARMOUR.finditer(text):
            data = _decode64(m[2])
            if data and (is_asn1_key(data) or is_ssh_key(data)):
                add("armour", *m.span())
    if "eyJ" in text:
        for m in _TOKEN.finditer(text):
            parts = m[0].split(".")
            if len(parts) == 5 and is_encrypted_token(parts):
                add("token", *m.span())
            elif is_signed_token(*parts[:3]):
                add("token", m.start(), m.start() + len(".".join(parts[:3])))
    for m in _BASE64.finditer(text):
        if kind := _confirmed(_decode64(m[0])):
            add(kind, *m.span())
    for m in _LONG_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := _confirmed(bytes.fromhex(m[0]))):
            add(kind, *m.span())
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


@arrow_udf(SPAN_TYPE)
def secret_spans(text: pa.Array) -> pa.Array:
    """Spans of secrets in a text column."""
    return to_arrow([find(t.as_py()) for t in text])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and the spans of secrets in its text."""
    return docs.select(F.col(id_col), secret_spans(F.col(text_col)).alias("found"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of ``documents``."""
    return digest(find_secrets(documents(spark, sf_dir)), KINDS[:3])
