"""Personal data and secrets: base spans against the plain patterns, method spans on made cases."""

import base64
import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pii, secrets

from .edge import SF, edge_docs, empty_docs


def plain_pii(text):
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d[::-1]))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def plain_secrets(text):
    found = [("assign", m.start(), m.end()) for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+_ 0123456789()é%", max_size=60))
def test_personal_base_spans(text):
    assert [x[:3] for x in pii.find(text) if x[3]] == plain_pii(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "API_KEY", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "x", "Secret", "ſecret", "."]), max_size=12).map("".join))
def test_secret_base_spans(text):
    assert [x[:3] for x in secrets.find(text) if x[3]] == plain_secrets(text)


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john.doe [at] example (dot) com now", "email", "john.doe [at] example (dot) com"),
        ("john at example dot com", "email", "john at example dot com"),
        ("write to jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("maria arroba correo punto es", "email", "maria arroba correo punto es"),
        ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("４111 1111 1111 1111", "card", "４111 1111 1111 1111"),
        ("mail user42 at example.com", "email", "user42 at example.com"),
        ("ask john.doe at mail.example.co.uk now", "email", "john.doe at mail.example.co.uk"),
        ("host 192 dot 168 dot 1 dot 1 is up", "ip", "192 dot 168 dot 1 dot 1"),
        ("card 4111 11 one one 1111 1111.", "card", "4111 11 one one 1111 1111"),
        ("\U0001f600\U0001f600 one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ],
)
def test_disguises(text, kind, span):
    assert [(k, text[s:e]) for k, s, e, base in pii.find(text) if not base] == [(kind, span)]


@pytest.mark.parametrize(
    ("text", "kind", "base", "whole"),
    [
        ("to p\u0430ul@example.com now", "email", "ul@example.com", "p\u0430ul@example.com"),
        ("to pa\u200bul@example.com now", "email", "ul@example.com", "pa\u200bul@example.com"),
        ("to bob@mail.ex\u0430mple.com now", "email", "bob@mail.ex", "bob@mail.ex\u0430mple.com"),
        ("call +1 555 123 45\uff16\uff17 now", "phone", "+1 555 123 45", "+1 555 123 45\uff16\uff17"),
    ],
)
def test_partly_disguised_identifiers_go_whole(text, kind, base, whole):
    found = [(k, text[s:e], b) for k, s, e, b in pii.find(text)]
    assert sorted(found) == sorted([(kind, base, True), (kind, whole, False)])
    assert pii.redact(text) == text.replace(whole, f"<{kind.upper()}>")


@pytest.mark.parametrize("text", ["look at example.com today", "we met at noon, point taken, one two three go", "die zwei und drei", "le point de vue", "nine of ten"])
def test_plain_prose_has_no_spans(text):
    assert pii.find(text) == []


def _b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def _der() -> bytes:
    def tlv(tag, body):
        n = len(body)
        return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body

    return tlv(0x30, tlv(2, b"\0") + tlv(2, b"\x01" * 64) + tlv(2, b"\x01\0\x01") + tlv(2, b"\x02" * 64))


def test_structures_are_confirmed():
    token = ".".join([_b64(b'{"alg":"HS256","typ":"JWT"}'), _b64(b'{"sub":"1"}'), _b64(b"x" * 32)])
    key = base64.b64encode(_der()).decode()
    ssh = base64.b64encode(b"\0\0\0\x07ssh-rsa\0\0\0\x03\1\0\1\0\0\0\x40" + b"\xab" * 64).decode()
    armour = f"-----BEGIN RSA PRIVATE KEY-----\n{key}\n-----END RSA PRIVATE KEY-----"
    for text, kind in ((token, "token"), (key, "der"), (ssh, "sshkey"), (armour, "armour"), (_der().hex().upper(), "der")):
        assert [k for k, *_, base in secrets.find(f"é {text} end") if not base] == [kind]


def test_broken_structures_are_not():
    bad_token = ".".join([_b64(b'{"typ":"JWT"}'), _b64(b'{"sub":"1"}'), _b64(b"x" * 32)])
    short = base64.b64encode(_der()[:-3]).decode()
    for text in (bad_token, short, base64.b64encode(b"just some prose that is long enough to look like it").decode()):
        assert [x for x in secrets.find(text) if not x[3]] == []


def test_no_limits_of_length():
    text = "a@" + "b" * 5000 + " dot com"
    assert [(text[s:e]) for k, s, e, base in pii.find(text)] == [text]
    body = base64.b64encode(_der_of(30000)).decode()
    armour = f"-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----"
    assert [armour[s:e] for k, s, e, base in secrets.find(armour) if k == "armour"] == [armour]


def _der_of(n):
    tlv = lambda tag, x: bytes([tag, 0x84]) + len(x).to_bytes(4, "big") + x
    return tlv(0x30, bytes([2, 1, 0]) + tlv(4, b"\x05" * n))


def test_nested_lengths_are_parsed():
    field = lambda x: len(x).to_bytes(4, "big") + x
    public = field(b"ssh-ed25519") + field(b"k" * 32)
    private = b"\1\2\3\4" * 2 + field(b"ssh-ed25519") + field(b"k" * 32) + field(b"s" * 64) + field(b"me")
    key = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(public) + field(private)
    assert secrets.is_ssh_key(key)
    assert not secrets.is_ssh_key(b"openssh-key-v1\0 and then some prose that goes on and on")
    assert not secrets.is_ssh_key(key[:-1]) and not secrets.is_ssh_key(key.replace(b"\1\2\3\4\1", b"\1\2\3\4\7"))
    inner_bad = bytes([0x30, 40, 2, 1, 0, 0x30, 33, 0x30, 200]) + b"x" * 33
    assert not secrets.is_asn1_key(inner_bad)


def test_encrypted_tokens():
    parts = [_b64(b'{"alg":"dir","enc":"A256GCM"}'), "", _b64(b"i" * 12), _b64(b"c" * 40), _b64(b"t" * 16)]
    for text, want in ((".".join(parts), 1), (".".join([_b64(b'{"alg":"dir"}'), *parts[1:]]), 0)):
        assert sum(k == "token" for k, *_ in secrets.find(f"see {text}.")) == want


@pytest.mark.parametrize("find", [pii.find, secrets.find])
def test_many_spans_take_linear_time(find):
    text = "\uff21 a@b.com -at-b-dot-com eyJhbGciOiJub25lIn0.eyJhIjoxfQ. " * 20000
    began = time.perf_counter()
    find(text)
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize(("module", "name", "plain"), [(pii, "op1_pii", plain_pii), (secrets, "op3_secrets", plain_secrets)])
def test_emitted_columns(spark, module, name, plain):
    texts = {r["doc_id"]: r["text"] or "" for r in module.documents(spark, SF).collect()}
    line = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    for r in getattr(module, name)(spark, SF).collect():
        text = texts[r["doc_id"]]
        base = plain(text)
        assert r["base_sha256"] == hashlib.sha256(line(base).encode()).hexdigest()
        assert r["spans"] == line(x[:3] for x in module.find(text))
        assert all(r[c] == sum(k == c[2:] for k, *_ in base) for c in r.asDict() if c[:2] == "n_" and c != "n_method")


def test_edges(spark):
    rows = {(r["doc_id"], r["n"]) for r in pii.find_pii(edge_docs(spark)).selectExpr("doc_id", "size(found) AS n").collect()}
    assert (8, 4) in rows and (2, 0) in rows and (None, 0) in rows
    assert secrets.find_secrets(edge_docs(spark)).count() == 11
    assert pii.digest(pii.find_pii(empty_docs(spark)), pii.KINDS).count() == 0
    out = pii.redact_documents(edge_docs(spark)).filter("doc_id = 8").first()
    assert out["text"].startswith("Mail <EMAIL> or <PHONE>, card <CARD>, host <IP>") and out["n_chars"] == len(out["text"])
