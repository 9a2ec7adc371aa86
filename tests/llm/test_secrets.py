"""Base patterns against the contract's own, structural kinds against keys built here, and what must not be reported."""

import base64
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from proofline.llm.queries import op12_structural_secrets
from proofline.llm.secrets import KINDS, Malformed, der_items, der_key, redacted, secret_spans, spans_of

P, Q = 2**89 - 1, 2**107 - 1  # primes


def tlv(tag, value):
    size = len(value)
    if size < 128:
        return bytes([tag, size]) + value
    width = (size.bit_length() + 7) // 8
    return bytes([tag, 0x80 | width]) + size.to_bytes(width, "big") + value


def integer(n):
    return tlv(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def sequence(*items):
    return tlv(0x30, b"".join(items))


def rsa(p=P, q=Q):
    n, e = p * q, 65537
    d = pow(e, -1, (p - 1) * (q - 1))
    return sequence(*map(integer, (0, n, e, d, p, q, d % (p - 1), d % (q - 1), pow(q, -1, p))))


def oid(digits):
    return tlv(6, bytes.fromhex(digits))


EC = sequence(integer(1), tlv(4, bytes(range(32))), tlv(0xA0, oid("2a8648ce3d030107")))
PKCS8 = sequence(integer(0), sequence(oid("2a864886f70d010101"), tlv(5, b"")), tlv(4, rsa()))
ED25519 = sequence(integer(0), sequence(oid("2b6570")), tlv(4, tlv(4, bytes(range(32)))))
LOCKED = sequence(sequence(oid("2a864886f70d01050d"), sequence(integer(5))), tlv(4, bytes(64)))
PUBLIC = sequence(sequence(oid("2a864886f70d010101"), tlv(5, b"")), tlv(3, b"\0" + sequence(integer(P * Q), integer(65537))))


def string(value):
    return len(value).to_bytes(4, "big") + value


def openssh(check=b"\1\2\3\4" * 2, cipher=b"none"):
    public = string(b"ssh-ed25519") + string(bytes(32))
    private = check + public + string(bytes(64)) + string(b"me") + b"\1\2\3"
    kdf = b"none" if cipher == b"none" else b"bcrypt"
    return b"openssh-key-v1\0" + string(cipher) + string(kdf) + string(b"") + (1).to_bytes(4, "big") + string(public) + string(private)


def folded(data, width=64):
    text = base64.b64encode(data).decode()
    return "\n".join(text[k : k + width] for k in range(0, len(text), width))


def url(value):
    return base64.urlsafe_b64encode(value if isinstance(value, bytes) else json.dumps(value).encode()).decode().rstrip("=")


def kinds(text):
    return [(s[2], text[s[0] : s[1]]) for s in spans_of(text) if s[2] not in ("hex", "assign", "access")]


@pytest.mark.parametrize(("key", "what"), [
    (rsa(), "rsa private key, 196 bits"), (PKCS8, "rsa private key, 196 bits"), (EC, "ec private key, 256 bits"),
    (ED25519, "ed25519 private key"), (LOCKED, "encrypted private key"),
])
def test_keys(key, what):
    assert der_key(key) == what
    for body in (folded(key), base64.b64encode(key).decode(), folded(key, 40)):
        text = f"é😀 before\n-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----\nafter"
        assert kinds(text) == [("der", body)]
    escaped = folded(key).replace("\n", "\\n")
    assert kinds(f'"private_key": "{escaped}\\n"') == [("der", escaped)]
    assert kinds(f"bytes {key.hex()} end") == [("der", key.hex())]


def test_damaged_keys_are_not_reported():
    rng = random.Random(1)
    for key in (rsa(), PKCS8, EC, ED25519):
        for cut in range(1, len(key)):
            with pytest.raises(Malformed):
                der_key(key[:cut])
        with pytest.raises(Malformed):
            der_key(key + b"\0")
    for key in (rsa(), PKCS8, EC, ED25519):
        for at in (1, 4 if key[1] >= 128 else 3):  # the outer length, the length of the first item
            for step in (1, 3, 128):
                wrong = bytearray(key)
                wrong[at] = (wrong[at] + step) % 256
                assert kinds(folded(bytes(wrong))) == []
    for data in (PUBLIC, rsa()[:60], bytes(200), rng.randbytes(400)):
        assert kinds(folded(data)) == []
    with pytest.raises(Malformed):
        der_items(b"\x30\x81\x05" + b"\x05\x00" * 2 + b"\0")  # a length not in its shortest form


def test_openssh():
    for key in (openssh(), openssh(cipher=b"aes256-ctr", check=b"12345678")):
        body = folded(key, 70)
        found = kinds(f"x\n{body}\n-----END")
        assert [k for k, _ in found] == ["openssh"] and body.startswith(found[0][1].rstrip("="))
    assert kinds(folded(openssh(check=b"\1\2\3\4\5\6\7\x08"))) == []


def test_tokens():
    head, body = url({"alg": "HS256", "typ": "JWT"}), url({"sub": "1"})
    signed = f"{head}.{body}.{url(bytes(32))}"
    assert kinds(f"Bearer {signed}, then") == [("token", signed)]
    assert kinds(f"a.b.{signed}") == [("token", signed)]
    unsigned = f"{url({'alg': 'none', 'typ': 'JWT'})}.{body}."
    assert kinds(f"({unsigned})") == [("token", unsigned)]
    locked = ".".join([url({"alg": "dir", "enc": "A256GCM"}), "", url(bytes(12)), url(bytes(40)), url(bytes(16))])
    assert kinds(locked) == [("token", locked)]
    for other in (f"{head}.{body}.", f"{url({'typ': 'JWT'})}.{body}.{body}", "some.long-words-of-text.here", f"{url([1, 2, 3, 4, 5, 6])}.{body}.{body}"):
        assert kinds(other) == []


def contract(text):
    """The base kinds by the patterns as the contract prints them."""
    letters = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    names = "|".join(letters(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile("(" + names + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    found.sort()
    counts = [sum(k == kind for _, k, _ in found) for kind in range(3)]
    return (*counts, hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest())


def test_base_kinds_over_random_texts(spark, tmp_path):
    rng = random.Random(8)
    parts = ["token", "Secret", "PASSWORD", "passwd", "api_key", "apiKey", "ſecret", "toKen", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH01234567",
             "AKIA1234567890ABCD", "0123456789abcdef", "abc", "x", "é", "\n", "漢", "longvalue.of-12+", "/", "deadbeef", "😀"]
    texts = [None, "", "token", "AKIA" * 9, "f" * 100_000, "token=" * 4000] + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op12_structural_secrets(spark, str(tmp_path)).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == contract(text or ""), text
    assert sum(r.n_assign for r in got.values()) > 200


def test_table(spark):
    key = folded(rsa())
    docs = spark.createDataFrame(
        [(1, f"a {key} b"), (1, f"a {key} b"), (None, 'é token = "abcdef0123456789"'), (2, None), (3, ""), (4, "plain words only")],
        "doc_id long, text string",
    ).selectExpr("*", "1 AS spans", "2 AS n_hex", "3 AS kind")
    out = secret_spans(docs)
    rows = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans], r.n_assign, r.n_access, r.n_hex) for r in out.collect()), key=str)
    assert rows == sorted([
        (1, [("der", 2, 2 + len(key))], 0, 0, 0), (1, [("der", 2, 2 + len(key))], 0, 0, 0),
        (None, [("assign", 2, 27), ("hex", 11, 27)], 1, 0, 1), (2, [], 0, 0, 0), (3, [], 0, 0, 0), (4, [], 0, 0, 0),
    ], key=str)
    clean = docs.where("doc_id is null").select("text").crossJoin(out.where("doc_id is null").select(F.col("spans").alias("found")))
    assert clean.select(redacted(F.col("text"), F.col("found"))).first()[0] == 'é <secret>"'
    assert secret_spans(docs.limit(0)).count() == 0
