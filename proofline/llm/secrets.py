"""Secret scan: patterns for the known shapes, and structural confirmation of everything that only looks encoded.

A run of base64 or hex characters is a candidate. It is decoded and reported only if the bytes are what they pretend to be: a
private key in ASN.1 DER whose nested lengths all fit (PKCS#1, SEC 1, PKCS#8, encrypted PKCS#8), an OpenSSH private key whose
nested strings all fit, or a signed token whose header is a JSON object with an algorithm. Random letters, hashes, images and
public keys do not pass.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import narrow

# The kinds in their fixed order; the first three are found by pattern, the others by structure.
KINDS = ("assign", "access", "hex", "der", "openssh", "token")
LEAST_VALUE = 12
# Fixed patterns. With re.ASCII only the letters A-Z and a-z are the same in either case.
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
# The longest run of a class from its first place is what the pattern with + finds there, so shorter runs can be left out at once.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
# Candidates for structure. A body of base64 may be folded into lines, with or without escaped line ends or quoting marks.
ENCODED = re.compile(
    r"[A-Za-z0-9+/_-]{24,}(?:(?:\r?\n|\\r\\n|\\n)[\x20\t>|#*]*[A-Za-z0-9+/_-]{1,})*(?:(?:\r?\n|\\r\\n|\\n)?={1,2})?", re.ASCII
)
FOLD = re.compile(r"(?:\r?\n|\\r\\n|\\n)[\x20\t>|#*]*", re.ASCII)
HEX_BYTES = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])", re.ASCII)
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{16,})\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)(?:\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]+))?", re.ASCII)
# DER begins with a SEQUENCE, tag 0x30, with a long length: these are its first characters in base64. An OpenSSH key begins with its name.
OPENSSH = b"openssh-key-v1\0"
DER_STARTS = ("MI", "MH", "MF", "MC", "MD", "ME", "MG")
OPENSSH_START = base64.b64encode(OPENSSH[:12]).decode()
SUSPECT = r"(?i:passw(or)?d|secret|token|api_?key)|AKIA|[0-9a-f]{16}|[A-Za-z0-9+/_-]{16}"
# Object identifiers, DER contents. Public-key algorithms and password-based encryption.
KEY_ALGORITHMS = {
    bytes.fromhex("2a864886f70d010101"): "rsa", bytes.fromhex("2a864886f70d01010a"): "rsa-pss", bytes.fromhex("2a8648ce3d0201"): "ec",
    bytes.fromhex("2a8648ce380401"): "dsa", bytes.fromhex("2a864886f70d010301"): "dh", bytes.fromhex("2b656e"): "x25519",
    bytes.fromhex("2b656f"): "x448", bytes.fromhex("2b6570"): "ed25519", bytes.fromhex("2b6571"): "ed448",
}
ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
INTEGER, OCTETS, OBJECT, SEQUENCE, SECOND = 0x02, 0x04, 0x06, 0x30, 0xA1
SPANS = (
    "doc_id long, spans array<struct<kind: string, start: long, end: long, detail: string>>, n_assign long, n_access long, n_hex long"
)
SPAN_TYPE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("detail", pa.string())])
Span = tuple[int, int, str, str]


class Malformed(ValueError):
    """The bytes are not what their first bytes say."""


def der_items(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, contents) of the items that fill ``data`` exactly; lengths must be in their shortest form."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or data[at] & 0x1F == 0x1F:
            raise Malformed
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            width = size & 0x7F
            size = int.from_bytes(data[at : at + width], "big")
            if not 1 <= width <= 4 or size < 0x80 or size >> (8 * (width - 1)) == 0:
                raise Malformed
            at += width
        if at + size > len(data):
            raise Malformed
        items.append((tag, data[at : at + size]))
        at += size
    return items


def der_size(data: bytes) -> int:
    """Length of the SEQUENCE at the start of ``data``, with its own tag and length."""
    if len(data) < 2 or data[0] != SEQUENCE:
        raise Malformed
    if data[1] < 0x80:
        return 2 + data[1]
    width = data[1] & 0x7F
    if not 1 <= width <= 4 or len(data) < 2 + width:
        raise Malformed
    return 2 + width + int.from_bytes(data[2 : 2 + width], "big")


def _numbers(items: list[tuple[int, bytes]]) -> list[int]:
    if any(tag != INTEGER or not value for tag, value in items):
        raise Malformed
    return [int.from_bytes(value, "big", signed=True) for _, value in items]


def _pkcs1(items: list[tuple[int, bytes]]) -> str:
    """Version, modulus, two exponents, two primes, two exponents, coefficient."""
    numbers = _numbers(items[:9])
    if len(numbers) < 9 or numbers[0] != len(items) - 9 or min(numbers[1:]) <= 0:
        raise Malformed  # version 1 has a tenth item with further primes
    return f"rsa private key, {numbers[1].bit_length()} bits"


def _dsa(items: list[tuple[int, bytes]]) -> str:
    """Version, p, q, g, public value, private value."""
    numbers = _numbers(items)
    if len(numbers) != 6 or numbers[0] != 0 or min(numbers[1:]) <= 0:
        raise Malformed
    return f"dsa private key, {numbers[1].bit_length()} bits"


def _sec1(items: list[tuple[int, bytes]]) -> str:
    """Version 1, private value, then the curve and the public value, each optional and tagged."""
    if len(items) < 2 or items[0] != (INTEGER, b"\1") or items[1][0] != OCTETS or not 16 <= len(items[1][1]) <= 72:
        raise Malformed
    for tag, value in items[2:]:
        if tag not in (0xA0, SECOND) or len(der_items(value)) != 1:
            raise Malformed
    return f"ec private key, {8 * len(items[1][1])} bits"


def _pkcs8(items: list[tuple[int, bytes]]) -> str:
    """Version, algorithm, an octet string that holds the key in its own form, optional attributes."""
    if len(items) < 3 or items[0] not in ((INTEGER, b"\0"), (INTEGER, b"\1")) or items[1][0] != SEQUENCE or items[2][0] != OCTETS:
        raise Malformed
    algorithm = der_items(items[1][1])
    name = KEY_ALGORITHMS.get(algorithm[0][1]) if algorithm and algorithm[0][0] == OBJECT else None
    inner = der_items(items[2][1])
    if name is None or len(inner) != 1:
        raise Malformed
    tag, value = inner[0]
    if name in ("rsa", "rsa-pss"):
        return _pkcs1(der_items(value)) if tag == SEQUENCE else _fail()
    if name == "ec":
        return _sec1(der_items(value)) if tag == SEQUENCE else _fail()
    if name in ("dsa", "dh"):
        return f"{name} private key" if tag == INTEGER else _fail()
    return f"{name} private key" if tag == OCTETS and len(value) in (32, 56, 57) else _fail()


def _encrypted(items: list[tuple[int, bytes]]) -> str:
    """Algorithm of password-based encryption, encrypted key."""
    if len(items) != 2 or items[0][0] != SEQUENCE or items[1][0] != OCTETS or len(items[1][1]) < 16:
        raise Malformed
    algorithm = der_items(items[0][1])
    if not algorithm or algorithm[0][0] != OBJECT or not algorithm[0][1].startswith(ENCRYPTIONS):
        raise Malformed
    return "encrypted private key"


def _fail() -> str:
    raise Malformed


def der_key(data: bytes) -> str:
    """What private key ``data`` is, all of it; Malformed if it is none."""
    outer = der_items(data)
    if len(outer) != 1 or outer[0][0] != SEQUENCE:
        raise Malformed
    items = der_items(outer[0][1])
    for form in (_pkcs8, _pkcs1, _sec1, _dsa, _encrypted):
        try:
            return form(items)
        except Malformed:
            continue
    raise Malformed


def _strings(data: bytes, count: int) -> tuple[list[bytes], bytes]:
    """``count`` strings with a four-byte length before each, and what follows them."""
    found = []
    for _ in range(count):
        size = int.from_bytes(data[:4], "big")
        if len(data) < 4 + size:
            raise Malformed
        found.append(data[4 : 4 + size])
        data = data[4 + size :]
    return found, data


def openssh_key(data: bytes) -> tuple[str, int]:
    """(what OpenSSH private key is at the start of ``data``, its length); Malformed if there is none."""
    if not data.startswith(OPENSSH):
        raise Malformed
    (cipher, derivation, _), rest = _strings(data[len(OPENSSH) :], 3)
    keys = int.from_bytes(rest[:4], "big")
    if not 1 <= keys <= 16 or (cipher == b"none") != (derivation == b"none"):
        raise Malformed
    strings, rest = _strings(rest[4:], keys + 1)
    names = [_strings(public, 1)[0][0] for public in strings[:-1]]
    if cipher == b"none" and (len(strings[-1]) < 8 or strings[-1][:4] != strings[-1][4:8]):
        raise Malformed  # the two check numbers of an open key are equal
    name = names[0].decode("ascii", "replace")
    return f"{'' if cipher == b'none' else 'encrypted '}openssh private key, {name}", len(data) - len(rest)


def from_base64(text: str) -> bytes:
    """Bytes of either alphabet, padded or not; a last lone character is left out."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    text = text[: len(text) - (len(text) % 4 == 1)]
    return base64.b64decode(text + "=" * (-len(text) % 4))


def _key_at(data: bytes) -> tuple[str, str, int] | None:
    """(kind, what it is, its length) of the key at the start of ``data``."""
    try:
        if data.startswith(OPENSSH):
            detail, size = openssh_key(data)
            return "openssh", detail, size
        size = der_size(data)
        return ("der", der_key(data[:size]), size) if size <= len(data) else None
    except Malformed:
        return None


def _body(text: str, begin: int, end: int) -> tuple[str, list[int]]:
    """The base64 characters of text[begin:end] without folds, and where each is."""
    letters, places, at = [], [], begin
    for fold in FOLD.finditer(text, begin, end):
        letters.append(text[at : fold.start()])
        places.extend(range(at, fold.start()))
        at = fold.end()
    letters.append(text[at:end])
    places.extend(range(at, end))
    return "".join(letters), places


def _key_in(letters: str, first: int) -> tuple[str, str, int] | None:
    """(kind, what it is, number of base64 characters) of the key that begins at ``first``. Only as much is decoded as it claims to have."""
    if letters.startswith(OPENSSH_START, first):
        return _key_at(from_base64(letters[first:]))
    try:
        size = der_size(from_base64(letters[first : first + 8]))
    except Malformed:
        return None
    count = -(-size * 4 // 3)
    return _key_at(from_base64(letters[first : first + count])) if first + count <= len(letters) else None


def _encoded_keys(text: str) -> Iterator[Span]:
    """Keys in base64 that begin where their candidate or one of its lines begins."""
    for found in ENCODED.finditer(text):
        letters, places = _body(text, *found.span())
        firsts = [0] + [k for k in range(1, len(places)) if places[k] != places[k - 1] + 1]
        done = 0
        for first in firsts:
            if first < done or not letters.startswith((*DER_STARTS, OPENSSH_START), first):
                continue
            key = _key_in(letters, first)
            if key:
                done = first + -(-key[2] * 4 // 3)
                last = places[done - 1] + 1
                while last < found.end() and text[last] == "=":
                    last += 1
                yield places[first], last, key[0], key[1]


def _hex_keys(text: str) -> Iterator[Span]:
    starts = (SEQUENCE.to_bytes().hex(), OPENSSH.hex())
    for found in HEX_BYTES.finditer(text):
        digits = found.group()
        key = _key_at(binascii.unhexlify(digits)) if digits.lower().startswith(starts) else None
        if key:
            yield found.start(), found.start() + 2 * key[2], key[0], key[1]


def _json(text: str) -> dict | None:
    try:
        value = json.loads(from_base64(text).decode("utf-8"))
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _tokens(text: str) -> Iterator[Span]:
    """Signed tokens: a header that is a JSON object with an algorithm, a payload, a signature; or the five parts of an encrypted one."""
    at = 0
    while found := TOKEN.search(text, at):
        header = _json(found[1])
        algorithm = header.get("alg") if header is not None else None
        if not isinstance(algorithm, str) or not algorithm:
            at = found.end(1)  # the second part may be the header of a token
            continue
        at = found.end()
        if isinstance(header.get("enc"), str) and found[5]:
            yield found.start(), found.end(), "token", f"encrypted token, {algorithm}"
        elif found[3] or algorithm.lower() == "none":
            yield found.start(), found.end(3), "token", f"signed token, {algorithm}"


def spans_of(text: str) -> list[Span]:
    """All findings in ``text`` as (start, end, kind, detail) in code points, by start, then kind in the order of KINDS."""
    found: list[Span] = [
        (m.start(), m.end(), "assign", m[1].lower()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE
    ]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", "") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", "") for m in HEX.finditer(text)]
    found += _encoded_keys(text)
    found += _hex_keys(text)
    if "." in text:
        found += _tokens(text)
    return sorted(found, key=lambda span: (span[0], KINDS.index(span[2]), span[1]))


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end, detail), n_assign, n_access, n_hex.

    Kinds: ``assign``, a name such as password or token, a colon or equals sign and a value of 12 characters or more; ``access``,
    an access key id of 18 or more; ``hex``, 16 or more lower-case hex digits; ``der`` and ``openssh``, private keys in base64 or hex
    that parse whole (structure is checked, not arithmetic: a key with a wrong number is still worth a report); ``token``, signed
    tokens whose header parses. Matches of a kind do not overlap, those of different kinds may. Places are code points, the end is
    exclusive. Null and empty texts have no spans. Each row is scanned where it is: repeated rows and null ids give a row each, other
    columns are ignored whatever their names, an empty table gives no rows. Whole texts are scanned, one at a time; nothing is
    shuffled.
    """

    def scan(batches):
        for batch in batches:
            texts = batch.column("text")
            suspects = _suspects(texts)
            spans = [spans_of(text.as_py()) if look else [] for text, look in zip(texts, suspects, strict=True)]
            counts = [[sum(s[2] == kind for s in found) for found in spans] for kind in KINDS[:3]]
            named = [[{"kind": s[2], "start": s[0], "end": s[1], "detail": s[3]} for s in found] for found in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(named, pa.list_(SPAN_TYPE)), *(pa.array(c, pa.int64()) for c in counts)],
                ["doc_id", "spans", "n_assign", "n_access", "n_hex"],
            )

    return narrow(docs, doc_id=id_col, text=text_col).mapInArrow(scan, SPANS)


def _suspects(texts: pa.Array) -> list[bool]:
    """Texts that can have a finding, by one pass in native code: every kind needs a name or a run of code characters."""
    return pc.fill_null(pc.match_substring_regex(texts, SUSPECT), False).to_pylist()


def redacted(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """``text`` with the code points of all spans replaced, overlapping spans by one mark."""
    kept = lambda done, upto: F.substr(text, done + 1, upto - done)
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("done"))

    def step(acc: Column, span: Column) -> Column:
        fresh = span["start"] >= acc["done"]
        out = F.when(fresh, F.concat(acc["out"], kept(acc["done"], span["start"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["done"], span["end"]).alias("done"))

    return F.aggregate(spans, state, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["done"] + 1)))
