"""Secret scans with structural confirmation.

Plain patterns report three kinds of candidates (``assign``, ``access``,
``hex``).  The method adds what a pattern alone cannot tell: base64 and hex
candidates are decoded, and only a body whose structure holds is reported -
a DER key whose nested lengths fill it exactly, with the inner key of a
wrapped one (and an encrypted one: its scheme and its octets); an OpenSSH key
whose strings fill it; a signed token whose header is a JSON object that names
an algorithm and whose payload is a JSON object, or an encrypted one of five
parts; an armoured private key with such a body, or with the header lines of
an encrypted one and whole cipher blocks; a service token whose checksum fits.

Bodies may be wrapped over lines (the first of 16 characters or more), indented,
and have their line ends written as ``\\n``.  A body says itself how long it is, so
it is read from where its encoding begins (after a sign that is none of base64
or hex).  No key has less than 23 bytes; a key body of fewer bytes is no candidate.

Each text is scanned whole inside the Spark task that holds its row; nothing
is shuffled.  Defined results: a null or empty text has no spans; repeated
rows are scanned alike; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from evalspark.llm import common

#: Kinds in the order in which spans that start together are listed.
BASE_KINDS = ("assign", "access", "hex")
METHOD_KINDS = ("pem", "der", "openssh", "jwt", "checksum")
_ORDER = {k: i for i, k in enumerate(BASE_KINDS + METHOD_KINDS)}

# Fixed patterns of the base kinds.
_ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN = 12

# Candidates of the method.
_MARKER = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40})PRIVATE KEY-----")
_ALGORITHM_AND_IV = re.compile(r"[A-Z0-9-]+,[0-9A-Fa-f]{16,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,4}")
#: Where the encoding of a SEQUENCE or of an OpenSSH key may begin.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:M[A-P]|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/_-]{14,}")
_HEX_BODY = re.compile(r"(?<![0-9a-fA-F])30(?:[0-9a-f]{44,}|[0-9A-F]{44,})(?![0-9a-fA-F])")
_RUN = re.compile(r"[A-Za-z0-9+/_-]*")
_LINE_END = re.compile(r"(?:[ \t]*(?:\\[nr]|[\r\n]))+[ \t]*")
_PAD = re.compile(r"={0,2}(?![A-Za-z0-9+/_=-])")
_CHECKSUM = re.compile(r"(?<![A-Za-z0-9])gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

Span = tuple[int, int, str]


def _decode64(body: str) -> bytes | None:
    body = re.sub(r"\s+", "", body).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of each element, if the elements fill ``data`` exactly."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            n, at = int.from_bytes(data[at:at + width], "big"), at + width
        if at + n > len(data):
            return None
        items.append((tag, data[at:at + n]))
        at += n
    return items


# Object identifiers of key algorithms, as encoded.
_RSA, _EC = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")
_RAW_KEYS = {bytes([0x2B, 0x65, last]): n for last, n in ((0x6E, 32), (0x6F, 56), (0x70, 32), (0x71, 57))}


def _one(data: bytes, tag: int) -> list[tuple[int, bytes]] | None:
    """What is inside the one element of this tag that fills ``data``."""
    items = _der_items(data)
    return _der_items(items[0][1]) if items and len(items) == 1 and items[0][0] == tag else None


def _version(inner: list[tuple[int, bytes]] | None) -> bool:
    return bool(inner) and len(inner) >= 2 and inner[0][0] == 0x02 and len(inner[0][1]) == 1 and inner[0][1][0] <= 1


def _is_numbers(inner: list[tuple[int, bytes]] | None) -> bool:
    """An RSA or DSA key: a version and at least five more numbers."""
    return _version(inner) and len(inner) >= 6 and all(t == 0x02 and c for t, c in inner[:6])


def _is_curve_key(inner: list[tuple[int, bytes]] | None) -> bool:
    return _version(inner) and inner[1][0] == 0x04 and len(inner[1][1]) >= 16 and all(t in (0xA0, 0xA1) for t, _ in inner[2:])


def _is_wrapped_key(inner: list[tuple[int, bytes]] | None) -> bool:
    """PKCS#8: a version, an algorithm, and an octet string that holds a key of that algorithm."""
    if not _version(inner) or len(inner) < 3 or inner[1][0] != 0x30 or inner[2][0] != 0x04:
        return False
    algorithm = _der_items(inner[1][1])
    if not algorithm or algorithm[0][0] != 0x06:
        return False
    name, key = algorithm[0][1], inner[2][1]
    if name == _RSA:
        return _is_numbers(_one(key, 0x30))
    if name == _EC:
        return _is_curve_key(_one(key, 0x30))
    items = _der_items(key)
    if name in _RAW_KEYS:
        return bool(items) and len(items) == 1 and items[0][0] == 0x04 and len(items[0][1]) == _RAW_KEYS[name]
    return bool(items) and len(items) == 1 and items[0][0] in (0x02, 0x04, 0x30) and len(items[0][1]) >= 16


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE that fills ``data`` and holds what a private key holds."""
    inner = _one(data, 0x30)
    return _is_wrapped_key(inner) or _is_curve_key(inner) or _is_numbers(inner)


def is_encrypted_key(data: bytes) -> bool:
    """PKCS#8, encrypted: a SEQUENCE of a scheme (with an object identifier) and the encrypted octets."""
    inner = _one(data, 0x30)
    if not inner or [t for t, _ in inner] != [0x30, 0x04] or len(inner[1][1]) < 16:
        return False
    scheme = _der_items(inner[0][1])
    return bool(scheme) and len(scheme) >= 2 and scheme[0][0] == 0x06 and scheme[1][0] == 0x30 and _der_items(scheme[1][1]) is not None


def _openssh_size(data: bytes) -> int | None:
    """Bytes of the OpenSSH key that ``data`` begins with: cipher, derivation, options, a count, public and private part."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return None
    at = len(magic)
    for part in range(6):
        if at + 4 > len(data):
            return None
        n, at = int.from_bytes(data[at:at + 4], "big"), at + 4
        if part == 3:
            if n < 1:
                return None
            continue
        if at + n > len(data):
            return None
        at += n
    return at


def is_openssh_key(data: bytes) -> bool:
    return _openssh_size(data) == len(data)


def _json_object(body: str) -> dict | None:
    data = _decode64(body)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def token_parts(parts: list[str]) -> int:
    """How many of the dotted parts are a signed token (three) or an encrypted one (five); 0 if they are none."""
    header = _json_object(parts[0])
    if header is None or not isinstance(header.get("alg"), str):
        return 0
    if isinstance(header.get("enc"), str):
        return 5 if len(parts) == 5 and all(_decode64(p) for p in parts[2:]) else 0
    if _json_object(parts[1]) is None:
        return 0
    return 3 if (parts[2] == "") == (header["alg"].lower() == "none") and _decode64(parts[2]) is not None else 0


def has_checksum(body: str, check: str) -> bool:
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = _BASE62[d] + digits
    return digits == check


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    if data[0] == 0x30 and is_der_key(data):
        return "der"
    return "openssh" if is_openssh_key(data) else None


def _armoured(label: str, body: str) -> bool:
    """Whether the text between two armour lines is a private key."""
    lines = [x.strip() for x in re.split(r"\\[nr]|[\r\n]", body)]
    fields = dict(x.split(":", 1) for x in lines if ":" in x)
    data = _decode64("".join(x for x in lines if ":" not in x))
    if "ENCRYPTED" in fields.get("Proc-Type", ""):
        return bool(data) and len(data) % 8 == 0 and bool(_ALGORITHM_AND_IV.fullmatch(fields.get("DEK-Info", "").strip()))
    if "ENCRYPTED" in label:
        return bool(data) and is_encrypted_key(data)
    return _key_kind(data) is not None


def _encoded_size(head: str) -> int | None:
    """Base64 characters of the element that begins with these (eight or more), if it is a SEQUENCE."""
    data = _decode64(head[:8])
    if not data or data[0] != 0x30:
        return None
    n, size = data[1], 2
    if n & 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4:
            return None
        n, size = int.from_bytes(data[2:2 + width], "big"), 2 + width
    return -(-(n + size) * 4 // 3)


def _joined(text: str, start: int, size: int | None) -> tuple[str, int]:
    """``size`` base64 characters from ``start`` on (all, if None), over line ends, and where they end."""
    parts, have, at = [], 0, start
    while True:
        end = _RUN.match(text, at).end()
        end = end if size is None else min(end, at + size - have)
        parts.append(text[at:end])
        have, at = have + end - at, end
        more = None if have == size else _LINE_END.match(text, at)
        if not more or not _RUN.match(text, more.end())[0]:
            return "".join(parts), at
        at = more.end()


def _base64_key(text: str, start: int) -> tuple[int, str] | None:
    """End and kind of the key whose base64 begins at ``start``, its lines joined."""
    size = _encoded_size(text[start:start + 8])
    if size is None:
        body, _ = _joined(text, start, None)
        n = _openssh_size(_decode64(body[:-1] if len(body) % 4 == 1 else body) or b"")
        size = -(-n * 4 // 3) if n else None
    if size is None:
        return None
    body, at = _joined(text, start, size)
    pad = _PAD.match(text, at) if len(body) == size else None
    kind = _key_kind(_decode64(body)) if pad else None
    return (pad.end(), kind) if kind else None


def base_spans(text: str) -> list[Span]:
    spans = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return spans


def method_spans(text: str) -> list[Span]:
    spans: list[Span] = []
    if "PRIVATE KEY-----" in text:
        opened = None
        for m in _MARKER.finditer(text):
            if m[1] == "END" and opened and opened[2] == m[2] and _armoured(m[2], text[opened.end():m.start()]):
                spans.append((opened.start(), m.end(), "pem"))
            opened = m if m[1] == "BEGIN" else None
    armour = list(spans)
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            parts = m[0].split(".")
            if n := token_parts(parts):
                spans.append((m.start(), m.start() + len(".".join(parts[:n])), "jwt"))
    done = 0
    for m in _BASE64.finditer(text):
        inside = any(a <= m.start() < b for a, b, _ in armour)
        if m.start() >= done and not inside and (found := _base64_key(text, m.start())):
            done = found[0]
            spans.append((m.start(), *found))
    for m in _HEX_BODY.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := _key_kind(bytes.fromhex(m[0]))):
            spans.append((m.start(), m.end(), kind))
    if "gh" in text:
        spans += [(m.start(), m.end(), "checksum") for m in _CHECKSUM.finditer(text) if has_checksum(m[1], m[2])]
    return list(dict.fromkeys(spans))


def listed(spans: list[Span]) -> list[str]:
    return [f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], _ORDER[s[2]], s[1]))]


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, base_spans, spans`` (arrays of ``kind:start:end``, code points, end exclusive) per row."""
    slim = docs.select("doc_id", "text")
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in common.slices(batch)):
            base, every = [], []
            for text in part.column(1).to_pylist():
                own = base_spans(text) if text else []
                base.append(listed(own))
                every.append(listed(own + method_spans(text)) if text else [])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(base, pa.list_(pa.string())), pa.array(every, pa.list_(pa.string()))],
                ["doc_id", "base_spans", "spans"])

    return slim.mapInArrow(run, f"doc_id {id_type}, base_spans array<string>, spans array<string>")


def digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()
