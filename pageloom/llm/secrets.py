"""Secret scans with structural confirmation.

Runs of base64 or hex characters are candidates. A candidate is reported only if its decoded bytes have
the structure of a secret:

* ``signed_token``: three base64url parts whose first two decode to JSON objects, the header with ``alg``;
  ``unsigned_token``: the same with ``alg`` none and an empty third part;
* ``pkcs1_key``, ``pkcs8_key``, ``ec_key``: DER whose nested lengths fill the bytes exactly, with the
  fields of that private key (armoured blocks are joined over their lines first);
  ``encrypted_pkcs8_key``: such DER with a password-based scheme and the encrypted octets;
* ``encrypted_pem_key``: an armoured block with Proc-Type and DEK-Info headers, whose bytes fill whole blocks of
  the cipher and whose initial vector has the length of one;
* ``openssh_key``: the magic, then length-prefixed fields that nest to the end, whatever the number of keys;
* ``assigned_key``: 16 to 64 raw bytes, assigned to a name such as token, secret or api_key, and not of one
  repeated pattern (at least as many different bytes as half the length, 16 at most). Base64 has a digit, +,
  / or padding, and where the length isn't a usual one for keys a digit and letters of both cases, so that
  words and identifiers aren't taken for keys.

Encodings are walked without recursion, so their depth isn't limited.

Defined cases: null and empty texts hold nothing; rows are scanned one by one, whole, whatever their length;
null ids are carried; the same secret in repeated rows or places is reported each time; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrow

_ARMOUR = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----((?:\s*[A-Za-z][A-Za-z0-9-]*: [^\n]*\n)*)([A-Za-z0-9+/=\s]*)-----END \1PRIVATE KEY-----")
_DEK = re.compile(r"DEK-Info: ([A-Z0-9-]+),([0-9A-Fa-f]+)\s")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]{6,})\.(ey[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_HEX = re.compile(r"(?:[0-9a-f]{2}){16,}|(?:[0-9A-F]{2}){16,}")
_NAMED = re.compile(r"(?i)token|secret|passw(?:or)?d|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth")
#: object identifiers of password-based encryption (PKCS 5 and PKCS 12)
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_LENGTHS, _LEAST, _MOST = (16, 20, 24, 32, 48, 64), 16, 64


def _der(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, content start and content end of the DER element at ``at``; None if it overruns ``end``."""
    if at + 2 > end:
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n == 0x80:
        return None
    if n > 0x80:
        k = n & 0x7F
        if k > 4 or at + k > end or b[at] == 0:
            return None
        n, at = int.from_bytes(b[at : at + k], "big"), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _fields(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill the range exactly, each constructed one nesting exactly too."""
    out, ends = [], [end]
    while ends:
        if at == ends[-1]:
            ends.pop()
            continue
        e = _der(b, at, ends[-1])
        if e is None:
            return None
        if len(ends) == 1:
            out.append(e)
        if e[0] & 0x20:
            ends.append(e[2])
            at = e[1]
        else:
            at = e[2]
    return out


def _der_key(b: bytes) -> str | None:
    top = _der(b, 0, len(b))
    if top is None or top[0] != 0x30 or top[2] != len(b):
        return None
    f = _fields(b, top[1], top[2])
    if not f:
        return None
    if [t for t, *_ in f] == [0x30, 4] and f[1][2] - f[1][1] >= 16:
        scheme = _der(b, f[0][1], f[0][2])
        if scheme and scheme[0] == 6 and b[scheme[1] : scheme[2]].startswith(_PASSWORD_BASED):
            return "encrypted_pkcs8_key"
    if f[0][0] != 2:
        return None
    version, tags = b[f[0][1] : f[0][2]], [t for t, *_ in f]
    if version == b"\0" and len(f) == 9 and set(tags) == {2}:
        return "pkcs1_key"
    if version in (b"\0", b"\1") and len(f) >= 3 and tags[1:3] == [0x30, 4] and b[f[1][1]] == 6:
        return "pkcs8_key"
    if version == b"\1" and len(f) >= 2 and tags[1] == 4 and f[1][2] - f[1][1] in (28, 32, 48, 66):
        return "ec_key"
    return None


def _openssh(b: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not b.startswith(magic):
        return False
    at, sizes = len(magic), []
    for _ in range(3):  # cipher, key derivation and its options
        n = int.from_bytes(b[at : at + 4], "big")
        sizes.append(n)
        at += 4 + n
    keys = int.from_bytes(b[at : at + 4], "big")
    at += 4
    for _ in range(keys + 1):  # the public keys, then the private part; each takes four bytes at least
        if at + 4 > len(b):
            return False
        at += 4 + int.from_bytes(b[at : at + 4], "big")
    return keys > 0 and at == len(b)


def _encrypted_pem(head: str, body: bytes | None) -> bool:
    dek = _DEK.search(head + "\n")
    if "Proc-Type: 4,ENCRYPTED" not in head or dek is None or not body:
        return False
    block = 16 if dek.group(1).startswith(("AES", "CAMELLIA", "SEED")) else 8
    return len(dek.group(2)) == 2 * block and len(body) % block == 0


def _decoded(s: str) -> bytes | None:
    body = s.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.translate(str.maketrans("-_", "+/")) + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json(s: str) -> dict | None:
    try:
        out = json.loads(_decoded(s) or b"")
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def _structure(b: bytes | None) -> str | None:
    return None if b is None else "openssh_key" if _openssh(b) else _der_key(b)


def _raw(b: bytes | None) -> bool:
    return b is not None and _LEAST <= len(b) <= _MOST and len(set(b)) >= min(16, len(b) // 2)


def _name(text: str, at: int) -> str:
    """The name that what begins at ``at`` is assigned to, or an empty one."""
    k = at
    if k and text[k - 1] in "\"'":
        k -= 1
    while k and text[k - 1].isspace():
        k -= 1
    if text.endswith("=>", 0, k):
        k -= 2
    elif k and text[k - 1] in "=:":
        k -= 1
    else:
        return ""
    while k and text[k - 1].isspace():
        k -= 1
    if k and text[k - 1] in "\"'":
        k -= 1
    end = k
    while k and (text[k - 1].isalnum() or text[k - 1] in "_.-"):
        k -= 1
    return text[k:end]


def _mixed(s: str, size: int) -> bool:
    """Whether base64 of so many bytes looks drawn at random and not like a word or an identifier."""
    if size in _LENGTHS:
        return any(c.isdigit() or c in "+/=" for c in s)
    return all(any(test(c) for c in s) for test in (str.isdigit, str.isupper, str.islower))


def scan(text: str) -> list[tuple[int, str, str]]:
    """(offset, kind, secret) in order; regions of one finding are not searched again."""
    out, taken = [], []
    for m in _ARMOUR.finditer(text):
        body = _decoded("".join(m.group(3).split()))
        kind = "encrypted_pem_key" if _encrypted_pem(m.group(2), body) else _structure(body)
        if kind:
            out.append((m.start(), kind, m.group()))
            taken.append(m.span())
    for m in _JWT.finditer(text):
        head = _json(m.group(1))
        alg = head.get("alg") if head else None
        signed = len(m.group(3)) >= 16
        if isinstance(alg, str) and (signed or not m.group(3) and alg.lower() == "none") and _json(m.group(2)) is not None:
            out.append((m.start(), "signed_token" if signed else "unsigned_token", m.group()))
            taken.append(m.span())
    taken.sort()
    k = 0
    for m in _RUN.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] < m.end():
            continue
        s, hexes = m.group(), _HEX.fullmatch(m.group())
        b = bytes.fromhex(s) if hexes else _decoded(s)
        kind = _structure(b)
        if kind is None and _raw(b) and (hexes or _mixed(s, len(b))) and _NAMED.search(_name(text, m.start())):
            kind = "assigned_key"
        if kind:
            out.append((m.start(), kind, s))
    return sorted(out)


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, kind, offset (characters, from 1), length, fingerprint (SHA-256) of every confirmed secret."""
    rows = narrow(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *f) for i, t in enumerate(b.column(1).to_pylist()) if t for f in scan(t)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                    pa.array([f[2] for f in found], pa.string()),
                    pa.array([f[1] + 1 for f in found], pa.int64()),
                    pa.array([len(f[3]) for f in found], pa.int64()),
                    pa.array([hashlib.sha256(f[3].encode()).hexdigest() for f in found], pa.string()),
                ],
                names=["doc_id", "kind", "offset", "length", "fingerprint"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, kind string, offset long, length long, fingerprint string")
