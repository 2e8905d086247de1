"""Secret scans: pattern candidates, and encoded candidates that are reported only if their structure holds.

Base kinds come from patterns alone: ``assign`` (a credential name, a separator and a value), ``access`` (an
access key id) and ``hex`` (a long run of hex digits). Confirmed kinds come from decoding: ``jwt`` is a signed
token whose header and payload decode to JSON objects, the header naming an algorithm; ``der`` is base64 or
hex, or the body of a PEM block, that decodes to a key encoding (nested ASN.1 lengths that fill their parents exactly,
in the shape of a PKCS#1, PKCS#8, encrypted PKCS#8, SEC 1 or SubjectPublicKeyInfo key), or a PEM block whose header
lines name a cipher and its initial vector and whose body is whole blocks of that cipher; ``ssh`` is base64 of
length-prefixed fields that fill the blob and start with a known key type, or an OpenSSH private key.

Spans are code points, end exclusive. Confirmed spans are added; they never change base spans.

Encoded keys are looked for wherever one can begin: behind any character but a letter or digit (so behind / + _ - and . too), in
lines of equal length without armour, in hex with colons or behind 0x, and in PEM blocks whose line breaks are written as a backslash
and n, as in JSON and environment files. A token may stand behind _ - or a full stop. What decodes decides.

Defined cases: what isn't UTF-8 counts as U+FFFD; null or empty text has no spans; very long texts are read whole, and the work
grows with their length (a place where no key header decodes costs nothing more); repeated rows are scanned each; an empty table gives an
empty result; matches of a kind never overlap; ties are ordered by start, then by kind as listed in ``KINDS``; only the text is read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import text_slices, valid_text

KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}KEY)-----([^-]*(?:-(?!----)[^-]*)*)-----END \1-----")
PEM_BODY = re.compile(r"\s*((?:[A-Za-z][A-Za-z0-9-]*:[^\r\n]*\r?\n[ \t]*)*)([A-Za-z0-9+/=\s]+)")
#: A line break as JSON, shells and environment files write it.
ESCAPED = re.compile(r"\\+r\\+n|\\+[nr]")
ENCRYPTED = re.compile(r"^Proc-Type:[ \t]*4,[ \t]*ENCRYPTED[ \t]*\r?$", re.MULTILINE)
CIPHER = re.compile(r"^[ \t]*DEK-Info:[ \t]*[A-Za-z0-9-]+,[ \t]*([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})[ \t]*\r?$", re.MULTILINE)
#: A header is an object, so it begins with ``{``.
JWT = re.compile(r"(?<![A-Za-z0-9])(e[w-z0-9_-][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?!\.?[A-Za-z0-9_-])")
JWT_WITHIN = re.compile(r"(?<=[_-])e[w-z0-9_-][A-Za-z0-9_-]{6,}")
#: What encoded keys begin with: a SEQUENCE, the length of an SSH key type, or ``openssh-key-v1``. Any separator may stand before,
#: those of the base64 alphabets (+ / - _) too: what follows decides.
KEY_START = re.compile(r"(?<![A-Za-z0-9])(?:M[A-P]|AAAA|b3BlbnNzaC1rZXktdjEA)")
PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
FOLD = re.compile(r"(?:\r?\n|\\+r\\+n|\\+n)[ \t]*")
HEX_CODED = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?((?:[0-9a-fA-F]{2}){24,}|[0-9a-fA-F]{2}(?::[0-9a-fA-F]{2}){23,})(?![0-9A-Za-z])")
#: Object identifiers of key algorithms (RSA, EC, DSA, X25519, X448, Ed25519, Ed448), DER content.
KEY_OIDS = tuple(map(bytes.fromhex, ("2a864886f70d010101", "2a8648ce3d0201", "2a8648ce380401", "2b656e", "2b656f", "2b6570", "2b6571")))
#: What identifiers of password-based encryption start with (PKCS#5, PKCS#12), DER content.
PBE_OIDS = tuple(map(bytes.fromhex, ("2a864886f70d0105", "2a864886f70d010c01")))
#: Key types of SSH public keys, and how many fields such a key has.
SSH_FIELDS = {
    b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3,
    b"sk-ssh-ed25519@openssh.com": 3, b"sk-ecdsa-sha2-nistp256@openssh.com": 4,
}
SSH_TYPES = tuple(SSH_FIELDS)
SSH_HEADS = {(len(x), x[:2]) for x in SSH_FIELDS}


def decode_base64(text: str) -> bytes | None:
    """Standard or URL-safe base64, white space and padding optional; None if it isn't."""
    body = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def asn1(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list[tuple] | None:
    """Elements (tag, content or list of elements) that fill ``data[at:end]`` exactly, else None."""
    end = len(data) if end is None else end
    out: list[tuple] = []
    while at < end:
        if end - at < 2 or depth > 12:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or end - at < k or (data[at] == 0) or (k == 1 and data[at] < 128):
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n > end - at:
            return None
        if tag & 0x20:
            inner = asn1(data, at, at + n, depth + 1)
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, data[at : at + n]))
        at += n
    return out


def is_der_key(data: bytes) -> bool:
    if len(data) < 24 or data[0] != 0x30:
        return False
    top = asn1(data)
    if top is None or len(top) != 1:
        return False
    parts = top[0][1]
    tags = [t for t, _ in parts]
    algorithm = lambda p: p[0] == 0x30 and bool(p[1]) and p[1][0][0] == 0x06 and p[1][0][1] in KEY_OIDS
    if tags[:3] == [0x02, 0x30, 0x04]:  # PKCS#8
        return len(parts[0][1]) == 1 and algorithm(parts[1])
    if tags == [0x30, 0x03]:  # SubjectPublicKeyInfo
        return algorithm(parts[0]) and parts[1][1][:1] == b"\0"
    if tags == [0x30, 0x04]:  # encrypted PKCS#8
        scheme = parts[0][1]
        return bool(scheme) and scheme[0][0] == 0x06 and scheme[0][1].startswith(PBE_OIDS) and len(parts[1][1]) >= 16
    if tags[:2] == [0x02, 0x04]:  # SEC 1
        return parts[0][1] == b"\x01" and len(parts[1][1]) >= 20
    if len(tags) in (6, 9) and set(tags) == {0x02}:  # PKCS#1 and DSA private keys
        return parts[0][1] in (b"\0", b"\x01") and len(parts[1][1]) >= 32
    return len(tags) == 2 and set(tags) == {0x02} and len(parts[0][1]) >= 64 and len(parts[1][1]) <= 8  # RSA public key


def der_length(data: bytes) -> int | None:
    """Bytes of the element that the data begin with, of which a few will do."""
    if len(data) < 2 or data[0] != 0x30:
        return None
    n, k = data[1], data[1] & 0x7F
    if n < 128:
        return 2 + n
    return 2 + k + int.from_bytes(data[2 : 2 + k], "big") if 1 <= k <= 4 and len(data) >= 2 + k else None


def ssh_length(data: bytes) -> int | None:
    """Bytes of the fields of the public key that the data begin with."""
    at, n = 0, None
    for k in range(6):
        if n is not None and k >= n:
            return at
        size = int.from_bytes(data[at : at + 4], "big")
        if len(data) - at - 4 < size:
            return None
        if n is None:
            n = SSH_FIELDS.get(data[at + 4 : at + 4 + size])
            if n is None:
                return None
        at += 4 + size
    return at


def is_ssh_key(data: bytes) -> bool:
    if data.startswith(b"openssh-key-v1\0"):
        return True
    fields, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if len(data) - at < 4 or n > len(data) - at - 4:
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return len(fields) >= 2 and fields[0] in SSH_TYPES and len(fields[1]) >= 3


def is_encrypted_key(headers: str, data: bytes) -> bool:
    """A PEM body in whole blocks of the cipher that the header lines name; the initial vector is as long as a block."""
    vector = CIPHER.search(headers)
    return bool(vector and ENCRYPTED.search(headers)) and len(data) >= 32 and len(data) % (len(vector[1]) // 2) == 0


def is_token(header: str, payload: str) -> bool:
    def parsed(part: str) -> object:
        data = decode_base64(part)
        try:
            return json.loads(data) if data else None
        except (ValueError, RecursionError):
            return None

    head = parsed(header)
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(parsed(payload), dict)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) by pattern alone."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]


def folded(text: str, at: int, need: int | None = None) -> tuple[str, list[tuple[int, int]]]:
    """Base64 characters from a place on, ``need`` of them if there are so many, and (characters so far, place behind them) of each
    line. Lines go on if they are as long as the first one; the last may be shorter."""
    found, ends, first = [], [], None
    size = 0
    while m := PIECE.match(text, at, len(text) if need is None else min(len(text), at + need - size)):
        piece = m[0]
        if first is not None and len(piece) > first:
            break
        found.append(piece)
        size += len(piece)
        ends.append((size, m.end()))
        if (need is not None and size >= need) or (first is not None and len(piece) < first):
            break
        first = len(piece) if first is None else first
        fold = FOLD.match(text, m.end()) if first >= 16 else None
        if fold is None:
            break
        at = fold.end()
    return "".join(found), ends


def encoded_key(text: str, at: int) -> tuple[int, bool] | None:
    """(end, whether DER) of the base64 key that begins at a place. DER and SSH public keys tell their own length, so that what
    stands behind doesn't matter unless it goes on in base64."""
    head = text[at : at + 8]
    data = decode_base64(head) if len(head) == 8 else None
    if data is None:
        return None
    if data[0] == 0x30:
        size = der_length(data)
        chars, ends = folded(text, at, -(-size * 4 // 3)) if size and size >= 24 else ("", [])
    elif data.startswith(b"openss") or (int.from_bytes(data[:4], "big"), data[4:6]) in SSH_HEADS:
        chars, ends = folded(text, at)
        whole = decode_base64(chars if len(chars) % 4 != 1 else chars[:-1]) or b""
        size = len(whole) if data.startswith(b"openss") else ssh_length(whole)
    else:
        return None
    need = -(-(size or 0) * 4 // 3)
    if not size or len(chars) < need:
        return None
    key = (decode_base64(chars[:need]) or b"")[:size]
    if not (is_der_key(key) or is_ssh_key(key)):
        return None
    n, end = next((n, end) for n, end in ends if n >= need)
    end -= n - need
    pad = 0
    while pad < 2 and text[end : end + 1] == "=" and (need + pad) % 4:
        end, pad = end + 1, pad + 1
    follows = text[end : end + 1]
    if follows and (follows.isascii() and follows.isalnum() or follows in "+/" and text[end + 1 : end + 2].isalnum()):
        return None
    return end, is_der_key(key)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of what decodes to a key or a signed token."""
    jwt, der, ssh = (KINDS.index(k) for k in ("jwt", "der", "ssh"))
    found = []
    for m in JWT.finditer(text):
        starts = [0, *(x.start() for x in JWT_WITHIN.finditer(m[1]))]
        start = next((k for k in starts if is_token(m[1][k:], m[2])), None)
        if start is not None:
            found.append((m.start() + start, jwt, m.end()))
    taken = []
    for m in PEM.finditer(text):
        inner = PEM_BODY.fullmatch(ESCAPED.sub("\n", m[2]))
        data = decode_base64(inner[2]) if inner else None
        if data and (is_der_key(data) or is_ssh_key(data) or is_encrypted_key(inner[1], data)):
            found.append((m.start(), ssh if is_ssh_key(data) else der, m.end()))
            taken.append(m.span())
    end, k = 0, 0
    for m in KEY_START.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if m.start() < end or (k < len(taken) and taken[k][0] <= m.start()):
            continue
        key = encoded_key(text, m.start())
        if key:
            end = key[0]
            found.append((m.start(), der if key[1] else ssh, end))
    for m in HEX_CODED.finditer(text):
        if is_der_key(bytes.fromhex(m[1].replace(":", ""))):
            found.append((m.start(1), der, m.end(1)))
    return found


def _alphabet(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


HEX_BYTES = _alphabet(b"0123456789abcdef")
#: The bytes of every confirmed kind but PEM; the shortest signed token (``{"alg":"x"}``, ``{}``) has 20 of them in a row.
CODED_BYTES = _alphabet(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=.")


def has_run(texts: list[bytes], alphabet: np.ndarray, length: int) -> np.ndarray:
    """Which texts have at least so many bytes of an alphabet in a row."""
    buf = np.frombuffer(b"\0".join([b"", *texts, b""]), np.uint8)
    stops = np.flatnonzero(~alphabet[buf])
    runs = np.concatenate([[0], np.cumsum(np.diff(stops) > length)])
    ends = np.cumsum([0] + [len(t) + 1 for t in texts])
    return np.diff(runs[np.searchsorted(stops, ends)]) > 0


#: What the shortest key in hex with colons begins with.
COLONS = re.compile(rb"30:[0-9a-f]{2}:[0-9a-f]{2}:[0-9a-f]{2}:")


def find_secrets(texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """For each UTF-8 text its spans in order; the costly patterns run only where a cheap necessary test passes."""
    out = []
    for data, long_hex, coded in zip(texts, has_run(texts, HEX_BYTES, 24), has_run(texts, CODED_BYTES, 20), strict=True):
        low, found = data.lower(), []
        named, access = any(n in low for n in NAMES), b"AKIA" in data
        pem = b"-----BEGIN" in data or COLONS.search(low) is not None
        if named or access or long_hex or coded or pem:
            text = data.decode("utf-8")
            found += base_spans(text) if named or access or long_hex else []
            found += confirmed_spans(text) if coded or pem else []
        out.append(sorted(found))
    return out


def secret_spans(text: Column) -> Column:
    """Struct (spans, base): strings ``kind:start:end`` joined by commas, and (n_assign, n_access, n_hex)."""

    kinds = {"spans": pa.string(), "base": pa.string(), "n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64()}

    @F.arrow_udf("spans string, base string, n_assign long, n_access long, n_hex long")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        join = lambda xs: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in xs)
        for texts in batches:
            rows = []
            for _, block in text_slices(texts):
                for found in find_secrets(block):
                    base = [x for x in found if x[1] < len(BASE)]
                    rows.append((join(found), join(base), *(sum(x[1] == k for x in base) for k in range(3))))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())]
            yield pa.StructArray.from_arrays(columns, names=list(kinds))

    return scan.asNondeterministic()(valid_text(text))  # else a filter on the spans has Spark scan twice
