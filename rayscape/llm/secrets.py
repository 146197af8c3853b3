"""Secret scans with structural confirmation.

Three base patterns (assignments, access keys, hex runs) are found as text. Beyond
them, base64 and hex runs are decoded and reported only where the bytes parse as a secret's
encoding: DER whose nested lengths fill the value exactly and whose outline is a private key's, an OpenSSH private key
whose fields fill it, PEM text that holds either, or a signed token whose header is JSON naming an algorithm. Public keys and certificates
parse as well, and are no secrets: they aren't reported.

A run is decoded as a whole, then from places where a key may begin inside it, and together with the
lines it is wrapped over.
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
from pyspark.sql import types as T

from rayscape.llm.arrowio import carried, slices

KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of 20 or more; shorter runs match nothing that lasts
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40,}(?:\r?\n[\t\x20]*[A-Za-z0-9+/]{4,}){1,400}={0,2}(?![A-Za-z0-9+/=])")
HEX_ANY = re.compile(r"[0-9A-Fa-f]{40,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}KEY)-----((?:\s*(?:Proc-Type|DEK-Info):[^\r\n]{0,200})*)([A-Za-z0-9+/=\s]{40,})-----END [A-Z0-9 ]{0,40}KEY-----")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{16,})")
# How base64 of a DER sequence, of an OpenSSH private key and of PEM text begins.
STARTS = re.compile(r"M[A-P](?=[A-Za-z0-9+/])|b3BlbnNzaC1r|LS0tLS1CRUdJTi")
LEAST_KEY = 20  # bytes of a decoded key at the least

Span = tuple[int, int, int]  # start, rank of the kind, end


def der_value(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of contents, end of contents) of the DER value at ``at``, if its length fits."""
    if at + 2 > end:
        return None
    tag, first = data[at], data[at + 1]
    at += 2
    if first < 0x80:
        size = first
    else:
        n = first & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        if size < 0x80:
            return None
        at += n
    return (tag, at, at + size) if at + size <= end else None


def is_der_key(data: bytes) -> bool:
    """Whether data is one DER value of a private key's outline, whose lengths fit at every depth.

    That is a SEQUENCE of a version (0 or 1) and further values, as plain private keys are; of an algorithm and an octet string, as
    encrypted ones are; or of version 3 and a sequence, as key stores are. Certificates and public keys begin otherwise.
    """
    top = der_value(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data) or len(data) < LEAST_KEY:
        return False
    first: list[tuple[int, int, int]] = []
    todo = [(top[1], top[2], 1)]
    while todo:
        at, end, depth = todo.pop()
        while at < end:
            value = der_value(data, at, end)
            if value is None or depth > 12:
                return False
            tag, start, at = value
            if depth == 1:
                first.append(value)
            if tag & 0x20:
                todo.append((start, at, depth + 1))
    tags = [v[0] for v in first]
    if len(first) < 2:
        return False
    if tags[0] == 0x02 and first[0][2] - first[0][1] == 1:
        version = data[first[0][1]]
        return (version in (0, 1) and tags[1] in (0x02, 0x04, 0x30)) or (version == 3 and tags[1] == 0x30)
    return tags == [0x30, 0x04] and first[0][1] < first[0][2] and data[first[0][1]] == 0x06


def fields(data: bytes, at: int, n: int | None = None) -> tuple[list[bytes], int] | None:
    """(n length-prefixed fields from ``at`` on, where they end); as many as fill the data if n isn't given; None if a length doesn't fit."""
    out: list[bytes] = []
    while len(out) != n if n is not None else at < len(data):
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if size > len(data) - at:
            return None
        out.append(data[at : at + size])
        at += size
    return out, at


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key: cipher, key derivation and its options, as many public keys as it says, and a private part that ends it."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    head = fields(data, len(magic), 3)
    if not head or head[1] + 4 > len(data):
        return False
    n = int.from_bytes(data[head[1] : head[1] + 4], "big")
    rest = fields(data, head[1] + 4, n + 1) if 1 <= n <= 64 else None
    return bool(rest) and rest[1] == len(data) and all(public_name(k) for k in rest[0][:-1]) and len(rest[0][-1]) >= 8


def public_name(blob: bytes) -> bool:
    """Whether a public key's fields fill it, the first one naming its algorithm."""
    found = fields(blob, 0)
    return bool(found) and len(found[0]) >= 2 and bool(re.match(rb"(ssh|ecdsa|sk-ssh|sk-ecdsa)-[a-z0-9@.-]{3,60}$", found[0][0]))


def unpack(run: str) -> bytes | None:
    """Bytes of a base64 run, in either alphabet, padded or not."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def kind_of_key(data: bytes | None) -> str | None:
    """What kind of private key bytes are: DER, OpenSSH, or PEM text of either."""
    if not data or len(data) < LEAST_KEY:
        return None
    if data.lstrip()[:11] == b"-----BEGIN ":
        m = PEM.search(data.decode("latin-1"))
        return kind_of_pem(m) if m else None
    return "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def kind_of_pem(m: re.Match) -> str | None:
    """The kind of an armoured key; one that says it is encrypted as a whole can't be looked into further."""
    body = unpack("".join(m[3].split()))
    if "ENCRYPTED" in m[2] and m[1].endswith("PRIVATE KEY"):
        return "der" if body and len(body) >= LEAST_KEY else None
    return kind_of_key(body) if body and not body.startswith(b"-----") else None


def is_signed_token(header: str) -> bool:
    """Whether a token's first part decodes to a JSON object that names its algorithm."""
    data = unpack(header)
    try:
        value = json.loads(data.decode("utf-8")) if data else None
    except (UnicodeDecodeError, ValueError, RecursionError):
        return False
    return isinstance(value, dict) and isinstance(value.get("alg"), str) and bool(value["alg"])


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def may_begin(run: str, at: int, end: int) -> bool:
    """Whether run[at:end] begins as a key does and, for DER, has the very length that it states. A constant number of steps."""
    if run.startswith(("b3BlbnNzaC1r", "LS0tLS1CRUdJTi"), at):
        return True
    head = unpack(run[at : min(at + 12, end)])
    size = (end - at - run[max(at, end - 2) : end].count("=")) * 3 // 4
    if not head or len(head) < 8 or head[0] != 0x30:
        return False
    n = head[1] & 0x7F
    return size == (2 + n if head[1] < 0x80 else 2 + n + int.from_bytes(head[2 : 2 + n], "big") if 1 <= n <= 4 else -1)


def run_spans(text: str, start: int, end: int) -> Iterator[Span]:
    """Keys in a run of base64: from its start, or else from the first place inside it where one begins and runs to its end."""
    run = text[start:end]
    for at in [0, *(m.start() for m in STARTS.finditer(run) if m.start())]:
        if may_begin(run, at, len(run)) and (kind := kind_of_key(unpack(run[at:]))):
            yield start + at, KINDS.index(kind), end
            return


def wrapped_spans(text: str, start: int, end: int) -> Iterator[Span]:
    """A key that begins a run of base64 lines and ends with one of them."""
    lines = [(start + m.start(), start + m.end()) for m in re.finditer(r"[A-Za-z0-9+/=]+", text[start:end])]
    run, ends = "".join(text[a:b] for a, b in lines), []
    for a, b in lines:
        ends.append(b - a + (ends[-1] if ends else 0))
    for k in range(len(lines), 1, -1):
        if may_begin(run, 0, ends[k - 1]) and (kind := kind_of_key(unpack(run[: ends[k - 1]]))):
            yield start, KINDS.index(kind), lines[k - 1][1]
            return


def structural_spans(text: str) -> list[Span]:
    armoured = [(m.start(), KINDS.index(kind), m.end()) for m in PEM.finditer(text) if (kind := kind_of_pem(m))] if "KEY-----" in text else []
    out: set[Span] = set()
    for m in ENCODED.finditer(text):
        out.update(run_spans(text, m.start(), m.end()))
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            out.update(wrapped_spans(text, m.start(), m.end()))
    out = {x for x in out if not any(a <= x[0] and x[2] <= b for a, _, b in armoured)} | set(armoured)
    for m in HEX_ANY.finditer(text):
        if (m.end() - m.start()) % 2 == 0 and (kind := kind_of_key(bytes.fromhex(m[0]))):
            out.add((m.start(), KINDS.index(kind), m.end()))
    if "eyJ" in text:
        out.update((m.start(), KINDS.index("jwt"), m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[1]))
    return sorted(out)


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch that spans cover replaced by ``[SECRET]``."""
    out, at = [], 0
    for s, _, e in sorted(spans):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = e
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text: str = "text", id_column: str = "doc_id", carry: bool = False, redacted: bool = False) -> DataFrame:
    """Base and confirmed spans of each row, with its id; with ``carry``, all its other columns come along as a struct ``__row`` instead.

    Null texts count as empty: no spans, and a null redacted text. Very long texts are
    scanned whole. Rows are independent, so repeated rows give repeated results and an
    empty table gives an empty one. Other columns of ``docs`` can have any name.
    """
    rows = docs.select(carried(docs, id_column, text, carry).alias("__row"), docs[text].alias("__text"))
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"] + ["redacted"] * redacted
    schema = T.StructType([rows.schema["__row"], *[T.StructField(n, T.LongType() if n.startswith("n_") else T.StringType()) for n in names]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            found = []
            for t in b.column("__text").to_pylist():
                base = base_spans(t or "")
                every = sorted(base + structural_spans(t or ""))
                kinds = [k for _, k, _ in base]
                row = (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(shown(base).encode()).hexdigest(), shown(every))
                found.append(row + ((redact(t, every) if t is not None else None,) if redacted else ()))
            types = [pa.int64()] * 3 + [pa.string()] * (len(names) - 3)
            arrays = [pa.array(c, t) for c, t in zip(zip(*found), types)]
            yield pa.RecordBatch.from_arrays([b.column("__row"), *arrays], names=["__row", *names])

    out = rows.mapInArrow(work, schema)
    return out if carry else out.withColumnRenamed("__row", id_column)
