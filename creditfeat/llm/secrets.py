"""Secret scans with structural confirmation.

Patterns find assigned secrets, access keys and long hex strings. Base64 and hex candidates are
decoded beyond that, and reported only if the bytes have the structure of a key: DER whose nested
lengths fit exactly, an OpenSSH container whose strings fit exactly, or a signed token with a
JSON header that names its algorithm. Candidates may be armoured, with header lines or with escaped line
ends as in JSON, unarmoured on one line or wrapped over several, in hex, or armour inside base64.
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

from creditfeat.llm.common import pick, ship_package

BASE_KINDS = ["assign", "access", "hex"]
#: In the order in which spans of one start are listed.
KINDS = [*BASE_KINDS, "jwt", "pem", "der", "ssh", "hexder", "hexssh", "pem64"]
MASK = "[REDACTED]"

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
# Parts of which every assigned secret holds one, to pass over texts quickly.
_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
# Bodies run to the next five dashes; header lines and escaped line ends are among them.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----).)+)-----END \1-----", re.DOTALL)
_PEM_HEADER = re.compile(r"^[A-Za-z][A-Za-z0-9-]*:.*$", re.MULTILINE)
_ESCAPED_END = re.compile(r"(?:\\r)?\\n|\\r")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
# The rest of a value that is wrapped over lines, whose ends may be escaped.
_NEXT_LINE = re.compile(r"(?:\r?\n[ \t]*|(?:\\r)?\\n)([A-Za-z0-9+/_-]+={0,2})")
_STARTS = ("M", "b3Bl", "LS0tLS1CRUdJTi")  # base64 of DER, of an OpenSSH key, of armour
_HEXKEY = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee]737368)[0-9A-Fa-f]{46,}")
_SSH_MAGIC = b"openssh-key-v1\x00"


def _decoded(text: str) -> bytes | None:
    """Base64 in either alphabet, with or without padding and line breaks."""
    body = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) pairs that fill ``data`` exactly, or None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size = int.from_bytes(data[at : at + width], "big")
            if size < 0x80:
                return None
            at += width
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


def is_private_der(data: bytes) -> bool:
    """Whether nested lengths and tags are those of an RSA, EC, PKCS#8 or encrypted PKCS#8 key."""
    outer = _der_items(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    inner = _der_items(outer[0][1])
    if not inner:
        return False
    tags = [tag for tag, _ in inner]
    if tags[:3] == [0x02, 0x30, 0x04] or tags == [0x30, 0x04]:
        algorithm = _der_items(inner[tags.index(0x30)][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if tags[:2] == [0x02, 0x04]:
        return inner[0][1] == b"\x01"
    return len(tags) >= 6 and set(tags) == {0x02}


def is_openssh_key(data: bytes) -> bool:
    """Whether the length-prefixed strings of an OpenSSH private key fill ``data`` exactly."""
    if not data.startswith(_SSH_MAGIC):
        return False
    at, strings = len(_SSH_MAGIC), 0
    for part in ("string", "string", "string", "count", "string", "string"):
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if part == "string":
            at += size
            strings += 1
        elif size != 1:
            return False
    return at == len(data) and strings == 5


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    """Whether header and payload are JSON objects and the header names its algorithm."""
    try:
        head, body = (json.loads(_decoded(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict):
        return False
    algorithm = head.get("alg")
    return isinstance(algorithm, str) and (bool(signature) or algorithm.lower() == "none")


def is_armoured_key(body: str) -> bool:
    """Whether what stands between the armour lines decodes to a key. The key of a body with the
    header lines of an encrypted one has no structure of its own, but whole cipher blocks."""
    body = _ESCAPED_END.sub("\n", body)
    headers = _PEM_HEADER.findall(body)
    data = _decoded(_PEM_HEADER.sub("", body))
    if not data:
        return False
    if any("ENCRYPTED" in h for h in headers) and any(h.startswith("DEK-Info:") for h in headers):
        return len(data) >= 16 and len(data) % 8 == 0
    return is_private_der(data) or is_openssh_key(data)


def _size_of(data: bytes) -> int | None:
    """Bytes that the key at the start of ``data`` says it has, if it begins like one."""
    if data[:1] == b"\x30" and len(data) > 1:
        width = data[1] & 0x7F if data[1] & 0x80 else 0
        if width > 4 or len(data) < 2 + width:
            return None
        return 2 + width + (int.from_bytes(data[2 : 2 + width], "big") if width else data[1])
    if data.startswith(_SSH_MAGIC):
        at = len(_SSH_MAGIC)
        for part in ("string", "string", "string", "count", "string", "string"):
            if at + 4 > len(data):
                return None
            at += 4 + (int.from_bytes(data[at : at + 4], "big") if part == "string" else 0)
        return at
    return None


def _wrapped(text: str, lines: list[str], end: int) -> int | None:
    """Adds the next line of a value that ends at ``end`` to ``lines``; where that one ends."""
    follows = None if lines[-1].endswith("=") else _NEXT_LINE.match(text, end)
    if not follows:
        return None
    lines.append(follows[1])
    return follows.end()


def _unarmoured(text: str, start: int, end: int) -> tuple[str, int, int] | None:
    """The key that begins with the run of base64 from ``start`` to ``end``, on one line or wrapped over several.
    A key's own length says how many lines are taken, and it must end where a line does."""
    if text[start] == "n" and text[start - 1 : start] == "\\":  # the letter of an escaped line end
        start += 1
    if not text.startswith(_STARTS, start):
        return None
    lines = [text[start:end]]
    armour = text.startswith(_STARTS[2], start)
    while True:
        whole = "".join(lines)
        data = _decoded(whole if whole.endswith("=") else whole[: len(whole) // 4 * 4]) or b""
        if armour:
            inner = _PEM.search(data.decode("ascii", "replace"))
            if inner:
                return ("pem64", start, end) if is_armoured_key(inner[2]) else None
        else:
            need = _size_of(data)
            if need is None and not text.startswith(_STARTS[1], start):
                return None
            if need is not None and 4 * need <= 3 * len(whole):
                data = _decoded(whole) or b""
                kind = "der" if is_private_der(data) else "ssh" if is_openssh_key(data) else None
                return (kind, start, end) if kind else None
        further = _wrapped(text, lines, end)
        if further is None:
            # The last characters of an unpadded value may be less than a group of four.
            data = _decoded(whole) or b""
            kind = "der" if is_private_der(data) else "ssh" if is_openssh_key(data) else None
            return (kind, start, end) if kind else None
        end = further


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then by kind as in ``KINDS``."""
    spans = []
    lower = text.lower()
    if any(hint in lower for hint in _HINTS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                spans.append(("assign", m.start(), m.end()))
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    if "eyJ" in text:
        spans += [
            ("jwt", m.start(), m.end()) for m in _JWT.finditer(text) if is_signed_token(*m.groups())
        ]
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            if is_armoured_key(m[2]):
                spans.append(("pem", m.start(), m.end()))
    done = 0
    for m in _BASE64.finditer(text):
        if m.start() < done or any(k == "pem" and a <= m.start() < b for k, a, b in spans):
            continue
        found = _unarmoured(text, *m.span())
        if found:
            spans.append(found)
            done = found[2]
    for m in _HEXKEY.finditer(text):
        data = bytes.fromhex(m[0]) if len(m[0]) % 2 == 0 else b""
        if is_private_der(data):
            spans.append(("hexder", m.start(), m.end()))
        elif is_openssh_key(data):
            spans.append(("hexssh", m.start(), m.end()))
    if len(spans) > 1:
        spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every run of overlapping spans replaced by ``MASK``."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _rows(spans: list[tuple[str, int, int]]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (array of kind, start, end) for every row of ``docs``.

    Null texts count as empty; empty texts have no spans. Repeated rows and null ids each give a
    row. Further columns are ignored. An empty table gives an empty result. Only one Arrow batch of
    texts is in a worker's memory at a time.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_rows(find_spans(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "spans"]
            )

    kind = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, kind)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``n_chars`` following it; other columns and
    their order stay. Null texts stay null."""
    ship_package(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                spans = find_spans(text or "")
                texts.append(masked(text, spans) if spans else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out
