"""Secret scans with multipart credential linking.

Patterns find what is a secret or an access identifier by its own form: assignments, access keys and hexadecimal
tokens. A credential has further parts that prove nothing alone: names of users, mixed tokens, values too short for
an assignment, endpoints. Every part has a role (``id``, ``secret`` or ``endpoint``), and an interval, its span widened
by ``REACH`` code points and clipped to its scope, the text between two blank lines. Parts of different roles whose
intervals meet are joined; a weak part is reported if it joins a strong part of another role, or parts of both other roles.

The join runs within a text, where the parts are found: per scope and role, starts are sorted beside the furthest end up
to each, so that whether a partner lies in reach is one bisection and no pairs are written out. Nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import LOWER_TABLE, packed, slices, utf8, without

#: Kinds that are reported by their form alone, and those that need partners, with the role of each.
KINDS = ("assign", "access", "hex")
ADDED = ("user", "value", "mixed", "endpoint")
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "user": "id", "value": "secret", "mixed": "secret", "endpoint": "endpoint"}
#: Most code points between two parts of a credential.
REACH = 200

# The patterns of the contract, and the lengths that a match must have.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{32,}")
VALUE_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
# End of the fixed values.

_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_USER = re.compile(r"""(?:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
_USERS = (b"user", b"login", b"account", b"clientid", b"client_id", b"keyid", b"key_id")
_MIXED = re.compile("[A-Za-z0-9+/_-]{16,}")
_CLASSES = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))
_ENDPOINT = re.compile(r"""(?:https?|ftp|ssh|s3|redis|amqp|postgresql|postgres|mysql|mongodb)://[^\x00-\x20"'<>]+""")
_BLANK = re.compile(r"\n[\x20\t]*\n")

_HEX_TABLE = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

Span = tuple[str, int, int]


def strong_parts(text: str, raw: bytes | None = None) -> tuple[list[Span], list[Span]]:
    """The (kind, start, end) in code points that count by themselves, in order, and assignments of too short a value.
    Matches of a kind are leftmost and do not overlap; one that fails a length is dropped and not tried again."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    found, short = [], []
    low = raw.translate(LOWER_TABLE)
    if any(w in low for w in _WORDS):
        for m in _ASSIGN.finditer(text):
            (found if len(m[2]) >= VALUE_LENGTH else short).append(("assign", *m.span()))
    if b"AKIA" in raw:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    if b"x" * HEX_LENGTH in raw.translate(_HEX_TABLE):
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))), short


def weak_parts(text: str, raw: bytes, strong: list[Span], short: list[Span]) -> list[Span]:
    """The parts that prove nothing alone: users and mixed tokens that overlap no strong part, short values, endpoints."""
    low = raw.translate(LOWER_TABLE)
    taken = _Reach([(a, b) for _, a, b in strong])
    free = lambda m: not taken.meets(m.start() + 1, m.end() - 1)
    found = [("value", a, b) for _, a, b in short]
    if any(w in low for w in _USERS):
        found += [("user", *m.span()) for m in _USER.finditer(text) if free(m)]
    if b"://" in raw:
        found += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    if found or strong:  # a mixed token alone links to nothing
        found += [("mixed", *m.span()) for m in _MIXED.finditer(text) if free(m) and all(c.search(m[0]) for c in _CLASSES)]
    return found


class _Reach:
    """Intervals, asked whether any of them meets another one."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.furthest = list(accumulate((b for _, b in spans), max))

    def meets(self, start: int, end: int) -> bool:
        """Whether an interval starts at ``end`` or before it and ends at ``start`` or after it."""
        n = bisect_right(self.starts, end)
        return n > 0 and self.furthest[n - 1] >= start


def linked(text: str, strong: list[Span], weak: list[Span], reach: int = REACH) -> list[Span]:
    """The weak parts that complement others of their scope."""
    ends = [m.end() for m in _BLANK.finditer(text)] if weak else []
    by_scope: dict[tuple[int, str, bool], list[tuple[int, int]]] = {}
    for parts, sure in ((strong, True), (weak, False)):
        for kind, a, b in parts:
            by_scope.setdefault((bisect_right(ends, a), ROLES[kind], sure), []).append((a, b))
    index = {k: _Reach(v) for k, v in by_scope.items()}
    out = []
    for kind, a, b in weak:
        near = lambda role, sure: (x := index.get((bisect_right(ends, a), role, sure))) is not None and x.meets(a - reach, b + reach)  # noqa: B023, E731
        others = [r for r in ("id", "secret", "endpoint") if r != ROLES[kind]]
        if any(near(r, True) for r in others) or all(near(r, False) for r in others):
            out.append((kind, a, b))
    return out


def secrets(text: str, raw: bytes, reach: int = REACH) -> list[Span]:
    """All reported spans: by start, then by kind, those that count alone before the linked ones."""
    strong, short = strong_parts(text, raw)
    weak = weak_parts(text, raw, strong, short)
    order = {k: i for i, k in enumerate((*KINDS, *ADDED))}
    return sorted(strong + linked(text, strong, weak, reach), key=lambda s: (s[1], order[s[0]], s[2])) if weak else strong


FOUND = T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _finder(reach: int):
    @arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        out = [[{"kind": k, "start": a, "end": b} for k, a, b in secrets(raw.decode(), raw, reach)] for part in slices(texts) for raw in utf8(part)]
        return pa.array(out, _SPANS)

    return find


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``docs`` with ``found``: kind, start and end (exclusive, code points) of every span, by start and kind.

    Kinds are assign, access and hex, then the linked user, value, mixed and endpoint. Null and empty texts have no spans, ids
    play no part, repeated rows fare alike, an empty table gives an empty one; a column named ``found`` is replaced; very
    long texts are read whole, a row at a time.
    """
    return without(docs, "found").withColumn("found", _finder(reach)("text"))


def _listed(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_table(docs: DataFrame, **how) -> DataFrame:
    """The digest: doc_id, counts by kind, base_sha256 and spans, then n_linked, the number of linked parts."""
    out = find_secrets(docs.select("doc_id", "text"), **how)
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    count = lambda *kinds: F.size(of(*kinds)).cast("long")
    return out.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(_listed(of(*KINDS)).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), count(*ADDED).alias("n_linked"))


@arrow_udf(T.StringType())
def _redacted(texts: pa.Array, found: pa.Array) -> pa.Array:
    out = []
    for text, spans in zip(texts.to_pylist(), found.to_pylist()):
        if text is not None and spans:
            kept, at = [], 0
            for s in spans:
                if s["start"] >= at:
                    kept += [text[at : s["start"]], f"[{ROLES[s['kind']].upper()}]"]
                at = max(at, s["end"])
            text = "".join([*kept, text[at:]])
        out.append(text)
    return pa.array(out, pa.string())


def redact(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every span replaced by its role, overlapping ones by the first's; columns as they are, null stays null."""
    out = find_secrets(packed(docs, "text"), **how).withColumn("text", _redacted("text", "found"))
    return out.select(*[(F.col("text") if c == "text" else F.col("_row").getField(c)).alias(c) for c in docs.columns])
