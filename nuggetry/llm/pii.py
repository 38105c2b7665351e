"""Personal data by information-theoretic sanitisation.

Patterns find the protected entities: e-mail and IP addresses, card and phone numbers; so does the information that
a single token carries, for secrets (long tokens of letters and digits with a high entropy). The corpus then says
which terms give an entity away: with documents as events, PMI(c; t) is what term t tells of entity c, IC(c) is
all there is to tell, and PMI / IC is the disclosure. Candidates are the terms that share at least ``support``
different texts with an entity, wherever they stand in them; a term's length does not matter, its frequency in the
corpus keeps common words' disclosure low. Terms that disclose ``remove_at`` or more
are removed wherever they stand, those from ``generalise_at`` on are replaced by their kind. Entities always go.

All counts are over all documents and meet in shuffles. How often a term stands in the texts that hold entities bounds
its disclosure from above, so that the whole corpus is asked only for terms that can still disclose enough: that
drops no term of the result. Disclosing terms go to the workers in blocks of bounded size, ``PASS`` blocks at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import WORD_TABLE, cut, discard, packed, slices, small, utf8, without

KINDS = ("email", "ip", "card", "phone")
ADDED = ("secret", "term_removed", "term_generalised")
SUPPORT = 2
GENERALISE_AT, REMOVE_AT = 0.9, 0.97
#: Most terms in a block that is sent to the workers.
BLOCK_TERMS = 200_000
#: Blocks that texts pass before what was found is written and the blocks are given up.
PASS = 2
#: Least length of a secret and least entropy of its characters, in bits.
SECRET_LENGTH, SECRET_BITS = 24, 3.0

# The patterns of the entities. The possessive and look-behind forms match the same texts in linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")
_TOKEN = re.compile("(?<![0-9A-Za-z])[0-9A-Za-z]{%d,}+" % SECRET_LENGTH)
_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _octet(part: str) -> bool:
    """Whether the digits name a number up to 255, whatever zeros lead."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _luhn(digits: list[int]) -> bool:
    odd = digits[-1::-2]
    return (sum(odd) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed and then by start."""
    found = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = [int(c) for c in m[0] if c.isdigit()]
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def secrets(text: str, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Tokens that overlap no entity, hold letters and digits, and whose characters carry ``SECRET_BITS`` or more."""
    out = []
    for m in _TOKEN.finditer(text):
        if m[0].isalpha() or m[0].isdigit() or any(a < m.end() and m.start() < b for _, a, b in found):
            continue
        n = m.end() - m.start()
        if -sum(c / n * log2(c / n) for c in Counter(m[0]).values()) >= SECRET_BITS:
            out.append(("secret", *m.span()))
    return out


def protected(text: str) -> list[tuple[str, int, int]]:
    """Entities, then secrets."""
    found = entities(text)
    return found + secrets(text, found)


def terms_beside(text: str, found: list[tuple[str, int, int]]) -> set[str]:
    """The terms of a text, lower-cased, that stand somewhere outside its entities."""
    spans = sorted((a, b) for _, a, b in found)
    out, i, reached = set(), 0, 0
    for m in _TERM.finditer(text):
        while i < len(spans) and spans[i][0] < m.end():
            reached, i = max(reached, spans[i][1]), i + 1
        if reached <= m.start():
            out.add(m[0].lower())
    return out


def _entities_and_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for part in slices(batch.column(0)):
            names, terms, copies = [], [], []
            for text, n in zip(part.to_pylist(), batch.column(1).slice(done, len(part)).to_pylist()):
                if found := protected(text):
                    names.append(list({f"{k}:{text[a:b].lower()}" for k, a, b in found}))
                    terms.append(list(terms_beside(text, found)))
                    copies.append(n)
            done += len(part)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.string())), pa.array(copies, pa.int64())], names=["entities", "terms", "n"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the texts that hold each term, summed over some megabytes of them."""
    for batch in batches:
        for part in slices(batch.column(0), 8 << 20):
            total = Counter()
            for text in utf8(part):
                total.update(set(_words(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])


def _words(text: bytes) -> list[bytes]:
    """The terms of a text, lower-cased as str.lower does it."""
    if not text.isascii():
        text = text.decode().lower().encode()
    return text.translate(WORD_TABLE).split()


def _blocks(terms: DataFrame, size: int) -> Iterator[list[str]]:
    """The terms in blocks of at most ``size``; one block is on the driver at a time."""
    block: list[str] = []
    for r in terms.toLocalIterator():
        block.append(r[0])
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def disclosures(docs: DataFrame, support: int = SUPPORT, least: float = 0.0) -> DataFrame:
    """``(term, disclosure)``: what the terms that keep an entity company tell of it, at most, from 0 to 1; those that
    tell ``least`` or more.

    Copies of one text count as documents but not as different texts for ``support``; entities in fewer texts have
    no candidates. Null texts count as documents without terms.
    """
    texts = docs.select("text").where("text IS NOT NULL")
    distinct = texts.where(F.col("text").rlike("[0-9@]")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    held = cut(distinct.mapInArrow(_entities_and_terms, "entities array<string>, terms array<string>, n long"))
    each = held.select("terms", "n", F.explode("entities").alias("entity"))
    alone = cut(each.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("n_texts")).where(F.col("n_texts") >= support).drop("n_texts"))
    total = F.lit(float(docs.count()))

    def told(n_term: str) -> F.Column:
        return F.least(F.lit(1.0), F.log2(total * F.col("n_both") / (F.col("n_entity") * F.col(n_term))) / F.log2(total / F.col("n_entity")))

    pairs = each.join(small(alone.select("entity")), "entity").select("entity", "n", F.explode("terms").alias("term"))
    together = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("n_texts")).where(F.col("n_texts") >= support)
    beside = held.select("n", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("n").alias("n_beside"))
    open_pairs = together.join(small(alone), "entity").where(F.col("n_entity") < total).join(beside, "term").where(told("n_beside") >= least)
    able = cut(open_pairs.select("entity", "term", "n_both", "n_entity"))
    terms = small(able.select("term").distinct())
    counted = texts.mapInArrow(_frequencies, "term string, n long").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_term"))
    out = cut(able.join(counted, "term").groupBy("term").agg(F.max(told("n_term")).alias("disclosure")).where(F.col("disclosure") >= least))
    for done in (held, alone, able):
        discard(done)
    return out


FOUND = T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()))
_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


@arrow_udf(FOUND)
def _find(texts: pa.Array) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in protected(t or "")] for part in slices(texts) for t in part.to_pylist()], _KIND)


def _marker(sent):
    @arrow_udf(FOUND)
    def mark(texts: pa.Array, before: pa.Array) -> pa.Array:
        """Adds the spans of disclosing terms that overlap no entity."""
        kinds, out, done = sent.value, [], 0
        for part in slices(texts):
            seen = before.slice(done, len(part)).to_pylist()
            done += len(part)
            for raw, text, spans in zip(utf8(part), part.to_pylist(), seen):
                if raw and not kinds.keys().isdisjoint(_words(raw)):
                    taken = [(s["start"], s["end"]) for s in spans if not s["kind"].startswith("term")]
                    for m in _TERM.finditer(text):
                        kind = kinds.get(m[0].lower().encode())
                        if kind and not any(a < m.end() and m.start() < b for a, b in taken):
                            spans.append({"kind": kind, "start": m.start(), "end": m.end()})
                out.append(spans)
        return pa.array(out, _KIND)

    return mark


def find_personal_data(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT, block_terms: int = BLOCK_TERMS, **how) -> DataFrame:
    """``docs`` with ``found``: kind, start and end (exclusive, code points) of every span.

    Kinds are email, ip, card, phone, then secret, ``term_removed`` and ``term_generalised``. Null text has no spans; a
    term is where its lower-cased form stands as a whole word; a column named ``found`` is replaced; very long
    texts are read whole, a row at a time.
    """
    chosen = disclosures(docs, least=generalise_at, **how)
    kind = F.when(F.col("disclosure") >= remove_at, "term_removed").otherwise("term_generalised")
    out, sent = without(docs, "found").withColumn("found", _find("text")), []
    for block in _blocks(chosen.select(F.concat_ws(" ", "term", kind).alias("t")), block_terms):
        if len(sent) == PASS:
            out = cut(out)
            for old in sent:
                old.unpersist()
            sent = []
        kinds = {t.encode(): k for t, k in (x.rsplit(" ", 1) for x in block)}
        sent.append(docs.sparkSession.sparkContext.broadcast(kinds))
        out = out.withColumn("found", _marker(sent[-1])("text", "found"))
    discard(chosen)
    return out


def _listed(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_table(docs: DataFrame, **how) -> DataFrame:
    """The digest: doc_id, counts by kind, base_sha256 and spans, then the added kinds: n_secret, n_term and
    sensitive (an entity or a secret). Spans come by kind, entities first, then by start."""
    out = find_personal_data(docs.select("doc_id", "text"), **how)
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    count = lambda *kinds: F.size(of(*kinds)).cast("long")
    spans = F.concat(of(*KINDS), *[F.array_sort(of(k)) for k in ADDED])
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(of(*KINDS)).cast("binary"), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
        count("secret").alias("n_secret"),
        count(*ADDED[1:]).alias("n_term"),
        (count(*KINDS, "secret") > 0).alias("sensitive"),
    )


@arrow_udf(T.StringType())
def _sanitised(texts: pa.Array, found: pa.Array) -> pa.Array:
    out = []
    for text, spans in zip(texts.to_pylist(), found.to_pylist()):
        if text is not None and spans:
            kept, at = [], 0
            for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                if s["end"] <= at:
                    continue
                kept.append(text[at : max(at, s["start"])])
                name = {"term_removed": "", "term_generalised": "[TERM]"}.get(s["kind"], f"[{s['kind'].upper()}]")
                kept.append(name if s["start"] >= at else "")
                at = s["end"]
            text = "".join([*kept, text[at:]])
        out.append(text)
    return pa.array(out, pa.string())


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with entities and secrets replaced by their kind, disclosing terms removed or replaced; columns as they
    are. Null text stays null, ids play no part, repeated rows fare alike, an empty table gives an empty one."""
    out = find_personal_data(packed(docs, "text"), **how).withColumn("text", _sanitised("text", "found"))
    return out.select(*[(F.col("text") if c == "text" else F.col("_row").getField(c)).alias(c) for c in docs.columns])
