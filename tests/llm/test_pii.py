import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from nuggetry.llm import pii, queries

from .helpers import SF, clashing, docs, odd, rows

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


@given(st.text(st.sampled_from("aB1029.@+-% ()é\n_4"), max_size=60))
@settings(max_examples=600, deadline=None)
def test_linear_patterns_find_the_same(text):
    assert pii.entities(text) == plain(text)


def test_query_against_plain_patterns(spark):
    base = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = rows(queries.op7_pii(spark, SF))
    assert len(got) == len(base)
    for r in got:
        want = plain(base[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        assert r["spans"] == joined or r["spans"].startswith(joined)


def test_terms_that_give_an_entity_away(spark):
    filler = "alpha beta gamma delta epsilon zeta"
    texts = [f"{filler} {i} Zorblatt writes to max@home.example.org often {i}" for i in range(4)] + [f"{filler} plain {i}" for i in range(300)] + ["say zorblatt again é", None]
    df = docs(spark, texts)
    told = {r["term"]: r["disclosure"] for r in rows(pii.disclosures(df))}
    assert told["zorblatt"] > 0.9 and told["zorblatt"] < told["writes"] == 1.0 and told.get("zeta", 0) < 0.2
    got = {r["doc_id"]: r for r in rows(pii.personal_data_table(df))}
    assert got[304]["spans"] == "term_generalised:4:12" or got[304]["spans"] == "term_removed:4:12"
    assert got[10]["spans"] == "" and got[305]["spans"] == ""
    assert got[0]["spans"].startswith("email:") and "term" in got[0]["spans"]
    clean = {r["doc_id"]: r["text"] for r in rows(pii.sanitise(df))}
    assert "[EMAIL]" in clean[0] and "Zorblatt" not in clean[0] and "zorblatt" not in clean[304] and clean[10] == texts[10] and clean[305] is None
    assert {r["spans"] for r in rows(pii.sanitise(clashing(df)))} == {"clash"}
    small = {r["doc_id"]: r["spans"] for r in rows(pii.personal_data_table(df, block_terms=1))}
    assert {i: set(s.split(",")) for i, s in small.items()} == {i: set(r["spans"].split(",")) for i, r in got.items()}


def test_odd_rows(spark):
    got = rows(pii.personal_data_table(clashing(odd(spark))))
    assert len(got) == 10 and all(r["spans"] == "" for r in got)
    assert pii.personal_data_table(odd(spark).limit(0)).count() == 0
    long = docs(spark, ["9" * 200_000 + " a@" * 50_000, "1." * 100_000, "+1" + " " * 100_000])
    assert [r["n_email"] for r in rows(pii.personal_data_table(long))] == [0, 0, 0]


def test_terms_far_from_the_entity_and_short_ones(spark):
    far = "alpha beta gamma delta " * 40
    texts = [f"Li 李 90210 {far} {i} max@home.example.org {' ' * 500} Bob{i % 2} x{i}" for i in range(4)] + [f"{far} plain {i}" for i in range(300)] + ["Li in 90210"]
    told = {r["term"]: r["disclosure"] for r in rows(pii.disclosures(docs(spark, texts)))}
    assert told["李"] == 1.0 and 0.9 < told["li"] == told["90210"] < 1.0 and told["bob0"] > 0.8 and told["gamma"] < 0.1
    assert "home" not in told and "x1" not in told
    got = {r["doc_id"]: r["spans"] for r in rows(pii.personal_data_table(docs(spark, texts)))}
    assert "term_generalised:0:2" in got[304] and "term_generalised:6:11" in got[304] and got[10] == ""


def test_terms_beside_entities():
    text = "Ana ana@b.org Zed 10.0.0.1x éa@b.orgé end"
    found = pii.entities(text)
    taken = [(a, b) for _, a, b in found]
    want = {m[0].lower() for m in pii._TERM.finditer(text) if not any(a < m.end() and m.start() < b for a, b in taken)}
    assert pii.terms_beside(text, found) == want


def test_addresses_with_leading_zeros():
    text = "0" * 6000 + "10.0255.3.00004 1.2.3.256 7.7.7.7"
    assert pii.entities(text) == [("ip", 0, 6015), ("ip", 26 + 6000, 33 + 6000)] == plain_long(text)


def plain_long(text):
    return [("ip", *m.span()) for m in IP.finditer(text) if all(int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def test_secrets_are_told_by_their_entropy(spark):
    key = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    texts = [f'token = "{key}" and so on', "a" * 40 + " " + "1" * 40 + " " + "a1" * 20, f"x{key}@mail.org", None]
    got = rows(pii.personal_data_table(docs(spark, texts)))
    assert [r["n_secret"] for r in got] == [1, 0, 0, 0] and [r["sensitive"] for r in got] == [True, False, True, False]
    assert got[0]["spans"] == "secret:9:49" and got[2]["spans"].startswith("email:0:")
    assert "[SECRET]" in pii.sanitise(docs(spark, texts[:1])).first()["text"]


def test_bound_on_the_disclosure_drops_no_term(spark):
    """Against counts by hand: every (entity, term) pair over all documents."""
    texts = [f"max{i % 7}@home.org wort{i % 11} ding{i % 3} {'selten' if i % 7 == 2 else ''} 007" for i in range(60)] + [f"wort{i % 13} ohne ding{i % 5}" for i in range(90)] + ["selten", None, ""]
    seen = [set(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())) for t in texts]
    of = [{t[a:b] for _, a, b in pii.entities(t or "")} for t in texts]
    want = {}
    for e in set().union(*of):
        have = [i for i, x in enumerate(of) if e in x]
        for term in set().union(*(pii.terms_beside(texts[i], pii.entities(texts[i])) for i in have)):
            both = [i for i in have if term in pii.terms_beside(texts[i], pii.entities(texts[i]))]
            if len({texts[i] for i in both}) >= 2:
                n, n_term = len(texts), sum(term in s for s in seen)
                told = min(1.0, pii.log2(n * len(both) / (len(have) * n_term)) / pii.log2(n / len(have)))
                want[term] = max(want.get(term, told), told)
    for least in (0.0, 0.3, 0.9):
        got = {r["term"]: r["disclosure"] for r in rows(pii.disclosures(docs(spark, texts), least=least))}
        assert got.keys() == {t for t, d in want.items() if d >= least} and all(abs(got[t] - want[t]) < 1e-9 for t in got)
