import random
import re
from collections import Counter, defaultdict

from quantframe.llm import divergence

from .support import SCHEMA, docs, empty, odd_texts, prose

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs, top):
    """The audit by its definition, in memory."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups, held, times = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = Counter(TERM.findall((text or "").translate(lower)))
        groups[lang or "", source or ""] += found
        held[lang or ""].update(found.keys())
        times[lang or ""] += found
    out = set()
    for lang in held:
        kept = [t for t, c in held[lang].items() if c >= min_docs]
        shares = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: shares(c) for (x, s), c in groups.items() if x == lang}, shares(times[lang])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in p if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)}
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if groups[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(terms[:top], 1)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(k % 7 or None, *r, 0) for k, r in enumerate(rows)], SCHEMA)


def test_audit_equals_its_definition(spark):
    rng = random.Random(3)
    rows = [(x, rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", "", None])) for x in odd_texts(rng) * 2 + [prose(rng, rng.randint(0, 60)) for _ in range(120)]]
    rows += [("ab ab ab", "lone", "a"), (None, "none", "a"), ("", "none", "b"), ("rare word", "none", "c")]
    got = {tuple(r) for r in divergence.audit(table(spark, rows), min_docs=3, top=4).collect()}
    assert got == plain(rows, 3, 4)
    assert {r[4] for r in got if r[0] == "none"} == {0} and not [r for r in got if r[0] == "lone"]


def test_long_texts_are_counted_in_pieces():
    text = "Über one " * 500 + "x" * 90 + " é"
    count = lambda piece: Counter(t for terms in divergence.terms_of(text, piece) for t in terms)
    assert count(16) == count(1 << 20) == Counter({"Über".encode(): 500, b"one": 500, b"x" * 90: 1, "é".encode(): 1})


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    c, n, v = 7_000_000_000_000_003, 9_000_000_000_000_007, 123_456_789
    got = spark.createDataFrame([(c, n, v)], "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()[0]
    assert got == 1 + 1_000_000_000 * (c + 2) // (n + 2 * v)


def test_hot_group_and_shuffled_groups(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(prose(rng, 30), "en", "hot" if k % 3 else f"s{k % 40}") for k in range(240)]
    expected = plain(rows, 10, 10)
    monkeypatch.setattr(divergence, "MAX_GROUPS", 1)
    assert {tuple(r) for r in divergence.audit(table(spark, rows)).collect()} == expected


def test_defined_cases(spark):
    assert divergence.audit(empty(spark)).count() == 0
    clash = docs(spark, ["a b", "a c"]).selectExpr("*", "'x' as term", "1 as n", "2 as place", "3 as value")
    assert divergence.audit(clash, min_docs=1).columns == ["lang", "source", "part", "item", "value", "rank"]
