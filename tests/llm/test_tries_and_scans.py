"""Prefix trie, license scan and divergence audit: SQL on the tables, brute force on odd ones, the split forms, defined cases."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from latentia.llm import divergence, licenses, prefixes, queries
from tests.conftest import SMALL
from tests.test_queries import plain

CONV = "conv_id long, turn long, role string, text string, at string, trail int"
DOC = "doc_id long, text string, lang string, source string, gi long, term string"


@pytest.mark.parametrize("name", ["op11_conversation_prefix_trie", "op12_license_scan", "op13_source_divergence"])
def test_matches_sql(spark, duck, name):
    frames = queries.QUERIES[name](spark, SMALL).toPandas(), duck.execute(queries.ORACLES[name]).df()
    got, want = [x.astype(object).where(x.notna(), None) for x in frames]
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def nodes(conversations: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    """The contract's rows of rebuilt conversations, by listing every prefix."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    inside = lambda p: [q for q in members if q[: len(p)] == p]
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(conversations[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in inside(p) if q)
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), kids[p], sum(not kids[q] for q in inside(p)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def as_rows(df) -> list[tuple]:
    return sorted([tuple(r[c] for c in prefixes.COLUMNS) for r in df.collect()], key=str)


def rebuild(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((-(1 << 60) if turn is None else turn, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t, key=lambda x: x[0])] for c, t in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - int(np.fmod(c, 100)), [])[: h[c]] + own[c][h[c] :] for c in own}


def odd_conversations() -> list[tuple]:
    rng, rows = np.random.default_rng(5), []
    for c in [*range(0, 40), 100, 101, 199, 305, 306, -7, -250, 12345]:
        shared = ["hello", "", "what is näive 日本?", "x" * 3000, "bye"]
        for t in range(int(rng.integers(0, 9))):
            text = shared[t] if t < 5 and rng.random() < 0.8 else f"own {rng.integers(3)}"
            rows.append((c, None if t == 0 and c % 3 == 0 else t, None if c % 4 == 0 else "user", None if text == "" else text, "clash", 1))
    repeated = [r for r in rows if r[0] == 5][:1] * 2
    return [*rows, *repeated, (None, 1, "user", "no id", "x", None)]


def test_trie_by_brute_force(spark):
    rows = odd_conversations()
    assert as_rows(prefixes.prefix_trie(spark.createDataFrame(rows, CONV))) == nodes(rebuild(rows))
    assert prefixes.prefix_trie(spark.createDataFrame([], CONV)).count() == 0


@pytest.mark.parametrize("paths", [1, 3])
def test_trie_with_oversized_subtries(spark, monkeypatch, paths):
    """Nearly every subtrie is dealt by its next turns, at many depths, and node strings span several ranges."""
    monkeypatch.setattr(prefixes, "PATHS", paths)
    monkeypatch.setattr(prefixes, "RANGE", 4)
    monkeypatch.setattr(prefixes, "BUCKET", 3)
    rows = odd_conversations()
    rows += [(1000 + c, t, "user", f"deep {t}", None, None) for c in range(30) for t in range(c)]  # each a prefix of the next
    rows += [(2000 + c, t, "user", "copy", None, None) for c in range(60) for t in range(3)]
    assert as_rows(prefixes.prefix_trie(spark.createDataFrame(rows, CONV))) == nodes(rebuild(rows))


def test_trie_of_turnless_conversations(spark):
    """A conversation whose own turns all lie before h and whose base is absent belongs to the root alone."""
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "gone", None, None)]
    assert as_rows(prefixes.prefix_trie(spark.createDataFrame(rows, CONV))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_ties_have_one_order(spark):
    rows = [(7, 1, "user", t, None, None) for t in "cab"]
    runs = [as_rows(prefixes.prefix_trie(spark.createDataFrame(r, CONV))) for r in (rows, rows[::-1])]
    assert runs[0] == runs[1]


def containments(text: str, templates: tuple[tuple[str, str], ...], threshold: Fraction) -> list[tuple[str, int, int]]:
    """All blocks against all templates."""
    row, out = licenses.words((text or "").encode()), []
    for label, t in templates:
        want = set(licenses.words(t.encode()))
        width = max(8, 1 << (len(t.split()) - 1).bit_length())
        for start in range(0, max(-(-len(row) // width) - 1, 1) * width, width):
            both = len(want & set(row[start : start + 2 * width]))
            if both >= threshold * len(want) and both:
                out.append((label, start, both))
    return sorted(out)


@pytest.mark.parametrize("threshold", [Fraction(1, 2), Fraction(7, 10), Fraction(9, 10), Fraction(1)])
def test_join_finds_every_block(spark, threshold):
    rng = np.random.default_rng(1)
    vocab = licenses.vocabulary(licenses.TEMPLATES)
    texts = [" ".join((vocab[i].decode() if rng.random() < 0.7 else "other") for i in rng.integers(0, len(vocab), n)) for n in (0, 1, 7, 8, 9, 40, 400, 4000)]
    for _, t in licenses.TEMPLATES:
        row = t.split()
        texts += ["word " * int(rng.integers(0, 40)) + " ".join(w for w in row if rng.random() < 0.9) + " tail" * 20, ", ".join(rng.permutation(row)).upper()]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in enumerate(texts)], DOC)
    got = {r["doc_id"]: sorted((b["label"], b["start"], b["overlap"]) for b in r["blocks"]) for r in licenses.scan(df, threshold=threshold).collect()}
    assert got == {i: containments(t, licenses.TEMPLATES, threshold) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 10


def test_license_report_of_odd_texts(spark):
    texts = [None, "", "...", "The MIT\n\nLicense. mit license", "mit-license", "mitlicense license", "MIT Licensé", "GNU General  Public LICENSE and apache_license", "Licensed under CC BY-NC 4.0.", "plain prose about a license"]
    df = spark.createDataFrame([(i, t, None, None, None, None) for i, t in enumerate(texts)] + [(None, texts[3], None, None, None, None)], DOC)
    got = {r["doc_id"]: r for r in licenses.report(df).collect()}
    assert [got[i]["n_base"] for i in range(10)] == [0, 0, 0, 2, 1, 0, 0, 2, 0, 0]
    assert (got[3]["first_word"], got[3]["last_word"], got[3]["base_labels"], got[3]["score"]) == (1, 3, "mit", 1.0) == (got[None]["first_word"], got[None]["last_word"], "mit", 1.0)
    assert got[7]["base_labels"] == "apache,gpl" and got[8]["labels"] == "cc-by-nc" and got[8]["base_labels"] == "" and got[8]["score"] == 1.0
    assert (got[0]["n_words"], got[0]["first_word"], got[0]["labels"], got[0]["score"]) == (0, None, "", 0.0) and got[9]["labels"] == ""
    assert licenses.report(spark.createDataFrame([], DOC)).count() == 0


def audit_rows(docs: list[tuple]) -> list[tuple]:
    """The contract's rows with Python's integers."""
    langs, out = {}, []
    for _, text, lang, source, *_ in docs:
        langs.setdefault(lang or "", []).append((source or "", (text or "").encode().translate(divergence.TO_TERMS).split()))
    for lang, rows in langs.items():
        df = Counter(t for _, ws in rows for t in set(ws))
        kept = [t for t, n in df.items() if n >= 10]
        counts = {s: Counter() for s, _ in rows}
        for s, ws in rows:
            counts[s].update(w for w in ws if df[w] >= 10)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                out += [(lang, s, part, item.decode(), v, i + 1) for i, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:most])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(512, 128), (4, 3)])
def test_audit_by_brute_force(spark, monkeypatch, sizes):
    """With the usual tiles, and with tiles of about four terms and one or two blocks of three groups."""
    monkeypatch.setattr(divergence, "TERMS", sizes[0])
    monkeypatch.setattr(divergence, "GROUPS", sizes[1])
    rng = np.random.default_rng(2)
    vocab = np.array(["a", "B", "ça", "日本", "zeta", "x1y", "the", "of", "q", "é", "the_end", "UP", "low", "tie", "tye"])
    rows = []
    for i in range(260):
        text = " ".join(vocab[np.minimum(rng.geometric(0.2, int(rng.integers(0, 30))) - 1, len(vocab) - 1)])
        rows.append((i, None if i % 17 == 0 else text, [None, "", "en", "de"][i % 4], [None, "", "s1", "s2", "ß", "s4", "s5", "s6"][int(rng.integers(8))], 1, "clash"))
    rows += [(999, "rare words only", "xx", "s", 1, None), (1000, None, "xx", "t", 1, None), (1001, "x" * 9000, "yy", None, None, None), *rows[:5]]
    columns = ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(tuple(r[c] for c in columns) for r in divergence.audit(spark.createDataFrame(rows, DOC)).collect())
    assert got == audit_rows(rows) and len(got) > 100
    assert divergence.audit(spark.createDataFrame([], DOC)).count() == 0


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 1, 10**9, 9 * 10**11 + 7, 4 * 10**15 - 3], np.int64)
    whole = np.array([4 * 10**15 + 11] * 5, np.int64)
    assert divergence.shares(counts, whole).tolist() == [1 + 10**9 * (int(c) + 2) // int(w) for c, w in zip(counts, whole, strict=True)]


def test_task_hands_on_what_it_holds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{'abcdefghij'[i % 10]} common", "en", f"s{i % 3}", 0, None) for i in range(60)], DOC).coalesce(1)
    whole = divergence.audit(docs).toPandas()
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    pd.testing.assert_frame_equal(*[x.sort_values(["lang", "source", "part", "rank"]).reset_index(drop=True) for x in (whole, divergence.audit(docs).toPandas())])
