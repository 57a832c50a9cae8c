"""The numbered operators against brute force, exact round trips and held-out accuracy, and their defined cases."""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentia.llm import cotrain, flac, lbl, media, minhash, mixing, packing, pii, pivots, queries, secrets, shingles, warc
from tests.conftest import SMALL

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = [None, "", "   ", "one", "one two", "The quick brown fox jumps over the lazy dog", "the QUICK brown fox jumps over the lazy dog", "naïve café — 日本語 text\n\nwith lines", "a " * 5000, "x" * 5000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, th long, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").persist()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", None, 1.0, 2, "k") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id here", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def text_of(docs) -> dict:
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_every_operator_takes_odd_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ops = {
        "pii": pii.report, "media": lambda d: media.pcm_features(media.encode_flac(d)), "lm": lbl.score, "mix": mixing.mix_report, "mixed": mixing.mix,
        "quality": lambda d: cotrain.score(d, labels), "good": lambda d: cotrain.keep_good(d, labels), "near": lambda d: minhash.near_duplicates(d, 3, 85, 100),
        "dedup": minhash.drop_near_duplicates, "secrets": secrets.report, "redact": secrets.redact, "pack": packing.pack,
    }
    for name, op in ops.items():
        assert op(none).count() == 0, name
        got = op(odd).toPandas()
        if name not in ("mixed", "good", "dedup", "pack"):
            assert len(got) == odd.count(), name


def luhn(digits: str) -> bool:
    d = [int(c) for c in digits[::-1]]
    return sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2]) == 0 or (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    texts = ["card 4111 1111 1111 1111 end", "again 4111 1111 1111 1111", "mail ann.lee@example.com now", "on 2021-02-28 and 28.02.2021", "bad 4111 1111 1111 1112", "ip 10.20.30.40 ssn 123-45-6789", "iban GB82 WEST 1234 5698 7654 32", None, "plain"]
    got = [r.asDict() for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    card = lambda s: re.search(r"[0-9]{4}(?: [0-9]{4}){3}", s)[0]
    assert card(got[0]["text"]) == card(got[1]["text"]) != "4111 1111 1111 1111" and luhn(card(got[0]["text"]).replace(" ", ""))
    assert got[2]["text"].endswith("@example.com now") and "ann.lee" not in got[2]["text"] and re.match(r"mail [a-z]{3}\.[a-z]{3}@", got[2]["text"])
    iso, local = re.match(r"on (\d{4}-\d\d-\d\d) and (\d\d\.\d\d\.\d{4})$", got[3]["text"]).groups()
    assert iso == "-".join(reversed(local.split("."))) and iso != "2021-02-28"
    assert got[4]["text"] == texts[4] and got[4]["n_pii"] == 0 and got[8]["text"] == "plain" and got[7]["text"] is None
    assert got[5]["n_ip"] == got[5]["n_ssn"] == 1 and got[6]["n_iban"] == 1
    new = re.sub(" ", "", got[6]["text"].removeprefix("iban "))
    assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1


def test_pseudonyms_in_many_formats(spark):
    card, phone = "4111111111111111", "555-123-4567"
    texts = [card, "4111-1111-1111-1111", "4111 1111 1111 1111 123", "2 4111111111111111", f"{phone} 555-987-6543", f"1234 {phone}", "ES91 2100 0418 4502 0005 1332 EUR 50", "es9121000418450200051332", "12/25/1990", "25.12.1990", "1990-12-25", "+44 20 7946 0958", "x..y@b.com", "999.1.1.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in pii.report(df).orderBy("doc_id").collect()]
    new, bare = got[0], lambda t: re.sub("[ -]", "", t)
    assert luhn(new) and new != card and bare(got[1]) == new and bare(got[2]) == new + "123" and got[3] == f"2 {new}"
    assert got[4].split()[0] == got[5].split()[1] != phone and got[4].split()[1] != "555-987-6543"
    assert bare(got[6]).removesuffix("EUR50") == got[7].upper() and got[6].endswith(" EUR 50") and got[7] != texts[7]
    assert got[8][6:] + got[8][:2] + got[8][3:5] == got[10].replace("-", "") == "".join(reversed(got[9].split("."))) != "19901225"
    assert re.fullmatch(r"\+44 \d\d \d{4} \d{4}", got[11]) and got[11] != texts[11] and got[12:] == texts[12:]
    other = [r["text"] for r in pii.pseudonymize(df.withColumn("n_card", F.lit("clash")), "another key").orderBy("doc_id").collect()]
    assert other[0] != new and luhn(other[0]) and other[12:] == texts[12:]


def test_feistel_is_a_bijection(spark):
    df = spark.range(1000).select(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.floor(F.col("id") / F.pow(F.lit(10), i)).cast("int") % 10).alias("v"))
    out = df.select(pii.feistel(F.col("v"), F.array_repeat(F.lit(10), 3), "x").alias("o"))
    assert out.distinct().count() == 1000


def test_phone_numbers_link_across_spellings(spark):
    """One number with and without code and separators; numbers abroad by the length of their code."""
    spellings = ["555-123-4567", "(555) 123-4567", "1-555-123-4567", "+1 555-123-4567", "+15551234567", "+1.555.123.4567"]
    abroad = ["+442079460958", "+44 20 7946 0958", "+44 (20) 7946-0958", "+35312345678", "+353 1 234 5678"]
    df = spark.createDataFrame(list(enumerate(spellings + abroad)), "doc_id long, text string")
    got = [r["text"] for r in pii.report(df).orderBy("doc_id").collect()]
    bare = [re.sub("[^0-9]", "", t) for t in got]
    assert len({b[-10:] for b in bare[:6]}) == 1 and bare[0] != "5551234567" and all(re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", b) for a, b in zip(got, spellings + abroad, strict=True))
    assert all(b.startswith("1") for b in bare[2:6]) and len({*bare[6:9]}) == 1 and bare[6][:2] == "44" and bare[6] != "442079460958" and bare[9] == bare[10] != "35312345678" and bare[9][:3] == "353"


def plain_feistel(values: list[int], radices: list[int], kind: str, key: str) -> list[int]:
    """Two halves in turn, each place moved by a hash of everything that it may depend on."""
    cut = len(values) // 2
    halves, bases = [values[:cut], values[cut:]], [radices[:cut], radices[cut:]]
    for r in range(pii.ROUNDS):
        own, seen = r % 2, ",".join(map(str, halves[1 - r % 2]))
        noise = [int(hashlib.sha256(f"{key}|{kind}|{r}|{i}|{seen}".encode()).hexdigest()[:7], 16) for i in range(len(halves[own]))]
        halves[own] = [(x + n) % b for x, n, b in zip(halves[own], noise, bases[own], strict=True)]
    return halves[0] + halves[1]


def test_pseudonyms_by_plain_feistel(spark):
    """Values of many lengths and radices, and whole pseudonyms of phones, addresses, emails and dates."""
    rng = np.random.default_rng(1)
    rows = [([int(rng.integers(b)) for b in bases], bases) for n in range(1, 20) for bases in [[int(b) for b in rng.choice([1, 2, 10, 26, 256, 9999], n)]]]
    df = spark.createDataFrame(rows, "v array<int>, r array<int>").select("v", "r", pii.feistel(F.col("v"), F.col("r"), "card", "k").alias("out"))
    for r in df.collect():
        assert r["out"] == plain_feistel(r["v"], r["r"], "card", "k")
    texts = ["555-123-4567", "10.20.30.40", "Ann.lee7@example.com", "2021-02-28"]
    got = [r["text"] for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    phone = plain_feistel([int(c) for c in "5551234567"], [10] * 10, "phone", "k")
    assert got[0] == "{}{}{}-{}{}{}-{}{}{}{}".format(*phone) and got[1] == ".".join(map(str, plain_feistel([10, 20, 30, 40], [256] * 4, "ip", "k")))
    codes = plain_feistel([0, 13, 13, 0, 11, 4, 4, 7], [26, 26, 26, 1, 26, 26, 26, 10], "email", "k")
    assert got[2] == chr(65 + codes[0]) + "".join(chr(97 + c) for c in codes[1:3]) + "." + "".join(chr(97 + c) for c in codes[4:7]) + str(codes[7]) + "@example.com"
    day = (datetime.date(2021, 2, 28) - datetime.date(1900, 1, 1)).days
    high, low = plain_feistel([day // 4297, day % 4297], [17, 4297], "date", "k")
    assert got[3] == str(datetime.date(1900, 1, 1) + datetime.timedelta(high * 4297 + low))


def test_media_round_trip(spark, odd):
    want = {r["doc_id"]: (r["text"] or "").encode() for r in odd.collect()}
    for r in media.pcm_features(media.encode_flac(odd)).collect():
        data = media.payload(want[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len(want[r["doc_id"]]), len(data)) and len(data) % 64 == 0 and data
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["tail_crc32"] == zlib.crc32(data[-64:])


def test_flac_predictors_seek_and_damage(spark):
    t = np.arange(20_000)
    x = np.rint(3000 * np.sin(t / 9) + np.random.default_rng(0).normal(0, 20, len(t))).astype(np.int64)
    data = flac.encode(x, bps=16, lpc=8)
    assert np.array_equal(np.concatenate([b.samples for b in flac.decode(data)]), x) and len(data) < 2 * len(x)
    late = list(flac.decode(data, 9000))
    assert late[0].sample_offset <= 9000 < late[0].sample_offset + len(late[0].samples) and late[0].sample_offset > 0
    broken = bytearray(data)
    broken[len(data) // 2] ^= 0x10
    cut = [(3, data[:60]), (4, data[:20]), (5, b""), (6, None)]
    row = media.decode_flac(spark.createDataFrame([(1, bytes(broken)), (2, data), *cut], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert [r["ok"] for r in row] == [False, True, False, False, False, False]
    assert (row[0]["ok"], row[1]["ok"]) == (False, True) and len(row[0]["blocks"]) < len(row[1]["blocks"])


def test_stored_streams_use_linear_predictors_and_come_back_as_blocks(spark, odd, monkeypatch):
    """The query's streams are files when they are read, with linear predictors where those are smaller; a broken stream is a row."""
    read, seen = media.pcm_features, []
    monkeypatch.setattr(media, "pcm_features", lambda m: (seen.append((m.inputFiles(), m.collect())), read(m))[1])
    want = Counter((r["doc_id"], hashlib.sha256(media.payload((r["text"] or "").encode())).hexdigest()) for r in odd.collect())
    assert Counter((r["doc_id"], r["payload_sha256"]) for r in media.round_trip(odd).collect()) == want
    assert len(seen) == media.PASSES and all(files for files, _ in seen)
    wave = bytes(np.rint(128 + 100 * np.sin(np.arange(9000) / 7)).astype(np.uint8))
    made = media.encode_flac(spark.createDataFrame([(1, wave), (2, b"ab" * 50)], "doc_id long, text binary"))
    streams = {r["doc_id"]: r["media"] for r in made.collect()}
    first = flac.read_info(streams[1]).first
    assert flac.decode_frame(streams[1], first, flac.read_info(streams[1]))[1].c.size == media.ORDER
    assert len(streams[1]) < len(flac.encode(media.as_samples(media.payload(wave)), parts_log=media.PARTS_LOG))
    blocks = media.decode_flac(made).where("doc_id = 1").first()["blocks"]
    assert [(b["sample_offset"], b["n_samples"]) for b in blocks] == [(0, 4096), (4096, 4096), (8192, 832)] and blocks[0]["byte_offset"] == first
    torn = read(spark.createDataFrame([(1, 9000, streams[1][:-5])], "doc_id long, n_bytes long, media binary")).first()
    assert not torn["ok"] and torn["error"] and torn["payload_sha256"] is None and torn["media_bytes"] == len(streams[1]) - 5


def test_flac_frame_written_by_hand():
    """A frame of a linear predictor, bit by bit: 10, then 3 / 2 of the sample before (rounded down) and 0, -1, -2."""
    bits = "0" + "100000" + "0" + f"{10:08b}" + "0011" + "00001" + "0011" + "00" + "0000" + "0001" + "10" + "11" + "011"
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    head = b"\xff\xf8\x60\x02\x00\x03"
    frame = head + bytes([flac.crc8(head)]) + body
    frame += flac.crc16(frame).to_bytes(2, "big")
    info = (4).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 4).to_bytes(8, "big") + bytes(16)
    blocks, error = flac.decode_many([b"fLaC\x80\x00\x00\x22" + info + frame])[0]
    assert error is None and [b.samples.tolist() for b in blocks] == [[10, 15, 21, 29]]


def test_language_model_base_and_score(docs):
    texts = text_of(docs)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter()
    for i, t in texts.items():
        if not held[i]:
            counts.update([*words(t), b"\0end"])
    n, v = sum(counts.values()), len(counts)
    rows = {r["doc_id"]: r for r in lbl.score(docs).collect()}
    for i, t in texts.items():
        c = [counts[w] for w in [*words(t), b"\0end"]]
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(c), sum(x > 0 for x in c), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c), rel=1e-9)
        assert np.isfinite(r["score"]) and r["score"] < 0
    for part in (True, False):
        total = lambda col: sum(r[col] for i, r in rows.items() if held[i] == part)  # noqa: B023, E731
        assert total("score") > total("base_score") * 0.99  # both negative: at least 1 % better
    again = {r["doc_id"]: r["score"] for r in lbl.score(docs.repartition(7)).collect()}
    assert all(again[i] == pytest.approx(r["score"], rel=1e-6) for i, r in rows.items())


def test_model_probabilities_sum_to_one():
    m = lbl.LogBilinear(np.arange(1, 41))
    p = m.log10(np.arange(40), np.tile([[3, 7]], (40, 1)))
    assert (10**p).sum() == pytest.approx(1)


def test_class_sums_take_few_exponentials(monkeypatch):
    """Sums over the classes as products of exponentials taken once for each row of q: right, and not one for each context and class."""
    rng, n = np.random.default_rng(0), 90
    m = lbl.LogBilinear(rng.integers(1, 1000, n), buckets_log=4)
    m.q += rng.normal(0, 1, m.q.shape).astype(np.float32)
    m.r += rng.normal(0, 0.3, m.r.shape).astype(np.float32)
    contexts = np.stack([np.where(rng.random(5000) < 0.5, rng.integers(0, n, 5000), n + rng.integers(0, 256, 5000)) for _ in range(2)], 1)
    classes = rng.integers(0, n, 5000)
    logits = (m.hidden(contexts).astype(np.float64) @ m.r.T) + m.b
    mass = np.exp(logits)
    norm = mass.sum(1)
    seen, exp = [0], np.exp
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: (seen.__setitem__(0, seen[0] + np.size(x)), exp(x, *a, **k))[1])
    own, tail, _ = m.log10_and_tail(classes, contexts, 60)
    monkeypatch.undo()
    assert np.allclose(own, np.log10(mass[np.arange(5000), classes] / norm), atol=2e-6) and np.allclose(tail, np.log10(mass[:, 60:].sum(1) / norm), atol=2e-6)
    assert seen[0] <= 2 * n * len(m.q) + n < len(np.unique(contexts, axis=0)) * n
    m.r *= 40  # factors beyond floats: the plain way
    m.products = None
    own, _, _ = m.log10_and_tail(classes, contexts, 60)
    logits = (m.hidden(contexts).astype(np.float64) @ m.r.T) + m.b
    assert not m.products.fits and np.allclose(own, (logits[np.arange(5000), classes] - np.logaddexp.reduce(logits, axis=1)) / np.log(10), rtol=1e-4, atol=1e-3)


def test_cells_side_by_side_score_as_alone():
    """Cells of several lengths, one without training tokens of its own and one of a single type, trained together or one by one."""
    rng, cells = np.random.default_rng(1), []
    for number, (tokens, types, rest) in enumerate([(900, 40, 0.2), (500, 7, 0.5), (129, 30, 0.0), (128, 1, 0.0), (5, 3, 0.0), (4, 3, 1.0)]):
        full = lbl.with_ones(rng.normal(0, 1, (max(1, tokens // 2), lbl.WIDTH)).astype(np.float32))
        members = rng.integers(0, types, tokens)
        cells.append(lbl.Cell(number, members, rng.integers(0, len(full), tokens), full, 1 + np.bincount(members, minlength=types), np.arange(tokens) < rest * tokens))
    together = lbl.cell_scores(cells)
    for c, some in zip(cells, together, strict=True):
        assert np.allclose(some, lbl.cell_scores([c])[0], atol=1e-5) and (some < 1e-6).all()
    learnt, plain = together[0][180:], np.log10(cells[0].counts / cells[0].counts.sum())[cells[0].members[180:]]
    assert not np.allclose(learnt, plain, atol=1e-3)


def test_draws_and_orders_are_the_plain_ones():
    rng = np.random.default_rng(2)
    for n in (1, 2, 300):
        m = lbl.Members(rng.integers(0, 1000, n) * (rng.random(n) < 0.5), np.array([0, n]))
        mass = np.concatenate([rng.random(2000) * m.cdf[-1], m.cdf, [0.0]])
        assert np.array_equal(m.drawn(mass), np.searchsorted(m.cdf, mass, "right"))
    t, one, two, held = rng.integers(0, 5, 900), rng.integers(0, 9, 900).astype("<u4"), rng.integers(0, 1 << 20, 900).astype("<u4"), rng.random(900) < 0.3
    for types in (5, 1 << 40):  # as one number, and without room for that
        order = lbl.by_type(t, types, one, two, held)
        assert np.array_equal(*(np.stack([x[o].astype(np.int64) for x in (t, one, two, held)]) for o in (order, np.lexsort((held, two, one, t)))))


def test_word_hashes_at_run_borders():
    """Hashes as their definition says, word by word, where words cross the runs that are hashed at once and beyond 256 bytes."""
    def plain(word: bytes) -> int:
        code = sum(int(shingles.BYTE_CODES[b]) * int(shingles.POWERS[i]) for i, b in enumerate(word.lower()))
        return int(shingles.scramble(np.array([code % (1 << 64)], np.uint64))[0])

    run, rng = shingles.RUN, np.random.default_rng(3)
    texts = [b" " * (run - 100) + b"Ab" * 100 + b" z", b"k " * run, b"", b"\t", b"q" * 256 + b" ", bytes(rng.choice(np.frombuffer(b"aBc \xc3\xa9", np.uint8), 3 * run))]
    for some in ([t] for t in [*texts, b"x" * 256]):
        hashes, counts = shingles.word_hashes(some)
        words = [w for t in some for w in WORD.findall(t)]
        assert counts.tolist() == [len(WORD.findall(t)) for t in some] and hashes.tolist() == [plain(w) for w in words]
    alone = np.concatenate([shingles.word_hashes([t])[0] for t in texts])
    assert np.array_equal(shingles.word_hashes(texts)[0], alone)
    mixed = shingles.word_hashes([*texts, b"y" * 700])[0]  # a word beyond 256 bytes: all by their places in words
    assert np.array_equal(mixed[:-1], alone)


def test_hot_cells_in_parts(docs):
    """Packs of 200 tokens: cells in parts keep all counts, score near the whole ones, and do not hang on the partitioning."""
    whole, parts, again = ({r["doc_id"]: r for r in d.collect()} for d in (lbl.score(docs), lbl.score(docs, pack=200), lbl.score(docs.repartition(5), pack=200)))
    for i, r in parts.items():
        assert [r[c] for c in ("held_out", "n_tokens", "n_known", "train_tokens")] == [whole[i][c] for c in ("held_out", "n_tokens", "n_known", "train_tokens")]
        assert r["base_score"] == pytest.approx(whole[i]["base_score"], rel=1e-9) and again[i]["score"] == pytest.approx(r["score"], rel=1e-5)
    total = [sum(r["score"] for r in rows.values()) for rows in (whole, parts)]
    assert total[0] != total[1] and total[1] == pytest.approx(total[0], rel=0.05)


def test_frequent_words_among_equal_counts(spark):
    corpus = lbl.corpus_statistics(spark.range(600_000).selectExpr("xxhash64(id) h", "1L c"), 1)
    assert len(corpus.words) == lbl.FREQUENT and corpus.class_counts.sum() == 600_001 and (np.diff(corpus.words.astype(float)) > 0).all()


def test_rare_words_depend_on_their_context(spark):
    """Words beyond the frequent ones: the same words in another order score otherwise, and the parts sum to one."""
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    common = " ".join(f"c{j}" for j in range(lbl.FREQUENT))
    pair = lambda a, b: f"rareleft{a} rareright{b}"
    rows = [(i, " ".join([common] * 2 if n < 40 else [pair(j, j) for j in range(n % 5, 40, 5)])) for n, i in enumerate(ids[:400])]
    good, bad = (" ".join(pair(j, (j + k) % 40) for j in range(40)) for k in (0, 7))
    docs = spark.createDataFrame([*rows, (held[0], good), (held[1], bad)], "doc_id long, text string").coalesce(2)
    got = {r["doc_id"]: r for r in lbl.score(docs).collect()}
    assert got[held[0]]["base_score"] == pytest.approx(got[held[1]]["base_score"])
    assert abs(got[held[0]]["score"] - got[held[1]]["score"]) > 1e-3
    training = lbl.with_flags(docs, "doc_id", "text").where("NOT held_out")
    corpus = lbl.corpus_statistics(lbl.token_counts(training), training.count())
    assert corpus.class_counts.sum() == corpus.tokens and len(corpus.cell_counts) * lbl.LEAF >= corpus.types - 1
    assert lbl.corpus_statistics(spark.range(100_000).selectExpr("xxhash64(id) h", "2L c"), 1).cell_counts.size >= 100_000 // lbl.LEAF
    members = lbl.Members(np.array([3, 1, 2, 5]), np.array([0, 2, 4]))
    members.r += np.arange(4)[:, None] / 10
    p = 10 ** members.log10(np.arange(4), np.ones((4, lbl.WIDTH), np.float32))
    assert p[:2].sum() == pytest.approx(1) and p[2:].sum() == pytest.approx(1)


def test_mixture_meets_its_targets(docs):
    rows = mixing.mix_report(docs).toPandas()
    texts = text_of(docs)
    assert all(r.size == len(words(texts[r.doc_id])) for r in rows[["doc_id", "size"]].itertuples(index=False))
    size = rows.groupby("source", dropna=False)["size"].sum()
    order = sorted((s for s in size.index if isinstance(s, str)), key=lambda s: [ord(c) for c in s]) + [s for s in size.index if not isinstance(s, str)]
    weight, left, target = {s: i % 3 + 1 for i, s in enumerate(order)}, set(order), {}
    while left:
        level = (size.sum() - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 3 * size[s] + 1e-9}
        target |= {s: 3.0 * size[s] for s in over} if over else {s: level * weight[s] for s in left}
        left = left - over if over else set()
    for s, g in rows.groupby("source", dropna=False):
        assert g["target"].iloc[0] == pytest.approx(target[s]) and g["source_size"].iloc[0] == size[s]
    assert (rows["taken"] <= 3 * rows["size"]).all() and rows["taken"].sum() == pytest.approx(size.sum(), rel=0.2)
    again = mixing.mix_report(docs.repartition(5)).toPandas()
    assert rows.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()


def test_quality_on_held_out_labels(spark):
    path = SMALL.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    test = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = cotrain.score(docs, labels.where(~test)).join(labels.where(test), "doc_id").toPandas()
    right = (got["keep"] == (got["quality"] == 1)).mean()
    assert right > max(got["quality"].mean(), 1 - got["quality"].mean()) + 0.1 or right > 0.9


def test_every_unlabelled_document_gives_gradients(spark):
    """No bound on the pool: all documents outside the labelled sample, those without an id too, when the views are sure."""
    docs = spark.range(7000).selectExpr("nullif(id, 6999) doc_id", "concat('word ', id) text", "'web' source", "'en' lang", "id n_chars")
    size = {"text": cotrain.CLASSES**3 + cotrain.WORDS + cotrain.CLASSES + 3, "meta": cotrain.SOURCES + cotrain.LANGS + 3}
    flat = {k: cotrain.Regression(np.zeros(n), np.ones(n), np.zeros(n, np.float32), 0.0) for k, n in size.items()}
    sure = {k: [cotrain.View(m, 1.0, 9.0)] for k, m in flat.items()}
    feats = cotrain.features(docs)
    got = cotrain.pool_sums(feats, np.arange(10), sure, flat)
    assert [v[-1] for v in got.values()] == [6990, 6990] and all(v[len(flat[k].w)] == pytest.approx(-3495) for k, v in got.items())
    whole = cotrain.pool_sums(feats.repartition(7), np.arange(10), sure, flat)
    assert all(np.allclose(got[k], whole[k], rtol=1e-4, atol=1e-3) for k in got)


def brute_components(texts: dict, k: int, num: int, den: int) -> dict:
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set()) for i, t in texts.items() for w in [words(t)]}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = [i for i in sorted(sets) if sets[i]]
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if den * min(len(x), len(y)) >= num * max(len(x), len(y)) and den * len(x & y) >= num * len(x | y):
                r, s = find(ids[a]), find(ids[b])
                root[max(r, s)] = min(r, s)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(docs, k, num):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, k, num, 100).collect()}
    want = brute_components(text_of(docs), k, num, 100)
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_chains_of_near_copies_are_one_group(spark):
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 500, 80)]
    texts, now = {}, list(base)
    for i in range(60):
        now = list(now)
        now[(7 * i) % 80] = f"n{i}"
        texts[i] = " ".join(now)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, 3, 85, 100).collect()} == brute_components(texts, 3, 85, 100)
    assert minhash.drop_near_duplicates(df, 3, 85, 100).columns == df.columns


def test_base_secrets_and_random_strings(spark, docs):
    shape = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    key = "q7Zt3mVx9LbR2kWs8NpYc4HdJf6GaTe1"
    extra = spark.createDataFrame([(-1, f"é token = '{'a' * 7}' AKIA{'Z' * 16} {'0f' * 12}"), (-2, f"here {key} there"), (-3, "an ordinary_sentence_with_underscores_in_it here")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    texts, rows = text_of(both), {r["doc_id"]: r for r in secrets.report(both).collect()}
    for i, t in texts.items():
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in shape.finditer(t) if len(m[1]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert rows[i]["base_sha256"] == secrets.span_digest(sorted(spans))
        assert [rows[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(k == j for _, k, _ in spans) for j in range(3)]
    assert "random:5:37" in rows[-2]["spans"] and rows[-3]["n_random"] == 0
    assert secrets.redact(both).where("doc_id = -2").first()["text"] == "here [random] there"


def test_random_strings_are_found_and_names_are_not(docs):
    rng, usual = np.random.default_rng(5), secrets.prose(docs)
    hit = lambda s: secrets.battery(s, secrets.inferred(s)) >= secrets.RANDOM_LEVEL and secrets.as_prose(s, secrets.inferred(s), usual) < 1e-3
    for name, chars in secrets.ALPHABETS[1:-1]:
        assert sum(hit("".join(rng.choice(list(chars), 24))) for _ in range(50)) >= 47, name
    known = [w for t in text_of(docs).values() for w in (t or "").split() if w.isalpha() and w.isascii() and 3 <= len(w) <= 10]
    names = ["".join(w.capitalize() for w in rng.choice(known, 5)) for _ in range(100)] + ["_".join(rng.choice(known, 4)) for _ in range(100)]
    assert sum(hit(n) for n in names) <= 2
    found = docs.sparkSession.createDataFrame([([(0, 1, 2, s)],) for s in [40] * 30 + [0] * 970], "tested array<struct<start:int,end:int,length:int,step:int>>")
    assert 1 <= secrets.discovery_steps(found)[2] <= 40 and secrets.discovery_steps(found)[0] == secrets.STEPS + 1


def test_warc_round_trip_and_salvage(spark, tmp_path):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "line\r\n\r\nWARC/1.1\r\n\r\nnot a record", "<p>é</p>"]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h, "extra") for i, h in enumerate(html)], "page_id long, url string, html string, digest string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    first = {}
    for i, h in enumerate(html):
        body = (h or "").encode()
        head = first.setdefault(body, i)
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if head == i else ("revisit", head))
    warc.write_warc(pages.coalesce(1), str(tmp_path / "w"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").rglob("part-*")))
    whole = list(warc.salvage(data))
    assert len(whole) == len(html) and all(f.header for f in whole)
    hurt = bytearray(data)
    hurt[whole[2].offset + whole[2].length - 6] ^= 1
    cut = bytes(hurt) + data[: whole[0].length // 2]
    found = list(warc.salvage(cut))
    gaps = [(f.offset, f.length) for f in found if f.header is None]
    assert gaps == [(whole[2].offset, whole[2].length), (len(data), whole[0].length // 2)] and sum(f.header is not None for f in found) == len(html) - 1
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_salvage_after_a_long_damaged_first_record(spark, monkeypatch):
    def record(body: bytes) -> bytes:
        return b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)

    long = np.random.default_rng(1).bytes(100_000)
    member = bytearray(gzip.compress(record(long)))
    member[:4] = b"\0\0\0\0"
    rest = [gzip.compress(record(b"b")), gzip.compress(record(b"c"))]
    assert [f.block for f in warc.salvage(bytes(member) + b"".join(rest)) if f.header] == [b"b", b"c"]
    hurt = b"XARC" + record(gzip.compress(b"body"))[4:]
    assert [f.block for f in warc.salvage(hurt + record(b"d") + record(b"e")) if f.header] == [b"d", b"e"]
    read = warc.read_warc
    monkeypatch.setattr(warc, "read_warc", lambda *a, **k: read(*a, **k).withColumn("gap", F.lit("lost")))
    with pytest.raises(ValueError, match="gaps read back"):
        warc.round_trip(spark.createDataFrame([(1, "http://x", "a", None)], "page_id long, url string, html string, digest string")).count()


def test_members_of_several_records(spark):
    """Three records in one gzip member; a damaged one between two valid ones is a gap within its member; gzip in a payload stays payload."""
    def record(body: bytes) -> bytes:
        digest = base64.b32encode(hashlib.sha1(body).digest())
        return b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Block-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (digest, len(body), body)

    three = gzip.compress(record(b"a") + record(gzip.compress(record(b"inner"))) + record(b"c"))
    hurt = gzip.compress(record(b"d") + record(b"eee").replace(b"eee", b"eXe") + record(b"f"))
    data = three + hurt + b"noise" + record(b"g")
    found = list(warc.salvage(data))
    assert [f.block for f in found if f.header] == [b"a", gzip.compress(record(b"inner")), b"c", b"d", b"f", b"g"]
    assert [(f.offset, f.length, f.reason) for f in found if f.header is None] == [(len(three), len(hurt), "in its member: block digest"), (len(three) + len(hurt), 5, "no version line")]
    table = warc.read_warc(spark.createDataFrame([("x.warc.gz", data)], "path string, content binary"))
    log = table.where("gap IS NOT NULL").select("path", "offset", "length", "gap").collect()
    assert [tuple(r) for r in log] == [("x.warc.gz", len(three), len(hurt), "in its member: block digest"), ("x.warc.gz", len(three) + len(hurt), 5, "no version line")]
    assert table.where("gap IS NULL").count() == 6


def test_one_long_page_does_not_thin_out_the_files(spark, tmp_path):
    """2,000 short pages and one of 20 MB, null and repeated ids: the short ones share files."""
    long = "0123456789abcdef" * (20 << 16)
    rows = [(None if i % 100 == 0 else i // 2, None, f"<p>{i}</p>") for i in range(2000)] + [(5000, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    warc.write_warc(pages, str(tmp_path / "w"))
    files = list((tmp_path / "w").rglob("part-*"))
    assert len(files) <= 4 + 4 and sum(f.stat().st_size > len(long) for f in files) == 1
    got = warc.round_trip(pages)
    assert got.count() == 2001 and got.where("payload_bytes = 20971520").first()["page_id"] == 5000 and got.where("page_id IS NULL AND record_type = 'response'").count() == 20


def test_top_k_equals_brute_force(spark, duck):
    got = queries.op9_pivot_topk(spark, SMALL).toPandas().sort_values(["query_id", "rank"])
    want = duck.execute(queries.ORACLES["op9_pivot_topk"]).df().sort_values(["query_id", "rank"])
    assert got[["query_id", "rank", "vec_id", "score"]].to_numpy().tolist() == want[["query_id", "rank", "vec_id", "score"]].to_numpy().tolist()
    odd = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, None]), (3, None), (4, [float("nan"), 0.0]), (5, [0.5, 0.5]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in pivots.search(odd).orderBy("rank").collect()] == [(1, 327680), (5, 98304)]
    assert pivots.search(odd.limit(0)).count() == 0
    twice = spark.createDataFrame([(0, [1.0, 0.0], 1), (0, [2.0, 0.0], 2), (1, [1.0, 1.0], 3)], "vec_id long, embedding array<double>, row_id int")
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pivots.search(twice).collect()) == [(0, 1, 0, 131072), (0, 1, 0, 131072), (0, 2, 1, 65536), (0, 2, 1, 131072)]


@pytest.mark.parametrize("shape", ["sphere", "flat", "repeated"])
def test_pivots_eliminate_and_stay_exact(shape):
    """One block against brute force; pivots that repeat or span all there is; a floor leaves fewer than half of the products."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64)) if shape != "flat" else rng.normal(size=(3000, 6)) @ rng.normal(size=(6, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    if shape == "repeated":
        x[100:200] = x[:100]
    rows, asking = np.arange(3000), np.arange(0, 3000, 50)
    p = x[rng.choice(200, 56, replace=False)].astype(float)
    products = x[asking] @ x.T
    products[np.arange(len(asking)), asking] = -(2**62)
    want = [[(int(c), int(s[c])) for c in np.lexsort((rows, -s))[:5]] for s in products]
    for floor in (np.full(len(asking), np.iinfo(np.int64).min), np.array([w[4][1] for w in want])):
        q, ids, scores, taken = pivots.eliminate(asking, x[asking], floor, rows, rows, x, p, 5)
        assert [list(zip(ids[q == i].tolist(), scores[q == i].tolist(), strict=True)) for i in asking] == want
        assert taken < 0.5 * products.size


def test_packing_covers_every_token_once(docs, odd):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    both = docs.select("doc_id", "text").unionByName(odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))
    rows = packing.pack(both).toPandas()
    for i, t in text_of(both).items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = rows[rows["doc_id"] == i].sort_values("start")
        assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() == len(ids) == own["doc_tokens"].iloc[0]
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 2048
    assert rows["length"].sum() / (2048 * rows["sequence_id"].nunique()) > 0.95


def test_solver_holds_the_demand_exactly():
    rng = np.random.default_rng(8)
    demand = {int(n): int(rng.integers(1, 200)) for n in rng.integers(1, 128, 40) * 16}
    found = packing.solve(demand)
    made = Counter()
    for p in found:
        assert sum(n * a for n, a in p.counts.items()) <= 2048
        made.update({n: a * p.times for n, a in p.counts.items()})
    assert dict(made) == demand
    least = -(-sum(n * d for n, d in demand.items()) // 2048)
    assert sum(p.times for p in found) <= 1.1 * least + 5


def test_solver_ends_with_every_length_in_demand():
    lengths = [*range(1, 16), *range(16, 2048, 16)]
    demand = dict(zip(lengths, np.random.default_rng(3).integers(1, 10**6, len(lengths)).tolist(), strict=True))
    made = Counter()
    for p in packing.solve(demand):
        made.update({n: a * p.times for n, a in p.counts.items()})
    assert dict(made) == demand


def test_large_groups_of_near_copies(spark):
    """One group of exact and one of near copies: the whole groups come out, with the same components as all pairs give for 99 %."""
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 9000, 150)]
    texts = {i: " ".join(base) for i in range(100)}
    for i in range(100, 400):
        now = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 6)):
            now[at] = f"n{i}x{at}"
        texts[i] = " ".join(now)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 3, 85, 100).collect()}
    want = brute_components(texts, 3, 85, 100)
    assert sum(got[i] == want[i][1] for i in texts) >= 0.99 * len(texts) and all(got[i] == 0 for i in range(100))


def test_pipeline_keeps_columns_and_drops_copies(spark, docs):
    import corpus_pipeline

    d, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, d, SMALL)
        assert out.columns == docs.columns
        seen.append(out.count())
        d = out
    assert 0 < seen[1] <= seen[0] <= docs.count()
    left = text_of(d)
    assert all(i == c for i, (n, c) in brute_components(left, 5, 80, 100).items() if n)
