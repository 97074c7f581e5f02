"""The numbered operators: brute force, exact round trips, held-out accuracy, SQL, and odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import chat, jaccard, media, mixing, pieces, pii, secrets, sharding, topk, toxicity
from tabulon.llm.components import components
from tabulon.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA, same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, base string, _text string"


def documents(spark, rows):
    """Rows of (doc_id, text[, source]) with extra columns whose names operators use themselves."""
    full = [(i, t, "en", (s or [None])[0], len(t) if t is not None else None, 7, "x", "y", "z") for i, t, *s in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [(1, "one two three four five", "b"), (1, "one two three four five", "b"), (2, None, None), (3, "", "a"), (4, "   ", "a"), (None, "one two three four five", "b"), (5, "x" * 50_000, "c"), (6, "word " * 20_000, None), (7, "ünï ▁ 🙂\x00 text", "ä")]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    same(QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df())


# ---- 1: mixing ----


def mixed(spark, rows):
    docs = documents(spark, rows).withColumn("size", mixing.word_count(F.col("text")))
    return mixing.mix_sources(docs)


def test_mixing_odd_rows(spark):
    got = mixed(spark, ODD).collect()
    assert len(got) == len(ODD) and {r.copies for r in got} <= {0, 1, 2, 3}
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    assert all(r.source_size == sizes[r.source] and r.target <= 3 * r.source_size for r in got)
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(sizes.values())) < 1e-6
    assert len({r.copies for r in got if r.doc_id == 1}) == 1
    assert mixed(spark, []).count() == 0 and mixing.emit(mixed(spark, ODD)).count() == sum(r.copies for r in got)


def test_mixing_targets_stop_and_reruns_agree(spark):
    rows = [(i, "w " * 10, "a") for i in range(600)] + [(1000 + i, "w " * 10, "b") for i in range(4)] + [(2000 + i, "w " * 10, "c") for i in range(400)]
    got, again = mixed(spark, rows).collect(), mixed(spark, rows).collect()
    targets, taken = {r.source: r.target for r in got}, Counter()
    for r in got:
        taken[r.source] += r.size * r.copies
    assert targets["b"] == 120 and taken["b"] == 120  # three times its size
    assert all(abs(taken[s] - targets[s]) < 0.1 * targets[s] for s in "ac")
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)


def test_mixing_shuffled_lookup(spark, monkeypatch):
    from tabulon.llm import common

    rows = [(i, "w " * (i % 7), f"s{i % 3}") for i in range(60)]
    want = sorted((r.doc_id, r.target, r.copies) for r in mixed(spark, rows).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted((r.doc_id, r.target, r.copies) for r in mixed(spark, rows).collect()) == want


# ---- 2: sharding ----


def test_sharding_balance_and_slots(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.shard_documents(docs, leaves=8).collect()
    bytes_, slots = Counter(), {}
    for r in got:
        bytes_[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    texts = dict(docs.select("doc_id", "text").collect())
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r["size"] == len(texts[r.doc_id].encode()) + 1 for r in got)
    assert sorted(bytes_) == list(range(8)) and max(bytes_.values()) < 1.1 * min(bytes_.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_odd_rows(spark):
    assert sharding.shard_documents(documents(spark, []), leaves=8).count() == 0
    got = sharding.shard_documents(documents(spark, ODD), leaves=3).collect()
    assert len(got) == len(ODD) and {r.shard for r in got} <= {0, 1, 2}
    equal = sharding.shard_documents(documents(spark, [(i, "same", "s") for i in range(90)]), leaves=3)
    assert all(25 <= r["count"] <= 35 for r in equal.groupBy("shard").count().collect())
    by_bytes = sharding.shard_documents(documents(spark, [(i, "x" * 99, "s") for i in range(100)]), leaf_bytes=1_000)
    assert by_bytes.select("shard").distinct().count() == 10


# ---- 3: toxicity ----


def test_toxicity_held_out_accuracy(spark):
    spark_rows = toxicity.op3_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    rows = spark_rows.filter("held_out").select("toxic", "predicted", "score", "doc_id").collect()
    hit = [r.predicted for r in rows if r.toxic]
    wrong = [r.predicted for r in rows if not r.toxic]
    assert sum(hit) >= 0.8 * len(hit) and sum(wrong) <= 0.01 * len(wrong)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)


def test_toxicity_odd_rows(spark):
    docs = documents(spark, [*ODD, *((100 + i, f"you vile {'cad' if i % 2 else 'friend'} number {i}") for i in range(60))])
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(40)] + [(None, 1), (100, None)], "doc_id long, label int")
    model = toxicity.train(docs, labels)
    got = toxicity.score_texts(docs, model, docs.columns).collect()
    assert len(got) == len(ODD) + 60 and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got if r.doc_id is not None and r.doc_id >= 100)
    none = toxicity.train(docs, labels.limit(0))
    assert all(abs(r.score - 0.1) < 1e-9 for r in toxicity.score_texts(docs, none, ["doc_id"]).collect())
    assert toxicity.score_texts(documents(spark, []), model, ["doc_id"]).count() == 0


# ---- 4: secrets ----

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def test_secrets_against_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in secrets.op4_secrets(spark, "/root/testdata/sf0.01").collect():
        own = base_spans(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in own) for j in range(3))
        assert r.base_sha256 == secrets.digest(own)


def test_secrets_odd_rows_and_random_tokens(spark):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choices(letters, k=40)) for _ in range(5)]
    rows = [*ODD, (20, 'ß api_KEY = "abcdef" Token:short to'), (21, "AKIA" + "A" * 16 + " é " + "0af" * 8), *((30 + i, f"plain words go here {k} and on") for i, k in enumerate(keys))]
    rows += [(200 + i, "internationalizationconsiderations " * 3 + "this-is-a-slug-of-many-words-here") for i in range(200)]
    got = {r.doc_id: r for r in secrets.find_secrets(documents(spark, rows), ["doc_id"]).collect()}
    text = {i: t or "" for i, t, *_ in rows}
    assert all([tuple(s) for s in r.base] == sorted(base_spans(text[i])) for i, r in got.items())
    found = {i for i, r in got.items() if any(s.kind == 3 for s in r.found)}
    assert {30 + i for i in range(5)} <= found and not any(i and i >= 200 for i in found)
    assert all(text[i][s.start : s.stop] in keys for i in found if 30 <= i < 40 for s in got[i].found if s.kind == 3)
    assert secrets.find_secrets(documents(spark, []), ["doc_id"]).count() == 0
    clean = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(documents(spark, rows), length="n_chars").collect()}
    assert clean[20][0] == 'ß <SECRET>" Token:short to' and clean[20][1] == len(clean[20][0])
    assert clean[2] == (None, None) and clean[6][0] == text[6] and not any(k in t for t, _ in clean.values() if t for k in keys)


# ---- 5: top-k ----


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(300)]
    odd = [(301, None), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, [9.0] * 8), (50, [2.0] * 8), (7, vectors[7][1]), (306, [])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("v", F.lit("x"))
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in vectors + odd[5:7]]
    asked = {q: min(tuple(v) for i, v in whole if i == q) for q in range(0, 300, 50)}
    want = []
    for q, v in asked.items():
        best = sorted((-int(np.dot(v, w)), i) for i, w in whole if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r["score"]) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_large_components_are_exact(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, [float(x) for x in rng.uniform(-3e6, 3e6, 8)]) for i in range(200)] + [(200, [3e6] * 8), (201, [3e6] * 7 + [3e6 - 1 / 256])]
    df = spark.createDataFrame([*vectors, (202, [1e300] * 8)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors}
    want = []
    for q in range(0, 201, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in whole.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r["score"]) for r in got) == sorted(want)


def test_topk_block_bounds():
    rng = np.random.default_rng(4)
    v = rng.integers(-80, 80, (500, 6))
    block = topk.Block(np.arange(500), v)
    for q in v[:40]:
        ids, scores = block.top(q, -1, 7)
        assert list(zip(-scores, ids, strict=True)) == sorted(zip(-(v @ q), range(500), strict=True))[:7]


# ---- 6: n-gram Jaccard ----


def brute_components(rows, words, percent):
    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())

    sets = [grams(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, *_), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize(("words", "percent", "steps"), [(4, 85, 2), (5, 80, 1), (2, 70, 1)])
def test_jaccard_against_brute_force(spark, words, percent, steps):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = list(ODD)
    for k in range(12):
        base = rng.choices(vocabulary, k=rng.choice((5, 9, 14, 25, 60, 150)))
        for v in range(rng.choice((3, 12))):
            copy = [*base]
            for _ in range(rng.randrange(0, 1 + len(copy) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((1000 * k + v + 10, " ".join(copy).upper() if v % 3 == 0 else "\n".join(copy)))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, rows), words, percent, steps).collect()]
    assert sorted(got, key=repr) == brute_components(rows, words, percent)


def test_jaccard_many_variants_of_one_text(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for v in range(1, 160):
        copy = [*base]
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(120)] = f"n{rng.randrange(10_000)}"
        rows.append((v, " ".join(copy)))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, rows), 4, 85, 2).collect()]
    assert sorted(got, key=repr) == brute_components(rows, 4, 85)


def test_jaccard_empty_and_stage(spark):
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0
    kept = jaccard.one_of_each(documents(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (3, ""), (4, ""), (5, None), (6, "x y z")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6]


def test_one_of_each_null_and_repeated_ids(spark):
    a, b, c, d = ("a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x")
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(documents(spark, rows)).collect()), key=repr)
    # A copy without id of a named document doesn't take other rows without id along.
    assert kept([(1, a), (None, a), (None, b), (None, c), (None, "")]) == sorted([(1, a), (None, b), (None, c), (None, "")], key=repr)
    # Copies that all have no id leave one; equal rows and rows of equal sets leave one.
    assert kept([(None, a), (None, a), (None, a.upper()), (None, b)]) in [sorted([(None, x), (None, b)], key=repr) for x in (a, a.upper())]
    # Texts that share an id leave apart; a repeated row stays once.
    assert kept([(1, c), (2, c), (2, d), (3, b), (3, b)]) == [(1, c), (2, d), (3, b)]
    # Near copies without ids, which aren't equal, among others without ids.
    base = [f"w{i}" for i in range(60)]
    near = [(None, " ".join([*base[:-1], f"x{i}"])) for i in range(20)]
    got = kept([*near, (None, a), (None, b), (7, c)])
    assert len(got) == 4 and {(None, a), (None, b), (7, c)} < set(got)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 70)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    assert {(r.node, r.label) for r in components(edges).collect()} == {(i, 1) for i in range(1, 71)} | {(100, 100), (101, 100)}


# ---- 7: SentencePiece ----


@pytest.fixture(scope="module")
def model():
    return pieces.Model(open(pieces.MODEL, "rb").read())


def test_pieces_words_and_scan_equal_the_library(model):
    rng = random.Random(2)
    alphabet = "abcdeiou  \n▁é中🙂XYZ01-/_.,the"
    texts = ["", " ", "  ", "a", " a", "a ", "\n\n x", "the" * 60, "a" * 90] + ["".join(rng.choices(alphabet, k=rng.randrange(1, 80))) for _ in range(150)]
    for t in texts:
        want = model.sp.encode(t)
        assert model.encode([t])[0].tolist() == want
        assert model.decode(np.array(want, np.int64)).decode() == t.replace("▁", " ")
        for chunk in (17, 40) if t else ():
            whole = pieces._normal(t)
            cuts = [*range(0, len(whole), chunk), len(whole)]
            leaves = [model.transfer(whole, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
            total = leaves[0][2]
            for x in leaves[1:]:
                total = pieces.times(total, x[2])
            ends = np.array([b == 0 for _, b in leaves[-1][1]])
            first, last = divmod(int(np.argmax(np.where(ends[None], total, pieces.NONE))), total.shape[1])
            path = pieces.choose([x[2] for x in leaves], first, last)
            ids = [model.trace(whole, a, b, leaves[i][0][path[i]], leaves[i][1][path[i + 1]]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            assert np.concatenate(ids).tolist() == want


def test_pieces_documents(spark, model):
    rows = [*ODD, (8, "no blanks at all ".replace(" ", "") * 60), (9, "blank and word " * 90)]
    docs = documents(spark, rows)
    coded = pieces.encode_documents(docs, chunk=300)
    got = coded.collect()
    text = {}
    for i, t, *_ in rows:
        text.setdefault(i, t)
    assert len(got) == len(rows) and all(list(r.ids) == model.sp.encode(text[r.doc_id] or "") for r in got)
    back = pieces.decode_documents(coded, ["doc_id"]).collect()
    assert all(r.text == (text[r.doc_id] or "").replace("▁", " ") for r in back)
    assert pieces.encode_documents(documents(spark, [])).count() == 0


# ---- 8: pseudonyms ----


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def test_pii_formats_and_links(spark):
    rows = [(1, "mail anna.b7@mail5.example.com, +1 (724) 555-7058 card 4041894974608795 ip 55.178.81.26. on 2024-02-29 and 31.12.1999, 02/30/2001 x 123-45-6789"), (2, "card 4041-8949-7460-8795; anna.b7@mail5.example.com 724-555-7058 2024-02-29"), *((i + 10, t) for i, t, *_ in ODD[2:] if i is not None)]
    got = {r.doc_id: r for r in pii.pseudonymise(documents(spark, rows)).collect()}
    one, two = got[1], got[2]
    shape = re.fullmatch(r"mail ([a-z]{4}\.[a-z]\d@mail5\.example\.com), \+1 \(([2-9]\d\d)\) ([2-9]\d\d)-(\d{4}) card (\d{16}) ip ((?:\d+\.){3}\d+)\. on (\d{4}-\d\d-\d\d) and (\d\d\.\d\d\.\d{4}), 02/30/2001 x (\d{3}-\d\d-\d{4})", one.text)
    assert shape and luhn(shape[5]) and shape[5] != "4041894974608795" and all(int(o) < 256 for o in shape[6].split("."))
    assert two.text == f"card {'-'.join(shape[5][i : i + 4] for i in (0, 4, 8, 12))}; {shape[1]} {shape[2]}-{shape[3]}-{shape[4]} {shape[7]}"
    assert (one.pii_email, one.pii_date, one.pii_ssn, one.pii_phone, one.pii_card, one.pii_ip) == (1, 2, 1, 1, 1, 1)
    assert all(got[i + 10].text == t for i, t, *_ in ODD[2:] if i is not None)
    assert pii.pseudonymise(documents(spark, rows[:1]), key="other").first().text != one.text
    assert pii.pseudonymise(documents(spark, [])).count() == 0


def test_pii_is_a_permutation(spark):
    numbers = spark.range(1000).select(F.array(*[F.floor(F.col("id") / 10**i).cast("int") % 10 for i in range(3)]).alias("s"))
    out = numbers.select(pii.feistel(F.col("s"), F.array(*[F.lit(10)] * 3), F.lit("k")).alias("t")).distinct()
    assert out.count() == 1000
    days = spark.range(pii.HIGH * pii.LOW).select(F.date_format(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert pii.pseudonymise(days.filter("text < '1901-01-01'")).filter("text between '1900-01-01' and '2099-12-31'").select("text").distinct().count() == 365


# ---- 9: chat ----


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, None, None), (None, 0, "user", "z"), (5, None, "user", "q"), (5, 1, "user", "r"), (6, 0, "user", "a"), (6, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("place", F.lit("x"))
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.format_conversations(df).collect()}
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got == {2: (2, 2, turn("user", "a") + turn("assistant", "b")), 4: (1, 1, turn("", "")), None: (1, 1, turn("user", "z")), 5: (2, 1, turn("user", "q") + turn("user", "r")), 6: (2, 1, turn("user", "a") * 2)}
    assert chat.format_conversations(df.limit(0)).count() == 0


# ---- 10: media ----


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1024, 1025, 5000])
def test_media_round_trip(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)
    payload = media.payload_of(data)
    avi = media.write_avi(payload)
    back = media.read_media(avi)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and back["payload_sha256"] == hashlib.sha256(payload.tobytes()).hexdigest()
    assert back["tail_crc32"] == zlib.crc32(payload.tobytes()[-64:])
    spans, *_ = media.riff_frames(avi)
    slow = np.concatenate([media._decode_slow(avi[a:b]) for a, b in spans])
    assert slow[: len(payload)].tobytes() == payload.tobytes()


def test_media_shots_and_columns(spark):
    dark, light = np.full(1024 * 20, 30, np.uint8), np.full(1024 * 15, 200, np.uint8)
    avi = media.write_avi(np.concatenate([dark, light, dark]))
    assert media.read_media(avi)["clips"] == [(0, 20), (20, 35), (35, 55)]
    rows = spark.createDataFrame([(1, bytearray(avi)), (2, None), (3, bytearray(b"no avi"))], "id int, media binary")
    assert [(r.id, r.clip, r.start_s, r.stop_s) for r in media.clip_table(rows, ["id"]).collect()] == [(1, 0, 0.0, 0.8), (1, 1, 0.8, 1.4), (1, 2, 1.4, 2.2)]
    got = media.media_columns(documents(spark, ODD), ["doc_id", "_text"]).collect()
    assert len(got) == len(ODD) and len({(r.media_sha256, r.feature) for r in got if r.n_bytes == 0}) == 1
    assert media.media_columns(documents(spark, []), ["doc_id"]).count() == 0


# ---- pipeline ----


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    kept, before = docs, docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, before, DATA).persist()
        assert kept.columns == docs.columns
        if name == "toxicity":
            scores = toxicity.score_texts(docs, toxicity.toxicity_model(spark, docs, DATA), ["doc_id"])
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scores.filter("score < 0.5").collect()}
        if name == "n-gram Jaccard join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, n, c in brute_components(rows, 5, 80) if d == c)
        if name == "secret scans":
            for r in kept.collect():
                assert (r.text == texts[r.doc_id]) == (not base_spans(texts[r.doc_id])) or "<SECRET>" in r.text
                assert not base_spans(r.text) and r.n_chars == len(r.text)
        before = kept
    out = corpus_pipeline.run(spark, DATA).collect()
    mix = {r.doc_id: r.copies for r in mixing.mix_sources(before.withColumn("size", mixing.word_count(F.col("text")))).collect() if r.copies}
    assert Counter(r.doc_id for r in out) == Counter(mix) and all(r.n_tokens == len(r.ids) for r in out)
    library = pieces.Model(open(pieces.MODEL, "rb").read()).sp
    final = {r.doc_id: r.text for r in before.collect()}
    assert all(list(r.ids) == library.encode(final[r.doc_id]) for r in out)
