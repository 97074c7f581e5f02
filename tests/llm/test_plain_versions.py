"""The numbered operators against plain versions, and on both sides of their limits."""

import hashlib
import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import chat, common, jaccard, media, pieces, pii, secrets, sharding, topk, toxicity
from tests.llm.test_llm import brute_components, documents

# ---- shared helpers ----


def test_shared_folder_is_asked_for_on_a_cluster():
    session = lambda master, named=None: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=SimpleNamespace(master=master))
    assert common.shared_dir(session("spark://host:7077", "hdfs://a/b")) == "hdfs://a/b"
    assert common.shared_dir(session("local[4]")).endswith("checkpoints")
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_is_a_join(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    big = spark.createDataFrame([(i % 3 if i < 90 else i, i, "x") for i in range(120)] + [(None, 7, "y")], "k long, v long, w string")
    small = spark.createDataFrame([(k, f"s{k}") for k in range(100)], "k long, s string")
    rows = lambda df: sorted(map(tuple, df.select("k", "v", "w", "s").collect()), key=repr)
    assert common.hot_keys(big, ["k"]).count() == 3
    assert rows(common.skew_join(big, small, "k", how)) == rows(big.join(small, "k", how))


# ---- 2: sharding ----


def plain_tree(points, k, base, wide, first=0):
    """{point: leaf} of points (axes, tie, size, name): the rule of the tree by sorting."""
    if k == 1 or not points:
        return {p[3]: first for p in points}
    spans = [(max(p[0][i] for p in points) - min(p[0][i] for p in points)) / wide[i] for i in range(len(wide))]
    axis = spans.index(max(spans))
    total = sum(p[2] for p in points)
    need, close = total * (k // 2) // k, max(1, int(total * sharding.CLOSE))

    def crossing(rows, key, need):
        before = 0
        for value in sorted({key(p) for p in rows}):
            got = sum(p[2] for p in rows if key(p) == value)
            if before + got >= need:
                return value, got, before
            before += got
        return value, got, before - got

    at, got, before = crossing(points, lambda p: p[0][axis], need)
    left = {p[3] for p in points if p[0][axis] < at}
    here = [p for p in points if p[0][axis] == at]
    if got > close:
        tie, more, inner = crossing(here, lambda p: p[1], need - before)
        left |= {p[3] for p in here if p[1] < tie or (p[1] == tie and 2 * (need - before - inner) >= more)}
    elif 2 * (need - before) >= got:
        left |= {p[3] for p in here}
    a, b = [p for p in points if p[3] in left], [p for p in points if p[3] not in left]
    return plain_tree(a, k // 2, base, wide, first) | plain_tree(b, k - k // 2, base, wide, first + k // 2)


@pytest.mark.parametrize(("leaves", "broadcast"), [(8, True), (5, False)])
def test_tree_against_a_plain_one(spark, monkeypatch, leaves, broadcast):
    if not broadcast:
        monkeypatch.setattr(sharding, "BROADCAST_ROWS", 0)
    rng = random.Random(leaves)
    points = [((float(rng.randrange(40)), float(rng.randrange(6)), rng.random()), float(rng.randrange(1 << 30)), rng.randrange(50, 400), i) for i in range(160)]
    df = spark.createDataFrame([(*p[0], p[1], p[2], p[3]) for p in points], "a double, b double, c double, tie double, size long, name long")
    wide = [max(p[0][i] for p in points) - min(p[0][i] for p in points) for i in range(3)]
    got = {r.name: r.shard for r in sharding.kd_shards(df, ["a", "b", "c"], leaves).collect()}
    assert got == plain_tree(points, leaves, None, wide)


def test_equal_texts_share_a_shard(spark):
    rows = [(i, f"text {i % 150} " * (1 + i % 150 % 7), f"s{i % 5}") for i in range(600)]
    got = sharding.shard_documents(documents(spark, rows), leaves=2).groupBy("text_crc32", "size").agg(F.count_distinct("shard").alias("n"))
    assert got.count() == 150 and got.filter("n > 1").count() == 0


# ---- 3: toxicity ----


def test_ftrl_against_a_plain_one():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 60, rng.integers(1, 25))) for _ in range(150)]
    labels = np.array([float(7 in r.tolist() or rng.random() < 0.1) for r in rows])
    weights, bias = toxicity.ftrl(rows, labels, epochs=3)
    base = (labels.sum() + 0.1) / (len(labels) + 1)
    heavier = min(toxicity.MOST_WEIGHT, max(1.0, (1 - base) / base) ** toxicity.BALANCE)
    z, n, b, b_n = Counter(), Counter(), math.log(base / (1 - base)), 1.0

    def weight(f):
        return 0.0 if abs(z[f]) <= toxicity.L1 else (math.copysign(toxicity.L1, z[f]) - z[f]) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for epoch in range(3):
        for i in np.random.default_rng(epoch).permutation(len(rows)).tolist():
            w = {f: weight(f) for f in rows[i].tolist()}
            g = (1 / (1 + math.exp(-(b + sum(w.values())))) - labels[i]) * (heavier if labels[i] else 1.0)
            for f, wf in w.items():
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * wf
                n[f] += g * g
            b_n += g * g
            b -= 0.05 * g / math.sqrt(b_n)
    assert abs(b - bias) < 1e-9 and all(abs(weight(f) - weights[f]) < 1e-9 for f in range(60))
    assert np.flatnonzero(weights).max(initial=0) < 60


# ---- 4: secrets ----


def test_tokens_meet_spans_as_all_pairs_say():
    rng = random.Random(6)
    for _ in range(200):
        spans = [(a, 0, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(6)))]
        begins, ends = secrets._merged(spans)
        for s in range(60):
            for e in (s + 1, s + 5):
                near = secrets.bisect_right(ends, s)
                assert (near < len(begins) and begins[near] < e) == any(s < b and a < e for a, _, b in spans)


def test_battery_against_plain_statistics():
    null = {"s2": 0.06, "s3": 0.005, "change": 0.05}
    rng = random.Random(8)
    for _ in range(60):
        token = "".join(rng.choices("0123456789abcdef", k=rng.randrange(20, 70)))
        if not re.search("[a-f]", token) or not re.search("[0-9]", token):
            continue
        fit, as_text = secrets.battery(np.frombuffer(token.encode(), np.uint8), null)
        n, counts, codes = len(token), Counter(token), [int(c, 16) for c in token]
        chi = sum((counts[c] - n / 16) ** 2 / (n / 16) for c in "0123456789abcdef")
        upper = lambda x: 0.5 * math.erfc(x / math.sqrt(2))
        uniform = upper(((chi / 15) ** (1 / 3) - (1 - 2 / 135)) / math.sqrt(2 / 135))
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
        stay = (10 / 16) ** 2 + (6 / 16) ** 2
        runs = 2 * upper(abs(changes - (n - 1) * (1 - stay)) / math.sqrt((n - 1) * stay * (1 - stay)))
        mean = sum(codes) / n
        serial = 2 * upper(abs(sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:], strict=False)) / sum((c - mean) ** 2 for c in codes)) * math.sqrt(n))
        half = -sum(math.log(max(min(p, 1), 1e-300)) for p in (uniform, runs, serial))
        assert abs(fit - math.exp(-half) * (1 + half + half**2 / 2)) < 1e-9 and 0 <= as_text <= 1


def test_thresholds_against_plain_false_discovery_control(spark):
    rng = random.Random(9)
    rows = [([(0, 9, rng.randrange(5), min(400, int(rng.expovariate(1 / rng.choice((2, 40))))))],) for _ in range(3000)]
    df = spark.createDataFrame(rows, f"candidates {secrets.CANDIDATES}")
    for c, least in enumerate(secrets.thresholds(df, 0.05)):
        bins = sorted((x[0][0][3] for x in rows if x[0][0][2] == c), reverse=True)
        fine = [b for b in set(bins) if b > 0 and len(bins) * 10 ** (-b / secrets.STEP) / sum(x >= b for x in bins) <= 0.05]
        assert least == min(fine, default=secrets.MOST_BIN + 1)


# ---- 5: exact top-k ----


def exact_best(vectors, k=5):
    whole = {i: [math.floor(x) * 256 + math.floor((x - math.floor(x)) * 256) for x in v] for i, v in vectors}
    out = []
    for q in whole:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], w, strict=False)), i) for i, w in whole.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk_components_near_two_to_the_forty(spark):
    rng = np.random.default_rng(2)
    small = [(i, rng.normal(0, 2, 8).tolist()) for i in range(1, 160)]
    wide = [(50, [2.0**14] * 8), (100, [0.0, *[float(x) for x in rng.integers(-(2**23), 2**23, 7)]]), (200, [2.0**32] + [0.0] * 7), (201, [-(2.0**32)] + [1.0] * 7), (202, []), (203, [1.0] * 3)]
    vectors = [v for v in small if v[0] not in (50, 100)] + wide
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()  # the product of 200 and 201 is no long, but none of the best
    assert sorted((r.query_id, r["rank"], r.vec_id, r["score"]) for r in got) == exact_best(vectors)


def test_topk_scores_beyond_a_long_fail(spark):
    df = spark.createDataFrame([(50, [2.0**40, 0.0]), (51, [2.0**40, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="no long"):
        topk.top_k(df, F.col("vec_id") % 50 == 0).collect()


def test_topk_blocks_of_any_size_agree(spark, monkeypatch):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, rng.normal(0, 1, 6).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    monkeypatch.setattr(topk, "BLOCK_ROWS", 37)
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect())) == want


# ---- 6: n-gram Jaccard ----


def test_jaccard_with_everything_hot(spark, monkeypatch):
    for module in (common, jaccard):
        monkeypatch.setattr(module, "HOT_ROWS", 2)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(base)) for i in range(30)]
    for v in range(30, 70):
        copy = [*base]
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(40)] = f"n{rng.randrange(30)}"
        rows.append((v, " ".join(copy)))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, rows), 2, 80).collect()]
    assert sorted(got, key=repr) == brute_components(rows, 2, 80)


# ---- 7: pieces ----


def test_kept_columns_of_clashing_names_are_replaced(spark):
    df = documents(spark, [(1, "one two three"), (2, None)]).withColumns({c: F.lit(7) for c in ("ids", "score", "candidates", "clip", "feature", "n_bytes")})
    encoded = pieces.encode_documents(df, keep=["doc_id", "ids"])
    assert encoded.columns == ["doc_id", "ids"] and {r.doc_id: len(r.ids) for r in encoded.collect()}[2] == 0
    assert pieces.decode_documents(encoded.withColumn("text", F.lit("x")), ["doc_id", "text"]).columns == ["doc_id", "text"]
    scored = toxicity.score_texts(df, {"features": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": -1.0}, ["doc_id", "score"])
    assert scored.columns == ["doc_id", "score"] and scored.select("score").count() == 2
    found = secrets.find_secrets(df, ["doc_id", "base", "candidates"])
    assert sorted(found.columns) == ["base", "doc_id", "found"] and found.count() == 2
    stored = media.media_columns(df, ["doc_id", "feature", "n_bytes"], with_media=True)
    assert len(set(stored.columns)) == len(stored.columns) == 9
    clips = media.clip_table(stored.withColumn("clip", F.lit("x")), ["doc_id", "clip"])
    assert clips.columns == ["doc_id", "clip", "first", "stop", "start_s", "stop_s"] and clips.count() == 2


# ---- 8: PII ----


def plain_feistel(symbols, radices, label):
    half = -(-len(symbols) // 2)
    left, right = list(symbols[:half]), list(symbols[half:])
    for k in range(pii.ROUNDS):
        to, other, first = (left, right, 0) if k % 2 == 0 else (right, left, half)
        digest = hashlib.sha256(f"{label}|{k}|{len(symbols)}|{','.join(map(str, other))}".encode()).hexdigest()
        for i in range(len(to)):
            to[i] = (to[i] + int(digest[(i % 16) * 4 : (i % 16) * 4 + 4], 16)) % radices[first + i]
    return left + right


def test_pseudonyms_against_a_plain_feistel(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        area, group, serial = rng.choice([x for x in range(1, 900) if x != 666]), rng.randrange(1, 100), rng.randrange(1, 10_000)
        rows.append((i, f"{area:03}-{group:02}-{serial:04}"))
    got = {r.doc_id: r.text for r in pii.pseudonymise(documents(spark, rows), key="k").collect()}
    for i, text in rows:
        area, group, serial = map(int, text.split("-"))
        a, g, s = plain_feistel([area - (2 if area > 666 else 1), group - 1, serial - 1], [898, 99, 9999], "k|ssn|")
        assert got[i] == f"{a + (2 if a + 1 >= 666 else 1):03}-{g + 1:02}-{s + 1:04}"


def test_dates_are_permuted_within_their_range(spark):
    days = spark.range(pii.DAYS).select(F.date_format(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert days.agg(F.max("text")).first()[0] == "2099-12-31"
    new = pii.pseudonymise(days)
    n, distinct, least, most, counted = new.agg(F.count("*"), F.count_distinct("text"), F.min("text"), F.max("text"), F.sum("pii_date")).first()
    assert (n, distinct, least, most, counted) == (pii.DAYS, pii.DAYS, "1900-01-01", "2099-12-31", pii.DAYS)


def test_mail_domain_and_session_key(spark):
    rows = [(1, "a@one.example"), (2, "a@two.example"), (3, "a@one.example")]
    got = {r.doc_id: r.text for r in pii.pseudonymise(documents(spark, rows)).collect()}
    assert got[1] == got[3] and all(got[i].endswith(rows[i - 1][1][1:]) for i in got)
    spark.conf.set(pii.KEY_SETTING, "other")
    try:
        named = {r.doc_id: r.text for r in pii.pseudonymise(documents(spark, rows)).collect()}
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert named == {r.doc_id: r.text for r in pii.pseudonymise(documents(spark, rows), key="other").collect()}


# ---- 9: chat ----


def test_turns_without_conversation(spark):
    rows = [(None, 0, "user", "z"), (None, 3, "user", "z"), (None, 0, "user", "y"), (None, 1, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(((r.conv_id, r.n_turns, r.n_copies, r.rendered.count("<|im_start|>")) for r in chat.format_conversations(df).collect()), key=repr)
    assert got == sorted([(None, 1, 2, 1), (1, 2, 1, 2), (2, 1, 2, 1)], key=repr)


# ---- 10: media ----


def test_shots_against_plain_loops(spark):
    rng = random.Random(11)
    rows = [(i, "".join(chr(rng.randrange(a, a + 30)) * 700 for a in rng.choices((40, 60, 90), k=12))) for i in range(6)] + [(90, None), (91, "x")]
    got = {r.doc_id: r.feature for r in media.media_columns(documents(spark, rows), ["doc_id"]).collect()}
    for i, text in rows:
        raw = (text or "").encode()
        raw += bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        size = media.ACROSS * media.DOWN
        frames = [raw[a : a + size] for a in range(0, len(raw), size)]
        frames[-1] += bytes(size - len(frames[-1]))
        hists = [Counter(b >> 3 for b in f) for f in frames]
        change = [sum(abs(a[k] - b[k]) for k in range(32)) / (2 * size) for a, b in zip(hists, hists[1:], strict=False)]
        cuts, began = [0], 0
        for j, c in enumerate(change):
            past = change[max(began, j - media.WINDOW) : j]
            mean = sum(past) / len(past) if past else 0
            limit = max(media.LEAST_CHANGE, mean + media.DEVIATIONS * sum(abs(p - mean) for p in past) / len(past) if past else 0)
            if c > limit:
                cuts.append(j + 1)
                began = j + 1
        edges = [*cuts, len(frames)]
        clips = "|".join(f"{a / media.RATE:.2f}-{b / media.RATE:.2f}" for a, b in zip(edges, edges[1:], strict=False))
        assert got[i] == f"frames={len(frames)};shots={len(cuts)};clips={clips}"


def test_a_third_of_the_rows_are_equal(spark):
    """Rows without ids and with one text are dealt over shards by number: sizes stay within 2 %, slots have no gaps."""
    rows = [(None, "y" * 120, "s")] * 1000 + [(i, f"{i} " + "x" * 117, "s") for i in range(2000)]
    got = sharding.shard_documents(documents(spark, rows), leaves=8).collect()
    assert len(got) == 3000
    sums, places = Counter(), {}
    for r in got:
        sums[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    mean = sum(sums.values()) / 8
    assert len(sums) == 8 and all(abs(s - mean) <= 0.02 * mean for s in sums.values())
    assert all(sorted(s) == list(range(len(s))) for s in places.values())


def test_one_id_with_many_texts_stays_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "GROUP_ROWS", 50)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(100)], "doc_id long, label int")
    docs = spark.createDataFrame([(i, f"word {i} more") for i in range(100)] + [(7, f"text {i} of one id") for i in range(3000)], "doc_id long, text string")
    sizes = spark.sparkContext.accumulator(0)

    def group(rows):
        import pyarrow as pa

        sizes.add(len(rows))
        return pa.table({"feature": pa.array([-1, len(rows)], pa.int64()), "weight": pa.array([0.5, 1.0])})

    monkeypatch.setattr(toxicity, "_train_group", group)
    model = toxicity.train(docs, labels, 200)
    assert sizes.value <= 260 and max(model["features"]) <= 100  # the features are the groups' sizes
