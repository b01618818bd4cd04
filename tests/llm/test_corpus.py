"""Operators 4, 5, 8, 9, 10 and the pipeline."""
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

from reqlens.llm import op4_minhash as near
from reqlens.llm import op5_mixing as mixing
from reqlens.llm import op8_quality_classifier as qual
from reqlens.llm import op9_token_ids as ids
from reqlens.llm import op10_pitman_yor as py
from reqlens.llm.common import read_table
from reqlens.llm.components import components
from reqlens.llm.tokens import Encoder

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------------------ 4
def brute_groups(rows):
    sets = {}
    for doc_id, text in rows:
        w = tuple((text or "").encode().lower().split())
        sets[doc_id] = {w[i:i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else ({w} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    held = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            held[g].append(d)
    for d, s in sets.items():
        for e, i in Counter(e for g in s for e in held[g] if e > d).items():
            if 100 * i >= 75 * (len(s) + len(sets[e]) - i):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check_groups(df, rows):
    want = brute_groups(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}
    assert got == want


def test_near_duplicates_equal_brute_force(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    check_groups(near.near_duplicates(docs), [tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("block, shingles", [(16, near.BLOCK_SHINGLES), (near.BLOCK, 1000), (near.BLOCK, near.BLOCK_SHINGLES)])
def test_near_duplicates_in_a_drifting_group(spark, monkeypatch, block, shingles):
    """A large group whose members are similar to neighbours but not to all,
    compared in several blocks and in one of production size."""
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", shingles)
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(150):
        if d % 3 == 0:
            base[rnd.randrange(120)] = f"x{d}"
        w = list(base)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(120)] = f"y{d}{rnd.random()}"
        rows.append((d, " ".join(w)))
    check_groups(near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), rows)


def test_near_duplicates_odd_rows(odd, none):
    rows = near.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert {(1, 10, 1, True), (2, 10, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True),
            (8, 1, 8, True)} <= got and any(r[0] is None and r[2] is None and r[3] for r in got)
    kept = near.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 8, 9, 10]
    assert near.near_duplicates(none).count() == 0


def test_components(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)]
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# ------------------------------------------------------------------------ 5
def test_sainte_lague_gives_the_highest_quotients():
    rnd = random.Random(8)
    for _ in range(200):
        votes = [rnd.randrange(0, 50) for _ in range(rnd.randrange(1, 7))]
        seats = rnd.randrange(0, 40)
        top = sorted(((-v / (2 * s + 1), i) for i, v in enumerate(votes) if v for s in range(seats)))[:seats]
        want = Counter(i for _, i in top)
        assert mixing.sainte_lague(votes, seats) == [want[i] if any(votes) else 0 for i in range(len(votes))]


def test_sainte_lague_of_one_large_and_many_small():
    """Highest quotients may give the large one less than its exact share."""
    def brute(votes, seats):
        top = sorted((-Fraction(v, 2 * s + 1), i) for i, v in enumerate(votes) if v for s in range(seats))[:seats]
        won = Counter(i for _, i in top)
        return [won[i] for i in range(len(votes))]
    assert mixing.sainte_lague([10000] + [100] * 51, 151) == brute([10000] + [100] * 51, 151)
    rnd = random.Random(4)
    for _ in range(60):
        votes = [rnd.randrange(2000, 9000)] + [rnd.randrange(0, 120) for _ in range(rnd.randrange(20, 60))]
        seats = rnd.randrange(1, 160)
        assert mixing.sainte_lague(votes, seats) == brute(votes, seats)
    assert mixing.sainte_lague([900, 50, 50], 20, [3, 20, 20]) == [3, 9, 8]


def test_capped_targets():
    assert mixing.capped_targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    # the last source is capped at 30, the rest goes to the others by weight
    assert mixing.capped_targets([135, 135, 10], [1, 2, 3]) == pytest.approx([250 / 3, 500 / 3, 30])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_mixing_meets_targets(spark, sf):
    rows = mixing.query(spark, sf).collect()
    src = {r["doc_id"]: r["source"] for r in read_table(spark, sf, "documents").collect()}
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        s = src[r["doc_id"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        size[s] += r["size"]
        target[s] = r["target"]
    names = sorted(size)
    assert [target[s] for s in names] == pytest.approx(mixing.capped_targets([size[s] for s in names], [1 + i % 3 for i in range(len(names))]))
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS + 0.02 * target[s] for s in names)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.query(spark, sf).collect()))


def test_mixing_odd_rows(odd, none):
    got = mixing.mix(odd)
    assert got.columns[-4:] == ["size", "source_size", "target", "taken"] and got.count() == odd.count()
    assert all(r["taken"] == 0 for r in got.collect() if r["size"] == 0)
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


# ------------------------------------------------------------------------ 8
def test_quality_classifier_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    rows = qual.query(spark, sf).where("held_out").join(read_table(spark, sf, "labels"), "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 for r in rows)
    good = np.array([r["score"] for r in rows if r["quality"] == 1])
    bad = np.array([r["score"] for r in rows if r["quality"] == 0])
    auc = (good[:, None] > bad[None, :]).mean()
    assert auc > 0.97 and (good >= 0.3).mean() > 0.97 and (bad < 0.3).mean() > 0.85


def test_quality_classifier_odd_rows(odd, none, labels):
    model = qual.fit(odd, labels)
    got = qual.with_scores(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert qual.keep_good(odd, labels).columns == odd.columns
    assert qual.fit(odd, labels.limit(0)).prior == 0.5
    assert qual.with_scores(none, model).count() == 0


# ------------------------------------------------------------------------ 9
def test_elias_fano_round_trip():
    rnd = np.random.default_rng(9)
    for d, top in ((1, 0), (1, 10), (5, 3), (1000, 10), (1000, 10**7), (3, 2**40)):
        ends = np.sort(rnd.integers(0, top + 1, d))
        low, lows, high = ids.ef_encode(ends, int(ends[-1]))
        assert (ids.ef_select(low, lows, high, d) == ends).all()
        some = rnd.integers(0, d, 7)
        assert (ids.ef_select(low, lows, high, d, some) == ends[some]).all()
        bits = 8 * len(lows) + 64 * len(high)
        assert bits <= d * (2 + math.ceil(math.log2(max(2, top / d)))) + 128


def test_chunks_give_the_library_s_ids(spark, sf):
    e = Encoder.of(PATH)
    texts = [r["text"] for r in read_table(spark, sf, "documents").collect()]
    texts += ["", " ", "  a", " a b", "a  b", "x\n y", "it's don't, \"q\" a_b 12ab, ab12. <|endoftext|> foo<|endoftext|>bar ",
              "naïve² ½x ʰa", "日本 語。 x", "é, É!! \x1c z", "tab\tx y", "한국어 text, ÅÄ.", "don't' can't!'",
              "a \x00b \x00", "end \n", "end.\n", "\n a", "a\n b", " \nc d\n\n", "\u0120a \u0120", "a \x1cb c\x85 d"]
    want = [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, e.dtype).tolist() for b in e.encode_bytes(texts)] == want


def test_token_table(spark, sf):
    from tokenizers import Tokenizer
    tok, start = Tokenizer.from_file(PATH), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in ids.query(spark, sf).collect()}
    for r in read_table(spark, sf, "documents").orderBy("doc_id").collect():
        x = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert got.pop(r["doc_id"]) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    assert not got


def test_token_odd_rows(odd, none, monkeypatch):
    monkeypatch.setattr(ids, "FRAME_IDS", 16)       # many frames to a file
    rows = sorted(ids.token_table(odd, PATH).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 6, 6, 8, 9, 10]
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)] == [1, 1]
    assert ids.token_table(none, PATH).count() == 0


# ----------------------------------------------------------------------- 10
def brute_base(rows):
    count, toks = Counter(), {}
    for d, t in rows:
        toks[d] = (t or "").encode().lower().split() + [None]
        if zlib.crc32(str(d).encode()) % 10:
            count.update(toks[d])
    n, v = sum(count.values()), len(count)
    return {d: (len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
            for d, w in toks.items()}


def test_language_model_baseline_and_gain(spark):
    sf = "/root/testdata/sf0.01"
    want = brute_base([tuple(r) for r in read_table(spark, sf, "documents").select("doc_id", "text").collect()])
    rows = py.query(spark, sf).collect()
    for r in rows:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_predictive_probabilities_sum_to_one():
    """Over the known words and the unknown one, in every context."""
    rng = np.random.default_rng(10)
    word, context = np.divmod(np.arange(40 * 3), 3)
    count = rng.integers(0, 6, 120)
    a, r, sums = py.sample_bucket(word, context, count, 40, 1, 1)
    n, v, c0, t0 = sums["rest"]
    p0 = (r + (py.ROOT_STRENGTH + py.ROOT_DISCOUNT * t0) / (v + 1)) / (py.ROOT_STRENGTH + c0)
    unknown = (py.ROOT_STRENGTH + py.ROOT_DISCOUNT * t0) / (v + 1) / (py.ROOT_STRENGTH + c0)
    seen = np.bincount(word, weights=count, minlength=40) > 0
    for k in range(3):
        own = context == k
        back = (py.STRENGTH + py.DISCOUNT * sums["t_k"][k])
        p = (a[own] + back * p0) / (py.STRENGTH + sums["c_k"][k])
        assert p[seen].sum() + back * unknown / (py.STRENGTH + sums["c_k"][k]) == pytest.approx(1, abs=1e-3)


def test_seating_matches_a_plain_sampler():
    """Mean number of tables against one-by-one Gibbs seating."""
    rng = np.random.default_rng(11)
    d, new, c = 0.5, 1.5, 12
    seat = py.Seating(np.full(3000, c), d, np.full(3000, new), rng)
    for _ in range(500):
        seat.move(np.full(3000, new), np.arange(3000))
    sizes = [1] * c
    total = 0
    for step in range(60_000):
        i = rng.choice(len(sizes), p=np.array(sizes) / c)
        sizes[i] -= 1
        sizes = [s for s in sizes if s]
        w = np.array([s - d for s in sizes] + [new])
        j = rng.choice(len(w), p=w / w.sum())
        if j == len(sizes):
            sizes.append(1)
        else:
            sizes[j] += 1
        total += len(sizes) * (step >= 10_000)
    assert seat.tables.mean() == pytest.approx(total / 50_000, rel=0.05)


def test_every_previous_word_is_a_context_of_its_own(spark):
    """5000 contexts, each with its own next word: what follows stays likely."""
    rows = [(d, " ".join(f"a{i} b{i}" for i in range(k, 5000, 20))) for d in range(200) for k in (d % 20,)]
    got = [r for r in py.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    # a pair is the likely word after its context and an unlikely context after the pair before
    assert got and all(r["score"] / r["n_tokens"] > -0.35 for r in got)


def log_stirling(c, d, most):
    row = np.full(most + 1, -np.inf)
    row[1] = 0.0
    for k in range(1, c):
        t = np.arange(1, most + 1)
        row[1:] = np.logaddexp(row[:-1], np.where(t <= k, np.log(np.maximum(k - d * t, 1e-300)), -np.inf) + row[1:])
    return row[1:]


@pytest.mark.parametrize("c, p, others", [(40, 0.02, 30.0), (500, 0.3, 300.0), (20_000, 0.02, 2000.0)])
def test_tables_of_hot_dishes_follow_their_distribution(c, p, others):
    """One draw at production settings against the exact distribution."""
    most, n = min(c, 800), 4000
    t = np.arange(1, most + 1)
    w = log_stirling(c, py.DISCOUNT, most) + np.cumsum(np.log((py.STRENGTH + py.DISCOUNT * (others + t - 1)) * p))
    w = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
    got = py.draw_tables(np.full(n, c), np.full(n, p), np.full(n, others), py.DISCOUNT, py.STRENGTH,
                         np.random.default_rng(12).random(n))
    mean = (w * t).sum()
    assert got.mean() == pytest.approx(mean, rel=0.02) and got.std() == pytest.approx((w * (t - mean) ** 2).sum() ** 0.5, rel=0.06)


def test_scores_do_not_depend_on_the_buckets(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    one, many = ({r["doc_id"]: r["score"] for r in py.score(docs, buckets=b).collect()} for b in (1, 23))
    assert one == pytest.approx(many, rel=1e-6)
    # and are those of the model over the whole corpus in one process
    texts = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b" end "] for r in docs.collect()}
    names = {w: i for i, w in enumerate(sorted({w for t in texts.values() for w in t}))}
    pairs = {d: [(names[w], names[v]) for w, v in zip(t, [b" end ", *t])] for d, t in texts.items()}
    count = Counter(x for d, t in pairs.items() if zlib.crc32(str(d).encode()) % 10 for x in t)
    keys = sorted({x for t in pairs.values() for x in t})
    a, r, sums = py.sample_bucket(*np.array(keys).T, np.array([count[x] for x in keys]), len(names), names=py.hash_words(list(names)))
    n, v, c0, t0 = sums["rest"]
    p0 = (r + (py.ROOT_STRENGTH + py.ROOT_DISCOUNT * t0) / (v + 1)) / (py.ROOT_STRENGTH + c0)
    p = {(w, k): (x + (py.STRENGTH + py.DISCOUNT * sums["t_k"][k]) * p0[w]) / (py.STRENGTH + sums["c_k"][k])
         for (w, k), x in zip(keys, a)}
    assert one == pytest.approx({d: sum(math.log10(p[x]) for x in t) for d, t in pairs.items()}, rel=1e-4)


def test_language_model_disk(spark, monkeypatch):
    """What lies on disk after each step, and how many rows a step makes."""
    rng = np.random.default_rng(13)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 1000) % 30_000) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).localCheckpoint()
    files = lambda: {f.getName() for f in [x.apply(i) for x in (disk.getAllFiles(),) for i in range(x.size())]
                     if f.getName().startswith("shuffle_")}
    disk, live, made, plain = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), [], [], py.land
    size = lambda path: sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))
    was = spark.conf.get("spark.sql.shuffle.partitions")

    def landed(df, name):
        left = files()
        out = plain(df, name)
        tables.append(out._landed.removeprefix("file:"))
        live.append((name, sum(map(size, tables))))
        assert files() <= left, name
        made[-1][name] = made[-1].get(name, 0) + out.count()
        return out
    monkeypatch.setattr(py, "land", landed)
    try:
        for n in ("2", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            tables = []
            made.append({})
            assert py.score(docs).count() == 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert max(x for _, x in live) < 1.7 * sum(map(len, texts))
    # rows do not grow with the partitions that the session happens to have
    assert made[0] == made[1]


def test_language_model_odd_rows(odd, none):
    rows = py.score(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (3, 4, 5)) and all(math.isfinite(r["score"]) for r in rows)
    assert next(r for r in rows if r["doc_id"] is None)["held_out"]
    assert py.score(none).count() == 0
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in py.score(odd.where("doc_id is null")).collect())


# ----------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, sf):
    import corpus_pipeline as pipe
    docs = read_table(spark, sf, "documents")
    kind = docs.columns
    steps = dict(pipe.STAGES)
    assert [n for n, _ in pipe.STAGES] == ["quality classifier", "near duplicates", "decontamination", "mix sources", "token ids"]
    good = steps["quality classifier"](spark, docs, sf)
    scores = qual.with_scores(docs, qual.fit(docs, read_table(spark, sf, "labels")))
    assert good.columns == kind and good.count() == scores.where("score >= 0.3").count()
    one = steps["near duplicates"](spark, docs, sf)
    want = {g for _, g in brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()]).values()}
    assert one.columns == kind and {r["doc_id"] for r in one.collect()} == want
    clean = steps["decontamination"](spark, docs, sf)
    assert clean.columns == kind and clean.count() < docs.count()
    mixed = steps["mix sources"](spark, docs, sf)
    assert mixed.columns == kind and mixed.count() > 0


def test_pipeline_run(spark, sf):
    import corpus_pipeline as pipe
    rows = sorted(pipe.run(spark, sf).collect(), key=lambda r: r["start"])
    assert rows and rows[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] and a["doc_id"] <= b["doc_id"] for a, b in zip(rows, rows[1:]))
