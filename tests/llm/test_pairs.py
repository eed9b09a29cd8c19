import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencia.llm import neardup, spans

WORDS = [f"w{k}" for k in range(3000)]


def naive_shared(texts, least):
    out = set()
    keys = sorted(k for k in texts if texts[k])
    for i, a in enumerate(keys):
        grams = {texts[a][k : k + least] for k in range(len(texts[a]) - least + 1)}
        for b in keys[i + 1 :]:
            if any(texts[b][k : k + least] in grams for k in range(len(texts[b]) - least + 1)):
                out.add((a, b))
    return out


def corpus():
    rng = random.Random(11)
    letters = "abcdefghij klmno पक"
    fresh = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = {k: fresh(rng.choice([0, 50, 299, 300, 700, 2000])) for k in range(40)}
    for n, (a, b) in enumerate([(0, 1), (2, 3), (4, 5), (6, 7), (8, 9), (10, 11)]):
        span = fresh([299, 300, 301, 350, 420, 900][n])
        texts[a], texts[b] = fresh(n * 13) + span + fresh(40), fresh(200) + span + fresh(n)
    hot = fresh(310)
    for k in range(100, 130):  # more texts than FEW share one stretch, half of them too little of it
        texts[k] = fresh(20) + (hot if k % 2 else hot[:280]) + fresh(30)
    texts[200], texts[201] = "a" * 900, "b" + "a" * 299
    texts[202] = "a" * 300
    return texts


@pytest.mark.parametrize("few", [0, 12])
def test_spans_are_those_of_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(spans, "FEW", few)
    texts = corpus()
    df = spark.createDataFrame([*texts.items(), (300, None), (None, "x" * 400), (301, "")], "doc_id bigint, text string").selectExpr("*", "1 as digest", "'k' as key")
    pairs, cover = spans.shared_spans(df.unionByName(df.limit(3)))
    assert {(r.a, r.b) for r in pairs.collect()} == naive_shared(texts, 300)
    for r in cover.collect():
        assert any(texts[r.key][r.begin : r.begin + 300] in t for k, t in texts.items() if k != r.key)


@pytest.mark.parametrize("few", [0, 12])
def test_all_places_of_a_repeated_passage_are_covered(spark, monkeypatch, tmp_path, few):
    monkeypatch.setattr(spans, "FEW", few)
    rng = random.Random(5)
    fresh = lambda n: "".join(rng.choice("abcdefghij klmno") for _ in range(n))
    p = fresh(400)
    # its only piece starts at 50 or before, so that the first 250 characters hold it whole
    s = next(t for t in iter(lambda: fresh(300), None) if max(spans.pieces(t)[0], default=99) <= 50)
    texts = {0: p + "#" + p, 1: p, 2: fresh(80) + s[:250] + fresh(60) + s, 3: fresh(40) + s + fresh(30), 4: "z" * 3000, 5: "y" + "z" * 700, 6: fresh(500)}
    df = spark.createDataFrame([(k, t, len(t)) for k, t in texts.items()], "doc_id bigint, text string, n_chars bigint")
    assert {(r.a, r.b) for r in spans.shared_spans(df)[0].collect()} == naive_shared(texts, 300)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_shared for r in spans.p10_shared(spark, str(tmp_path)).collect()}
    for k, t in texts.items():
        grams = {o[i : i + 300] for j, o in texts.items() if j != k for i in range(len(o) - 299)}
        assert got[k] == len({x for i in range(len(t) - 299) if t[i : i + 300] in grams for x in range(i, i + 300)})
    assert got[0] == 800


def test_spans_of_an_empty_table(spark):
    pairs, cover = spans.shared_spans(spark.createDataFrame([], "doc_id bigint, text string"))
    assert pairs.count() == 0 and cover.count() == 0


def test_starts_leave_no_gap():
    rng = np.random.default_rng(1)
    for points in (rng.integers(97, 100, 3000), np.full(500, 97), rng.integers(2304, 2400, 1500)):
        at = spans.starts(points.astype(np.uint32), 50)
        assert np.diff(np.concatenate(([-1], at, [len(points)]))).max() <= 50


def test_a_long_passage_in_many_texts_costs_its_pairs(spark):
    rng = random.Random(21)
    fresh = lambda n: "".join(rng.choice("abcdefghij klmno") for _ in range(n))
    hot, texts = fresh(1500), {}
    for k in range(250):  # whole, cut off in front, and cut off behind
        texts[k] = fresh(rng.randrange(40)) + (hot, hot[k * 3 :], hot[: 1500 - k * 3])[k % 3] + fresh(rng.randrange(40))
    texts[900] = hot + fresh(5) + hot
    df = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    assert {(r.a, r.b) for r in spans.shared_spans(df)[0].collect()} == naive_shared(texts, 300)


# ---- near duplicates


def naive_alike(texts, width, threshold):
    sets = {k: {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for k, t in texts.items() if t for w in [t.lower().split()]}
    keys = sorted(k for k in sets if sets[k])
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def messages():
    rng = random.Random(2)
    out, key = {}, 0
    for size in [1, 1, 2, 3, 5, 30]:
        base = [rng.choice(WORDS) for _ in range(150)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            out[key] = " ".join(own)
            key += 1
    out[key], out[key + 1], out[key + 2] = out[0], out[0].upper(), out[0]
    return out


@pytest.mark.parametrize("few", [2, 24])
def test_groups_are_those_of_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(neardup, "FEW", few)
    texts = messages()
    rows = [*texts.items(), (900, None), (901, ""), (902, "one"), (None, texts[0]), (3, texts[3])]
    df = spark.createDataFrame(rows, "k bigint, t string").selectExpr("*", "1 as id", "2 as same")
    got = {r.k: r.group for r in neardup.groups(df, "k", "t", width=2, threshold=0.75).collect()}
    assert set(got) == set(texts)
    alike = naive_alike(texts, 2, 0.75)
    root = {k: k for k in texts}
    for _ in texts:
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


@pytest.mark.parametrize("few,most", [(2, 7), (24, 1024)])
def test_links_of_a_crowd_are_those_of_brute_force(spark, monkeypatch, few, most):
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "MOST", most, raising=False)
    texts = {k: t for t, k in {t.lower(): k for k, t in messages().items()}.items()}  # each a class of its own
    df = spark.createDataFrame([*texts.items()], "k bigint, t string")
    got = {r.k: r.links for r in neardup.groups(df, "k", "t", width=2, threshold=0.75).collect()}
    assert got == {k: sum(k in p for p in naive_alike(texts, 2, 0.75)) for k in texts}
    assert max(got.values()) > 20


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_a_chain_in_a_crowd_holds_together(spark, monkeypatch, kind):
    """The middle one is alike to both ends, which are not alike; all three meet in the only bucket there is."""
    for name, value in {"FEW": 1, "ROWS": 1, "bands_for": lambda threshold: 1}.items():
        monkeypatch.setattr(neardup, name, value)
    words = next(w for w in ([f"{s}w{k}" for k in range(120)] for s in range(50)) if len({int(neardup.minhash(neardup.shingles(" ".join(w[k : k + 100]), 1), 1 + neardup.CHECKS)[0]) for k in (0, 10, 20)}) == 1)
    df = spark.createDataFrame([(k, " ".join(words[k * 10 : k * 10 + 100])) for k in range(3)], "k bigint, t string").withColumn("k", F.col("k").cast(kind))
    got = {int(r.k): (int(r.group), r.links) for r in neardup.groups(df, "k", "t", width=1, threshold=0.8).collect()}
    assert got == {0: (0, 1), 1: (0, 2), 2: (0, 1)}


def test_bands_miss_little():
    for threshold in (0.75, 0.8, 0.95):
        n = neardup.bands_for(threshold)
        assert (1 - threshold**neardup.ROWS) ** n <= neardup.MISS < (1 - threshold**neardup.ROWS) ** (n - 1)


def test_a_key_with_several_texts_is_linked_by_any(spark):
    a, b = (" ".join(f"{s}{k}" for k in range(60)) for s in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "nothing like it at all")], "k bigint, t string")
    assert {(r.k, r.group) for r in neardup.groups(df, "k", "t", width=2, threshold=0.75).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_pruning_keeps_what_is_alike():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (4000, neardup.CHECKS), np.uint8)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 256, a.shape, np.uint8))
    kept = neardup.survivors(a, b, 0.75)
    assert len(kept) > 0.99 * len(a)
    far = np.where(rng.random(a.shape) < 0.3, a, rng.integers(0, 256, a.shape, np.uint8))
    assert len(neardup.survivors(a, far, 0.75)) == 0


def test_no_messages(spark):
    assert neardup.groups(spark.createDataFrame([], "k bigint, t string"), "k", "t").count() == 0
