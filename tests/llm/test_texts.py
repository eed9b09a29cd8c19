import numpy as np
import pytest

from evidencia.llm import language, pii, pii_labels, pii_train
from evidencia.llm import queries as Q

EN = ["Please carry the letter and two photographs when you report on {0} May.", "Working time is {0} hours a day and the team gives paid leave after that.", "Your supervisor will explain the work during the first {0} days at the office.", "Do not pay anyone who claims to be from our desk, this letter is free of cost {0}."]
HI = ["Koi paisa nahi lagega, dhyan rakhna ki {0} log pehle se aaye hain.", "Interview sirf chat par hoga, {0} baje taiyar rehna, call nahi aayegi.", "Har task ka {0} milega aur paisa usi din wallet mein aa jayega.", "Ghar walon se pooch lo, phir jaldi bata dena, main {0} tak intezaar karunga."]


def message(lines, k, n=4):
    return "\n".join(lines[(k + i) % len(lines)].format(k * 7 + i) for i in range(n))


def labelled():
    rows = [(k, message(EN, k), "en") for k in range(40)] + [(100 + k, message(HI, k), "hi_latn") for k in range(40)]
    wrong = [(200 + k, message(EN, k), "hi_latn") for k in range(5)] + [(210, message(HI, 1), None)]
    mixed = [(300, "Ref: AB/1\n" + EN[0].format(3) + "\n" + EN[1].format(4) + "\nPost: Clerk\n" + HI[0].format(5) + "\n\n" + HI[1].format(6), "en")]
    return rows, wrong, mixed


def test_labels_are_mended_and_stretches_found(spark):
    rows, wrong, mixed = labelled()
    odd = [(400, None, "en"), (401, "", None), (402, "Ref: 1\n---\n[Fwd]", "en")]
    df = spark.createDataFrame([*rows, *wrong, *mixed, *odd, rows[0]], "offer_id bigint, source_text string, lang string").selectExpr("*", "1 as key", "2 as label")
    got = {}
    for r in language.segments(df, "offer_id", "source_text", "lang").distinct().collect():
        got.setdefault(r.offer_id, []).append((r.first_line, r.last_line, r.lang))
        assert 0 < r.confidence <= 1
    for k, _, lang in rows:
        assert got[k] == [(1, 4, lang)]
    for k in range(5):
        assert got[200 + k] == [(1, 4, "en")]
    assert got[210] == [(1, 4, "hi_latn")]
    assert sorted(got[300]) == [(2, 3, "en"), (5, 7, "hi_latn")]
    assert not {400, 401, 402} & set(got)


def test_a_wording_over_represented_among_wrong_labels_moves_nothing():
    odd = "Ping me on {0} or leave a note at the desk before {0}."  # seen under a wrong label more often than under its own
    en = [message(EN, k) for k in range(40)] + [odd.format(99)]
    hi = [message(HI, k) for k in range(40)] + [odd.format(k) for k in range(6)]
    own = language.mended([en, hi])
    assert {x for x in own[0] if x.startswith("ping")} and not any(x.startswith("ping") for x in own[1])
    models = language.Languages(["en", "hi_latn"], [en, hi])
    assert models.of([language.sentence(odd.format(5))])[0][0] == "en"
    for line in ("der vertrag wird morgen früh im büro unterschrieben", "zq xw vvk jjq pzx kkw qqz wvx", "મારું નામ રમેશ છે અને હું અહીં રહું છું"):
        assert models.of([line]) == [(None, 0.0)]
    assert all(x == ("en", pytest.approx(1, abs=0.1)) for x in models.of([language.sentence(x.format(3)) for x in EN]))


def test_probabilities_sum_to_one():
    sample = [["abab abba", "baab"], ["cdcd dccd"]]
    models = language.Models(sample)
    # the characters that may follow `ab`, with one share left for those never seen
    known = sorted(set("".join(x for part in sample for x in part)) | {"\x02", "\x03"})
    for lang in (0, 1):
        def cost(line):
            return models.entropy([line])[0, lang] * (len(line) + 1)

        # p(c | start, a, b) = p(abc...) / p(ab...), with the closing mark's own cost taken off
        points = np.array([[2, 2, 97, 98, ord(c)] for c in known], np.uint64)
        total = 0.0
        for row in points:
            h = language.hashes(row)
            p, carried = None, 0.0
            for n in range(language.ORDER, 0, -1):
                at, there = language._find(models.keys[n], h[n][language.ORDER - n : language.ORDER - n + 1])
                if there[0]:
                    p = carried + models.logp[n][at[0], lang]
                    break
                at, there = language._find(models.contexts[n], h[n - 1][language.ORDER - n : language.ORDER - n + 1])
                carried += models.backoff[n][at[0], lang] if there[0] else 0.0
            total += 2 ** (p if p is not None else carried + models.floor)
        assert 0.75 < total < 1.01
        assert np.isfinite(cost("ab"))
    assert models.entropy(["abab"])[0].argmin() == 0 and models.entropy(["dcdc"])[0].argmin() == 1


def test_nothing_to_fit_on(spark):
    df = spark.createDataFrame([(1, "some words here", None)], "offer_id bigint, source_text string, lang string")
    assert language.segments(df, "offer_id", "source_text", "lang").count() == 0
    assert language.segments(df.limit(0), "offer_id", "source_text", "lang").count() == 0


# ---- personal details

TEXT = "Speak to Veloshi N. Narvoti of the talent desk on +91 73200 47847 between 9:43 am and 3.23 pm.\nRef: ZE-834918\nYour ID 0491-6160-5605 has been attached to file TN69732, correct it today if wrong.\nThe kit will reach Flat 699, Gulmobagh Apartments, Pathamarg Road, Vadugusagar 680959 once the desk clears it.\nFor any doubt write to talent.7728@lakshyaworks.in.example and quote RR-231927 in the subject.\nHR: +91 8XXXX XXXXX"
WANT = {("name", "Veloshi N. Narvoti"), ("phone", "+91 73200 47847"), ("id", "0491-6160-5605"), ("address", "Flat 699, Gulmobagh Apartments, Pathamarg Road, Vadugusagar 680959"), ("email", "talent.7728@lakshyaworks.in.example")}


def test_details_are_found_and_replaced(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, TEXT), (None, "no detail here")], "k bigint, t string").selectExpr("*", "'x' as key", "'y' as found")
    got = pii.find(df, "k", "t").collect()
    assert {(r.kind, r.found) for r in got if r.k == 1} == WANT == {(r.kind, r.found) for r in got if r.k == 4}
    assert all(TEXT[r.begin : r.end] == r.found for r in got)
    clean = {r.k: r.redacted for r in pii.redact(df, "k", "t").collect()}
    assert clean[2] is None and clean[3] == "" and clean[None] == "no detail here"
    assert not any(x in clean[1] for _, x in WANT) and "[PHONE]" in clean[1] and "Ref: ZE-834918" in clean[1] and "+91 8XXXX XXXXX" in clean[1]


def test_stretches_cover_the_text():
    for text in (TEXT, "", "\n\n", "one", "A long word. Another one ... and a third · last"):
        cut = pii.stretches(text)
        assert all(text[a : a + len(s)] == s for a, s in cut)
        assert "".join(text.split()) == "".join(c for c in ("".join(s for _, s in cut)).split()) or "..." in text


def test_folding_keeps_lengths_and_windows_are_reconciled():
    for text in (TEXT, "é₹अமA1 ०१२ 😀 x"):
        assert len(pii.folded(text)) == len(text)
    words = ("the desk in the office runs since spring and gives paid leave to all of them " * 8).split(" ")
    for n in range(0, 60, 4):  # the span falls on every place of a window's edge
        text = " ".join([*words[:n], "or ring +91 73200 47847 by tonight", *words])
        spans = pii.Reader(pii.tagger()).read([text])[0]
        assert {(pii.KINDS[k], text[a:b]) for a, b, k in spans} == {("phone", "+91 73200 47847")}


def test_held_out_accuracy(small):
    import pandas as pd

    folder = small.replace("sf0.001", "sf0.01")  # where there are enough names for the labels to be learnt from
    texts = []
    for _, name, key, text in pii.SOURCES:
        texts += pd.read_parquet(f"{folder}/{name}.parquet", columns=[text])[text].dropna().tolist()
    data = pii_train.sample(texts)
    with np.load(pii.WEIGHTS) as f:
        score = pii_train.score(dict(f), data)
    for right, found, there in score.values():
        assert right >= 0.95 * found and right >= 0.95 * there


def test_gradient():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in pii_train.initial(5).items()}
    batch = [(rng.integers(1, 20, n).astype(np.uint8), rng.integers(0, pii.LABELS, n).astype(np.uint8)) for n in (5, 8, 3)]
    _, grad = pii_train.step(w, batch)
    for k in ("wf", "wb", "out", "trans", "start", "bias"):
        i = tuple(rng.integers(0, n) for n in w[k].shape)
        kept, e = w[k][i], 1e-3
        w[k][i] = kept + e
        up, _ = pii_train.step(w, batch)
        w[k][i] = kept - e
        down, _ = pii_train.step(w, batch)
        w[k][i] = kept
        assert abs((up - down) / (2 * e) - grad[k][i]) < 1e-4


def test_training_learns():
    data = [(f"call {d}{d}{d} now", np.array([0] * 5 + [3, 4, 4] + [0] * 4, np.uint8)) for d in range(10)] + [("nothing here", np.zeros(12, np.uint8))] * 5
    w = pii_train.train([(pii.folded(f), y) for f, y in data], 6, hidden=8, say=lambda s: None)
    right, found, there = pii_train.score(w, [(pii.folded(f), y) for f, y in data])[1]
    assert right == there == found


def test_label_shapes():
    names = pii_labels.Labeller([])
    spans = lambda s: {(pii_labels.KINDS[k], s[a:b]) for a, b, k in names.spans(s)}
    assert spans("mail a.b[at]firm[dot]in[dot]example or ring ६४३१८ ५२९९६") == {("email", "a.b[at]firm[dot]in[dot]example"), ("phone", "६४३१८ ५२९९६")}
    assert spans("pay ₹15500-23000 on chat at 11.22 am, code LM-80415") == set()


# ---- catalogue


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_run(spark, small, name):
    df = Q.QUERIES[name](spark, small)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, small, name):
    from pathlib import Path

    import duckdb

    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    cur = con.execute(Q.SQL[name])
    columns = [c[0] for c in cur.description]
    shown = lambda v: "" if v is None else f"{v:.9f}" if isinstance(v, float) else str(v)
    df = Q.QUERIES[name](spark, small)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(map(shown, r)) for r in df.select(columns).collect()) == sorted(tuple(map(shown, r)) for r in cur.fetchall())
