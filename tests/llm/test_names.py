import random

import numpy as np
import pytest

from evidencia.functions.edits import distance
from evidencia.llm import bktree, orgnames, places

CITIES = [(1, "Jedieri", "Vindhara Pradesh", None), (2, "Nabhogarh", "Purvabhumi", None), (3, "Nabhogarh", "Chitramala", None), (4, "Shujapuur", "Uttarvan", "Yoyemer"), (5, "Navi Shujapuur", "Uttarvan", None), (None, "Nowhere", "X", None)]


def test_tree_finds_what_all_distances_find():
    rng = random.Random(1)
    words = list({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(150)})
    for w in words[:25]:
        assert bktree.distances(w, *bktree.matrix(words)).tolist() == [distance(w, x) for x in words]
    found = bktree.Tree(words).find(words, np.full(len(words), 2))
    for w, f in zip(words, found):
        assert sorted(f) == sorted((distance(w, x), k) for k, x in enumerate(words) if distance(w, x) <= 2)


@pytest.mark.parametrize(
    "value, want",
    [
        ("Jedieri", 1),
        ("  jedeiri - 443032", 1),
        ("Sector 14, Jed-ieri (WFO)", 1),
        ("near Jediieri railway station", 1),
        ("Nabhogarh", 0),
        ("Nabhogarh, CM", 3),
        ("nabhoagrh purvabhumi", 2),
        ("Jedieri, Chitramala", 0),
        ("Yoyemmer", 4),
        ("Shujap uur / office", 4),
        ("Navi Shujapur, UV", 5),
        ("Uttarvan", 0),
        ("Work from home", 0),
        ("Torogenagar", 0),
        ("12, --", 0),
        ("", 0),
    ],
)
def test_places(value, want):
    g = places.Gazetteer([c for c in CITIES if c[0]])
    g.learn([value])
    assert places.meant(g.hits(value)) == want


@pytest.mark.parametrize("shard", [1, 2, 3, 20_000])
def test_shards_agree(spark, shard):
    cities = spark.createDataFrame(CITIES, "city_id bigint, city string, state string, former_name string")
    values = spark.createDataFrame([(v, 0) for v in ["jedieir", "Yoyemer", "Navi Shujapuur", "nowhere at all", None, "Nabhogarh, PB", "jedieir", "", "Jedieri, Chitramala", "Shujapuur, Purvabhumi", "Nabhogarh", "Nabhogarh, Uttarvan"]], "v string, value int").select("v")
    got = {r.v: r.city_id for r in places.to_list(values, "v", cities, shard=shard).collect()}
    # a value that names another state goes to no entry, whichever shard knows that state
    assert got == {"jedieir": 1, "Yoyemer": 4, "Navi Shujapuur": 5, "nowhere at all": 0, "Nabhogarh, PB": 2, "": 0, "Jedieri, Chitramala": 0, "Shujapuur, Purvabhumi": 0, "Nabhogarh": 0, "Nabhogarh, Uttarvan": 0}
    assert places.to_list(values, "v", cities.limit(0)).filter("city_id <> 0").count() == 0


def test_a_name_has_any_number_of_words():
    g = places.Gazetteer([(7, "Old Town Of The Five Wells", "Uttarvan", None)])
    g.learn(["near old town of the five welss, Uttarvan"])
    assert places.meant(g.hits("near old town of the five welss, Uttarvan")) == 7


# ---- organisations


@pytest.mark.parametrize(
    "name, want",
    [
        ("The Klod. Ron. Textiles LLP", (["klod", "ron"], "textiles", True)),
        ("Technologies - Nurzek Dreprad (P) Ltd", (["nurzek", "dreprad"], "technologies", False)),
        ("m/s infra, jaapfal merkdrep", (["jaapfal", "merkdrep"], "infra projects", False)),
        ("Bulmrand Vinnib Int'l Pvt.Ltd", (["bulmrand", "vinnib"], "international", False)),
        ("Retail Svcs - Dungfolm Hetjirk", (["dungfolm", "hetjirk"], "retail services", False)),
        ("Pvt Ltd", ([], "", False)),
    ],
)
def test_cores(name, want):
    assert orgnames.core(name) == want


GROUPS = [
    ["Shuxreng Gamdrurt Technologies Pvt Ltd", "SKUXRENG GAMDRURT TECHNOLOGIES", "Shux. Gamdrurt Tech", "Gamdrurt Shuxreng Technologies LLP", "ShuxrengGamdrurt Technologies", "Team Shuxreng Gamdrrut"],
    ["Nelmdrork Shalmtush Solutions", "M/s Nelmdrork Shalmtush Solns."],
    ["Nelmdrork Shalmtush Foods Private Limited", "foods, nelmdork shalmtush"],
    ["Randhug Drivdriv Motors Private Limited", "Rardhug Drivdriv Motor", "Rand. Drivdriv Motors"],
]


def test_organisations(spark):
    rows = [(n, k + 1) for k, g in enumerate(GROUPS) for n in g] + [("", 1), ("--", 2)]
    got = {r.name: r.org for r in orgnames.organisations(spark.createDataFrame(rows, "name string, n bigint")).collect()}
    assert set(got) == {n for g in GROUPS for n in g}
    for g in GROUPS:
        assert len({got[n] for n in g}) == 1, g
    assert len(set(got.values())) == len(GROUPS)


def test_a_name_without_its_line_decides_nothing_between_two(spark):
    rows = [("Nelmdrork Shalmtush Foods", 3), ("Nelmdrork Shalmtush Motors", 3), ("Nelmdrork Shalmtush", 1)]
    got = {r.name: r.org for r in orgnames.organisations(spark.createDataFrame(rows, "name string, n bigint")).collect()}
    assert len(set(got.values())) == 3


def test_no_names(spark):
    assert orgnames.organisations(spark.createDataFrame([], "name string, n bigint")).count() == 0


@pytest.mark.parametrize("word, line", [("phrma", "pharma"), ("txtls", "textiles"), ("lgstcs", "logistics"), ("mtrs", "motors"), ("technlogies", "technologies"), ("svcs", "services"), ("stmr", None), ("fields", None)])
def test_lines_by_rule(word, line):
    assert orgnames.line_of(word) == line


MORE = [
    ["William Harvel Dronsk Motors", "Bill Harvel Dronsk Motors", "Dronsk William Harvel Motors", "W H D Motors"],
    ["Kestrin Brothers", "Kestrin Bros"],
    ["Golvanesk Pirrundal Shastrovik Trelembrad Uvonkrest Hanjaddu", "Trelembrad Golvanesk Pirrundal Shastrovik Uvonkrest Hanjadu Ltd"],
]


def test_nicknames_order_initials_and_long_names(spark):
    rows = [(n, 9 - k) for g in MORE for k, n in enumerate(g)]
    got = {r.name: r.org for r in orgnames.organisations(spark.createDataFrame(rows, "name string, n bigint")).collect()}
    for g in MORE:
        assert len({got[n] for n in g}) == 1, g
    assert len(set(got.values())) == len(MORE)


def test_forms_of_a_name_of_any_length_are_few():
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    assert len(list(orgnames.own_forms("".join(words), words))) < 400


def test_a_form_that_very_many_names_share(spark):
    rows = [(f"Drovikan {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}", 1) for k in range(600)] + [("Drovikan", 5)]
    got = {r.name: r.org for r in orgnames.organisations(spark.createDataFrame(rows, "name string, n bigint")).collect()}
    assert len(got) == 601
