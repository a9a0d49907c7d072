"""Lookups against a pair-by-pair check."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions.dates import same_month
from tidewell.functions.orgs import normalize_org
from tidewell.functions.text import longest_name, title_key
from tidewell.operators import lookup


@pytest.mark.parametrize("accept,bonus", [(0.85, 0.0), (0.95, 0.35), (0.7, 0.0)])
def test_linkage_loses_no_partner(spark, accept, bonus):
    rnd = random.Random(5)
    words = ["환경안전", "담당", "채용", "공고", "7월", "8월", "울산", "경력", "신입", "EHS", "[급]", "품질"]
    make = lambda tag: [(f"{tag}{i}", rnd.choice(["한빛", "대솔"]), " ".join(rnd.choices(words, k=rnd.randint(0, 5)))) for i in range(80)]
    left = spark.createDataFrame(make("l"), "lid string, org string, t1 string")
    right = spark.createDataFrame(make("r"), "rid string, org string, t2 string")
    pairs = left.join(right, "org").filter(same_month("t1", "t2")).withColumn(
        "s", F.round(lookup.similarity(title_key("t1"), title_key("t2")) + bonus, 6)).filter(F.col("s") >= accept)
    want = {r["lid"]: r["s"] for r in pairs.groupBy("lid").agg(F.max("s").alias("s")).collect()}
    out = lookup.link_records(left, right, ["org"], "t1", "t2", "lid", "rid", accept, F.lit(bonus), bonus)
    assert {r["lid"]: r["score"] for r in out.collect() if r["score"] is not None} == want and out.count() == 80
    with pytest.raises(ValueError):
        lookup.link_records(left, right, ["org"], "t1", "t2", "lid", "rid", 0.4)


def _agree(a, b):
    return bool(a and b and (a in b or b in a))


@pytest.mark.parametrize("accept,bonus,malus", [(0.95, 0.35, -0.5), (0.85, 0.3, 0.0), (0.9, 0.05, -0.05)])
def test_linkage_by_company_evidence_equals_all_pairs(spark, accept, bonus, malus):
    rnd = random.Random(8)
    words = ["환경안전", "담당", "채용", "공고", "7월", "8월", "울산", "경력", "EHS", "[급]", "품질"]
    firms = ["한빛", "(주)한빛", "한빛전자", "대솔", "솔", "", None, "㈜대솔 소재", "Nuri", "nuri, chem"]
    make = lambda tag, n: [(f"{tag}{i:03}", rnd.choice(firms), rnd.choice([None, *[" ".join(rnd.choices(words, k=rnd.randint(0, 5))) for _ in range(9)]])) for i in range(n)]
    left = spark.createDataFrame([*make("l", 90), ("l000", "한빛", "채용")], "lid string, c1 string, t1 string")
    right = spark.createDataFrame(make("r", 90), "rid string, c2 string, t2 string")
    score = lookup.similarity(title_key("t1"), title_key("t2"))
    pairs = left.crossJoin(right).filter(same_month("t1", "t2")).select(
        "lid", "t1", "c1", "rid", normalize_org("c1", "detail").alias("a"), normalize_org("c2", "detail").alias("b"), score.alias("s")).collect()
    want = {}
    for r in pairs:
        total = round(r["s"] + (bonus if _agree(r["a"], r["b"]) else malus), 6)
        if total >= accept:
            row = (r["lid"], r["c1"], r["t1"])
            want[row] = min(want.get(row, (0, "")), (-total, r["rid"]))
    out = lookup.link_by_evidence(left, right, "t1", "t2", "c1", "c2", "rid", accept, bonus, malus)
    assert out.columns == ["lid", "c1", "t1", "rid_match", "score"]
    got = out.collect()
    assert len(got) == 91 and {(r["lid"], r["c1"], r["t1"]): (-r["score"], r["rid_match"]) for r in got if r["rid_match"]} == want
    assert lookup.link_by_evidence(left, right.limit(0), "t1", "t2", "c1", "c2", "rid").filter("rid_match is null").count() == 91
    with pytest.raises(ValueError):
        lookup.link_by_evidence(left, right, "t1", "t2", "c1", "c2", "rid", 0.8, 0.35)


def test_names_inside_names(spark):
    rnd = random.Random(4)
    draw = lambda n: sorted({"".join(rnd.choices("ab한", k=rnd.randint(1, 7))) for _ in range(n)})
    outer, inner = [*draw(60), "ab한" * 400], draw(40)
    got = lookup.contained_names(spark.createDataFrame([(n,) for n in [*outer, "", None]], "name string"),
                                 spark.createDataFrame([(n,) for n in [*inner, *inner, "", None]], "name string"))
    assert sorted(map(tuple, got.collect())) == sorted((o, i) for o in outer for i in inner if i in o)


@pytest.mark.parametrize("boundary", [True, False])
def test_mentions_of_a_table_equal_mentions_of_a_list(spark, boundary):
    names = ["HB", "한빛전자", "한빛전자소재", "3Q", "한빛", "ab", "b", "전자소"]
    rnd = random.Random(2)
    parts = [*names, "x", " ", "가", "HBX", "내"]
    texts = spark.createDataFrame([(i, "".join(rnd.choices(parts, k=rnd.randint(0, 6)))) for i in range(120)], "id int, t string")
    table = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["id"]: r["name"] for r in lookup.mention_join(texts, "id", "t", table, "name", boundary=boundary).collect()}
    if boundary:
        want = {r["id"]: r["w"] for r in texts.select("id", longest_name(sorted(names, key=str.lower), "t").alias("w")).collect()}
    else:
        want = {r["id"]: min((n for n in names if n.lower() in r["t"].lower()), key=lambda n: (-len(n), n.lower()), default=None) for r in texts.collect()}
    assert got == want


def test_short_names_where_no_long_one_occurs(spark):
    names = ["q", "zu", "mire", "quarry", "lampblack", "lampblack stove"]
    said = [(1, "a lampblack stove"), (2, "LAMPBLACK, quarry"), (3, "the quarry"), (4, "quagmire"), (5, "azure q"), (6, "aqua"), (7, "none"), (8, None), (8, "zu"), (None, "mire")]
    texts = spark.createDataFrame(said, "id int, t string")
    table = spark.createDataFrame([(n,) for n in names], "name string")
    for gram in (1, 3, 8, 40):
        got = {(r["id"], r["t"]): r["name"] for r in lookup.mention_join(texts, "id", "t", table, "name", gram=gram).collect()}
        assert [got[k] for k in said[:7]] == ["lampblack stove", "lampblack", "quarry", "mire", "zu", "q", None]
        assert got[(8, None)] == got[(8, "zu")] == "zu" and got[(None, "mire")] is None  # names belong to ids
    none = lookup.mention_join(texts, "id", "t", table.filter("false"), "name")
    assert none.filter("name is null").count() == len(said)


def test_best_company_and_flags(spark):
    q = spark.createDataFrame([(1, "(주)한빛"), (2, "대솔")], "q int, name string")
    hits = spark.createDataFrame([(1, "한빛소재", 0), (1, "한빛", 1), (1, "한빛", 2), (2, "누리", 0)], "q int, listed string, pos int")
    assert [tuple(r) for r in lookup.best_company(q, hits, "q", "name", "listed", "pos").select("q", "pos", "score").collect()] == [(1, 1, 3)]
    many = spark.range(50).withColumn("k", F.lit(1))
    small = spark.createDataFrame([(1, "v")], "k int, v string")
    assert lookup.spread_join(many, small, ["k"], salts=4).count() == 50


@pytest.mark.parametrize("boundary", [True, False])
@pytest.mark.parametrize("signs", [10_000, 0])
def test_automaton_and_join_find_the_same(spark, boundary, signs):
    """Signs 0 sends the dictionary through the distributed join."""
    names = ["HB", "한빛전자", "한빛전자소재", "3Q", "3q", "한빛", "ab", "b", "전자소", "b 7", "", None, "İz"]
    rnd = random.Random(6)
    parts = [*filter(None, names), "x", " ", "가", "HBX", "내", "7"]
    rows = [(i, "".join(rnd.choices(parts, k=rnd.randint(0, 7))), "clash") for i in range(150)] + [(900, None, ""), (901, "x" * 200_000 + "한빛전자", "")]
    texts = spark.createDataFrame(rows, "id int, t string, _n string")
    table = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["id"]: r["name"] for r in lookup.longest_mentions(texts, "id", "t", table, "name", boundary=boundary, automaton_signs=signs).collect()}

    def fits(t, n):
        at = t.find(n)
        while at >= 0:
            before, after = t[at - 1:at] if at else "", t[at + len(n):at + len(n) + 1]
            if not boundary or not (before and before in ASCII and n[0] in ASCII + "0123456789") and not (after and after in ASCII and n[-1] in ASCII + "0123456789"):
                return True
            at = t.find(n, at + 1)
        return False

    for i, t, _ in rows:
        found = [n for n in names if n and fits((t or "").lower(), n.lower())]
        assert got[i] == min(found, key=lambda n: (-len(n.lower()), n.lower(), n), default=None)
    assert "Exchange" not in _plan(lookup.longest_mentions(texts, "id", "t", table, "name"))
    assert lookup.longest_mentions(texts, "id", "t", table.limit(0), "name").filter("name is null").count() == len(rows)


def test_a_million_names_and_a_hot_text(spark):
    names = spark.range(1_000_000).select(F.concat(F.lit("n"), F.hex("id")).alias("name"))
    hot = spark.range(200).select("id", F.lit("zz n1F4A0 and nFFFFF, n7 ").alias("t")).unionByName(
        spark.createDataFrame([(500, "one nABC " * 20_000)], "id long, t string"))
    got = {r["id"]: r["name"] for r in lookup.longest_mentions(hot, "id", "t", names, "name", automaton_signs=8_000_000).collect()}
    assert {got[i] for i in range(200)} == {"n1F4A0"} and got[500] == "nABC"  # FFFFF is beyond the last name


ASCII = "abcdefghijklmnopqrstuvwxyz"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
