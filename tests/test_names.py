"""Names in texts by one automaton, against the plain patterns, and what they resolve to."""

import random
import re
import time

import pytest

from spindrift.operators import names


def plain_spans(known, text):
    """What an alternation of names, longer ones first, finds."""
    if not known:
        return []
    return [(m.start(), m.end(), m[0]) for m in re.finditer("|".join(re.escape(n) for n in sorted(known, key=lambda n: (-len(n), n))), text)]


def plain_unit_like(text, endings):
    return [m.span() for m in re.finditer("[一-鿿A-Za-z0-9]{2,}?(?:" + "|".join(endings) + ")", text)]


def plain_told(known, text):
    others = []
    for start, end in plain_unit_like(text, names.WITHIN):
        name = re.sub("^(?:" + "|".join(names.BEFORE) + ")+", "", text[start:end])
        if name and name not in known:
            others.append((end - len(name), end))
    return [s for s in plain_spans(known, text) if not any(a <= s[0] and s[1] <= b for a, b in others)]


def plain_unknown(known, text):
    own, out = plain_told(known, text), set()
    for start, end in plain_unit_like(text, names.UNKNOWN):
        if not any(max(start, a) < min(end, b) for a, b, _ in own):
            name = re.sub("^(?:" + "|".join(names.UNKNOWN_BEFORE) + ")+", "", text[start:end]).strip()
            if name:
                out.add(name)
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_spans_equal_the_plain_patterns(seed):
    rng = random.Random(seed)
    letters = "資訊管理電腦科學系所中心處與和查請問a1 ，學院"
    known = {"".join(rng.choices(letters, k=rng.randrange(1, 6))) for _ in range(25)} | {"資管系", "資訊", "資訊學院", "中心"}
    own = names.Names(list(known))
    for _ in range(300):
        text = "".join(rng.choices(letters, k=rng.randrange(0, 40)))
        assert own.spans(text) == plain_spans(known, text)
        assert names.unit_like(text, names.WITHIN) == plain_unit_like(text, names.WITHIN)
        assert own.told(text) == plain_told(known, text)
        assert own.unknown(text) == plain_unknown(known, text)


def test_long_texts_and_large_registries_take_linear_time():
    own = names.Names([f"name{i}" for i in range(20_000)])
    text = "資訊" * 200_000 + " name7 name19999x " * 50_000
    began = time.perf_counter()
    assert len(own.spans(text)) == 100_000
    assert own.unknown("資訊" * 300_000) == [] and time.perf_counter() - began < 20


def directory(spark):
    t = spark.createDataFrame
    return names.Directory(
        t([(" 資工 ", "資訊工程學系"), ("資工系", "資訊工程學系"), ("教務", "教務處"), ("兩屬", "甲系"), ("兩屬", "乙系"), ("", "x")], "alias string, unit string"),
        t([("s1", "資訊工程學系", True), ("s2", "教務處", False), ("s3", "學務處", True), ("s4", "學務處", True), ("s5", "圖書館", True)], "name string, unit string, enabled boolean"),
        t([("資訊工程學系", True, "listing", "s1"), ("教務處", True, "listing", "s2"), ("總務處", True, "scoped", None), ("人事室", False, "listing", "s1"), ("主計室", True, "unsupported", None)], "unit string, enabled boolean, strategy string, source_name string"),
        t([("校內獎學金", "s3"), ("獎學金", "s5"), ("停用獎學金", "s2")], "alias string, source string"),
    )


CASES = [
    ("資工", None, "known_unit_with_listing", "資工", "資訊工程學系", [], "s1"),
    (None, "資工系的公告", "known_unit_with_listing", "資工系的公告", "資訊工程學系", [], "s1"),
    ("教務", None, "known_unit_without_verified_site", "教務", "教務處", [], None),
    ("學務處", None, "ambiguous", "學務處", None, ["學務處"], None),
    ("圖書館", "公告", "known_unit_with_listing", "圖書館", "圖書館", [], "s5"),
    (None, "資工和教務", "ambiguous", "資工和教務", None, ["教務處", "資訊工程學系"], None),
    ("兩屬", None, "ambiguous", "兩屬", None, ["乙系", "甲系"], None),
    (None, "火星學系最新消息", "unknown", "火星學系", None, [], None),
    (None, "火星學系在哪裡", "none", "火星學系在哪裡", None, [], None),
    ("火星學系", "月球中心公告", "ambiguous", "火星學系", None, ["月球中心", "火星學系"], None),
    ("資工", "月球中心公告", "ambiguous", "資工", None, ["月球中心", "資訊工程學系"], None),
    ("哪裡", None, "unknown", "哪裡", None, [], None),
    (None, None, "none", "", None, [], None),
    (" ", " 校內獎學金 ", "known_unit_with_listing", "校內獎學金", "學務處", [], "s3"),
    (None, "獎學金", "known_unit_with_listing", "獎學金", "圖書館", [], "s5"),
    (None, "停用獎學金", "known_unit_without_verified_site", "停用獎學金", "教務處", [], None),
    (None, "獎學金和校內獎學金", "known_unit_with_listing", "獎學金和校內獎學金", "學務處", [], "s3"),
    (None, "獎學金與停用獎學金", "ambiguous", "獎學金與停用獎學金", None, ["s2", "s5"], None),
    ("資工", "獎學金", "ambiguous", "資工", None, ["圖書館", "資訊工程學系"], None),
    ("圖書館", "獎學金", "known_unit_with_listing", "圖書館", "圖書館", [], "s5"),
    (None, "新資工學院公告", "unknown", "新資工學院", None, [], None),
]


def test_resolution(spark):
    rows = spark.createDataFrame([(i, u, q) for i, (u, q, *_) in enumerate(CASES)], "id long, unit string, query string")
    got = {r.id: (r.status, r.requested, r.unit, r.candidates, r.source) for r in names.resolved(rows, "id", "unit", "query", directory(spark)).collect()}
    for i, (_, _, *want) in enumerate(CASES):
        assert got[i] == tuple(want), CASES[i]
    assert names.resolved(rows.limit(0), "id", "unit", "query", directory(spark)).collect() == []


def test_official_units_without_sources(spark):
    d = directory(spark)
    own = names.Directory(d.aliases.unionByName(spark.createDataFrame([(u, u) for u in ("總務處", "人事室", "主計室", "無名處")], "alias string, unit string")), d.sources, d.units, d.routes)
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(("總務處", "人事室", "主計室", "無名處"))], "id long, unit string").selectExpr("*", "cast(null as string) as query")
    got = {r.unit: r.status for r in names.resolved(rows, "id", "unit", "query", own).collect()}
    assert got == {"總務處": names.SCOPED, "人事室": names.UNVERIFIED, "主計室": names.UNVERIFIED, "無名處": names.UNVERIFIED}


def test_mentions_and_normal_forms(spark):
    table = spark.createDataFrame([("資管系", "資訊管理學系"), ("資管", "資訊管理"), ("系", "X")], "alias string, unit string")
    rows = spark.createDataFrame([(1, " 資管系和資管 "), (2, None), (3, ""), (4, "新資管學院")], "id long, t string")
    own = names.names_of(table)
    found = {r.id: [(m.start, m.end, m.alias) for m in r.mentions] for r in names.mentions(rows, "t", own).collect()}
    assert found == {1: [(1, 4, "資管系"), (5, 7, "資管")], 2: [], 3: [], 4: [(1, 3, "資管")]}
    assert {r.id: len(r.mentions) for r in names.mentions(rows, "t", own, unit_aware=True).collect()}[4] == 0
    assert {r.id: r.normal for r in names.normalized(rows, "t", table).collect()} == {1: "資訊管理學系和資訊管理", 2: None, 3: "", 4: "新資訊管理學院"}
    assert {r.id: r.normal for r in names.normalized(rows, "t", table, unit_aware=True).collect()}[4] == "新資管學院"


def test_a_registry_has_a_bound(spark):
    table = spark.range(30).selectExpr("concat('n', id) as alias")
    with pytest.raises(ValueError):
        names.names_of(table, most=10)
    assert names.Names([]).spans("x") == [] and names.names_of(table.limit(0)).names == []


def test_the_institution_may_stand_before_a_unit():
    known = ["資工系"]
    assert names.Names(known).told("某大學資工系") == [] and names.Names(known, ("某大學",)).told("某大學資工系") == [(3, 6, "資工系")]
