"""Destination scope, anchors and predicates of places: exact cases."""

import pytest
from pyspark.sql import functions as F

from wayfold.operators import geo

#: scope, destination intent, start city, places to visit; texts that leave it and texts that don't, each with the start city exempt or not
CASES = [
    ("西南地区 丽江出发，在西南地区一个月", "西南地区", "丽江", [], [("天津城市探索", True), ("北京文化体验", True)], [("丽江滇西北自然风光", True), ("香格里拉梅里雪山", True), ("林芝南迦巴瓦", True)]),
    ("西南地区 北京出发，西南地区一个月", "西南地区", "北京", [], [("北京出发城市景点", True), ("北京文化体验", True), ("北京景点", False), ("天津顺路游", True)], [("北京出发至成都", True)]),
    ("香格里拉 香格里拉 昆明出发，香格里拉雪山7日自驾", "香格里拉 香格里拉", "昆明", ["香格里拉"], [("昆明 昆明出发去云南旅游", True)], [("昆明 昆明出发与滇中过渡", True)]),
    ("上海 从南昌，玩7天，目的地上海", "上海", "南昌", [], [("南昌历史文化探索", True)], [("南昌-上海 南昌至上海交通衔接", True), ("上海-南昌 返程准备与离开", True)]),
    ("全国自驾", "全国", "北京", [], [], [("天津顺路游", True)]),
    (None, None, None, None, [], [("天津", True), (None, True), ("", False)]),
]


@pytest.mark.parametrize("case", CASES, ids=[str(c[2]) + str(i) for i, c in enumerate(CASES)])
def test_scope(spark, case):
    scope, intent, start, must, out, kept = case
    rows = [(scope, intent, start, must, t, a) for t, a in out + kept]
    df = spark.createDataFrame(rows, "scope string, intent string, start string, must array<string>, t string, a boolean")
    s = geo.Scope(F.col("scope"), F.col("intent"), F.col("start"), F.coalesce("must", F.array().cast("array<string>")))
    got = {(r.t, r.a): r.v for r in df.select("t", "a", F.when(F.col("a"), s.violation(F.col("t"), True)).otherwise(s.violation(F.col("t"), False)).alias("v")).collect()}
    assert {k for k, v in got.items() if v is not None} == set(out)


def test_anchors(spark):
    a = [geo.Anchor("玉峰", "雪山", ("雪线",), priority=1), geo.Anchor("湖", "水乡", priority=5), geo.Anchor("雪山", "雪山", kind="destination")]
    rows = {"去雪线": ["玉峰"], "水乡与玉峰": ["湖", "玉峰"], "别处": ["湖", "玉峰"], None: ["湖", "玉峰"]}
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert {r.t: r.a for r in df.select("t", geo.phase_anchors(F.col("t"), a).alias("a")).collect()} == rows
    assert [r.a for r in df.where("t = '别处'").select(geo.phase_anchors(F.col("t"), a, False).alias("a")).collect()] == [[]]
    cover = spark.createDataFrame([("玉色的玉",), ("雪山",), ("上玉峰",)], "t string").select("t", *[x.covered(F.col("t")).alias(x.name) for x in a])
    assert [tuple(r)[1:] for r in cover.collect()] == [(True, False, False), (False, False, True), (True, False, False)]


def test_places(spark):
    df = spark.createDataFrame([("市政府广场",), ("湖边广场",), ("雪山",), (None,)], "t string")
    assert [r.x for r in df.select(geo.is_administrative(F.col("t")).alias("x")).collect()] == [True, False, False, False]
    assert [r.x for r in df.select(geo.is_logistics_kind(F.concat("t", F.lit("停车场"))).alias("x")).collect()] == [True, True, True, False]
