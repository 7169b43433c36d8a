"""Destination scope of texts, anchors of phases, and predicates of places.

Rules are data: a region has a name, aliases and the keywords that it allows.
Everything is a column expression over the row's own scope, so texts of many
trips are checked in one pass without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Region:
    name: str
    aliases: tuple[str, ...]
    allows: tuple[str, ...]

    @property
    def names(self) -> tuple[str, ...]:
        return (self.name, *self.aliases)


#: Some regions and provinces; a caller passes the full list of its own.
REGIONS = [
    Region("西南", ("西南", "西南地区", "云贵川", "云贵川渝", "云贵川渝藏", "川滇藏", "滇藏"), ("西南", "云南", "贵州", "四川", "重庆", "西藏", "滇", "黔", "川", "渝", "藏", "昆明", "丽江", "大理", "滇西北", "香格里拉", "迪庆", "德钦", "梅里", "泸沽湖", "成都", "阿坝", "甘孜", "稻城", "亚丁", "康定", "四姑娘山", "贵阳", "遵义", "黔东南", "荔波", "黄果树", "拉萨", "林芝", "鲁朗", "巴松措", "南迦巴瓦", "雅鲁藏布")),
    Region("华北", ("华北", "京津冀"), ("华北", "北京", "天津", "河北", "石家庄", "保定", "承德", "秦皇岛", "张家口", "山西", "太原", "大同", "内蒙古", "呼和浩特")),
    Region("华东", ("华东", "江浙沪", "长三角"), ("华东", "上海", "江苏", "南京", "苏州", "无锡", "浙江", "杭州", "宁波", "安徽", "合肥", "黄山", "福建", "福州", "厦门", "江西", "南昌", "山东", "济南", "青岛")),
]
PROVINCES = [
    Region("云南", ("云南", "滇"), ("云南", "滇", "昆明", "丽江", "大理", "香格里拉", "迪庆", "德钦", "梅里", "泸沽湖", "西双版纳", "腾冲")),
    Region("北京", ("北京",), ("北京",)),
    Region("天津", ("天津",), ("天津",)),
    Region("上海", ("上海",), ("上海",)),
]
#: Scopes without a bound.
ANYWHERE = ["全国", "全中国", "国内", "中国大陆", "不限区域"]
#: A keyword that another contains, though it means another place.
INSIDE = {"西北": "滇西北"}
#: How a text names the start city as a place to leave, pass or reach; {} is the city.
TRANSFER = ["{}出发", "{}出发地", "从{}", "由{}", "{}启程", "{}起点", "起点{}", "出发地{}", "{}集结", "{}集合", "{}转场", "{}中转", "{}接驳", "{}交通", "{}至", "{}到", "{}-", "{}—", "抵达{}", "到达{}", "经{}", "途经{}", "至{}", "到{}", "-{}", "—{}", "返程{}", "返回{}", "回到{}", "离开{}"]
#: How a text names it as a place to visit.
VISIT = ["{}景点", "{}市区", "{}老城", "{}城区", "{}文化", "{}体验", "{}游览", "{}深度", "{}停留", "{}核心", "{}自然风光", "在{}玩", "在{}游"]
#: Words of visiting, of moving, and of logistics.
SIGHTS = ["旅游", "景点", "景区", "市区", "老城", "城区", "文化体验", "自然风光", "深度游", "游览", "核心体验"]
MOVES = ["至", "到", "-", "—", "交通", "衔接", "过渡", "转场", "中转", "接驳"]
LOGISTICS = ["出发", "启程", "起点", "出发地", "集结", "集合", "转场", "中转", "接驳", "交通", "衔接", "过渡", "抵达", "到达", "途经", "返程", "返回", "回到", "离开"]
TOURISM = ["旅游", "旅行", *SIGHTS[1:]]
#: Kinds of places that are no sights, and what makes a name administrative or natural.
LOGISTICS_KINDS = ["住宿", "酒店", "餐饮", "餐厅", "美食", "交通", "停车", "服务区"]
ADMINISTRATIVE = ["市政府", "政府", "政务", "派出所", "公安", "银行", "营业厅", "购物中心", "酒店", "宾馆", "餐厅", "饭店", "广场"]
NATURAL = ["景区", "风景", "公园", "峡谷", "雪山", "湖", "海", "林海", "观景", "草原", "湿地"]


def has_any(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether a text contains one of the words; false for null."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return F.coalesce(out, F.lit(False))


def _texts(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _related(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


@dataclass(frozen=True)
class Scope:
    """The check of texts against the destination scope of their trip.

    scope, intent and start are text columns: all that was said of the trip,
    what names its destination, and the start city; must is an array of
    places to visit.  Nulls count as empty.
    """

    scope: Column
    intent: Column
    start: Column
    must: Column | None = None
    regions: tuple[Region, ...] = tuple(REGIONS)
    provinces: tuple[Region, ...] = tuple(PROVINCES)

    def _rules(self) -> list[Region]:
        return [*self.regions, *self.provinces]

    def known(self) -> list[str]:
        """All keywords of the rules, the longest first, of equal length by place."""
        return sorted(dict.fromkeys(w for r in self._rules() for w in (*r.names, *r.allows) if w), key=len, reverse=True)

    def allowed(self) -> Column:
        """The keywords that the scope allows (F16): those of its regions and the places to visit, without the start city's family unless the intent names it; empty when there is no bound."""
        start, none = F.coalesce(self.start, F.lit("")), _texts([])
        by_rule = [F.when(has_any(self.scope, r.names), _texts(r.allows)).otherwise(none) for r in self._rules()]
        named = F.array_distinct(F.filter(F.transform(F.concat(*by_rule, *([self.must] if self.must is not None else [])), F.trim), lambda v: v != ""))
        meant = F.contains(F.coalesce(self.intent, F.lit("")), start)
        for r in self._rules():
            meant = meant | (has_any(self.intent, r.names) & F.exists(_texts(r.allows), lambda a: _related(a, start)))
        kept = F.when((start != "") & ~meant, F.filter(named, lambda v: ~_related(v, start))).otherwise(named)
        return F.when(has_any(self.scope, ANYWHERE), none).otherwise(kept)

    def violation(self, text: Column, allow_start: bool) -> Column:
        """The first known keyword in a text, the longest first, that the scope doesn't allow (F14); null for none.

        With ``allow_start`` the start city, and its province in a text about
        moving, may be named as a place to leave, pass or reach, but not as one
        to visit (F15).
        """
        text, start, allowed = F.trim(F.coalesce(text, F.lit(""))), F.coalesce(self.start, F.lit("")), self.allowed()
        ok = lambda k: F.exists(allowed, lambda a: _related(a, k))
        form = lambda p: F.contains(text, F.concat(F.lit(p.split("{}")[0]), start, F.lit(p.split("{}")[1])))
        any_form = lambda ps: _any([form(p) for p in ps])
        transfer = (start != "") & F.contains(text, start) & any_form(TRANSFER)
        visited = (has_any(text, SIGHTS) & ~has_any(text, MOVES)) | any_form(VISIT)
        moving = has_any(text, LOGISTICS) & ~has_any(text, TOURISM)
        family = lambda k: _any([F.array_contains(_texts([*r.names, *r.allows]), start) & (F.array_contains(_texts(r.names), k) | (k == start)) for r in self.provinces])
        leave = lambda k: F.when(k == start, ~visited).otherwise(family(k) & moving) if allow_start else F.lit(False)
        inside = lambda k: _any([(k == F.lit(a)) & F.contains(text, F.lit(b)) & ok(F.lit(b)) for a, b in INSIDE.items()])
        bad = F.filter(_texts(self.known()), lambda k: F.contains(text, k) & ~inside(k) & ~(transfer & leave(k)) & ~ok(k))
        return F.when((F.size(allowed) > 0) & (text != ""), F.try_element_at(bad, F.lit(1)))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def scope_review(n_violations: Column) -> tuple[Column, Column]:
    """(score, passed) of a trip with so many violations."""
    return F.when(n_violations == 0, 95).otherwise(30), n_violations == 0


def is_logistics_kind(kind: Column) -> Column:
    return has_any(kind, LOGISTICS_KINDS)


def is_administrative(text: Column) -> Column:
    """Whether name, type and address tell an office or shop and nothing of nature."""
    return has_any(text, ADMINISTRATIVE) & ~has_any(text, NATURAL)


@dataclass(frozen=True)
class Anchor:
    """A place that a trip should reach; ``aliases`` also stand for its destination."""

    name: str
    destination: str = ""
    aliases: tuple[str, ...] = ()
    kind: str = "sight"
    priority: int = 0

    @property
    def spellings(self) -> list[str]:
        """The name, also without an ending that texts leave out."""
        return [self.name, *(self.name.removesuffix(e) for e in ("峰", "国家公园") if self.name.endswith(e) and self.name != e)]

    def covered(self, text: Column) -> Column:
        """Whether a text reaches it (J22); a destination also by its own name."""
        return has_any(text, self.spellings) | (has_any(text, [self.destination]) if self.kind == "destination" and self.destination else F.lit(False))


def phase_anchors(text: Column, anchors: list[Anchor], allow_all: bool = True) -> Column:
    """Names of the anchors of a phase's text, by destination, alias or name (J21), the highest priority first, of equal ones by place; all of them if none fits and ``allow_all``."""
    own = sorted((a for a in anchors if a.kind != "destination"), key=lambda a: -a.priority)
    fits = [F.when(has_any(text, [*([a.destination] if a.destination else []), *a.aliases, a.name]), F.lit(a.name)) for a in own]
    found = F.array_distinct(F.filter(F.array(*fits), lambda x: x.isNotNull())) if own else _texts([])
    return F.when(F.size(found) == 0, F.array_distinct(_texts([a.name for a in own]))).otherwise(found) if allow_all else found
