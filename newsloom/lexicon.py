"""Terms that the extraction and the question expansion look for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: The default lexicon, in declared order.
INSTITUTIONS = ["中国证监会", "证监会", "中国人民银行", "央行", "国家金融监督管理总局", "金融监管总局", "上海证券交易所", "深圳证券交易所", "上交所", "深交所"]
ALIASES = {"证监会": "中国证监会", "央行": "中国人民银行", "金融监管总局": "国家金融监督管理总局", "上交所": "上海证券交易所", "深交所": "深圳证券交易所"}
INDUSTRIES = ["人工智能", "半导体", "新能源汽车", "新能源", "房地产", "银行业", "证券业", "保险业", "医药", "消费电子", "资本市场"]
EVENTS = ["财报", "并购", "融资", "上市", "处罚", "合作", "投资", "增持", "减持", "回购", "分红", "改革", "监管"]
RULES = [("属于", "属于"), ("任职", "任职于"), ("发布", "发布"), ("投资", "投资"), ("合作", "合作"), ("收购", "收购"), ("并购", "并购"), ("影响", "影响"), ("推动", "推动"), ("促进", "促进"), ("导致", "导致"), ("监管", "监管")]
POLICY_WORDS = ["意见", "办法", "规定", "规划", "通知"]
DEFAULT_RELATION = "关联"
SOURCE_RELATION = "来源于"
MOST_TERMS = 200_000  # a lexicon is a parameter that every task holds


@dataclass(frozen=True)
class Lexicon:
    """Each list in order of trial."""

    institutions: tuple[tuple[str, str], ...]  # surface, canonical
    aliases: tuple[tuple[str, str], ...]
    industries: tuple[str, ...]
    events: tuple[str, ...]
    rules: tuple[tuple[str, str], ...]  # marker, label
    policy_words: tuple[str, ...] = tuple(POLICY_WORDS)

    @classmethod
    def default(cls) -> Lexicon:
        return cls(_longest([(n, ALIASES.get(n, n)) for n in INSTITUTIONS]), tuple(ALIASES.items()), tuple(sorted(INDUSTRIES, key=len, reverse=True)), tuple(EVENTS), tuple(RULES))

    @classmethod
    def from_table(cls, table: DataFrame) -> Lexicon:
        """From rows (term, kind, entity_type, canonical, ord); a parameter table that every task holds, of at most ``MOST_TERMS`` rows."""
        rows = table.where("term is not null").limit(MOST_TERMS + 1).collect()
        if len(rows) > MOST_TERMS:
            raise ValueError(f"a lexicon has at most {MOST_TERMS} terms")
        by: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: (r.ord if r.ord is not None else 1 << 30, r.term)):
            by.setdefault(r.kind, []).append(r)
        named = [(r.term, r.canonical or r.term) for kind in ("institution", "alias") for r in by.get(kind, [])]
        return cls(
            _longest(named),
            tuple((r.term, r.canonical or r.term) for r in by.get("alias", [])),
            tuple(sorted((r.term for r in by.get("industry", [])), key=len, reverse=True)),
            tuple(r.term for r in by.get("event", [])),
            tuple((r.term, r.canonical or r.term) for r in by.get("rule", [])),
        )


def _longest(pairs: list[tuple[str, str]]) -> tuple[tuple[str, str], ...]:
    return tuple(sorted(pairs, key=lambda p: len(p[0]), reverse=True))


def default_table(spark: SparkSession) -> DataFrame:
    rows = [(n, "institution", "机构", n) for n in INSTITUTIONS if n not in ALIASES]
    rows += [(a, "alias", "机构", c) for a, c in ALIASES.items()]
    rows += [(n, "industry", "行业", n) for n in INDUSTRIES] + [(n, "event", "事件", n) for n in EVENTS] + [(m, "rule", None, label) for m, label in RULES]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "term string, kind string, entity_type string, canonical string, ord int")
