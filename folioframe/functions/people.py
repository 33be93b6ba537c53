"""Creator names: parsing, labels, Chinese person names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from folioframe.functions.text import clean_text, let, null_if_blank, text_or_empty, unfold_ligatures

# Common Chinese family names used when no dictionary is given.
COMMON_SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤逯"
)
COMMON_COMPOUND_SURNAMES = (
    "欧阳", "上官", "司马", "诸葛", "皇甫", "令狐", "宇文", "东方", "公孙", "慕容",
    "夏侯", "司徒", "尉迟", "长孙", "轩辕", "南宫", "独孤", "端木", "百里", "呼延",
)
# Words and signs that rule a person name out.
NOT_A_PERSON = (
    "方案|规划|建议|研究|论文|分析|历史|北京|城市|中国|问题|讨论|考察|设计|建筑|全集|报告|成果|关于|对于|有关"
)
NOT_IN_A_NAME = "[0-9A-Za-z《》“”、，。]"


@dataclass(frozen=True)
class Surnames:
    """One- and two-character family names. Pass your own to widen the defaults."""

    single: Sequence[str] = tuple(COMMON_SURNAMES)
    compound: Sequence[str] = COMMON_COMPOUND_SURNAMES

    @classmethod
    def read(cls, spark: SparkSession, path: str, limit: int = 20000) -> "Surnames":
        """Dictionary file, one name per line, `#` comments; refuses anything larger than a dictionary."""
        names = [r[0].strip() for r in spark.read.text(path).limit(limit + 1).collect()]
        if len(names) > limit:
            raise ValueError(f"{path} holds more than {limit} names")
        names = [n for n in names if n and not n.startswith("#")]
        return cls(
            tuple(n for n in names if len(n) == 1) or cls.single,
            tuple(n for n in names if len(n) == 2) or cls.compound,
        )


DEFAULT_SURNAMES = Surnames()


def creator(family: Column, given: Column, kind: Column | str = "author") -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(family.alias("family"), given.alias("given"), kind.alias("creator_type"))


def parse_name(c: Column, kind: str = "author") -> Column:
    """`Family, Given`, else the last word is the family name."""
    t = F.trim(c)
    words = F.split(t, r"\s+")
    comma = t.contains(",")
    family = F.when(comma, F.trim(F.substring_index(t, ",", 1))).otherwise(F.element_at(words, -1))
    given = F.when(comma, F.trim(F.regexp_replace(t, r"^[^,]*,", ""))).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    )
    return creator(family, given, kind)


def display_name(person: Column, family_first: bool = False) -> Column:
    family, given = null_if_blank(person["family"]), null_if_blank(person["given"])
    both = F.concat_ws(", ", family, given) if family_first else F.concat_ws(" ", given, family)
    return F.coalesce(F.when(family.isNotNull() & given.isNotNull(), both), family, given, F.lit(""))


def authors(creators: Column) -> Column:
    return F.filter(creators, lambda p: p["creator_type"].isin("author", "creator"))


def editors(creators: Column) -> Column:
    return F.filter(creators, lambda p: p["creator_type"] == "editor")


def family_names(creators: Column) -> Column:
    names = F.transform(creators, lambda p: F.coalesce(null_if_blank(p["family"]), null_if_blank(p["given"])))
    return F.filter(names, lambda n: n.isNotNull())


def first_creator(creators: Column, language: Column) -> Column:
    """`A`, `A and B` or `A et al.`; the Chinese forms when the language says so."""
    zh = F.lower(text_or_empty(language)).startswith("zh")

    def label(names: Column) -> Column:
        one, two, n = F.get(names, F.lit(0)), F.get(names, F.lit(1)), F.size(names)
        return (
            F.when(n <= 0, "")
            .when(n == 1, one)
            .when(n == 2, F.concat(one, F.when(zh, "和").otherwise(" and "), two))
            .otherwise(F.concat(one, F.when(zh, "等").otherwise(" et al.")))
        )

    chosen = let(authors(creators), lambda a: F.when(F.size(a) > 0, a).otherwise(creators))
    return F.coalesce(let(family_names(chosen), label), F.lit(""))


def bibtex_name(person: Column) -> Column:
    """`Family, Given` without dangling punctuation."""
    family, given = text_or_empty(person["family"]), text_or_empty(person["given"])
    return F.when(family != "", F.trim(F.concat(family, F.lit(", "), given), F.lit(", "))).otherwise(given)


def clean_author_line(c: Column) -> Column:
    """Foot-note marks and affiliation numbers taken out of an author line."""
    c = F.regexp_replace(unfold_ligatures(c), "[✉†‡§*]+", " ")
    c = F.regexp_replace(c, r"(?<=[^0-9])\s+\d+(?=\s|$)", " ")
    c = F.regexp_replace(c, r"(?<=[A-Za-z])\d+", "")
    c = F.regexp_replace(c, r",\s*\d+", " ")
    c = F.regexp_replace(c, r"(?<![\p{L}\p{N}_])\d+(?![\p{L}\p{N}_])", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "), F.lit(" ,;"))


def looks_like_person(c: Column, surnames: Surnames = DEFAULT_SURNAMES) -> Column:
    """Family name first, 2 to 6 characters, no title vocabulary; lists need every part to pass."""

    def one(p: Column) -> Column:
        return (
            F.length(p).between(2, 6)
            & ~p.rlike(NOT_A_PERSON)
            & ~p.rlike(NOT_IN_A_NAME)
            & (F.substring(p, 1, 2).isin(*surnames.compound) | F.substring(p, 1, 1).isin(*surnames.single))
        )

    parts = F.filter(F.transform(F.split(clean_text(c), "[、，]"), lambda x: F.trim(x)), lambda p: p != "")
    return F.coalesce(let(parts, lambda ps: (F.size(ps) > 0) & F.forall(ps, one)), F.lit(False))


def split_authors(c: Column, surnames: Surnames = DEFAULT_SURNAMES) -> Column:
    """Split at the enumeration signs; at blanks or 和 only if every piece is a person."""

    def people_only(token: Column, pattern: str) -> Column:
        subs = F.filter(F.transform(F.split(token, pattern), lambda x: F.trim(x)), lambda s: s != "")
        return let(subs, lambda ss: F.when((F.size(ss) >= 2) & F.forall(ss, lambda s: looks_like_person(s, surnames)), ss))

    def pieces(token: Column) -> Column:
        return F.coalesce(people_only(token, r"\s+"), people_only(token, "和"), F.array(token))

    tokens = F.filter(F.transform(F.split(c, "[、，]"), lambda x: F.trim(x)), lambda t: t != "")
    return F.flatten(F.transform(tokens, pieces))


def family_of(c: Column) -> Column:
    """Last ASCII word of a display name, lower case."""
    words = F.split(F.trim(F.regexp_replace(c, "[^A-Za-z]+", " ")), " ")
    return F.lower(F.element_at(words, -1))


def folded_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^A-Za-z0-9_\x{80}-\x{10FFFF}]+", "")
