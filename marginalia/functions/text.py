"""Text expressions: Column to Column, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that are never keywords.
STOP_WORDS = tuple(
    (
        "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to "
        "of in for on with at by from as into through during before after above below between under and but or yet so if because although though "
        "while where when that which who whom whose what this these those i you he she it we they me him her us them my your his its our their "
        "这里 那里 这个 那个 什么 怎么 为什么 因为 所以 但是 如果 虽然 而且 或者 和 与 的 了 在 是 我 你 他 她 它 们 有 没有 一个 一种 一些 可以 需要 "
        "应该 能够 已经 现在 今天 明天 昨天 这样 那样 如何 谁 哪 哪些 哪里 什么时候 怎样 非常 很 太 最 更 比较 相当 真的 确实 当然 可能 也许 大概 一定 "
        "必须 得 地 着 过 把 被 让 给 向 从 到 对于 关于 由于 根据 按照 通过 随着 除了 包括 涉及 有关 学习 使用 实现 添加 创建 记录 一下"
    ).split()
)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tokens(text: Column) -> Column:
    """All CJK characters, then all words of up to 21 characters, then all runs of digits, of the lower-case text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.concat(_all(low, "[一-鿿]"), _all(low, "[a-z][a-z0-9_]{0,20}"), _all(low, r"(?U)\d+"))


def keyword_matches(text: Column) -> Column:
    """Candidates for keywords in order: runs of 2 to 10 CJK characters, or words of 2 to 16 characters, without stop words."""
    found = _all(F.lower(F.coalesce(text, F.lit(""))), "[一-鿿]{2,10}|[a-zA-Z][a-zA-Z0-9_]{1,15}")
    return F.filter(found, lambda w: ~w.isin(*STOP_WORDS))


def wiki_links(text: Column) -> Column:
    """Trimmed texts of ``[[...]]`` on one line, without empty ones."""
    return F.filter(F.transform(_all(F.coalesce(text, F.lit("")), r"(?d)\[\[(.*?)\]\]", 1), strip), lambda x: x != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def preview(text: Column, size: int, always: bool = False) -> Column:
    """The first characters, with an ellipsis when cut; ``always``: with an ellipsis unless empty."""
    text = F.coalesce(text, F.lit(""))
    cut = F.concat(F.substring(text, 1, size), F.lit("..."))
    return F.when(F.length(text) > (0 if always else size), cut).otherwise(text)


def default_title(content: Column) -> Column:
    return preview(content, 50)


def slug(title: Column) -> Column:
    """Lower case, spaces as hyphens, first 50 characters, then word characters and hyphens only."""
    return F.regexp_replace(F.substring(F.replace(F.lower(title), F.lit(" "), F.lit("-")), 1, 50), r"(?U)[^\w\-]", "")


def file_name(id_: Column, type_: Column, title: Column) -> Column:
    return F.when(type_ == "fleeting", F.concat(F.substring(id_, 1, 8), F.lit("-"), F.substring(id_, 9, 1000), F.lit(".md"))).otherwise(F.concat(id_, F.lit("-"), slug(title), F.lit(".md")))


def note_id(ts: Column, number: Column) -> Column:
    """Timestamp to the second and four digits."""
    return F.concat(F.date_format(ts, "yyyyMMddHHmmss"), F.lpad(number.cast("string"), 4, "0"))


def id_of_stem(stem: Column) -> Column:
    """Note id of a file name without extension, null if it has none."""
    return F.when(stem.rlike(r"^\d{8}-\d{10}$"), F.replace(stem, F.lit("-"), F.lit(""))).when(stem.rlike(r"(?s)^\d{18}(-.*)?$"), F.substring(stem, 1, 18))


def bm25_text(title: Column, content: Column) -> Column:
    return F.concat_ws(" ", title, content)


def vector_text(title: Column, content: Column) -> Column:
    return F.concat_ws("\n", title, content)


def match_text(title: Column, tags: Column, content: Column) -> Column:
    """What keywords are looked up in: title, tags and the first 500 characters, in lower case."""
    return F.lower(F.concat_ws(" ", title, F.array_join(F.coalesce(tags, F.array()), " "), F.substring(F.coalesce(content, F.lit("")), 1, 500)))


def has_all_tags(tags: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)).cast("array<string>"), F.coalesce(tags, F.array().cast("array<string>")))) == 0
