"""Column functions over text: tokens, cleaning, token filters, sentences, features of words and queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed word lists of the token filters.
PRONOUNS = ["i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "我", "你", "他", "她", "它", "我们", "你们", "他们"]
PARTICLES = ["的", "地", "得", "了", "着", "过", "the", "a", "an"]
HTML_NAMES = ["div", "span", "p", "br", "li", "ul", "ol", "td", "tr", "table", "nbsp", "amp", "lt", "gt"]


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script; texts of plain ASCII take the faster pattern."""
    low = F.lower(text)
    plain = F.octet_length(low) == F.length(low)
    return F.when(plain, F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1))).otherwise(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def marked_tokens(text: Column, mark: str) -> Column:
    """The same tokens as one string, with a mark of one character that is in none of them between two."""
    low = F.lower(text)
    plain = F.octet_length(low) == F.length(low)
    runs = F.when(plain, F.regexp_replace(low, "[^a-z0-9]++", mark)).otherwise(F.regexp_replace(low, r"[^\p{L}\p{N}]++", mark))
    return F.btrim(runs, F.lit(mark))


def words(text: Column) -> Column:
    """Runs between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def keep_token(t: Column) -> Column:
    """The chain of token filters: punctuation, markdown, pronouns, HTML, particles, numbers and padding."""
    checks = [
        ~t.rlike(r"^[\p{Punct}　-〿＀-￯]+$"), ~t.rlike(r"^[#*`~>|=_-]+$"), ~F.lower(t).isin(PRONOUNS), ~t.rlike(r"<[^>]+>|&[a-z]+;") & ~F.lower(t).isin(HTML_NAMES),
        ~t.isin(PARTICLES), ~t.rlike(r"^[0-9.]+$") & (F.trim(t) == t) & (t != ""),
    ]
    return reduce(lambda a, b: a & b, checks)


def sentences(text: Column) -> Column:
    """Sentences after 。 ！ ？ ? !, then after semicolons, which stay; trimmed, blank ones left out."""
    parts = F.split(text, r"(?<=[。！？?!])\s*")
    return F.filter(F.transform(F.flatten(F.transform(parts, lambda p: F.split(p, r"(?<=;)"))), lambda s: _strip(s)), lambda s: ~s.isin("", ";"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def char_grams(text: Column, least: int = 1, most: int = 3) -> Column:
    """Runs of ``least`` to ``most`` characters of the lower-cased text."""
    low = F.lower(text)

    def runs(n: int) -> Column:
        at = F.sequence(F.lit(1), F.length(low) - (n - 1))
        return F.when(F.length(low) >= n, F.transform(at, lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[runs(n) for n in range(least, most + 1)]))


def clean_term(text: Column) -> Column:
    """Anything but letters, digits, white space and CJK goes; white space is squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def clean_heading(line: Column) -> Column:
    """A Markdown heading without hashes, emphasis and closing punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"^#+\s*", ""), r"[*_`]+|[:：]\s*$", ""))


def coherence(text: Column, least: int = 2) -> Column:
    """0 to 1: at least ``least`` sentences .3, 10 to 200 characters each on average .3, at most three empty lines .2, 5 to 30 % of full-width punctuation .2."""
    found = sentences(text)
    mean = F.aggregate(found, F.lit(0), lambda n, x: n + F.length(x)) / F.greatest(F.size(found), F.lit(1))
    breaks = F.size(F.split(text, "\n\n")) - 1
    ratio = F.length(F.regexp_replace(text, r"[^。！？，；：]", "")) / F.greatest(F.length(text), F.lit(1))
    tests = [(F.size(found) >= least, 0.3), (mean.between(10, 200), 0.3), (breaks <= 3, 0.2), (ratio.between(0.05, 0.3), 0.2)]
    return F.round(reduce(lambda x, y: x + y, [F.when(c, w).otherwise(0.0) for c, w in tests]), 6)


def dynamic_lambda(query: Column, base: float = 0.7) -> Column:
    """The diversity weight by query length: short ones lean to relevance, long ones to diversity."""
    n = F.length(F.trim(query))
    return F.when(n <= 17, F.least(F.lit(base + 0.3), F.lit(0.9))).when(n <= 30, F.lit(base)).otherwise(F.greatest(F.lit(base - 0.2), F.lit(0.3)))


# Fixed value: the punctuation that complexity counts.
PUNCTUATION = "，。！？；：\"\"''（）【】"


def simple_complexity(query: Column) -> Column:
    """Mean of length / 50 and words / 10, each at most 1; blank queries 0."""
    n = F.size(words(query))
    score = (F.least(F.length(query) / 50.0, F.lit(1.0)) + F.least(n / 10.0, F.lit(1.0))) / 2
    return F.when(n > 0, F.round(score, 6)).otherwise(0.0)


def complexity(query: Column, longest: float = 20.0, long_word: int = 4, marks: float = 10.0) -> Column:
    """A quarter each of length, variety, share of long words and punctuation; blank queries 0."""
    w = words(query)
    n = F.size(w)
    variety, long = F.size(F.array_distinct(w)) / n, F.size(F.filter(w, lambda x: F.length(x) > long_word)) / n
    dots = F.length(F.regexp_replace(query, f"[^{PUNCTUATION}]", ""))
    score = (F.least(n / longest, F.lit(1.0)) + variety + long + F.least(dots / marks, F.lit(1.0))) / 4
    return F.when(n > 0, F.round(score, 6)).otherwise(0.0)


def complexity_level(score: Column) -> Column:
    return F.when(score < 0.3, "simple").when(score < 0.7, "medium").otherwise("complex")


def shape(token: Column) -> Column:
    """X for capitals, x for small and CJK letters, d for digits; anything else stays."""
    out = token
    for pattern, mark in ((r"\p{Lu}", "\u0001"), (r"[\p{Ll}一-鿿]", "\u0002"), (r"\p{Nd}", "\u0003")):
        out = F.regexp_replace(out, pattern, mark)
    return F.translate(out, "\u0001\u0002\u0003", "Xxd")


def token_features(token: Column) -> dict[str, Column]:
    """Features of one token for sequence labelling: length, affixes, shape, kinds of characters."""
    n = F.length(token)
    return {
        "lower": F.lower(token),
        "length": n,
        "prefix": F.substring(token, 1, 2),
        "suffix": F.regexp_extract(token, r"(?s)(.{1,2})$", 1),
        "shape": shape(token),
        "is_digit": token.rlike(r"^\p{Nd}+$"),
        "is_alpha": token.rlike(r"^\p{L}+$"),
        "has_number": token.rlike(r"\d"),
        "has_cjk": token.rlike(r"[一-鿿]"),
        "has_latin": token.rlike(r"[a-zA-Z]"),
        "has_punctuation": token.rlike(r"[^\p{L}\p{N}_\s]"),
    }


# Ordered (name, words in the heading) of content types; the first that fits counts.
CONTENT_TYPES = [
    ("army_rule", ["军队规则", "army rule", "战斗专注", "殊途同归"]),
    ("detachment_rule", ["分队规则", "detachment", "军阵", "host"]),
    ("unit", ["单位数据", "unit", "人物", "character", "步兵", "infantry", "载具", "vehicle"]),
    ("corerule", ["核心规则", "core rule", "游戏规则", "game rule"]),
]
# Profile marks that make a deep section a unit's.
PROFILE_MARKS = ["M ", "T ", "SV ", "W ", "LD ", "OC "]


def _any(text: Column, words_: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words_])


def content_type(heading: Column, level: Column, text: Column) -> Column:
    """The kind of a section by its heading, then by profile marks in a section of level 3 or more; else corerule."""
    h, out = F.lower(heading), F.when((level >= 3) & _any(F.upper(text), PROFILE_MARKS) & (F.coalesce(heading, F.lit("")) != ""), "unit").otherwise("corerule")
    for name, keys in reversed(CONTENT_TYPES):
        out = F.when(_any(h, keys), name).otherwise(out)
    return out


# Ordered (category, part of the content type, word in the heading) of terms.
TERM_CATEGORIES = [("units", "unit", "单位"), ("skills", "skill", "技能"), ("weapons", "weapon", "武器"), ("factions", "faction", "派系"), ("mechanics", "mechanic", "机制")]


def term_category(kind: Column, heading: Column) -> Column:
    out = F.lit("general")
    for name, part, word in reversed(TERM_CATEGORIES):
        out = F.when(F.lower(kind).contains(part) | F.lower(heading).contains(word), name).otherwise(out)
    return out


def cjk_part(text: Column) -> Column:
    """CJK letters, brackets, middle dots and single spaces of a text, joined."""
    kept = F.array_join(F.regexp_extract_all(text, F.lit(r"([一-鿿\s()（）·]+)"), F.lit(1)), "")
    return F.coalesce(_strip(F.regexp_replace(kept, r"\s+", " ")), F.lit(""))


def name_and_synonyms(text: Column) -> tuple[Column, Column]:
    """``name (a, b) rest``: the name and the comma-separated synonyms in its first brackets; without brackets all is name."""
    t, bracket = _strip(text), r"^([^(（]+)[(（]([^)）]*)[)）]"
    inside = F.filter(F.transform(F.split(F.regexp_extract(t, bracket, 2), ","), _strip), lambda x: x != "")
    return F.when(t.rlike(bracket), _strip(F.regexp_extract(t, bracket, 1))).otherwise(t), F.when(t.rlike(bracket), inside).otherwise(F.array().cast("array<string>"))


def term_shapes(text: Column) -> Column:
    """Distinct likely terms: capitalised words, letters with a number, X之Y, and runs of four letters or more."""
    shapes = [r"([A-Z][a-zA-Z一-鿿]+)", r"([A-Za-z一-鿿]+\d+)", r"([A-Za-z一-鿿]+之[A-Za-z一-鿿]+)", r"([A-Za-z一-鿿]{4,})"]
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(x), F.lit(1)) for x in shapes])))


# The letters that may stand alone in a vocabulary's evaluation.
SINGLE_LETTERS = "战术规则军队单位模型分队技能"


def keep_word(t: Column) -> Column:
    """A word counts in a vocabulary's evaluation unless it is a pronoun, a particle, punctuation, blank, a lone letter but a listed one, hashes or a tag."""
    lone = (F.length(t) == 1) & ~t.isin(*SINGLE_LETTERS)
    return ~(t.isin(PRONOUNS) | t.isin(PARTICLES) | t.rlike(r"^[\p{Punct}　-〿＀-￯]$") | t.rlike(r"^\s*$") | lone | t.rlike("^#+$") | t.rlike("^<.*>$"))


def chunk_label_v3(document: str, kind: Column, heads: list[Column]) -> Column:
    """The older label of a chunk: the document, its kind's name, and the first heading, or the first three of a unit."""
    # The kinds' names.
    names = F.when(kind == "army_rule", "军队规则").when(kind == "detachment_rule", "分队规则").when(kind == "unit", "单位数据").otherwise("核心规则")
    first = F.coalesce(heads[0], F.lit(""))
    three = F.array_join(F.filter(F.array(*[F.coalesce(h, F.lit("")) for h in heads[:3]]), lambda h: h != ""), "-")
    return F.concat(F.lit(document), names, F.lit("-"), F.when(kind == "unit", three).otherwise(first))
