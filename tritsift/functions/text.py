"""Text normalization as column expressions. Null text gives null or an empty list, as Spark's built-ins do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic, in alphabetical order.
STOP_WORDS = tuple(sorted({
    "a", "an", "the", "this", "that", "it", "its", "in", "on", "at", "of", "to", "for", "from", "with", "by", "as", "into", "about", "through", "during",
    "and", "or", "but", "not", "no", "so", "if", "then", "than", "is", "are", "was", "were", "be", "been", "being",
    "do", "does", "did", "have", "has", "had", "can", "could", "may", "might", "must", "shall", "should", "will", "would",
}))
ACRONYMS = {
    "url": "uniform resource locator", "api": "application programming interface", "ux": "user experience", "ui": "user interface", "cpu": "central processing unit",
    "gpu": "graphics processing unit", "rag": "retrieval augmented generation", "nlp": "natural language processing", "ner": "named entity recognition",
    "ml": "machine learning", "srl": "semantic role labeling", "llm": "large language model", "lm": "language model", "kb": "knowledge base",
    "iot": "internet of things", "io": "input output", "db": "database", "os": "operating system", "sql": "structured query language", "ai": "artificial intelligence",
}
SPACES = "[ \t\r\n]+"


def raw_tokens(text: Column) -> Column:
    """Lower-cased tokens, an underscore parting words too."""
    return F.filter(F.split(F.lower(F.translate(text, "_", " ")), SPACES), lambda t: t != "")


def content_tokens(text: Column) -> Column:
    """raw_tokens of more than one letter that aren't stop words."""
    return F.filter(raw_tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def alnum_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1))


def distinct_tokens(*texts: Column) -> Column:
    """Content tokens of several fields, each at its first place."""
    return F.array_distinct(F.concat(*(F.coalesce(content_tokens(t), F.array().cast("array<string>")) for t in texts)))


def possessive_base(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, "^(.+)'s$", "$1"), "^(.+)s'$", "$1s")


def _acronyms() -> Column:
    return F.create_map(*(x for a, full in sorted(ACRONYMS.items()) for x in (F.lit(a), F.array(*map(F.lit, full.split())))))


def canonical(tokens: Column, possessive: bool = True, acronym: bool = True) -> Column:
    """Content tokens with possessives reduced and acronyms spelled out, each at its first place."""
    out = F.transform(tokens, possessive_base) if possessive else tokens
    if acronym:
        table = _acronyms()
        out = F.flatten(F.transform(out, lambda t: F.coalesce(F.try_element_at(table, t), F.array(t))))
    return F.array_distinct(out)


def possessive_forms(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: possessive_base(t) != t)


def acronym_forms(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, possessive_base), lambda t: t.isin(*ACRONYMS))


def query_variants(text: Column) -> Column:
    """array<struct<axes, tokens>>: the canonical tokens, and for each axis that alters them, and for both, those without it. Four at most."""
    tokens = content_tokens(text)
    poss, acro = F.size(possessive_forms(tokens)) > 0, F.size(acronym_forms(tokens)) > 0
    form = lambda name, p, a: F.struct(F.lit(name).alias("axes"), canonical(tokens, p, a).alias("tokens"))
    every = F.array(form("", True, True), F.when(poss, form("possessive", False, True)), F.when(acro, form("acronym", True, False)), F.when(poss & acro, form("possessive,acronym", False, False)))
    return F.array_compact(every)


def slug(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), "_")


def trim_filler(slug_: Column) -> Column:
    """A slug without the weak words at its end, of which one word always stays."""
    return F.regexp_replace(slug_, "(_(at|and|by|for|home|in|of|on|people|persons|to|with))+$", "")


_WH = ("how", "what", "when", "where", "which", "who", "whom", "whose", "why")


def has_wh(slug_: Column) -> Column:
    return F.arrays_overlap(F.split(slug_, "_"), F.array(*map(F.lit, _WH)))


def atomize(text: Column) -> Column:
    """One atom: white space collapsed, lower case, underscores kept."""
    return F.lower(F.trim(F.regexp_replace(text, SPACES, " ")))


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^\\x00-\\x7F]", "")


def code_token(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), " /.", "___")


def index_text(text: Column, *parts: Column) -> Column:
    """The text where it isn't empty, else the parts that aren't null, joined."""
    return F.coalesce(F.nullif(text, F.lit("")), F.concat_ws(" ", *parts))


def sentences(text: Column) -> Column:
    """Parts of a text after . ! or ? and before a capital or digit, without the signs at their ends."""
    parts = F.split(text, "(?<=[.!?])[ \t\r\n]+(?=[A-Z0-9])")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, "(^[ .,;\t\r\n]+)|([ .,;\t\r\n]+$)", "")), lambda s: s != "")


#: Suffix and what takes its place, in the order in which they are tried.
SUFFIXES = tuple(rule.split(">") for rule in "ies>y ves>f ing> tion>t sion>s ment> ness> able> ible> ated>at ized>iz ised>is ally> ous> ful> ive> ery> ed> er> ly> es> s>".split(" "))


def stem(token: Column) -> Column:
    """The first suffix rule that fits and leaves three letters or more; tokens of up to four letters stay."""
    out = F.when(F.length(token) <= 4, token)
    for suffix, to in SUFFIXES:
        left = F.length(token) - len(suffix)
        out = out.when(token.endswith(suffix) & (left + len(to) >= 3), F.concat(F.left(token, left), F.lit(to)))
    return out.otherwise(token)


def role_tokens(subject: Column, relation: Column, obj: Column, text: Column) -> Column:
    """struct<s, r, o, partial>: content tokens of the three roles, and the letters of those that have any. The text fills o only if the object is null or empty."""
    tokens = lambda c: F.coalesce(content_tokens(c), F.array().cast("array<string>"))
    roles = {"s": tokens(subject), "r": tokens(relation), "o": tokens(F.coalesce(F.nullif(obj, F.lit("")), text))}
    partial = F.array_compact(F.array(*(F.when(F.size(c) > 0, n) for n, c in roles.items())))
    return F.struct(*(c.alias(n) for n, c in roles.items()), partial.alias("partial"))


def bucket(text: Column, n: int) -> Column:
    """Content hash modulo n, the same in any engine that has md5."""
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def iso_to_millis(text: Column) -> Column:
    """Epoch milliseconds of an ISO-8601 text, 0 if empty or null; without a zone it is UTC."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))), F.lit(0))


def millis_to_iso(millis: Column) -> Column:
    """The reverse; 0 and null give the empty text."""
    return F.when(F.coalesce(millis, F.lit(0)) == 0, F.lit("")).otherwise(F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS"))
