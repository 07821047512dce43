"""Text functions as columns. Sizes are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without weight in retrieval.
STOP_WORDS = tuple(
    sorted(
        "a all also an and are as at be been both but by can could did do does each every few for from had "
        "has have here how in is it its just may might more most must no nor not now of on only or other own "
        "same shall should so some such than that the their them there these they this those to too very was "
        "were what when where which who whom why will with would".split()
    )
)
#: Characters a token has on average, by tokenizer.
CHARS_PER_TOKEN = {"cl100k": 3.8, "p50k": 4.0, "simple": 4.0}
#: White space of any kind: by character, and as a class of patterns.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPACE = "[\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def trimmed(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(SPACES))


def tokenize(text: Column, min_length: int = 3, stop_words: bool = True) -> Column:
    """Lower-cased runs of letters, marks and digits, of at least min_length, without stop words."""
    words = F.split(F.lower(text), "[^\\p{L}\\p{M}\\p{N}]+")
    kept = lambda w: F.length(w) >= max(1, min_length)
    return F.filter(words, (lambda w: kept(w) & ~w.isin(*STOP_WORDS)) if stop_words else kept)


def term_frequency(term: Column, tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


def normalize_score(score: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (score - low) / F.nullif(high - low, F.lit(0.0))).otherwise(F.lit(0.0))


def normalize_whitespace(text: Column) -> Column:
    """Runs of white space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def clean_for_embedding(text: Column) -> Column:
    """Without control characters; tab and line breaks become spaces."""
    return normalize_whitespace(F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", ""))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+?)(\\.[^./]*)?$", 1)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""))


def token_count(text: Column, model: str = "simple") -> Column:
    """Estimated tokens: at least 1 for any text, 0 for none."""
    n = F.length(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / F.lit(CHARS_PER_TOKEN[model])).cast("int"))).cast("int")


def estimate_characters(tokens: Column, model: str = "simple") -> Column:
    return F.when(tokens <= 0, 0).otherwise(F.floor(tokens * F.lit(CHARS_PER_TOKEN[model])).cast("int")).cast("int")


def fits(text: Column, max_tokens: int, model: str = "simple") -> Column:
    return token_count(text, model) <= max_tokens


def count_details(text: Column, model: str = "simple") -> Column:
    """Struct of token_count, character_count, model and effective_ratio, 0 without tokens."""
    n, tokens = F.length(text), token_count(text, model)
    ratio = F.when(tokens > 0, n / F.nullif(tokens, F.lit(0))).otherwise(F.lit(0.0))
    return F.struct(tokens.alias("token_count"), n.alias("character_count"), F.lit(model).alias("model"), ratio.alias("effective_ratio"))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, trimmed, without empty ones."""
    lines = F.regexp_replace(text, "\\r\\n?", "\n")
    return F.filter(F.transform(F.split(lines, "\\n\\s*\\n+"), trimmed), lambda p: p != "")


def split_regex(text: Column, pattern: str) -> Column:
    """Trimmed non-empty parts between matches; the whole text if nothing matches."""
    return F.filter(F.transform(F.split(trimmed(text), pattern), lambda p: F.trim(p)), lambda p: p != "")


def preview(text: Column, n: int = 500) -> Column:
    return F.concat(F.left(text, F.lit(n)), F.when(F.length(text) > n, "...").otherwise(""))


def sanitize_query(text: Column, n: int = 1000) -> Column:
    return F.left(F.trim(F.regexp_replace(text, "\\p{Cntrl}", "")), F.lit(n))


def listed_lines(text: Column) -> Column:
    """Lines without numbering and bullets, without empty ones."""
    plain = lambda line: F.trim(F.regexp_replace(F.regexp_replace(F.trim(line), "^\\d+\\.\\s*", ""), "^[-*]\\s*", ""))
    return F.filter(F.transform(F.split(text, "\\n"), plain), lambda line: line != "")


def fill_template(template: str, **values: Column) -> Column:
    """template with each {name} replaced; all names must be there."""
    if missing := [k for k in values if "{" + k + "}" not in template]:
        raise ValueError(f"the template lacks {missing}")
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)
