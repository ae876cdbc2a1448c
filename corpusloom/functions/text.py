"""Text expressions: tokens, normal forms, n-grams, keys, patterns. Built-in expressions unless named *_exact."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: letters, marks and digits make words; each punctuation mark or symbol is a token of its own
TOKEN = r"[\p{L}\p{M}\p{N}]+|[\p{P}\p{S}]"
#: Vietnamese letters and their bases, built from Unicode's decompositions.
_MARKED = "".join(chr(c) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(unicodedata.normalize("NFD", chr(c))) > 1 and unicodedata.normalize("NFD", chr(c))[0].isascii())
_BASE = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)


def tokens(text: Column) -> Column:
    """Tokens of a text as it stands; an empty array for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def terms(text: Column) -> Column:
    """Tokens of the lower-cased text."""
    return tokens(F.lower(text))


def unique_terms(text: Column) -> Column:
    """Distinct terms in UTF-8 order."""
    return F.array_sort(F.array_distinct(terms(text)))


def collapsed(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def split_normalized(text: Column) -> Column:
    """Lower case with every punctuation mark as a space, then collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{P}", " "), r"(?U)\s+", " "))


def character_ngrams(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams; a shorter text is its own gram, an empty one has none."""
    grams = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)))  # one pass; a substring at each place would be quadratic
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) < n, F.array(text)).otherwise(grams)


def folded(text: Column) -> Column:
    """Lower case without diacritics, d for the barred letter, hyphens and white space as single spaces."""
    plain = F.translate(F.translate(F.lower(text), _MARKED, _BASE), "đ-", "d ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def document_number_key(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.translate(F.lower(text), _MARKED, _BASE), "đ", "d")


def law_identity_key(name: Column) -> Column:
    """`luat <title> <year>` of a law's name, null where the name has none."""
    plain = F.trim(F.regexp_replace(folded(name), "[^0-9a-z]+", " "))
    found = F.regexp_extract(plain, r"^((?:bo luat|luat) .+? (?:19|20)[0-9]{2})(?: |$)", 1)
    return F.when(found != "", found)


# fixed values: shapes of document numbers and coordinates
DOCUMENT_NUMBER = r"(?iuU)(?<!\w)(?:số[ \t]*)?([0-9]+/(?:[0-9]{4}/)?[0-9a-zđ]+(?:-[0-9a-zđ]+)*)(?!\w)"


def document_numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DOCUMENT_NUMBER), F.lit(1))


def sentences(text: Column) -> Column:
    """Non-blank parts between sentence ends."""
    return F.filter(F.transform(F.split(text, r"(?:[.!?]+(?=\s|$)|\n+)"), F.trim), lambda s: s != "")


def sentence_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(sentences(text)))


def word_count(text: Column) -> Column:
    """White-space separated words."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def rouge_tokens(text: Column) -> Column:
    """Lower-cased ASCII words and digits; all other characters separate."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def content_id(prefix: str, payload: Column, digits: int = 24) -> Column:
    """A content-addressed id: prefix and the first hex digits of SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(payload.cast("binary"), 256), 1, digits))


def checksum(payload: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(payload.cast("binary"), 256))


def canonical(text: Column) -> Column:
    """NFC, runs of white space as one space, none at the ends."""
    composed = F.when(text.rlike(r"[^\x00-\x7F]"), nfc_exact(text)).otherwise(text)
    return F.trim(F.regexp_replace(composed, r"(?U)[\s\x1C-\x1F]+", " "))


def compacted(text: Column, limit: int) -> Column:
    """The canonical text if it has at most limit words, else its longest prefix of whole sentences within them, else all of it."""
    whole = canonical(text)
    words = F.regexp_extract(whole, rf"^(?:[^ ]+ ){{0,{limit - 1}}}[^ ]+", 0)
    prefix = F.regexp_extract(words, r"(?s)^.*[.!?](?= |$)", 0)
    return F.when(words == whole, whole).when(prefix != "", prefix).otherwise(whole)


def deletion_only(before: Column, after: Column) -> Column:
    """Whether a canonical answer was only cut short at the end of a sentence, or left alone: so no claim was added or reworded."""
    return F.coalesce(F.startswith(before, after) & ((before == after) | F.substring(after, -1, 1).isin(".", "?", "!")), F.lit(False))


# fixed values: forbidden content and its replacement
_SECRET = r"(?i)\b(?:hf_[a-z0-9]{8,}|sk-[a-z0-9-]{8,}|akia[0-9a-z]{16}|(?:api[_-]?key|token|secret|password)\s*[=:]\s*\S+)"
_ABSOLUTE = r"(?:\b[A-Za-z]:[\\/]|(?<![\w/:.])/(?:home|root|users|tmp|var|etc|mnt)/)\S*"


def has_forbidden(text: Column) -> Column:
    """Whether a text holds a secret or an absolute path."""
    return text.rlike(_SECRET) | text.rlike(_ABSOLUTE)


def redacted(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _SECRET, "[REDACTED]"), _ABSOLUTE, "[PATH]")


def http_url_ok(url: Column) -> Column:
    """An absolute HTTP(S) URL with a host and without credentials."""
    return F.coalesce(url.rlike(r"^(?i)https?://[^/?#@\s]+(?:[/?#]\S*)?$"), F.lit(False))


def rendered(template: str, **columns: Column) -> Column:
    """A prompt template with {name} fields."""
    parts, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), columns[name]]
    return F.concat(*parts, F.lit(rest))


@F.pandas_udf(T.StringType())
def nfc_exact(text: pd.Series) -> pd.Series:
    """NFC, which no built-in gives; use it once at ingestion."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def casefold_exact(text: pd.Series) -> pd.Series:
    """NFC and full case folding."""
    return text.map(lambda t: unicodedata.normalize("NFC", t).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def document_number_key_exact(text: pd.Series) -> pd.Series:
    def key(t):
        plain = "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFC", t).casefold()) if unicodedata.category(c) != "Mn")
        return unicodedata.normalize("NFC", plain.replace("đ", "d"))

    return text.map(key, na_action="ignore")
