"""Text, name, identifier and year expressions (Column in, Column out)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.functions import vocab


# Letters without a Unicode decomposition.
WHOLE_LETTERS = [("ł", "l"), ("ø", "o"), ("đ", "d"), ("ð", "d"), ("þ", "th"), ("æ", "ae"),
                 ("œ", "oe")]


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """One-to-one and one-to-many compatibility folds derived from Unicode data.

    One-to-one folds cover every character whose decomposition leaves a single ASCII
    letter or digit, or one of the letters without a decomposition; one-to-many ones the
    Latin blocks.
    """
    single_from, single_to, multiple = [], [], []
    for point in range(0x80, 0x110000):
        char = chr(point)
        folded = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not 0x300 <= ord(c) <= 0x36F
        ).lower()
        if folded == char or 0xD800 <= point <= 0xDFFF:
            continue
        plain = folded.isascii() and folded.isalnum() or folded in dict(WHOLE_LETTERS)
        if len(folded) == 1 and plain:
            single_from.append(char)
            single_to.append(folded)
        elif (point < 0x250 or 0xFB00 <= point <= 0xFB06) and len(folded) > 1:
            if folded.isascii() or point in (0x149, 0x13F, 0x140):
                multiple.append((char.lower(), folded.replace("ʼ", " ")))
    return "".join(single_from), "".join(single_to), tuple(multiple)


def fold_accents(text: Column) -> Column:
    """Lowercase, decompose compatibly and drop combining marks."""
    source, target, multiple = _fold_table()
    folded = F.translate(F.lower(text), source, target)
    pattern = "[" + "".join(char for char, _ in multiple) + "]"
    expanded = folded
    for char, replacement in multiple:
        expanded = F.replace(expanded, F.lit(char), F.lit(replacement))
    folded = F.when(folded.rlike(pattern), expanded).otherwise(folded)
    return F.regexp_replace(folded, "[̀-ͯ]", "")


def text_key(text: Column) -> Column:
    """Accent-folded words separated by single spaces."""
    return F.trim(F.regexp_replace(fold_accents(text), "[^a-z0-9]+", " "))


def person_key(name: Column) -> Column:
    """Text key with the non-decomposing Latin letters folded and suffixes dropped."""
    text = fold_accents(name)
    for letter, plain in WHOLE_LETTERS:
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.trim(F.regexp_replace(
        F.regexp_replace(text_key(text), r"\b(jr|sr)\b", " "), " +", " "))


def name_key(name: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def spaced_name_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def name_variants(name: Column) -> Column:
    """Keys of the whole name, the name without parentheses, and each parenthetical."""
    inside = F.regexp_extract_all(name, F.lit(r"\(([^)]*)\)"), 1)
    raw = F.concat(F.array(name, F.regexp_replace(name, r"\([^)]*\)", " ")), inside)
    return F.array_distinct(F.filter(F.transform(raw, name_key), lambda k: k != ""))


def key_set(values: Column, key=text_key) -> Column:
    """Distinct non-empty keys of an array; null arrays give an empty set."""
    keys = F.transform(F.coalesce(values, F.array().cast("array<string>")), key)
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def overlap(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right))


def identifier_key(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"^https?://(dx\.)?doi\.org/", ""))


def slug(value: Column) -> Column:
    """Words joined by hyphens; a long slug is cut and told apart by a digest."""
    text = F.regexp_replace(F.lower(F.trim(value)), "['\"]", "")
    text = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.concat(F.substring(text, 1, 80), F.lit("-"), F.substring(F.md5(text), 1, 8))
    return F.when(F.length(text) > 80, cut).otherwise(
        F.coalesce(F.nullif(text, F.lit("")), F.lit("untitled")))


def underscore_slug(value: Column) -> Column:
    text = F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_")
    return F.regexp_replace(text, "^_+|_+$", "")


def work_id(person_id: Column, title: Column) -> Column:
    return F.concat(F.lit("work:"), slug(person_id), F.lit(":"), slug(title))


def entity_id(kind: str, label: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), slug(label))


def claim_id(subject: Column, field: Column, source: Column, value: Column) -> Column:
    return F.concat_ws(":", F.lit("claim"), slug(subject), slug(field), slug(source), slug(value))


def relationship_id(source: Column, target: Column, kind: Column) -> Column:
    return F.concat_ws(":", F.lit("relationship"), source, kind, target)


def person_entity_id(value: Column) -> Column:
    return F.when(value.startswith("person:"), value).otherwise(F.concat(F.lit("person:"), value))


def strip_person_prefix(value: Column) -> Column:
    return F.regexp_replace(value, "^person:", "")


def url_host(url: Column) -> Column:
    """Lowercased host without a leading ``www.``, or the legacy label."""
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit("Legacy source URL"))


def is_web_url(value: Column) -> Column:
    return F.coalesce(value.rlike("(?i)^https?://"), F.lit(False))


def encode_component(value: Column) -> Column:
    """Percent-encode as URL components: spaces as %20, ``!'()*`` kept."""
    text = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for code, char in [("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")]:
        text = F.replace(text, F.lit(code), F.lit(char))
    return F.replace(text, F.lit("%7E"), F.lit("~"))


def article_url(name: Column) -> Column:
    path = encode_component(F.regexp_replace(name, r"\s+", "_"))
    return F.concat(F.lit("https://en.wikipedia.org/wiki/"), path)


def decode_entities(text: Column) -> Column:
    # The character references a roster page uses, in decoding order.
    for entity, char in [("&nbsp;", " "), ("&amp;", "&"), ("&#039;", "'"), ("&apos;", "'"),
                         ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")]:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strip_html(text: Column) -> Column:
    plain = decode_entities(F.regexp_replace(text, "<[^>]+>", " "))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def signed_year(value: Column) -> Column:
    """Year of ``+1879-03-14T...`` or ``-0427-...`` as a signed integer."""
    return F.nullif(F.regexp_extract(value, r"^([+-]\d{4,})", 1), F.lit("")).try_cast("int")


def year_label(year: Column) -> Column:
    return (F.when(year.isNull(), "present")
            .when(year < 0, F.concat((-year).cast("string"), F.lit(" BCE")))
            .otherwise(year.cast("string")))


def strip_import_notes(notes: Column) -> Column:
    text = F.regexp_replace(
        notes, r"(?i)\s*Merged duplicate import from Wikidata:\s*https?://\S+", "")
    text = F.regexp_replace(text, r"(?i)\s*Imported from Wikidata(?:\s*:\s*https?://\S+)?", "")
    return F.nullif(F.trim(text), F.lit(""))


def merge_unique(*arrays: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(a, empty) for a in arrays]))


def merge_unique_trimmed(*arrays: Column) -> Column:
    trimmed = F.transform(merge_unique(*arrays), lambda v: F.trim(v))
    return F.array_distinct(F.filter(trimmed, lambda v: v != ""))


def evidence_tokens(text: Column) -> Column:
    """Distinct words longer than four characters that are not stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{5,}"), F.lit(0))
    return F.array_except(words, F.array(*[F.lit(w) for w in vocab.EVIDENCE_STOPWORDS]))


def joined(*parts: Column) -> Column:
    """Space-joined text of scalar and array columns; nulls are skipped."""
    return F.concat_ws(" ", *parts)


def person_search_text(columns=None) -> Column:
    names = columns or ["name", "era", "movement", "region", "fields", "subfields", "works",
                        "notes"]
    return F.lower(F.concat_ws(" ", *[F.col(c) for c in names]))
