"""Scalar text functions as ``Column -> Column`` expressions (no Python in the hot path)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import vocab as V


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- flattening


def join_list(c) -> Column:
    """Array to text; null elements read as empty text."""
    return F.coalesce(F.array_join(_col(c), " ", ""), F.lit(""))


def join_map(c) -> Column:
    """Map to ``k v k v`` text."""
    pairs = F.transform(F.map_entries(_col(c)), lambda e: F.concat(e["key"], F.lit(" "), F.coalesce(e["value"], F.lit(""))))
    return F.coalesce(F.array_join(pairs, " "), F.lit(""))


def plain(c) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def flatten_map(c, sort: bool = False) -> Column:
    """Map to an array of ``k: v`` strings without empty values."""
    kept = F.filter(F.map_entries(_col(c)), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    rows = F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    rows = F.coalesce(rows, F.array().cast("array<string>"))
    return F.array_sort(rows) if sort else rows


def flatten_list(c) -> Column:
    return F.coalesce(F.filter(_col(c), lambda v: v.isNotNull() & (v != "")), F.array().cast("array<string>"))


def searchable_text(title="title", features="features", details="details",
                    description="description", categories="categories", store="store") -> Column:
    """All searchable fields in their fixed order, joined by single spaces; absent values add nothing."""
    pieces = F.concat(
        F.when(_col(title).isNotNull(), F.array(_col(title))).otherwise(F.array().cast("array<string>")),
        F.coalesce(_col(features), F.array().cast("array<string>")),
        F.coalesce(
            F.transform(F.map_entries(_col(details)), lambda e: F.concat(e["key"], F.lit(" "), F.coalesce(e["value"], F.lit("")))),
            F.array().cast("array<string>")),
        F.coalesce(_col(description), F.array().cast("array<string>")),
        F.coalesce(_col(categories), F.array().cast("array<string>")),
        F.when(_col(store).isNotNull(), F.array(_col(store))).otherwise(F.array().cast("array<string>")),
    )
    return F.trim(F.array_join(pieces, " "))


# ---------------------------------------------------------------- tokens


def terms(c, stopwords: Sequence[str] = V.STOPWORDS) -> Column:
    """Query-side tokens: runs of ASCII letters and digits, longer than one, stop words removed."""
    found = F.transform(F.regexp_extract_all(_col(c), F.lit("(?iU)[a-z0-9]+"), F.lit(0)), F.lower)
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*stopwords))


def query_terms(c, limit: int = V.QUERY_TERM_LIMIT, stopwords: Sequence[str] = V.STOPWORDS) -> Column:
    """Distinct query terms in order of first use, at most ``limit`` of them (part of the query contract)."""
    return F.slice(F.array_distinct(terms(c, stopwords)), 1, limit)


def _diacritic_table() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base letter plus marks, mapped to that base letter.

    Combining marks come last without a counterpart, so ``translate`` deletes them.
    """
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x0370, 0x0530), *range(0x1E00, 0x2000)]:
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        base = "".join(p for p in parts if not unicodedata.combining(p))
        if len(parts) > 1 and len(base) == 1 and base != letter:
            source.append(letter)
            target.append(base)
    marks = [chr(code) for code in range(0x0300, 0x0370) if unicodedata.combining(chr(code))]
    return "".join(source + marks), "".join(target)


_FOLD_FROM, _FOLD_TO = _diacritic_table()


def index_tokens(c) -> Column:
    """Index-side tokens: lower-cased, accents folded, split on everything that is no letter or digit."""
    folded = F.translate(F.lower(_col(c)), _FOLD_FROM, _FOLD_TO)
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def normalized(c) -> Column:
    """Whitespace collapsed, trimmed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " ")))


# ---------------------------------------------------------------- categories


def _empty_strings() -> Column:
    return F.array().cast("array<string>")


def coarse_category(c) -> Column:
    parts = F.flatten(F.transform(F.coalesce(_col(c), _empty_strings()), lambda v: F.split(v, ",")))
    parts = F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    kept = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(*V.UMBRELLA_LABELS))
    last_two = F.when(F.size(kept) > 2, F.slice(kept, -2, 2)).otherwise(kept)
    return F.when(F.size(kept) == 0, F.lit(V.DEFAULT_CATEGORY)).otherwise(F.array_join(last_two, " "))


def specific_categories(c) -> Column:
    return F.filter(
        F.coalesce(_col(c), _empty_strings()),
        lambda v: ~F.array_join(terms(v), " ").isin(*V.GENERIC_CATEGORIES),
    )


def _nodes_below_root(c) -> Column:
    path = F.coalesce(_col(c), _empty_strings())
    below = F.when(F.size(path) > 1, F.slice(path, F.lit(2), F.size(path) - 1)).otherwise(_empty_strings())
    return F.transform(below, normalized)


def _words(values: Sequence[str]) -> Column:
    """Literal array of words, stated as one SQL expression."""
    return F.expr("array(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")")


def category_group(c) -> Column:
    nodes = _nodes_below_root(c)
    return (
        F.when(F.exists(nodes, lambda n: n.isin("shoes", "boot shop")), "shoes")
        .when(F.exists(nodes, lambda n: n.contains("jewelry")), "jewelry")
        .otherwise("clothing")
    )


def fine_category_group(c) -> Column:
    nodes = _nodes_below_root(c)
    has = lambda n, words: F.arrays_overlap(terms(n), _words(words))
    return (
        F.when(F.exists(nodes, lambda n: n.isin("shoes", "boot shop") | has(n, V.SHOE_TERMS)), "shoes")
        .when(
            F.exists(nodes, lambda n: (n == "jewelry") | ((n != "jewelry watch accessories") & has(n, V.JEWELRY_TERMS))),
            "jewelry",
        )
        .when(F.array_contains(nodes, "clothing"), "clothing")
        .otherwise("other")
    )


def head_noun_group(c) -> Column:
    """Group of a free category text from its head nouns alone."""
    words = terms(c)
    return (
        F.when(F.arrays_overlap(words, _words(V.SHOE_TERMS)), "shoes")
        .when(F.arrays_overlap(words, _words(V.JEWELRY_TERMS)), "jewelry")
        .otherwise("clothing")
    )


# ---------------------------------------------------------------- prices


def price_number(c) -> Column:
    """Usable price: a finite non-negative number, or the number after ``from``; else null."""
    raw = F.trim(_col(c))
    plain_number = F.when(raw.rlike(r"^[+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?$"), raw.cast("double"))
    bound = F.regexp_extract(raw, r"(?i)^from\s+([0-9]+(?:\.[0-9]+)?)$", 1)
    number = F.coalesce(plain_number, F.when(bound != "", bound.cast("double")))
    return F.when(F.abs(number) < float("inf"), number)


def price_is_lower_bound(c) -> Column:
    return F.coalesce(F.trim(_col(c)).rlike(r"(?i)^from\s+[0-9]+(\.[0-9]+)?$"), F.lit(False))


def price_kind(c) -> Column:
    return (
        F.when(price_is_lower_bound(c), "lower_bound").when(price_number(c).isNotNull(), "exact").otherwise("missing")
    )


def first_number(c) -> Column:
    """First number anywhere in a price text, to two decimals (half-even)."""
    text = F.regexp_extract(plain(c), r"[0-9]+(?:\.[0-9]+)?", 0)
    return F.when(text != "", F.bround(text.cast("double"), 2))


def price_band(c) -> Column:
    p = _col(c)
    return (
        F.when(p.isNull(), F.lit(None).cast("string"))
        .when(p < 15, "under $15").when(p < 25, "$15-$25").when(p < 50, "$25-$50").when(p < 100, "$50-$100")
        .otherwise("over $100")
    )


def budget_bucket(c) -> Column:
    p = _col(c)
    return (
        F.when(p.isNull(), F.lit(None).cast("string"))
        .when(p < 25, "under 25").when(p < 50, "25 to 49").when(p < 100, "50 to 99").otherwise("100 or more")
    )


# ---------------------------------------------------------------- attributes


def normalize_department(c) -> Column:
    text = _col(c)
    words = terms(F.regexp_replace(text, "-", " "))
    rule = F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
    unisex = F.array_contains(words, V.AUDIENCE_UNISEX)
    rule = rule.when(unisex & F.arrays_overlap(words, _words(V.AUDIENCE_BABY)), "unisex baby")
    rule = rule.when(unisex & F.arrays_overlap(words, _words(V.AUDIENCE_CHILD)), "unisex child")
    rule = rule.when(unisex, "unisex adult")
    for label, audience in V.AUDIENCE_RULES:
        rule = rule.when(F.arrays_overlap(words, _words(audience)), label)
    return rule.otherwise(F.nullif(normalized(text), F.lit("")))


def extract_department(c) -> Column:
    return F.when(F.arrays_overlap(terms(c), _words(V.AUDIENCE_WORDS)), normalize_department(c))


def first_detail(c, keys: Sequence[str]) -> Column:
    m = _col(c)
    return normalized(F.coalesce(*[F.nullif(F.element_at(m, F.lit(k)), F.lit("")) for k in keys]))


def _first_word(c, words: Sequence[str]) -> Column:
    hit = F.lower(F.regexp_extract(_col(c), r"(?iU)\b(" + "|".join(words) + r")\b", 1))
    return F.nullif(hit, F.lit(""))


def first_material(c) -> Column:
    return _first_word(c, V.MATERIALS)


def first_color(c) -> Column:
    return _first_word(c, V.COLORS)


# ---------------------------------------------------------------- constraints


def clean_constraint(c, limit: int = 180) -> Column:
    """Whitespace collapsed, edge punctuation stripped, cut to ``limit`` characters (the constraint contract)."""
    collapsed = F.regexp_replace(_col(c), r"(?U)\s+", " ")
    stripped = F.regexp_replace(collapsed, r"^[ \-;,.\t\n]+|[ \-;,.\t\n]+$", "")
    return F.regexp_replace(F.substring(stripped, 1, limit), r"(?U)\s+$", "")


def classify_constraint(c) -> Column:
    low = F.lower(_col(c))
    rule = F.when(low.contains("budget") | low.rlike(r"(\$|<=|under)\s*[0-9]"), "budget")
    for kind, words in V.CONSTRAINT_TYPES:
        rule = rule.when(low.rlike("|".join(re.escape(w) for w in words)), kind)
    return rule.otherwise("feature")


def purchase_frequency(c) -> Column:
    count = F.size(F.filter(F.split(F.coalesce(_col(c), F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    return (
        F.when(count == 0, "no prior purchases").when(count == 1, "1 prior purchase")
        .when(count == 2, "2 prior purchases").otherwise("3-4 prior purchases")
    )


def rating_style(c) -> Column:
    return F.when(_col(c) >= 5, "usually positive").when(_col(c) >= 4, "mixed").otherwise("critical")


def query_text(category, constraint_texts) -> Column:
    """Category and constraint texts joined by single spaces."""
    return F.array_join(F.concat(F.array(_col(category)), _col(constraint_texts)), " ")
