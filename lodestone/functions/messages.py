"""Message parsing as columns over a table of turns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as X

# Message forms of the templated dialogue, tried in this order.
OPENING_BUYING = r"(?s)^I'm looking for (.+?)\. A key requirement is: (.+)\.$"
OPENING_BROWSING = r"(?s)^I'm looking for (.+), but I'm still exploring\.$"
OPENING_PREFERENCE = r"(?s)^I'm looking for (.+?)\. (.+)$"
OVERRIDE = r"(?s)^Actually, ignore my earlier preference\. What I need is: (.+)\.$"
CLARIFICATION = r"(?s)^For that, what matters is: (.+)\.$"
NO_PREFERENCE_START = "I don't have"

# Budget phrases, tried in this order.
BUDGETS = (
    r"(?iU)(?:under|below|less than|up to|maximum|max)\s*\$?\s*(\d+(?:\.\d+)?)",
    r"(?iU)budget(?:\s+(?:around|of))?\s*\$?\s*(\d+(?:\.\d+)?)",
    r"(?iU)\$\s*(\d+(?:\.\d+)?)\s*(?:or less|maximum|max)",
)
# Price-like phrase whose last match bounds the budget, and the negated-term phrase.
BUDGET_UPPER = (
    r"(?iU)(?:\b(?:under|below|less than|up to|max(?:imum)?|budget(?: is| of| around)?|price(?: is)?)[^\d$]{0,12}|\$)"
    r"(\d+(?:\.\d{1,2})?)"
)
BUDGET_UPPER_LIMIT = 1_000_000.0
NEGATIVE_TERM = (
    r"(?iU)\b(?:(?:not(?!\s+(?:only|quite|sure)\b)|no(?!\s+(?:preference|additional|longer)\b)|without)\s+(?:too\s+)?|"
    r"(?:don'?t|do\s+not)\s+(?:want|need|prefer)\s+)([a-z0-9-]+)"
)
# Word classes of the multi-label message classifier.
CLASS_WORDS = {
    "material": (
        "cotton", "polyester", "nylon", "leather", "wool", "spandex", "silk", "rayon", "fabric",
        "linen", "denim", "fleece", "mesh", "suede", "canvas", "rubber"),
    "color": (
        "black", "white", "blue", "red", "pink", "green", "brown", "gray", "grey", "purple",
        "yellow", "orange", "beige", "navy", "gold", "silver", "tan", "khaki", "color"),
    "size": (
        "size", "sizing", "width", "wide", "narrow", "xs", "small", "medium", "large", "xl", "xxl", "petite", "tall"),
    "style": (
        "department", "style", "fit", "sleeve", "neck", "casual", "formal", "vintage",
        "classic", "modern", "sporty", "athletic", "slim", "relaxed", "oversized", "elegant"),
    "use_case": (
        "hiking", "running", "gym", "winter", "outdoor", "work", "walking", "workout", "office",
        "wedding", "travel", "school", "beach", "rain", "snow", "cycling"),
    "budget": ("budget", "under", "below", "price", "cheaper", "less"),
}


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_opening(c) -> Column:
    """First message of a session: intent, category, constraint, hard flag and where the constraint came from."""
    m = X._col(c)
    form = (
        F.when(m.rlike(OPENING_BUYING), "buying").when(m.rlike(OPENING_BROWSING), "browsing")
        .when(m.rlike(OPENING_PREFERENCE), "preference").otherwise("plain")
    )
    group = lambda p, g: F.regexp_extract(m, p, g)
    category = (
        F.when(form == "buying", group(OPENING_BUYING, 1)).when(form == "browsing", group(OPENING_BROWSING, 1))
        .when(form == "preference", group(OPENING_PREFERENCE, 1)).otherwise(m)
    )
    raw = F.when(form == "buying", group(OPENING_BUYING, 2)).when(form == "preference", _strip(group(OPENING_PREFERENCE, 2)))
    return F.struct(
        F.when(form == "browsing", "browsing").otherwise("buying").alias("intent"),
        _strip(category).alias("category"),
        F.nullif(clean_value(raw), F.lit("")).alias("constraint"),
        (form == "buying").alias("hard"),
        F.when(form == "buying", "initial").when(form == "preference", "initial_preference").alias("source"),
    )


def clean_value(c) -> Column:
    """Constraint text as stored: whitespace collapsed, spaces and full stops stripped at both ends."""
    return F.regexp_replace(F.regexp_replace(X._col(c), r"(?U)\s+", " "), r"^[ .]+|[ .]+$", "")


def parse_reply(c) -> Column:
    """Later message: which kind it is and the values it carries."""
    m = X._col(c)
    override = F.regexp_extract(m, OVERRIDE, 1)
    clarified = F.regexp_extract(m, CLARIFICATION, 1)
    values = (
        F.when(override != "", F.array(override)).when(clarified != "", F.split(clarified, ";"))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.struct(
        F.when(override != "", "override").when(clarified != "", "clarification")
        .when(m.startswith(NO_PREFERENCE_START), "no_preference").otherwise("other").alias("kind"),
        F.filter(F.transform(values, clean_value), lambda v: v != "").alias("values"),
    )


def budget_of(c) -> Column:
    """Budget named by one text: the first phrase form that matches gives the number."""
    tries = [F.nullif(F.regexp_extract(X._col(c), p, 1), F.lit("")).cast("double") for p in BUDGETS]
    return F.coalesce(*tries)


def last_budget(constraints) -> Column:
    """Budget of the last constraint that names one; input is array<struct<text, hard>>."""
    found = F.filter(
        F.transform(X._col(constraints), lambda c: F.struct(budget_of(c["text"]).alias("maximum"), c["hard"].alias("hard"))),
        lambda b: b["maximum"].isNotNull())
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def budget_upper(c) -> Column:
    """Number of the last price-like phrase in a text."""
    found = F.transform(F.regexp_extract_all(X._col(c), F.lit(BUDGET_UPPER), F.lit(1)), lambda t: t.cast("double"))
    usable = F.filter(found, lambda v: v <= BUDGET_UPPER_LIMIT)
    return F.when(F.size(usable) > 0, F.element_at(usable, -1))


def negative_terms(c) -> Column:
    """Distinct negated words, lower-cased, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(X._col(c), F.lit(NEGATIVE_TERM), F.lit(1)), F.lower)))


def classify_message(c, stopwords) -> Column:
    """Every attribute class whose words occur in the message."""
    words = X.terms(F.lower(X._col(c)), stopwords)
    hits = []
    for kind, vocabulary in CLASS_WORDS.items():
        test = F.arrays_overlap(words, X._words(vocabulary))
        if kind == "budget":
            test = test | X._col(c).contains("$")
        hits.append(F.when(test, F.lit(kind)))
    return F.array_compact(F.array(*hits))
