"""Canonical text forms, exact source slices and tolerant JSON: the few places that need Python, kept small.

Unicode compatibility folding is no built-in of Spark.  The Arrow functions below see a row only when it holds
characters that folding could change; every other row passes them as null.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import slot_vocab as SV
from lodestone.functions import text as X


def fold_text(value: str) -> str:
    return unicodedata.normalize("NFKC", value).casefold()


@F.pandas_udf(T.StringType())
def _fold_batch(values: pd.Series) -> pd.Series:
    return values.map(fold_text, na_action="ignore")


def folded(c) -> Column:
    """Compatibility-normalized, case-folded text; plain ASCII rows stay in the JVM."""
    text = X._col(c)
    ascii_only = text.rlike(r"^\p{ASCII}*$")
    return F.when(text.isNull() | ascii_only, F.lower(text)).otherwise(_fold_batch(F.when(~ascii_only, text)))


def surface(c) -> Column:
    """Folded text with whitespace collapsed."""
    return F.trim(F.regexp_replace(folded(c), r"(?U)\s+", " "))


def canonical(c, fold: bool = True) -> Column:
    """Canonical value text: quotes, ampersand, possessives, separators and spelling aliases resolved.

    ``fold=False`` is for text known to be ASCII.
    """
    text = F.coalesce(X._col(c).cast("string"), F.lit(""))
    text = folded(text) if fold else F.lower(text)
    text = F.regexp_replace(text, "[‘’]", "'")
    text = F.replace(text, F.lit("&"), F.lit(" and "))
    text = F.regexp_replace(text, r"(?U)\b(men|women|boy|girl)'s\b", "$1")
    text = F.regexp_replace(text, "[^a-z0-9.$% ]+", " ")
    text = F.trim(F.regexp_replace(text, " +", " "))
    aliases = sorted(SV.ALIASES.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    replaced = text
    for old, new in aliases:
        replaced = F.regexp_replace(replaced, rf"\b{old}\b", new)
    any_alias = r"\b(" + "|".join(old for old, _ in aliases) + r")\b"
    return F.when(text.rlike(any_alias), F.trim(F.regexp_replace(replaced, " +", " "))).otherwise(text)


def _offsets(text: str) -> tuple[str, list[int]]:
    """Folded text with single spaces, and for each of its characters the place it came from."""
    pieces = [(folded_char, i) for i, char in enumerate(text) for folded_char in fold_text(char)]
    kept: list[tuple[str, int]] = []
    for char, i in pieces:
        if not char.isspace():
            kept.append((char, i))
        elif kept and kept[-1][0] != " ":
            kept.append((" ", i))
    while kept and kept[-1][0] == " ":
        kept.pop()
    return "".join(c for c, _ in kept), [i for _, i in kept]


def source_slice(value: str | None, sources) -> str | None:
    """The slice of the first source that equals ``value`` after folding, with word boundaries at both ends."""
    needle, _ = _offsets((value or "").strip())
    if not needle or sources is None:
        return None
    before = r"(?<![^\W_])" if needle[0].isalnum() else ""
    after = r"(?![^\W_])" if needle[-1].isalnum() else ""
    pattern = re.compile(before + re.escape(needle) + after)
    for text in sources:
        if text:
            haystack, places = _offsets(text)
            hit = pattern.search(haystack)
            if hit:
                return text[places[hit.start()]: places[hit.end() - 1] + 1]
    return None


@F.pandas_udf(T.StringType())
def source_slices(values: pd.Series, sources: pd.Series) -> pd.Series:
    return pd.Series([source_slice(v, s) for v, s in zip(values, sources)], dtype="object")


# Defects of model responses that are repaired.
BAD_ESCAPE = re.compile(r'\\(?!["\\/bfnrt]|u[0-9a-fA-F]{4})')
STRAY_QUOTE = re.compile(r'"\s+"(?=[A-Za-z_][A-Za-z0-9_]*"\s*:)')


def repaired_json(content: str | None) -> tuple[str | None, str | None]:
    """(JSON text of the object, kind of repair); no text means the response cannot be used, kind says why."""
    if content is None:
        return None, "no response"

    def attempt(text: str):
        try:
            return True, json.loads(text)
        except ValueError:
            return False, None

    escaped = BAD_ESCAPE.sub(r"\\\\", content)
    unquoted = STRAY_QUOTE.sub('"', escaped)
    tries = [("none", content)]
    lead = content.lstrip()
    try:
        _, end = json.JSONDecoder().raw_decode(lead)
        tries.append(("trailing_text", lead[:end]))
    except ValueError:
        pass
    tries += [("escapes", escaped), ("stray_quote", unquoted)]
    for kind, text in tries:
        good, parsed = attempt(text)
        if good:
            if isinstance(parsed, dict):
                return json.dumps(parsed, ensure_ascii=False), kind
            return None, "not an object"
    return None, "invalid json"


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("kind", T.StringType())]))
def _repair_batch(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repaired_json(c) for c in contents], columns=["json", "kind"])


def parse_response(c) -> Column:
    """struct(json, kind): usable JSON object text and how it was obtained.

    Well-formed objects are recognized by the JVM; only the others reach the repair function.
    """
    text = X._col(c)
    strict = F.try_parse_json(text)
    closes = F.trim(text).endswith("}") & F.trim(text).startswith("{")
    good = strict.isNotNull() & closes & F.schema_of_variant(strict).startswith("OBJECT")
    repaired = _repair_batch(F.when(~F.coalesce(good, F.lit(False)), text))
    return F.when(good, F.struct(text.alias("json"), F.lit("none").alias("kind"))).otherwise(repaired)
