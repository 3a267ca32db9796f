"""Budget events: what messages say about a budget, as columns over turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X

# Budget phrases by kind, and phrases that lift a budget.
_AMOUNT = r"((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)"
_MONEY = rf"(?:usd\s*)?\$?\s*{_AMOUNT}"
_MARKED_MONEY = rf"(?:usd\s*\$?|\$)\s*{_AMOUNT}"
BUDGET_KINDS = {
    "around": (
        rf"\bbudget\b.{{0,24}}?\b(?:around|about|approximately|approx\.?)\s*{_MONEY}",
        rf"\b(?:around|about|approximately|approx\.?)\s*{_MARKED_MONEY}",
    ),
    "max": (
        rf"\bbudget\b.{{0,24}}?\b(?:under|below|up\s+to|at\s+most|maximum(?:\s+of)?|max(?:\s+of)?|no\s+more\s+than)\s*{_MONEY}",
        rf"\b(?:under|below|up\s+to|at\s+most|no\s+more\s+than)\s*{_MARKED_MONEY}",
        rf"\bbudget\b.{{0,24}}?{_MONEY}\s*(?:or\s+less|max(?:imum)?)\b",
    ),
    "min": (
        rf"\bbudget\b.{{0,24}}?\b(?:over|above|at\s+least|minimum(?:\s+of)?|min(?:\s+of)?|no\s+less\s+than)\s*{_MONEY}",
        rf"\b(?:over|above|at\s+least|no\s+less\s+than)\s*{_MARKED_MONEY}",
        rf"\bbudget\b.{{0,24}}?{_MONEY}\s*(?:or\s+more|min(?:imum)?)\b",
    ),
}
NO_BUDGET = (
    r"\b(?:do\s+not|don't)\s+have\s+(?:an?\s+)?(?:additional\s+)?preference\s+for\s+(?:the\s+)?budget\b",
    r"\bno\s+(?:additional\s+)?(?:preference|limit)\s+(?:for|on)\s+(?:the\s+)?budget\b",
    r"\bno\s+budget\s+(?:preference|limit)\b",
    r"\bbudget\s+(?:does\s+not|doesn't)\s+matter\b",
    r"\b(?:flexible|open)\s+(?:about|on|with)\s+(?:the\s+)?budget\b",
    r"\bany\s+budget\b",
)
# Kinds in the order that decides between events of one place.
_ORDER = ("lifted", "around", "max", "min")


def _found(message: Column, kind: str, pattern: str) -> Column:
    """All matches of one phrase as (first, last, order, amount): each is looked for behind the one before it."""
    rule = "(?iU)" + pattern
    hits = F.regexp_extract_all(message, F.lit(rule), F.lit(0))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<first:int,last:int,kind_order:int,amount:double>>").alias("found"))
    amount = (lambda hit: F.regexp_replace(F.regexp_extract(hit, rule, 1), ",", "").cast("double")) if kind != "lifted" else (lambda hit: F.lit(None).cast("double"))

    def step(acc: Column, hit: Column) -> Column:
        first = F.call_function("locate", hit, message, acc["next"])
        last = first + F.length(hit)
        event = F.struct(first.alias("first"), last.alias("last"), F.lit(_ORDER.index(kind)).alias("kind_order"), amount(hit).alias("amount"))
        return F.struct(last.alias("next"), F.concat(acc["found"], F.array(event)).alias("found"))

    return F.aggregate(hits, start, step)["found"]


def budget_event(message) -> Column:
    """(kind, amount) of the last budget phrase of a message in the order of the text; kind ``lifted`` takes a budget back."""
    text = F.replace(X._col(message), F.lit("\u2019"), F.lit("'"))
    every = F.concat(*[_found(text, k, p) for k, ps in (("lifted", NO_BUDGET), *BUDGET_KINDS.items()) for p in ps])
    last = F.array_max(every)
    names = F.array(*map(F.lit, _ORDER))
    return F.when(last.isNotNull(), F.struct(F.get(names, last["kind_order"]).alias("kind"), last["amount"].alias("amount")))


def budgets_in_force(turns: DataFrame) -> DataFrame:
    """(session_id, turn, event, kind, amount): each turn's own event, and the budget that holds after it; null when none does.

    ``turns``: session_id, turn, message.  The last event of the session up to the turn counts, and a lifting one ends the budget.
    """
    rows = turns.select("session_id", "turn", budget_event("message").alias("said"))
    held = F.last("said", ignorenulls=True).over(Window.partitionBy("session_id").orderBy("turn"))
    rows = rows.select("session_id", "turn", F.col("said.kind").alias("event"), held.alias("held"))
    open_ = F.col("held.kind") != "lifted"
    return rows.select("session_id", "turn", "event", F.when(open_, F.col("held.kind")).alias("kind"), F.when(open_, F.col("held.amount")).alias("amount"))
