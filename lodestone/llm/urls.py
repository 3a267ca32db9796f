"""URL filters as a temporal list join, with DataFrame operations only.

Dated list entries (a domain is added to or removed from a list) become validity intervals: an entry holds until the next entry
of the same list and domain.  Each capture is evaluated against what was valid when it was fetched: its host and the host's
parent domains meet the intervals by domain and period of time, so that neither a long history nor a popular domain is one key.
The longest listed domain decides; on the same domain the allow list comes before the block list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PERIOD = 30 * 86400  # seconds; captures and intervals meet inside periods of this length


def host(url: Column) -> Column:
    """The host of an absolute URL in lower case; null for null and for anything else."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def domains(name: Column) -> Column:
    """A host and its parent domains of at least two labels, the host alone if it has fewer."""
    labels = F.split(name, "\\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, n), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, since, until) from entries (list, domain, listed boolean, at in seconds).

    ``until`` is exclusive and null for what still holds.  Entries of one list and domain at the same time: removal wins.
    Entries with a null field are left out.
    """
    clean = entries.select("list", F.lower("domain").alias("domain"), "listed", "at").dropna()
    clean = clean.groupBy("list", "domain", "at").agg(F.bool_and("listed").alias("listed"))
    following = F.lead("at").over(Window.partitionBy("list", "domain").orderBy("at"))
    return clean.withColumn("until", following).where("listed").select("list", "domain", F.col("at").alias("since"), "until")


def filtered(captures: DataFrame, entries: DataFrame, url_column: str = "url", time_column: str = "fetched") -> DataFrame:
    """``captures`` with ``host``, ``listed_domain``, ``list`` and ``kept`` added; ``fetched`` is in seconds.

    ``kept`` is false where the deciding list is ``block``.  Captures without a host, without a time or without a valid entry are
    kept with null in the other columns.  Rows are kept as they are, repeated ones too.
    """
    rows = captures.withColumn("host", host(F.col(url_column)))
    latest = rows.agg(F.max(time_column).alias("latest"))  # one row: where open intervals end
    asked = rows.where(f"host is not null and `{time_column}` is not null").groupBy("host", F.col(time_column).alias("asked")).agg(F.count("*").alias("n"))
    asked = asked.select("host", "asked", F.floor(F.col("asked") / PERIOD).alias("period"), F.explode(domains(F.col("host"))).alias("domain"))
    held = intervals(entries).crossJoin(F.broadcast(latest)).where("since <= latest")
    last = F.least(F.coalesce(F.col("until") - 1, F.col("latest")), F.col("latest"))
    held = held.where("until is null or until > since").select(
        "list", "domain", "since", "until", F.explode(F.sequence(F.floor(F.col("since") / PERIOD), F.floor(last / PERIOD))).alias("period"))
    valid = asked.join(held, ["domain", "period"]).where("since <= asked and (until is null or asked < until)")
    strength = F.struct(F.length("domain").alias("size"), (F.col("list") == "allow").cast("int").alias("allows"), F.col("list").alias("list"), F.col("domain").alias("domain"))
    decided = valid.groupBy("host", F.col("asked").alias(time_column)).agg(F.max(strength).alias("best"))
    out = rows.join(decided, ["host", time_column], "left")
    return out.select(
        *[c for c in captures.columns if c not in ("host", "listed_domain", "list", "kept")], "host", F.col("best.domain").alias("listed_domain"), F.col("best.list").alias("list"),
        (~F.coalesce(F.col("best.list") == "block", F.lit(False))).alias("kept"))
