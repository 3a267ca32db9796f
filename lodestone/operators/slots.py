"""Attribute slots of products and conversations: values, evidence masks, subtypes and priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import slot_vocab as SV
from lodestone.functions import text as X
from lodestone.functions.canonical import canonical
from lodestone.operators.ranks import percent_ranks
from lodestone.session import broadcast_if_small, write_table


def vocabulary(spark: SparkSession) -> DataFrame:
    """(slot, phrase, value) of every slot and of the categories; a few hundred rows."""
    rows = [(slot, p, v) for slot, words in SV.SLOTS.items() for p, v in words.items()]
    rows += [("category", p, v) for p, v in SV.CATEGORIES.items()]
    listed = ", ".join(f"named_struct('slot', '{s}', 'phrase', '{p}', 'value', '{v}')" for s, p, v in rows)
    return spark.range(1).select(F.expr(f"inline(array({listed}))"))


def explode_phrases(df: DataFrame, keys: list[str], text: str, longest: int = 3, words: int | None = None) -> DataFrame:
    """(keys, phrase): distinct word n-grams of a canonical text column, in time linear in the text.

    ``words`` keeps only the first words of a text, where that is the rule.
    """
    split = df.select(*keys, F.split(text, " ").alias("_w"))
    if words:
        split = split.withColumn("_w", F.slice("_w", 1, words))
    return split.select(*keys, F.explode(_grams(F.col("_w"), longest)).alias("phrase"))


def vocabulary_hits(texts: DataFrame, key: list[str], text: str = "normalized") -> DataFrame:
    """(key, slot, phrase, value): vocabulary phrases found in canonical texts, by a join on their n-grams."""
    grams = explode_phrases(texts, key, text)
    return grams.join(F.broadcast(vocabulary(texts.sparkSession)), "phrase")


def _grams(words: Column, longest: int) -> Column:
    """Distinct runs of up to ``longest`` neighbouring words."""
    grams, previous = [words], words
    for n in range(2, longest + 1):
        tail = F.slice(words, F.lit(n), F.greatest(F.size(words), F.lit(1)))
        # Where a text is out of words the join of null words is null and drops out.
        previous = F.array_compact(F.zip_with(previous, tail, lambda a, b: F.concat(a, F.lit(" "), b)))
        grams.append(previous)
    return F.array_distinct(F.concat(*grams))


def _found(c, pairs) -> Column:
    """Values of all phrases a canonical text contains.

    Words of a canonical text stand one space apart, so a phrase in it is a run of its words: the runs are looked up among the phrases, in
    time linear in the text whatever the vocabulary's size.
    """
    values: dict[str, list[str]] = {}
    for phrase, value in pairs:
        values.setdefault(phrase, []).append(value)
    phrases = F.expr("array(" + ", ".join(f"'{p}'" for p in values) + ")")
    told = F.expr("map(" + ", ".join(f"'{p}', array(" + ", ".join(f"'{v}'" for v in vs) + ")" for p, vs in values.items()) + ")")
    words = F.split(F.coalesce(X._col(c), F.lit("")), " ")
    named = F.array_intersect(_grams(words, max(len(p.split(" ")) for p in values)), phrases)
    return F.array_distinct(F.flatten(F.transform(named, lambda p: F.element_at(told, p))))


def extract_slot(c, slot: str) -> Column:
    """Sorted distinct values of one slot in a canonical text, as a column expression."""
    return F.array_sort(_found(c, (SV.CATEGORIES if slot == "category" else SV.SLOTS[slot]).items()))


def detail_slot(c) -> Column:
    """Slot that a detail key speaks about."""
    key = X._col(c)
    rule = None
    for slot, markers in SV.DETAIL_SLOTS:
        test = key.rlike("|".join(markers))
        rule = F.when(test, slot) if rule is None else rule.when(test, slot)
    return rule


def source_texts(catalog: DataFrame, flattened: bool = False) -> DataFrame:
    """(parent_asin, source, key, text, raw): every text an attribute may be read from; the key is empty but for details.

    ``flattened`` reads each field as one text, as the index stores it.
    """
    entry = lambda s, k, v, full: F.struct(
        F.lit(s).alias("source"), k.alias("key"), v.alias("text"), full.alias("raw"))
    none = F.lit(None).cast("string")
    single = lambda s, c: F.array(entry(s, none, c, c))
    if flattened:
        parts = [single("categories", X.join_list("categories")), single("title", X.plain("title")),
                 single("features", X.join_list("features")), single("details", X.join_map("details")), single("store", X.plain("store"))]
    else:
        listed = lambda s, c: F.transform(X.flatten_list(c), lambda v: entry(s, none, v, v))
        detail = F.transform(
            F.filter(F.map_entries("details"), lambda e: e["value"].isNotNull() & (e["value"] != "")),
            lambda e: entry("details", e["key"], e["value"], F.concat(e["key"], F.lit(": "), e["value"])))
        parts = [listed("categories", "categories"), single("title", X.plain("title")), listed("features", "features"),
                 F.coalesce(detail, F.array().cast("array<struct<source:string,key:string,text:string,raw:string>>")),
                 single("store", X.plain("store"))]
    return catalog.select("parent_asin", F.inline(F.concat(*parts))).filter("text <> ''").withColumn("key", F.coalesce("key", F.lit("")))


def text_slots(texts: DataFrame) -> DataFrame:
    """(source, key, text, slot, value, rank): what each different text says; ``rank`` orders evidence for the same value.

    ``texts``: different source, key, text, raw.  Among equal values the more confident wins, then a structured detail, then source and text.
    """
    named = ["source", "key", "text"]
    texts = texts.withColumns({"canonical_key": canonical("key"), "normalized": canonical("text")})
    structured = (F.col("source") == "details") & (F.col("canonical_key") != "")
    keyed = texts.withColumn("detail_slot", F.when(structured, detail_slot("canonical_key")))
    carried = [*named, "canonical_key", "detail_slot", "raw", "normalized"]
    hits = vocabulary_hits(keyed.filter("source <> 'store'"), carried).drop("phrase")
    readable = (
        # A structured detail speaks only about its own slot; a flattened one is free text.
        F.when(F.col("source") == "details", F.col("slot") == F.col("detail_slot"))
        .when(F.col("slot") == "category", F.col("source").isin("categories", "title") & ~F.col("normalized").isin(*SV.GENERIC_LABELS))
        .otherwise(True)
    )
    found = hits.filter(readable)
    # A short label that names no known category and no audience is a category of its own.
    short = (F.size(F.split("normalized", " ")) <= 4) & (F.col("normalized") != "") & ~F.col("normalized").isin(*SV.GENERIC_LABELS)
    told = hits.filter("source = 'categories' and slot in ('category', 'audience')").select(*named)
    labels = keyed.filter("source = 'categories'").filter(short).join(told, named, "left_anti").select(
        *carried, F.lit("category").alias("slot"), F.col("normalized").alias("value"))
    brands = keyed.filter("source = 'store' or detail_slot = 'brand'").select(
        *carried, F.lit("brand").alias("slot"), F.col("normalized").alias("value"))
    every = found.select(*labels.columns).unionByName(labels).unionByName(brands)
    confidence = F.element_at(F.create_map(*[x for k, v in SV.SOURCE_CONFIDENCE.items() for x in (F.lit(k), F.lit(v))]), F.col("source"))
    source = F.when(F.col("source") == "details", F.concat(
        F.lit("details."), F.when(F.col("canonical_key") == "", "value").otherwise(F.col("canonical_key")))).otherwise(F.col("source"))
    rank = F.struct(
        F.round(confidence, 3).alias("confidence"), source.contains(".").alias("dotted"), source.alias("source"),
        F.substring("raw", 1, 240).alias("raw"))
    usable = (F.col("value") != "") & ~F.col("value").isin(*SV.NOISE_VALUES) & ~F.col("value").rlike("^[0-9]+$")
    return every.filter(usable).select(*named, "slot", "value", rank.alias("rank")).distinct()


def product_slots(catalog: DataFrame, flattened: bool = False) -> DataFrame:
    """(parent_asin, slot, value, source, confidence, raw): best evidence for each value of each slot.

    Catalogs repeat their texts (labels, brands, details), so every different text is read once and its values go to the products
    that hold it.
    """
    texts = source_texts(catalog, flattened)
    named = ["source", "key", "text"]
    # Written first: conditions on the canonical form would else be judged before the texts are made different.
    different = write_table(texts.select(*named, "raw").distinct(), "different_texts")
    said = write_table(text_slots(different), "text_slots")
    every = texts.select("parent_asin", *named).join(broadcast_if_small(said), named)
    best = every.groupBy("parent_asin", "slot", "value").agg(F.max("rank").alias("b"))
    return best.select("parent_asin", "slot", "value", "b.source", "b.confidence", "b.raw")


def reliable(slots: DataFrame) -> DataFrame:
    trusted = F.col("source").isin(*SV.RELIABLE_SOURCES) | F.col("source").startswith("details.")
    return slots.filter(trusted & (F.col("confidence") >= SV.RELIABLE_CONFIDENCE))


def mask_registry(spark: SparkSession) -> DataFrame:
    rows = [(s, v, b) for s, bits in SV.MASK_BITS.items() for v, b in bits.items()]
    return spark.createDataFrame(rows, "slot string, value string, bit bigint")


def evidence_masks(slots: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """One bit mask per mask slot and product, over reliable evidence.

    ``products`` (parent_asin) brings in products without any slot, whose masks are empty; without it, those of ``slots`` count.
    """
    bits = reliable(slots).join(F.broadcast(mask_registry(slots.sparkSession)), ["slot", "value"])
    masks = [F.coalesce(F.bit_or(F.when(F.col("slot") == s, F.col("bit"))), F.lit(0)).alias(f"{s}_mask") for s in SV.MASK_SLOTS]
    every = slots if products is None else products
    return every.select("parent_asin").distinct().join(bits.groupBy("parent_asin").agg(*masks), "parent_asin", "left").select(
        "parent_asin", *[F.coalesce(f"{s}_mask", F.lit(0)).alias(f"{s}_mask") for s in SV.MASK_SLOTS])


def evidence_table_violations(masks: DataFrame) -> DataFrame:
    """One row of counts: rows, repeated ids, masks with bits outside the registry."""
    outside = F.lit(False)
    for s in SV.MASK_SLOTS:
        allowed = sum(SV.MASK_BITS[s].values())
        outside = outside | (F.col(f"{s}_mask").bitwiseAND(F.lit(~allowed)) != 0)
    per_id = masks.groupBy("parent_asin").agg(F.count("*").alias("n"), F.max(outside.cast("int")).alias("outside"))
    return per_id.agg(
        F.sum("n").alias("rows"), F.sum((F.col("n") > 1).cast("int")).alias("repeated_ids"), F.sum("outside").alias("outside_registry"))


# ---------------------------------------------------------------- conversation side


def constraint_view(states: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Normalized intent of each conversation state.

    ``states``: query_id, category_text, active_terms, excluded_terms [, classified array<string>].
    Result: category_terms, positive and negative array<struct<slot, value, source>>, exact and excluded-exact terms,
    classified slots; ``keep`` names further columns that stay beside them.
    """
    keep = keep or []
    none = F.array().cast("array<string>")
    words_of = lambda c: canonical(F.array_join(F.filter(c, lambda t: ~t.contains("-")), " "))
    # Written first: the planner would else put the canonical forms into every place that reads them, some two thousand replacements a row.
    rows = write_table(states.select(
        "query_id", *keep, canonical("category_text").alias("cat"), canonical(F.array_join("active_terms", " ")).alias("act"),
        canonical(F.array_join("excluded_terms", " ")).alias("exc"), words_of("active_terms").alias("act_text"), words_of("excluded_terms").alias("exc_text"),
        "active_terms", "excluded_terms", F.col("classified") if "classified" in states.columns else none.alias("classified")), "canonical_states")
    meaningful = lambda v: (v != "") & ~v.isin(*SV.NOISE_VALUES) & ~v.rlike("^[0-9]+$")
    known = extract_slot("cat", "category")
    loose = F.array_distinct(F.filter(
        F.array_except(F.split("cat", " "), "cat_done"), lambda t: (F.length(t) > 1) & ~t.isin(*SV.NOISE_VALUES)))
    category_terms = F.when(F.size(known) > 0, known).when(F.col("cat").isin(*SV.GENERIC_LABELS), none).otherwise(F.array_sort(loose))

    def exact(terms: str, words: str, done: str) -> Column:
        # Terms are single ASCII words, so their canonical forms are the words of the joined canonical text; only
        # hyphenated ones are phrases of their own and are looked at one by one.
        single = F.filter(F.array_except(words, done), meaningful)
        hyphened = F.transform(F.filter(terms, lambda t: t.contains("-")), lambda t: F.trim(F.regexp_replace(t, "-+", " ")))
        paired = F.arrays_zip(hyphened.alias("v"), F.array_repeat(done, F.size(hyphened)).alias("done"))
        phrases = F.filter(paired, lambda p: meaningful(p["v"]) & (F.size(F.array_except(F.split(p["v"], " "), p["done"])) > 0))
        return F.array_sort(F.array_distinct(F.concat(single, F.transform(phrases, lambda p: p["v"]))))

    rows = rows.withColumns({"act_words": F.split("act_text", " "), "exc_words": F.split("exc_text", " ")})
    rows = rows.withColumns({"cat_done": _consumed("cat"), "act_done": _consumed("act"), "exc_done": _consumed("exc")})
    keys = rows.select(
        "query_id", *keep, category_terms.alias("category_terms"), _slot_keys("act").alias("act_keys"), _slot_keys("cat").alias("cat_keys"),
        _slot_keys("exc").alias("exc_keys"), exact("active_terms", "act_words", "act_done").alias("exact_terms"),
        exact("excluded_terms", "exc_words", "exc_done").alias("excluded_exact_terms"), "classified")
    as_struct = lambda k, source: F.struct(
        F.substring_index(k, "=", 1).alias("slot"), F.substring_index(k, "=", -1).alias("value"), source.alias("source"))
    told = lambda keys, source: F.transform(keys, lambda k: F.struct(k.alias("k"), F.lit(source).alias("source")))
    positive = F.array_sort(F.concat(told("act_keys", "active_terms"), told(F.array_except("cat_keys", "act_keys"), "category_text")))
    view = keys.select(
        "query_id", *keep, "category_terms", F.transform(positive, lambda x: as_struct(x["k"], x["source"])).alias("positive"),
        F.transform(F.array_sort("exc_keys"), lambda k: as_struct(k, F.lit("excluded_terms"))).alias("negative"),
        "exact_terms", "excluded_exact_terms", "classified")
    slots = F.array_sort(F.array_distinct(F.concat(
        "classified", F.transform("positive", lambda c: c["slot"]), F.transform("negative", lambda c: c["slot"]))))
    return view.withColumn("classified_slots", slots).drop("classified")


def _slot_keys(text: str) -> Column:
    """``slot=value`` keys of everything the vocabularies find in a canonical text."""
    return _found(text, [(p, f"{s}={v}") for s, words in SV.SLOTS.items() for p, v in words.items()])


def _consumed(text) -> Column:
    """Words of all vocabulary phrases found in a canonical text."""
    every = {p for words in (*SV.SLOTS.values(), SV.CATEGORIES) for p in words}
    return F.array_distinct(F.flatten(F.transform(_found(text, [(p, p) for p in sorted(every)]), lambda p: F.split(p, " "))))


# ---------------------------------------------------------------- subtypes and priors


def product_subtypes(catalog: DataFrame) -> DataFrame:
    """(parent_asin, subtype, observed): canonical leaf category of one to four words.

    Observed subtypes come from the category path; a product whose title names another product's subtype carries it
    as inferred.
    """
    leaf = canonical(F.element_at("categories", -1))
    observed = catalog.filter(F.size("categories") > 0).select("parent_asin", leaf.alias("subtype")).filter(
        (F.col("subtype") != "") & (F.size(F.split("subtype", " ")) <= 4) & ~F.col("subtype").isin(*SV.GENERIC_LABELS))
    names = observed.select("subtype").distinct()
    titles = catalog.select("parent_asin", canonical("title").alias("t"))
    grams = explode_phrases(titles, ["parent_asin"], "t", 4).withColumnRenamed("phrase", "subtype")
    inferred = grams.join(names, "subtype").select("parent_asin", "subtype").distinct()
    return observed.withColumn("observed", F.lit(True)).unionByName(inferred.withColumn("observed", F.lit(False))).groupBy(
        "parent_asin", "subtype").agg(F.max("observed").alias("observed"))


def subtype_stats(subtypes: DataFrame) -> DataFrame:
    return subtypes.groupBy("subtype").agg(F.count("*").alias("document_frequency"))


def resolve_query_subtypes(queries: DataFrame, stats: DataFrame, keep: int = 4) -> DataFrame:
    """Longest, then rarest subtypes named by a category text.  ``queries``: query_id, category."""
    from lodestone.operators.retrieval import rank_within

    named = queries.select("query_id", canonical("category").alias("t"))
    grams = explode_phrases(named, ["query_id"], "t", 4, words=12).withColumnRenamed("phrase", "subtype")
    found = grams.join(stats, "subtype")
    ranked = rank_within(found, F.desc(F.size(F.split("subtype", " "))), F.asc("document_frequency"), F.asc("subtype"), name="place")
    return ranked.filter(F.col("place") <= keep).select("query_id", "subtype", "place")


def subtype_priors(catalog: DataFrame, stats: DataFrame) -> DataFrame:
    """Percentiles of shrunk rating and of rating count among products of the same leaf category."""
    one = stats.select("mean_rating", "median_rating_number")
    shrunk = (F.col("rating_number") * F.col("average_rating") + F.col("median_rating_number") * F.col("mean_rating")) / (
        F.col("rating_number") + F.col("median_rating_number"))
    rows = catalog.crossJoin(F.broadcast(one)).select(
        "parent_asin", canonical(F.element_at("categories", -1)).alias("subtype"), F.round(shrunk, 9).alias("bayes"),
        F.col("rating_number").cast("double").alias("count"))
    ratings = percent_ranks(rows, ["subtype"], "bayes", "bayesian_rating_percentile")
    counts = percent_ranks(rows, ["subtype"], "count", "popularity_percentile")
    return rows.join(ratings, ["subtype", "bayes"]).join(counts, ["subtype", "count"]).select(
        "parent_asin", "subtype", "bayesian_rating_percentile", "popularity_percentile")
