"""Exact lexical top-k over blocks of postings with their largest impact.

Products are numbered in the order of their ids.  Those with the same weighted terms and length have the same score for every
query and form one class; classes are numbered by their first product and cut into ranges.  The postings of a term inside a range are one
block: class numbers, impacts (a query multiplies them by the term's weight alone) and the largest impact.  Blocks are laid out by term, so
a set of query terms reads its own blocks only.

Queries with the same known terms are answered once.  A query is routed to the ranges by its terms' block maxima.  The ranges with the
highest bounds are searched first, each for its share
of the k results, and give a place (score and product number) that the k-th result cannot fall behind; then only ranges whose
bound reaches that score are searched, and what lies behind that place is not handed on.  So a query hands on a few k rows however
many ranges there are, also where a score is shared by any number of products.  Inside a range, terms of high impact make candidates
until the rest of the terms together could no longer lift a new class to the threshold; those terms are only looked up for candidates
that can still reach it.  The k best classes by score and first product hold the k best products; they are told product by product.
Scores are compared as whole billionths and equal ones by product number, so ties are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vocab as V
from lodestone.session import write_table

RANGE = 8192  # classes of a range
QUERIES = 262_144  # queries that one task answers for a range
TASKS = 32  # groups of (range, queries) aimed at where ranges are few
FEWEST = 64  # queries that are worth a task of their own
ROUTED = 8192  # queries that one task routes
PROBED = 4  # one range in so many is searched for the threshold
UNIT = 1e9  # scores are rounded to nine places
SLACK = 1e-7  # above what rounding to nine places and the order of a sum can change
PUSHED_TERMS = 10_000


@dataclass(frozen=True)
class BlockIndex:
    blocks: DataFrame   # term, range, n, peak, docs array<int> (classes), impacts array<double>
    names: DataFrame    # doc, parent_asin
    members: DataFrame  # range, place (class in its range), nth, doc


def numbered(rows: DataFrame, key: str = "parent_asin", number: str = "doc") -> DataFrame:
    """``rows`` with numbers from 0 in the order of a key."""
    columns = rows.columns
    rows = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id())
    rows = write_table(rows.select(*columns, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_row")), "numbered")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the sort
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(parts, "_part").select(*columns, (F.col("_before") + F.col("_row")).alias(number))


def build_blocks(postings: DataFrame, documents: DataFrame, totals: DataFrame, folder: str, products: int = RANGE) -> BlockIndex:
    """Blocks of (parent_asin, term, wtf) postings, sorted by term inside files that hold whole terms."""
    spark = postings.sparkSession
    numbered(documents.select("parent_asin", "doc_len")).write.parquet(f"{folder}/names")
    names = spark.read.parquet(f"{folder}/names")
    content = F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(" ", "term", F.col("wtf").cast("string"))))), 256)
    postings.groupBy("parent_asin").agg(content.alias("content")).join(names, "parent_asin").write.parquet(f"{folder}/contents")
    contents = spark.read.parquet(f"{folder}/contents")
    same = ["content", "doc_len"]
    classes = numbered(contents.groupBy(*same).agg(F.min("doc").alias("doc")), "doc", "class").select(
        *same, F.col("doc").alias("first"), F.floor(F.col("class") / products).cast("int").alias("range"), (F.col("class") % products).cast("int").alias("place"))
    classes.write.parquet(f"{folder}/classes")
    classes = spark.read.parquet(f"{folder}/classes")
    nth = F.row_number().over(Window.partitionBy("range", "place").orderBy("doc"))
    contents.join(classes, same).select("range", "place", nth.alias("nth"), "doc").write.parquet(f"{folder}/members")
    k1, b = V.BM25_K1, V.BM25_B
    impact = F.col("wtf") * (k1 + 1) / (F.col("wtf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len")))
    firsts = classes.join(names.select(F.col("doc").alias("first"), "parent_asin"), "first").select("parent_asin", "doc_len", "range", "place")
    rows = postings.select("parent_asin", "term", "wtf").join(firsts, "parent_asin").crossJoin(F.broadcast(totals.select("avg_len")))
    rows = rows.select("term", "range", F.struct(F.col("place").alias("doc"), impact.alias("impact")).alias("p"))
    listed = rows.groupBy("term", "range").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # at most a range's classes
    blocks = listed.select(
        "term", "range", F.size("ps").alias("n"), F.array_max(F.col("ps.impact")).alias("peak"), F.col("ps.doc").alias("docs"), F.col("ps.impact").alias("impacts"))
    blocks.repartitionByRange("term").sortWithinPartitions("term", "range").write.parquet(f"{folder}/blocks")
    return BlockIndex(spark.read.parquet(f"{folder}/blocks"), names, spark.read.parquet(f"{folder}/members"))


def _lists():
    """A reader of list columns; made here and handed on, so that workers need not import this module."""
    def read(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Values of a column of lists without nulls, and where each list begins and ends among them."""
        if not len(column):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        whole = pa.concat_arrays(column.chunks)
        sizes = whole.value_lengths().to_numpy(zero_copy_only=False)
        return whole.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))
    return read


def _routed(every: bool):
    """Ranges of every query with their bounds, the highest first."""
    lists = _lists()

    def route(key, peaks, queries):
        ranges, at = lists(peaks.column("ranges"))
        bounds, _ = lists(peaks.column("bounds"))
        place = {t: i for i, t in enumerate(peaks.column("term").to_pylist())}
        total, present = np.zeros(int(ranges.max(initial=0)) + 1), np.zeros(int(ranges.max(initial=0)) + 1, np.int32)
        terms, cut = lists(queries.column("terms"))
        out_ranges, out_bounds = [], []
        for i in range(queries.num_rows):
            own = terms[cut[i]:cut[i + 1]].tolist()
            total[:], present[:] = 0.0, 0
            for t in own:
                span = slice(at[place[t]], at[place[t] + 1])
                total[ranges[span]] += bounds[span]
                present[ranges[span]] += 1
            some = np.flatnonzero(present >= (len(own) if every else 1))
            some = some[np.argsort(-total[some], kind="stable")]
            out_ranges.append(some.astype(np.int32))
            out_bounds.append(total[some])
        return pa.table({
            "q": queries.column("q"), "part": queries.column("part"), "terms": queries.column("terms"),
            "ranges": pa.array(out_ranges, pa.list_(pa.int32())), "bounds": pa.array(out_bounds, pa.list_(pa.float64()))})
    return route


def _answer(k: int, every: bool, products: int, counting: bool):
    """Answers the queries of one (range, group): rows (q, doc, nano), or the number of scored classes per query.

    No row lies behind the place (``theta`` billionths, product ``last``) that a query names.
    """
    def first(nanos: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
        """Places of the ``k`` highest scores, equal ones by product number."""
        if len(nanos) > k:
            kth = np.partition(nanos, len(nanos) - k)[len(nanos) - k]
            above, equal = np.flatnonzero(nanos > kth), np.flatnonzero(nanos == kth)
            return np.concatenate([above, equal[np.argsort(docs[equal], kind="stable")[:k - len(above)]]])
        return np.arange(len(nanos))

    read = _lists()

    def answer(key, blocks, queries):
        known = blocks.filter(pc.is_valid(blocks.column("term")))
        lists = {
            t: (d.values.to_numpy(), i.values.to_numpy(), p, w)
            for t, d, i, p, w in zip(known.column("term").to_pylist(), known.column("docs"), known.column("impacts"), known.column("peak").to_pylist(), known.column("idf").to_pylist())}
        classes = blocks.filter(pc.is_null(blocks.column("term")))
        places, _ = read(classes.column("docs"))
        held, cut = read(classes.column("members"))
        begin, size = np.zeros(products, np.int64), np.zeros(products, np.int64)
        begin[places], size[places] = cut[:-1], np.diff(cut)

        def told(docs: np.ndarray, nanos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Products of classes as far as they can be among the ``k`` best."""
            best = first(nanos, held[begin[docs]], k)
            best = best[np.argsort(-nanos[best], kind="stable")]
            docs, nanos = docs[best], nanos[best]
            sizes = size[docs]
            ahead = (np.cumsum(sizes) - sizes)[np.searchsorted(-nanos, -nanos)]  # products of higher scores
            docs, nanos, sizes = docs[ahead < k], nanos[ahead < k], sizes[ahead < k]
            at = np.repeat(begin[docs] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            return held[at], np.repeat(nanos, sizes)

        score, touched = np.zeros(products), np.zeros(products, bool)
        terms, span = read(queries.column("terms"))
        out_query, out_doc, out_nano = [], [], []
        for row, (query, theta, last) in enumerate(zip(*(queries.column(c).to_pylist() for c in ("q", "theta", "last")))):
            wanted = terms[span[row]:span[row + 1]].tolist()
            own = [lists[t] for t in wanted if t in lists]
            if not own or (every and len(own) < len(wanted)):
                continue
            least = -np.inf if theta is None else theta / UNIT - SLACK
            if every:
                own.sort(key=lambda x: len(x[0]))
                docs, raw = own[0][0], own[0][1] * own[0][3]
                for other, impact, _, w in own[1:]:
                    at = np.minimum(np.searchsorted(other, docs), len(other) - 1)
                    both = other[at] == docs
                    docs, raw = docs[both], raw[both] + impact[at[both]] * w
                pairs = len(own[0][0])
            else:
                own.sort(key=lambda x: -x[2] * x[3])
                rest = np.append(np.cumsum([x[2] * x[3] for x in own][::-1])[::-1], 0.0)
                seen, used = [], 0
                for docs, impact, _, w in own:
                    if rest[used] < least:
                        break
                    score[docs] += impact * w
                    seen.append(docs[~touched[docs]])
                    touched[seen[-1]] = True
                    used += 1
                    if used < len(own) and sum(map(len, seen)) >= k:
                        partial = score[np.concatenate(seen)]
                        least = max(least, np.partition(partial, len(partial) - k)[len(partial) - k] - SLACK)
                docs = np.concatenate(seen) if seen else np.zeros(0, np.int32)
                raw = score[docs]
                score[docs], touched[docs] = 0.0, False
                fits = raw + rest[used] >= least
                docs, raw = docs[fits], raw[fits]
                pairs = len(docs)
                for i in range(used, len(own)):
                    other, impact, _, w = own[i]
                    at = np.minimum(np.searchsorted(other, docs), len(other) - 1)
                    raw = raw + np.where(other[at] == docs, impact[at] * w, 0.0)
                    fits = raw + rest[i + 1] >= least
                    docs, raw = docs[fits], raw[fits]
            nanos = np.floor(raw * UNIT + 0.5).astype(np.int64)
            if counting:
                docs, nanos = np.zeros(1, np.int64), np.array([pairs])
            else:
                if theta is not None:
                    fits = (nanos > theta) | ((nanos == theta) & (held[begin[docs]] <= last))
                    docs, nanos = docs[fits], nanos[fits]
                docs, nanos = told(docs, nanos)
                if theta is not None:
                    fits = (nanos > theta) | (docs <= last)
                    docs, nanos = docs[fits], nanos[fits]
                best = first(nanos, docs, k)
                docs, nanos = docs[best], nanos[best]
            out_query.append(np.full(len(docs), query, np.int64))
            out_doc.append(docs)
            out_nano.append(nanos)
        empty = [np.zeros(0, np.int64)]
        return pa.table({
            "range": pa.array(np.full(sum(map(len, out_doc)), key[0].as_py(), np.int32)), "q": pa.array(np.concatenate(out_query or empty)), "doc": pa.array(np.concatenate(out_doc or empty)), "nano": pa.array(np.concatenate(out_nano or empty))})
    return answer


def _searched(index: BlockIndex, asked: DataFrame, wanted: DataFrame, k: int, every: bool, products: int, counting: bool) -> DataFrame:
    """Answers (range, q, doc, nano) of ``asked``: range, part, q, terms, theta, last.  ``wanted``: part, term, id, idf."""
    keys = ["range", "part"]
    groups = asked.select(*keys).distinct()
    needed = index.blocks.join(wanted, "term").join(groups, keys, "left_semi").select(
        *[F.col(c).alias(c) for c in keys], F.col("id").alias("term"), "idf", "peak", "docs", "impacts", F.lit(None).cast("array<long>").alias("members"))
    members = index.members.where(F.col("nth") <= k).groupBy("range", "place").agg(F.array_sort(F.collect_list("doc")).alias("members")).join(groups, "range").select(
        *[F.col(c).alias(c) for c in keys], *[F.lit(None).cast(t).alias(c) for c, t in (("term", "long"), ("idf", "double"), ("peak", "double"))],
        F.array("place").alias("docs"), F.lit(None).cast("array<double>").alias("impacts"), "members")
    return needed.unionByName(members).groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        _answer(k, every, products, counting), "range int, q long, doc long, nano long")


def search(index: BlockIndex, term_rows: DataFrame, term_stats: DataFrame, k: int, every: bool = False, products: int = RANGE, counting: bool = False) -> DataFrame:
    """(query_id, parent_asin, score, rank): the ``k`` best products of each query, equal scores by id.

    ``term_rows``: query_id, term, n_terms.  With ``every``, products must hold all terms of the query.  With ``counting``, the rows are
    (query_id, pairs): how many classes of products were scored.
    """
    term_rows = term_rows.join(term_stats.select("term", "idf"), "term")
    known = F.array_sort(F.collect_list("term"))
    queries = term_rows.groupBy("query_id", "n_terms").agg(F.concat_ws(" ", known).alias("known"), F.count("*").alias("n"))
    if every:
        queries = queries.where("n = n_terms")
    queries = write_table(queries.select("query_id", "known"), "queries")
    different = write_table(queries.select("known").distinct().withColumn("q", F.monotonically_increasing_id()), "different_queries")
    blocks = index.blocks
    words = different.select(F.explode(F.split("known", " ")).alias("term")).distinct()
    vocabulary = write_table(words.join(term_stats.select("term", "idf"), "term").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    terms = [r[0] for r in vocabulary.select("term").limit(PUSHED_TERMS + 1).collect()]
    if len(terms) <= PUSHED_TERMS:  # pushed to the scan; beyond, the join by term does the same
        blocks = blocks.where(F.col("term").isin(terms))
    index = BlockIndex(blocks, index.names, index.members)
    total, ranges = different.count(), (index.members.agg(F.max("range")).first()[0] or 0) + 1
    parts = max(1, -(-total // QUERIES), min(total // FEWEST, TASKS // ranges))
    routed = max(1, -(-total // ROUTED))
    requests = write_table(
        different.select("q", F.explode(F.split("known", " ")).alias("term")).join(vocabulary.select("term", "id"), "term")
        .groupBy("q").agg(F.array_sort(F.collect_list("id")).alias("terms")).select(
            "q", "terms", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int").alias("part"), F.pmod(F.xxhash64(F.lit(1), "q"), F.lit(routed)).cast("int").alias("desk")), "requests")
    spoken = requests.select("desk", F.explode("terms").alias("id")).distinct()
    peaks = blocks.select("term", "range", "peak").join(vocabulary, "term").groupBy("id").agg(
        F.collect_list(F.struct("range", (F.col("peak") * F.col("idf")).alias("bound"))).alias("ps"))
    peaks = peaks.join(spoken, "id").select(F.col("desk").alias("desk"), F.col("id").alias("term"), F.col("ps.range").alias("ranges"), F.col("ps.bound").alias("bounds"))
    bounds = write_table(peaks.groupBy("desk").cogroup(requests.groupBy("desk")).applyInArrow(
        _routed(every), "q long, part int, terms array<long>, ranges array<int>, bounds array<double>"), "bounds")
    wanted = write_table(requests.select("part", F.explode("terms").alias("id")).distinct().join(vocabulary, "id"), "wanted")
    probes = max(1, ranges // PROBED)
    share = k if probes == 1 else min(k, 2 * -(-k // probes) + 8)
    open_end = [F.lit(None).cast("long").alias(c) for c in ("theta", "last")]
    best = bounds.select(F.explode(F.slice("ranges", 1, probes)).alias("range"), "part", "q", "terms", *open_end)
    first = write_table(_searched(index, best, wanted, share, every, products, False), "first")
    place = Window.partitionBy("q").orderBy(F.desc("nano"), "doc")  # at most a share per probed range
    kth = write_table(first.withColumn("_n", F.row_number().over(place)).where(F.col("_n") == k).select(
        "q", F.col("nano").alias("theta"), F.col("doc").alias("last")), "thresholds")
    # A probed range is told in full unless it gave its whole share and the last row of it still lies before the threshold.
    told = first.groupBy("q", "range").agg(F.count("*").alias("_rows"), F.min("nano").alias("_least"))
    more = told.join(kth, "q", "left").where((F.col("_rows") >= share) & F.lit(share < k) & F.coalesce(F.col("_least") >= F.col("theta"), F.lit(True)))
    more = write_table(more.select("q", "range"), "unfinished")
    again = more.groupBy("q").agg(F.collect_set("range").alias("again"))
    rest = bounds.join(kth, "q", "left").join(again, "q", "left").select(
        "q", "part", "terms", "theta", "last", "again", F.posexplode(F.arrays_zip("ranges", "bounds")).alias("_at", "r"))
    rest = rest.where((F.col("_at") >= probes) | F.coalesce(F.array_contains("again", F.col("r.ranges")), F.lit(False))).where(
        F.coalesce(F.col("r.bounds") >= F.col("theta") / UNIT - SLACK, F.lit(True)))
    rest = rest.select(F.col("r.ranges").alias("range"), "part", "q", "terms", "theta", "last")
    if counting:
        head = _searched(index, best, wanted, share, every, products, True)
        tail = _searched(index, rest, wanted, k, every, products, True)
        pairs = head.union(tail).groupBy("q").agg(F.sum("nano").cast("long").alias("pairs"))
        return queries.join(different, "known").join(pairs, "q").select("query_id", "pairs")
    head = first.join(more, ["q", "range"], "left_anti").select("q", "doc", "nano")
    found = head.union(_searched(index, rest, wanted, k, every, products, False).select("q", "doc", "nano")) if ranges > 1 else head
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    named = ranked.join(index.names.select("doc", "parent_asin"), "doc")
    return queries.join(different, "known").join(named, "q").select(
        "query_id", "parent_asin", F.round(F.col("nano") / UNIT, 9).alias("score"), "rank")
