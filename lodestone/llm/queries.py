"""Registered queries of the pipeline operators, each over its whole table."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jpeg, language, segmentations, urls
from lodestone.llm.centroids import clusters
from lodestone.llm.common import table
from lodestone.llm.embeddings import linked_vectors
from lodestone.llm.lines import line_members
from lodestone.llm.minhash import near_duplicates
from lodestone.llm.packing import packed
from lodestone.llm.phrases import collocations
from lodestone.llm.repeats import without_repeats
from lodestone.llm.toxicity import fit, score
from lodestone.llm.wrappers import main_texts
from lodestone.session import write_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


YEAR = 366 * 86400
START = 1704067200  # 2024-01-01, in seconds


def _draw(column: Column, salt: str) -> Column:
    """A number below 2^28 from the digest of a value."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", column.cast("string"), F.lit(salt))), 1, 7), 16, 10).cast("long")


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries about the hosts and domains of the pages: five changes in a year, by the digest of the name."""
    names = pages.select(F.explode(urls.domains(urls.host(F.col("url")))).alias("domain")).distinct()
    lists = names.crossJoin(F.broadcast(names.sparkSession.createDataFrame([("block", 3), ("allow", 5)], "list string, rare long")))
    drawn = lists.where(_draw(F.concat_ws("|", "domain", "list"), "in") % F.col("rare") == 0)
    changes = drawn.select("list", "domain", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    at = START + _draw(F.concat_ws("|", "domain", "list", "k"), "at") % YEAR
    return changes.select("list", "domain", (F.col("k") % 2 == 0).alias("listed"), at.alias("at"))


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, each fetched at a time of its own, against the list entries that were valid then."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    captures = pages.withColumn("fetched", START + _draw(F.col("page_id"), "fetched") % YEAR)
    return urls.filtered(captures, list_entries(pages))


_DRAW = "CAST('0x' || substr(md5(CAST({0} AS VARCHAR) || '|{1}'), 1, 7) AS BIGINT)"
ORACLES["op1_url_filter"] = f"""
WITH captures AS (
  SELECT page_id, url, {START} + {_DRAW.format("page_id", "fetched")} % {YEAR} AS fetched,
         nullif(lower(regexp_extract(url, '{urls.HOST}', 1)), '') AS host FROM pages),
labels AS (SELECT host, string_split(host, '.') AS parts FROM (SELECT DISTINCT host FROM captures WHERE host IS NOT NULL)),
names AS (
  SELECT host, array_to_string(parts[k:], '.') AS domain
  FROM labels, unnest(range(1, greatest(len(parts), 2))) AS t(k)),
entries AS (
  SELECT list, domain, k % 2 = 0 AS listed, {START} + {_DRAW.format("domain || '|' || list || '|' || k", "at")} % {YEAR} AS moment
  FROM (SELECT DISTINCT domain FROM names), (VALUES ('block', 3), ('allow', 5)) AS l(list, rare), range(5) AS r(k)
  WHERE {_DRAW.format("domain || '|' || list", "in")} % rare = 0),
states AS (SELECT list, domain, moment, bool_and(listed) AS listed FROM entries GROUP BY list, domain, moment),
spans AS (SELECT *, lead(moment) OVER (PARTITION BY list, domain ORDER BY moment) AS until FROM states),
valid AS (
  SELECT c.host, c.fetched, s.domain, s.list,
         row_number() OVER (PARTITION BY c.host, c.fetched ORDER BY length(s.domain) DESC, s.list = 'allow' DESC, s.list DESC, s.domain DESC) AS place
  FROM (SELECT DISTINCT host, fetched FROM captures) c JOIN names n ON n.host = c.host
  JOIN spans s ON s.domain = n.domain AND s.listed AND s.moment <= c.fetched AND (s.until IS NULL OR c.fetched < s.until))
SELECT c.page_id, c.url, c.fetched, c.host, v.domain AS listed_domain, v.list, coalesce(v.list <> 'block', true) AS kept
FROM captures c LEFT JOIN valid v ON v.host = c.host AND v.fetched = c.fetched AND v.place = 1
"""


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents with their near-duplicate class at two edits, and whether they stay."""
    return line_members(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without 50-byte strings of documents with smaller ids."""
    cut = without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), with_text=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose crc32 of the id is not 2 modulo 4."""
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    labelled = table(spark, sf_dir, "documents", F.col("doc_id").alias("id"), "text", "lang", part.alias("part")).where("part <> 2")
    found = language.identify(table(spark, sf_dir, "documents", "doc_id", "text"), language.fit(labelled))
    return found.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def toxicity_model(spark: SparkSession, sf_dir: str):
    """The classifier learned from the labelled documents whose crc32 of the id is not divisible by five."""
    labels = table(spark, sf_dir, "labels", F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    learned = F.crc32(F.col("id").cast("string")) % 5 != 0
    # The same condition on both sides of their join: no other text is moved.
    return fit(labels.where(learned), table(spark, sf_dir, "documents", F.col("doc_id").alias("id"), "text").where(learned))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    scored = score(table(spark, sf_dir, "documents", "doc_id", "text"), toxicity_model(spark, sf_dir))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packed(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op7_sentencepiece_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four different segmentations of every document, sampled without replacement: their ids, and whether those decode to the text."""
    return segmentations.sampled(table(spark, sf_dir, "documents", "doc_id", "text"))


def _media_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for media in batch.column("media").to_pylist():
            image = jpeg.decode(media)
            payload = jpeg.payload_of(image)
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-16:]))
            out["media_bytes"].append(len(media))
            out["media_sha256"].append(hashlib.sha256(media).hexdigest())
            out["feature"].append(jpeg.feature(jpeg.tensor(image)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), *map(pa.array, out.values())],
            ["doc_id", "n_bytes", *out])


@query
def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as progressive JPEG media, then read back, decoded and described."""
    media = write_table(jpeg.stored(table(spark, sf_dir, "documents", "doc_id", "text")), "media", compression="zstd")
    return media.mapInArrow(
        _media_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


@query
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), percent=85)


@query
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings at a cosine of 0.9."""
    return linked_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of each language over all documents."""
    return collocations(table(spark, sf_dir, "documents", "text", "lang"))


_PIECES = r"[.,;:!?\x0A-\x0D]"
ORACLES["op11_phrase_collocations"] = f"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT doc, lang, unnest(string_split_regex(text, '{_PIECES}')) AS piece FROM docs),
rows AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM rows), (VALUES (1), (2), (3)) AS t(k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
parts AS MATERIALIZED (SELECT lang, array_to_string(p, ' ') AS part, f FROM grams WHERE k < 3 AND f >= 10),
cuts AS MATERIALIZED (
  SELECT lang, p, f AS a, j, array_to_string(p[1:j], ' ') AS head, array_to_string(p[j + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM grams WHERE k >= 2 AND f >= 10)),
cut AS (
  SELECT c.*, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN parts x ON x.lang = c.lang AND x.part = c.head JOIN parts y ON y.lang = c.lang AND y.part = c.tail),
lowest AS MATERIALIZED (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
inner_parts AS (
  SELECT lang, q, max(a) AS most FROM (SELECT lang, unnest([p[1:2], p[2:3]]) AS q, a FROM lowest WHERE len(p) = 3) GROUP BY lang, q),
rest AS (
  SELECT s.*, array_to_string(p, ' ') AS phrase FROM lowest s LEFT JOIN inner_parts i ON i.lang = s.lang AND i.q = s.p
  WHERE i.most IS NULL OR 100 * i.most < 50 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM rest JOIN totals USING (lang) QUALIFY rank <= 2000
"""


@query
def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return main_texts(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 finite components in eight clusters."""
    return clusters(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def _rounds(k: int, rounds: int, size: int) -> str:
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT row, vec_id, d, CAST(floor(1024 * CAST(embedding[d] AS DOUBLE)) AS HUGEINT) AS x
  FROM kept, unnest(range(1, {size + 1})) AS t(d)),
first AS (
  SELECT row, row_number() OVER (ORDER BY sha256('3:' || vec_id), row) - 1 AS cluster FROM kept WHERE vec_id IS NOT NULL
  QUALIFY cluster < {k}),
c0 AS MATERIALIZED (SELECT cluster, d, x AS c FROM x JOIN first USING (row))"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT row, cluster, distance FROM (SELECT row, cluster, sum((x - c) * (x - c)) AS distance FROM x JOIN c{r} USING (d) GROUP BY row, cluster)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT cluster, d, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{r} LEFT JOIN (
    SELECT cluster, d, CAST(sum(x) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM x JOIN a{r} USING (row) GROUP BY cluster, d) USING (cluster, d))""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256
FROM a{rounds} JOIN kept USING (row)
JOIN (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS digest FROM c{rounds} GROUP BY cluster) USING (cluster)"""


ORACLES["op13_centroid_clusters"] = _rounds(8, 10, 64)
