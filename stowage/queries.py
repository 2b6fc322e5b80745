"""The registered queries over whole tables, each with the same rows as DuckDB SQL.

Objects come from the catalogs of ``sources.tables``. Sizes at which objects
are cut are scaled to them: 8 KiB instead of 8 MiB.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions.selectors import EntryFilter, Selector, filter_kind, input_kind, literal_prefix_of
from stowage.functions.urls import url_columns
from stowage.operators import events as log
from stowage.operators import extract, parts, verify
from stowage.plans import create, index
from stowage.plans.scale import checkpoint_dir
from stowage.sources.catalog import with_versions
from stowage.sources.tables import bucket, byte_length, catalog, document_key, line_items, table, versions
from stowage.sources.tar import register

CHUNK = THRESHOLD = 8192

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DOCUMENTS = "SELECT 'documents' AS bucket, lang || '/' || source || '/' || doc_id || '.txt' AS key, NULL::VARCHAR AS version_id, coalesce(strlen(text), 0)::BIGINT AS size, TIMESTAMP '2024-01-01' + to_seconds(doc_id % 97) AS t FROM documents"
PAGES = "SELECT 'pages' AS bucket, page_id || '.html' AS key, NULL::VARCHAR AS version_id, coalesce(strlen(html), 0)::BIGINT AS size, TIMESTAMP '2024-01-01' + to_seconds(page_id) AS t FROM pages"
EVENTS = "SELECT 'events' AS bucket, event_type || '/' || user_id || '/' || event_id || '.json' AS key, NULL::VARCHAR AS version_id, coalesce(strlen(props), 0)::BIGINT AS size, ts AS t FROM events"
ORDERS = "SELECT 'orders' AS bucket, o_orderstatus || '/' || o_orderpriority || '/' || o_orderkey AS key, NULL::VARCHAR AS version_id, floor(o_totalprice)::BIGINT AS size, o_orderdate AS t FROM orders"
ALL = f"objects AS ({DOCUMENTS} UNION ALL {PAGES} UNION ALL {EVENTS} UNION ALL {ORDERS})"
#: Header, data and padding of every object's entry, and its place in the archive.
LAYOUT = """lens AS (
  SELECT *, CASE WHEN strlen(key) <= 100 THEN 512 ELSE 1024 + (strlen(key) + 1 + 511) // 512 * 512 END::BIGINT AS header_len, ((512 - size % 512) % 512)::BIGINT AS pad_len FROM objects
), placed AS (
  SELECT *, header_len + size + pad_len AS entry_len, row_number() OVER w - 1 AS position, coalesce(sum(header_len + size + pad_len) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS header_offset
  FROM lens WINDOW w AS (ORDER BY t, bucket, key, version_id)
)"""
#: Download parts: cut from the threshold on, and an empty object is one part.
PARTS = """cut AS (
  SELECT *, CASE WHEN size < 8192 THEN 1 ELSE (size + 8191) // 8192 END AS n FROM objects
), parts AS (
  SELECT bucket, key, version_id, size AS object_size, i::INT AS part_number, i * 8192 AS range_start, least(size, CASE WHEN n = 1 THEN size ELSE (i + 1) * 8192 END) AS range_end
  FROM (SELECT *, unnest(range(0, n)) AS i FROM cut)
)"""


def query(sql: str | None):
    """Registers a query and its SQL."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# Inputs


@query(r"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS bucket, nullif(regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1), '') AS key FROM pages")
def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheme, bucket and key of every page's URL."""
    return table(spark, sf_dir, "pages").select("page_id", *(c.alias(n) for n, c in url_columns(F.col("url")).items()))


def input_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of every kind, made from the keys of documents."""
    texts = F.array(F.lit(""), F.concat("lang", F.lit("/")), F.concat("lang", F.lit("/**")), F.concat_ws("/", "lang", "source", F.lit("[0-9]?.txt")), document_key(), F.concat(F.lit("/"), document_key()))
    return table(spark, sf_dir, "documents").select(F.explode(texts).alias("input")).distinct()


INPUTS = "inputs AS (SELECT DISTINCT unnest(['', lang || '/', lang || '/**', lang || '/' || source || '/[0-9]?.txt', lang || '/' || source || '/' || doc_id || '.txt', '/' || lang || '/' || source || '/' || doc_id || '.txt']) AS input FROM documents)"


@query(f"WITH {INPUTS} SELECT input, CASE WHEN input = '' THEN 'bucket' WHEN regexp_matches(input, '[*?\\[\\]]') THEN 'glob' WHEN input LIKE '%/' THEN 'prefix' ELSE 'object' END AS kind FROM inputs")
def classify_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of inputs of archives."""
    return input_texts(spark, sf_dir).withColumn("kind", input_kind(F.col("input")))


@query(f"WITH {INPUTS} SELECT input, CASE WHEN input IN ('', '/') THEN 'error' WHEN regexp_matches(input, '[*?\\[\\]]') THEN 'glob' WHEN input LIKE '%/' THEN 'prefix' ELSE 'object' END AS kind FROM inputs")
def classify_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of the same texts as filters of entries."""
    return input_texts(spark, sf_dir).withColumn("kind", filter_kind(F.col("input")))


@query(f"WITH {INPUTS} SELECT input, regexp_extract(input, '^([^*?\\[\\]]*)', 1) AS prefix FROM inputs")
def glob_literal_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every match of a glob begins with."""
    return input_texts(spark, sf_dir).withColumn("prefix", literal_prefix_of(F.col("input")))


# Selection


def selected(spark: SparkSession, sf_dir: str, name: str, text: str | None) -> DataFrame:
    return bucket(spark, sf_dir, name).where(Selector.parse(text).predicate()).select("bucket", "key", "size")


def selection(objects: str, condition: str) -> str:
    return f"SELECT bucket, key, size FROM ({objects}) WHERE {condition}"


@query(selection(DOCUMENTS, "true"))
def select_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objects of a bucket."""
    return selected(spark, sf_dir, "documents", None)


@query(selection(DOCUMENTS, "starts_with(key, 'en/src7/') AND instr(substr(key, 9), '/') = 0"))
def select_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct children of a prefix."""
    return selected(spark, sf_dir, "documents", "en/src7/")


@query(selection(PAGES, "key = '7.html'"))
def select_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object."""
    return selected(spark, sf_dir, "pages", "7.html")


@query(selection(DOCUMENTS, r"regexp_matches(key, '(?s)^en/[^/]*/1[^/]*\.txt\z')"))
def select_glob_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars stay inside a path component."""
    return selected(spark, sf_dir, "documents", "en/*/1*.txt")


@query(selection(EVENTS, r"regexp_matches(key, '(?s)^(.*/)?1[^/]*\.json\z')"))
def select_glob_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stars cross components."""
    return selected(spark, sf_dir, "events", "**/1*.json")


@query(selection(ORDERS, "regexp_matches(key, '(?s)^[FO]/[1-3]-[^/]*/[^/]*[^0-4/]\\z')"))
def select_glob_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of characters, one of them negated."""
    return selected(spark, sf_dir, "orders", "[FO]/[1-3]-*/*[!0-4]")


@query(selection(DOCUMENTS, r"regexp_matches(key, '(?s)^[^/]s/src[^/]/[^/][^/]\.txt\z')"))
def select_glob_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question mark is one character."""
    return selected(spark, sf_dir, "documents", "?s/src?/??.txt")


# Plan


@query(
    f"WITH objects AS ({DOCUMENTS}), versions AS (SELECT lang || '/' || source || '/' || doc_id || '.txt' AS key, 'v' || (doc_id % 5) AS v FROM documents WHERE doc_id % 3 <> 0) "
    "SELECT bucket, key, v AS version_id, size FROM objects LEFT JOIN versions USING (key)"
)
def version_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed documents with their current versions."""
    return with_versions(bucket(spark, sf_dir, "documents"), versions(spark, sf_dir)).select("bucket", "key", "version_id", "size")


#: Inputs that overlap, and one that matches nothing.
SEVERAL = ("en/src7/", "en/**", "**/1*.txt", "fr/src4/8.txt", "xx/**")
SEVERAL_SQL = {
    0: "starts_with(key, 'en/src7/') AND instr(substr(key, 9), '/') = 0",
    1: "starts_with(key, 'en/')",
    2: r"regexp_matches(key, '(?s)^(.*/)?1[^/]*\.txt\z')",
    3: "key = 'fr/src4/8.txt'",
    4: "starts_with(key, 'xx/')",
}


def several() -> list[Selector]:
    return [Selector.parse(s) for s in SEVERAL]


@query(f"WITH objects AS ({DOCUMENTS}) " + " UNION ALL ".join(f"SELECT {i}::INT AS ordinal, bucket, key, size FROM objects WHERE {c}" for i, c in SEVERAL_SQL.items()))
def union_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All inputs as a bag, from one scan."""
    return create.union_inputs(bucket(spark, sf_dir, "documents"), several()).select("ordinal", "bucket", "key", "size")


@query("SELECT 'lineitem' AS bucket, l_orderkey || '/' || l_linenumber AS key, arg_min(size, (l_shipdate, size)) AS size FROM (SELECT *, floor(l_extendedprice)::BIGINT AS size FROM lineitem) GROUP BY l_orderkey, l_linenumber")
def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object once: the first in archive order."""
    return create.dedupe(line_items(spark, sf_dir)).select("bucket", "key", "size")


@query(
    f"WITH objects AS ({DOCUMENTS}) "
    + " UNION ALL ".join(
        f"SELECT {i}::INT AS ordinal, '{s.kind}' AS kind, '{s.value}' AS value, count(*) AS n_objects, coalesce(sum(size), 0)::BIGINT AS n_bytes FROM objects WHERE {SEVERAL_SQL[i]}" for i, s in enumerate(Selector.parse(s) for s in SEVERAL)
    )
)
def input_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every input matches, from one scan."""
    return create.match_counts(bucket(spark, sf_dir, "documents"), several())


@query(f"WITH {ALL} SELECT bucket, key, size, row_number() OVER (ORDER BY t, bucket, key, version_id) - 1 AS position FROM objects")
def plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every object in the archive."""
    return create.in_order(catalog(spark, sf_dir)).select("bucket", "key", "size", "position")


@query(f"WITH {ALL} SELECT count(*) AS n_objects, coalesce(sum(size), 0)::BIGINT AS n_bytes, (coalesce(sum(size), 0) + 512 * count(*))::BIGINT AS estimated_bytes FROM objects")
def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and bytes of the objects, and the estimate of the archive's size."""
    return create.totals(catalog(spark, sf_dir))


# Parts


@query(f"WITH {ALL}, {PARTS} SELECT * FROM parts")
def object_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Download parts of all objects."""
    return parts.object_parts(catalog(spark, sf_dir), THRESHOLD, CHUNK)


UPLOADS = "uploads AS (SELECT bucket, key, version_id, size AS object_size, (i + 1)::INT AS part_number, i * 8192 AS range_start, least((i + 1) * 8192, size) AS range_end FROM (SELECT *, unnest(range(0, (size + 8191) // 8192)) AS i FROM objects WHERE size > 8192))"


@query(f"WITH {ALL}, {UPLOADS} SELECT * FROM uploads")
def upload_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload parts of the objects above the threshold."""
    return parts.upload_parts(catalog(spark, sf_dir), THRESHOLD, CHUNK)


#: Sizes from bytes to beyond what a store takes, and some that are not known.
HINTS = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN floor(o_totalprice)::BIGINT * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 100000000 END END AS size_hint FROM orders"


@query(
    f"SELECT *, CASE WHEN size_hint IS NULL THEN 'multipart' WHEN size_hint > 5497558138880 THEN 'too_large' WHEN size_hint <= 8192 THEN 'single' ELSE 'multipart' END AS strategy, "
    f"CASE WHEN size_hint IS NULL THEN 8192 WHEN size_hint > 5497558138880 OR size_hint <= 8192 THEN NULL WHEN (size_hint + 8191) // 8192 > 10000 THEN (size_hint + 9999) // 10000 ELSE 8192 END::BIGINT AS chunk_size FROM ({HINTS})"
)
def upload_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How an object of each size is uploaded."""
    scale = F.element_at(F.array(*(F.lit(x) for x in (1, 1_000, 1_000_000, 100_000_000))), (F.col("o_orderkey") % 4 + 1).cast("int")).cast("long")
    hints = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.floor("o_totalprice") * scale).alias("size_hint"))
    return parts.upload_strategy(hints, THRESHOLD, CHUNK)


def document_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of every part of every document."""
    text = table(spark, sf_dir, "documents").select(document_key().alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    cut = parts.read_parts(text.withColumns({"start": F.lit(0).cast("long"), "end": F.octet_length("data").cast("long")}), THRESHOLD, CHUNK)
    return cut.withColumn("data", F.substring("data", (F.col("range_start") + 1).cast("int"), (F.col("range_end") - F.col("range_start")).cast("int")))


RANGES = """cut AS (
  SELECT lang || '/' || source || '/' || doc_id || '.txt' AS key, encode(coalesce(text, '')) AS data, strlen(coalesce(text, '')) AS size FROM documents
), pieces AS (
  SELECT key, size, i::INT AS part_number, i * 8192 AS range_start, CASE WHEN size < 8192 THEN size ELSE least((i + 1) * 8192, size) END AS range_end, data
  FROM (SELECT *, unnest(range(0, CASE WHEN size < 8192 THEN 1 ELSE (size + 8191) // 8192 END)) AS i FROM cut)
), ranges AS (
  SELECT key, part_number, range_start, range_end, sha256(data[range_start + 1:range_end]) AS sha256 FROM pieces
)"""


@query(f"WITH {RANGES} SELECT * FROM ranges")
def read_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum of every part's bytes."""
    return document_ranges(spark, sf_dir).select("key", "part_number", "range_start", "range_end", verify.checksum(F.col("data")).alias("sha256"))


@query(f"WITH {RANGES} SELECT key, count(*) AS n_parts, sum(range_end - range_start)::BIGINT AS n_bytes, sha256(string_agg(sha256, '' ORDER BY part_number)) AS sha256 FROM ranges GROUP BY key")
def read_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects put together from their parts in order, by the checksum over those of the parts."""
    each = F.struct("part_number", verify.checksum(F.col("data")).alias("sha256"))
    whole = document_ranges(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n_parts"), F.sum(F.col("range_end") - F.col("range_start")).cast("long").alias("n_bytes"), F.sort_array(F.collect_list(each)).alias("parts"))
    return whole.select("key", "n_parts", "n_bytes", verify.checksum(F.array_join("parts.sha256", "")).alias("sha256"))


#: Parts that a damaged transfer has done.
DONE = "done AS (SELECT * FROM parts WHERE (object_size + part_number) % 7 <> 0)"


def done_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return object_parts(spark, sf_dir).where((F.col("object_size") + F.col("part_number")) % 7 != 0)


@query(
    f"WITH {ALL}, {PARTS}, {DONE}, g AS (SELECT *, coalesce(lag(range_end) OVER w <> range_start OR lag(part_number) OVER w + 1 <> part_number, false) AS gap FROM done WINDOW w AS (PARTITION BY bucket, key, version_id ORDER BY part_number)) "
    "SELECT bucket, key, version_id, count(*) AS n_parts, count(*) FILTER (gap) AS n_gaps, min(range_start) = 0 AS starts_at_zero, max(range_end) = max(object_size) AS ends_at_size, count(*) FILTER (gap) = 0 AND min(range_start) = 0 AND max(range_end) = max(object_size) AS contiguous FROM g GROUP BY bucket, key, version_id"
)
def parts_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the parts of every object follow each other from its start to its end; here some are not there."""
    return parts.contiguity(done_parts(spark, sf_dir))


@query(
    f"WITH {ALL}, {PARTS}, {DONE} "
    "SELECT p.bucket, p.key, p.version_id, count(*) AS n_expected, count(d.part_number) AS n_done, count(*) = count(d.part_number) AS complete FROM parts p LEFT JOIN done d ON p.bucket = d.bucket AND p.key = d.key AND p.part_number = d.part_number GROUP BY ALL"
)
def parts_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of which all planned parts are done; here some are not."""
    return parts.completeness(done_parts(spark, sf_dir), object_parts(spark, sf_dir))


@query(f"WITH {ALL}, {PARTS} SELECT *, part_number = 0 AS is_first, range_end = object_size AS is_last FROM parts")
def part_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last parts."""
    return parts.lifecycle(object_parts(spark, sf_dir))


@query(f"WITH {ALL}, {PARTS} SELECT count(*) AS n_parts, coalesce(sum(range_end - range_start), 0)::BIGINT AS n_bytes FROM parts")
def part_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and bytes to download."""
    return parts.part_totals(object_parts(spark, sf_dir))


@query(f"WITH {ALL}, {UPLOADS} SELECT bucket, key, version_id, count(*) AS n_parts, sum(range_end - range_start)::BIGINT AS n_bytes FROM uploads GROUP BY ALL")
def multipart_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and bytes of every object that is uploaded in parts."""
    return parts.multipart_totals(upload_parts(spark, sf_dir))


# Archive

INDEX_COLUMNS = ["bucket", "key", "version_id", "size", "position", "header_offset", "header_len", "data_offset", "data_len", "pad_len", "entry_len"]


@query(f"WITH {ALL}, {LAYOUT} SELECT bucket, key, version_id, size, position, header_offset, header_len, header_offset + header_len AS data_offset, size AS data_len, pad_len, entry_len FROM placed")
def archive_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte layout of an archive of all objects."""
    return index.archive_index(catalog(spark, sf_dir)).select(INDEX_COLUMNS)


@query(f"WITH {ALL}, {LAYOUT} SELECT count(*) AS n_entries, coalesce(sum(size), 0)::BIGINT AS data_bytes, coalesce(sum(entry_len), 0)::BIGINT AS entry_bytes, (coalesce(sum(entry_len), 0) + 1024)::BIGINT AS archive_bytes FROM placed")
def archive_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of that archive."""
    return index.archive_totals(catalog(spark, sf_dir))


@query(
    f"WITH {ALL}, {LAYOUT}, a AS (SELECT (coalesce(sum(entry_len), 0) + 1024)::BIGINT AS total FROM placed) "
    "SELECT i::INT AS part_number, i * 65536 AS range_start, least((i + 1) * 65536, total) AS range_end FROM (SELECT total, unnest(range(0, (total + 65535) // 65536)) AS i FROM a)"
)
def archive_upload_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive as a stream, cut into chunks."""
    return parts.archive_upload_parts(archive_totals(spark, sf_dir), 65_536)


# Extract


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the archive of all objects, as its headers tell them."""
    return catalog(spark, sf_dir).select("key", "size")


@query(f"WITH objects AS ({DOCUMENTS}), {LAYOUT} SELECT key, size, header_offset, header_offset + header_len AS data_offset FROM placed")
def entry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and where their data stands, from the headers of an archive of all documents that is written first."""
    register(spark)
    path = f"{checkpoint_dir(spark)}/entry-scan-{uuid.uuid4().hex}.tar"
    data = table(spark, sf_dir, "documents").select(document_key().alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    placed = index.archive_index(bucket(spark, sf_dir, "documents")).select("key", "size", "header_offset", "data_offset", F.lit(0).cast("long").alias("range_start"), F.col("size").alias("range_end"))
    placed.join(data, "key").select("key", "size", "header_offset", "data_offset", "range_start", "range_end", "data").write.format("stowage-tar-writer").mode("append").save(path)
    return spark.read.format("stowage-tar").load(path).select("key", "size", "header_offset", "data_offset")


FILTERS = ("7.html", "en/", "click/**/1*.json", "O/[12]-*/*5")
FILTER_SQL = {
    "7.html": "key = '7.html'",
    "en/": "starts_with(key, 'en/')",
    "click/**/1*.json": r"regexp_matches(key, '(?s)^click/(.*/)?1[^/]*\.json\z')",
    "O/[12]-*/*5": r"regexp_matches(key, '(?s)^O/[12]-[^/]*/[^/]*5\z')",
}
ANY_SQL = "(" + " OR ".join(FILTER_SQL.values()) + ")"


def taken(spark: SparkSession, sf_dir: str, *filters: str) -> DataFrame:
    return extract.marked(entries(spark, sf_dir), [EntryFilter.parse(f) for f in filters])


def kept(condition: str) -> str:
    return f"WITH {ALL} SELECT key, size FROM objects WHERE {condition}"


@query(kept(FILTER_SQL["7.html"]))
def filter_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one key."""
    return taken(spark, sf_dir, "7.html").where("included").drop("included")


@query(kept(FILTER_SQL["en/"]))
def filter_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries below a prefix, at any depth."""
    return taken(spark, sf_dir, "en/").where("included").drop("included")


@query(kept(FILTER_SQL["click/**/1*.json"]))
def filter_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that match a glob."""
    return taken(spark, sf_dir, "click/**/1*.json").where("included").drop("included")


@query(f"WITH {ALL} SELECT key, size, {ANY_SQL} AS included FROM objects")
def filter_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries, with whether any filter takes them."""
    return taken(spark, sf_dir, *FILTERS)


def filters_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f,) for f in FILTERS], "value string")


@query(kept(ANY_SQL))
def filter_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a row of a table of filters takes."""
    return extract.semi_join(entries(spark, sf_dir), filters_table(spark))


@query(kept(f"NOT {ANY_SQL}"))
def filter_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that none takes."""
    return extract.semi_join(entries(spark, sf_dir), filters_table(spark), "left_anti")


@query(
    f"WITH {ALL}, m AS (SELECT size, {ANY_SQL} AS included FROM objects) "
    "SELECT count(*) FILTER (included) AS extracted_objects, coalesce(sum(size) FILTER (included), 0)::BIGINT AS extracted_bytes, count(*) FILTER (NOT included) AS skipped_objects, coalesce(sum(size) FILTER (NOT included), 0)::BIGINT AS skipped_bytes FROM m"
)
def extract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted and skipped entries."""
    return extract.summary(filter_any(spark, sf_dir))


@query(f"WITH {ALL} SELECT key, 'restored' || key AS target FROM objects WHERE {ANY_SQL}")
def target_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where entries go: the prefix is put before the path as it is."""
    return filter_any(spark, sf_dir).where("included").select("key", extract.target_key("restored").alias("target"))


@query(
    f"""WITH {ALL}, big AS (SELECT key, size, (size + 8191) // 8192 AS n FROM objects WHERE size >= 8192)
SELECT key, size, 'small' AS component, 0::BIGINT AS seq, 0::BIGINT AS range_start, size AS range_end FROM objects WHERE size < 8192
UNION ALL SELECT key, size, 'start', 0, 0, 0 FROM big
UNION ALL SELECT key, size, 'part', i + 1, i * 8192, least((i + 1) * 8192, size) FROM (SELECT *, unnest(range(0, n)) AS i FROM big)
UNION ALL SELECT key, size, 'end', n + 1, size, size FROM big"""
)
def entry_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as the pieces in which they are handed on."""
    return extract.components(entries(spark, sf_dir), THRESHOLD, CHUNK)


# Integrity


@query("SELECT lang || '/' || source || '/' || doc_id || '.txt' AS key, sha256(coalesce(text, '')) AS sha256 FROM documents")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum of every document."""
    return table(spark, sf_dir, "documents").select(document_key().alias("key"), verify.checksum(F.coalesce("text", F.lit(""))).alias("sha256"))


@query(
    """WITH d AS (SELECT doc_id, lang || '/' || source || '/' || doc_id || '.txt' AS key, coalesce(text, '') AS text FROM documents),
e AS (SELECT key, sha256(text) AS sha256 FROM d WHERE doc_id % 13 <> 0),
a AS (SELECT key, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS sha256 FROM d WHERE doc_id % 11 <> 0)
SELECT key, CASE WHEN a.sha256 IS NULL THEN 'missing' WHEN e.sha256 IS NULL THEN 'extra' WHEN a.sha256 = e.sha256 THEN 'ok' ELSE 'mismatch' END AS status, e.sha256 AS expected_sha256, a.sha256 AS actual_sha256 FROM e FULL JOIN a USING (key)"""
)
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected documents against actual ones, of which some are gone, changed or new."""
    rows = table(spark, sf_dir, "documents").select("doc_id", document_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    expected = rows.where("doc_id % 13 <> 0").select("key", verify.checksum(F.col("text")).alias("sha256"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    actual = rows.where("doc_id % 11 <> 0").select("key", verify.checksum(changed).alias("sha256"))
    return verify.reconcile(expected, actual)


# Events


#: Kinds of events of which a damaged log has lost some.
LOST = ("input_part_downloaded", "object_part_uploaded", "object_uploaded")


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of an archive's creation and of its extraction with all filters, without events that were lost."""
    objects = catalog(spark, sf_dir)
    made = log.create_log(index.entry_columns(objects), parts.object_parts(objects, THRESHOLD, CHUNK))
    read = taken(spark, sf_dir, *FILTERS)
    pieces = extract.components(read.where("included"), THRESHOLD, CHUNK).where("component in ('small', 'part')").withColumn("part_number", F.greatest(F.col("seq") - 1, F.lit(0)))
    whole = made.select("event", "key", "part_number", "bytes").unionByName(log.extract_log(read, pieces))
    return whole.where(~(F.col("event").isin(*LOST) & (F.col("bytes") % 10 == 7)))


JOB = f"""{ALL}, {LAYOUT}, {PARTS}, own AS (
  SELECT *, {ANY_SQL} AS included FROM placed
), pieces AS (
  SELECT key, part_number, range_end - range_start AS n FROM parts
), whole AS (
  SELECT unnest(['input_object_download_started', 'input_object_download_completed', 'archive_object_written']) AS event, key, NULL::INT AS part_number, size AS bytes FROM placed
  UNION ALL SELECT 'archive_bytes_written', key, NULL, entry_len FROM placed
  UNION ALL SELECT unnest(['input_part_unordered_downloaded', 'input_part_downloaded', 'archive_part_written']), key, part_number, n FROM pieces
  UNION ALL SELECT unnest(['extract_object_starting', 'extract_object_finished', 'object_upload_starting', 'object_uploaded']), key, NULL, size FROM own WHERE included
  UNION ALL SELECT 'extract_object_skipped', key, NULL, size FROM own WHERE NOT included
  UNION ALL SELECT unnest(['extract_object_part_read', 'object_part_uploaded']), key, part_number, n FROM pieces WHERE {ANY_SQL}
), events_ AS (
  SELECT * FROM whole WHERE NOT (event IN {LOST} AND bytes % 10 = 7)
)"""


@query(f"WITH {JOB} SELECT event, count(*) AS n, coalesce(sum(bytes), 0)::BIGINT AS n_bytes FROM events_ GROUP BY event")
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and bytes of every kind of event."""
    return log.summary(job_log(spark, sf_dir))


@query(f"SELECT e AS event, count(*) AS n FROM (SELECT unnest({list(log.ONCE)}) AS e, unnest(range({len(log.ONCE)})) AS i) JOIN region ON r_regionkey < i % 3 GROUP BY e HAVING count(*) > 1")
def event_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a job has once at most, but its log has more often; here each is there never, once or twice."""
    each = F.explode(F.array(*(F.struct(F.lit(e).alias("event"), F.lit(i % 3).alias("times")) for i, e in enumerate(log.ONCE))))
    return log.repeated(table(spark, sf_dir, "region").select("r_regionkey", each.alias("e")).where("r_regionkey < e.times").select("e.event"))


@query(
    f"""WITH {JOB}, s AS (SELECT key, event, sum(bytes)::BIGINT AS b FROM events_ GROUP BY ALL), k AS (SELECT DISTINCT key FROM s),
j AS (SELECT unnest({[a for a, _ in log.BY_KEY]}) AS a, unnest({[b for _, b in log.BY_KEY]}) AS b)
SELECT k.key, j.a AS left_event, j.b AS right_event, x.b AS left_bytes, y.b AS right_bytes FROM k CROSS JOIN j LEFT JOIN s x ON x.key = k.key AND x.event = j.a LEFT JOIN s y ON y.key = k.key AND y.event = j.b WHERE x.b IS DISTINCT FROM y.b"""
)
def event_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose events do not agree with each other."""
    return log.mismatched(job_log(spark, sf_dir))


@query(f"WITH {JOB} SELECT count(*) AS n_objects, coalesce(sum(bytes), 0)::BIGINT AS n_bytes FROM events_ WHERE event = 'object_uploaded'")
def upload_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and bytes that were uploaded."""
    return job_log(spark, sf_dir).where("event = 'object_uploaded'").agg(F.count("*").alias("n_objects"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("n_bytes"))


@query(f"WITH {JOB}, u AS (SELECT key, part_number, bytes, sum(bytes) OVER (PARTITION BY key ORDER BY part_number)::BIGINT AS uploaded FROM events_ WHERE event = 'object_part_uploaded') SELECT u.*, size, uploaded > size AS exceeds, uploaded = size AS done FROM u JOIN objects USING (key)")
def upload_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded bytes of every object, part after part."""
    return log.progress(job_log(spark, sf_dir), entries(spark, sf_dir), ["key"])


@query(
    f"WITH {JOB}, s AS (SELECT event, count(*) AS n, coalesce(sum(bytes), 0)::BIGINT AS b FROM events_ GROUP BY event), p AS (SELECT unnest([{', '.join(f"('{a}', '{b}', '{op}')" for pairs, op in ((log.EQUAL, '='), (log.MORE, '<')) for a, b in pairs)}]) AS p), "
    "j AS (SELECT p[1] AS a, p[2] AS b, p[3] AS op FROM p) "
    "SELECT j.a || ' ' || op || ' ' || j.b AS invariant, coalesce(x.n, 0)::BIGINT AS left_n, coalesce(y.n, 0)::BIGINT AS right_n, coalesce(x.b, 0)::BIGINT AS left_bytes, coalesce(y.b, 0)::BIGINT AS right_bytes, "
    "CASE WHEN op = '=' THEN coalesce(x.n, 0) = coalesce(y.n, 0) AND coalesce(x.b, 0) = coalesce(y.b, 0) ELSE coalesce(x.b, 0) < coalesce(y.b, 0) OR coalesce(x.n, 0) = 0 END AS holds "
    "FROM j LEFT JOIN s x ON x.event = j.a LEFT JOIN s y ON y.event = j.b"
)
def event_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds in the log of every successful job; in this one some of it doesn't."""
    return log.reconcile(job_log(spark, sf_dir))
