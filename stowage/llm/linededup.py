"""Line deduplication by content-defined chunks of lines, in DataFrame functions only.

A rolling hash runs over the hashes of lines (of a line and the one before; blank lines are
skipped and belong to the chunk before them). A chunk begins where it is at a local minimum,
so the same passage is cut in the same way wherever it stands, and every chunk has at least
two lines that are not blank. Inside a run of equal lines, where the rolling hash stands still,
every second line begins a chunk: such chunks are equal wherever the run begins.

Chunks that occur more than once in the corpus are found by their hash, confirmed by
comparing their bytes, and removed from all places but the first (smallest doc_id, then
position). A copy of a whole text loses all its lines. Where a passage stands between other
lines, those between its ends and its outermost minima stay: they are in chunks with the others.

Only candidates of a repeated hash carry text through a shuffle (a sieve leaves most others
out). The chunks of a hot passage are combined by an aggregation before they are dealt, and in the joins
that follow they are dealt to buckets (``hot_join``).

Edge cases. A null text stays null, an empty one empty. Texts with fewer than two lines that are not
blank lose nothing. Rows that share a doc_id and a chunk at the same place count as one, which stays; a row
without an id loses nothing, but others lose what it has. Very long texts are cut whole; an empty
table gives an empty result. Extra columns stay as they are; those of the names that are added are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MARKS, cut, hot_join, sieve, table, unused

#: The rolling hash is taken modulo a prime.
PRIME = 1_048_573


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is then worked out once, wherever the optimizer moves the whole."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Numbers of the lines that are not blank, the rolling hash at each, and those that begin a chunk.
FULL = r"filter(sequence(0, size(ls) - 1), i -> ls[i] rlike '[^ \\t\\x0B\\f\\r]')"
HASHES = "transform(nb, i -> cast(conv(substring(md5(ls[i]), 1, 8), 16, 10) as bigint))"
ROLLING = f"transform(hs, (h, k) -> (h * 31 + case when k > 0 then hs[k - 1] else 0 end) % {PRIME})"
CUTS = """filter(sequence(0, size(rs) - 1), k -> k = 0 or k > 1 and k < size(rs) - 1 and (
  rs[k] < rs[k - 1] and rs[k] <= rs[k + 1] or k % 2 = 0 and rs[k] = rs[k - 1] and rs[k] = rs[k - 2] and rs[k] = rs[k + 1]))"""
#: The chunks of a text: an array of arrays of lines; none if fewer than two lines are not blank.
CHUNKS = let(
    "ls",
    "split(text, '\\n', -1)",
    let("nb", FULL, let("hs", HASHES, let("rs", ROLLING, let("st", f"transform(case when size(nb) < 2 then array() else {CUTS} end, k -> case when k = 0 then 0 else nb[k] end)", "transform(st, (s, k) -> slice(ls, s + 1, coalesce(get(st, k + 1), size(ls)) - s))")))),
)


def chunked(docs: DataFrame) -> DataFrame:
    """``doc_id, chunk, body, h`` for every chunk."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # the outer form, as the other one repeats its argument in a filter
    own = rows.select("doc_id", F.posexplode_outer(F.expr(CHUNKS)).alias("chunk", "own")).where("own is not null")
    return own.select("doc_id", "chunk", F.array_join("own", "\n").alias("body")).withColumn("h", F.xxhash64("body"))


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, chunk, h`` of every chunk whose bytes stand elsewhere before."""
    chunks = chunked(docs)
    many = cut(chunks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    total = many.agg(F.sum("n")).first()[0] or 0
    found = cut(hot_join(sieve(chunks, many, "h"), many, "h", "doc_id", total))
    # equal hashes are candidates only: the bytes of the body decide
    first = found.groupBy("h", "body").agg(F.min(F.struct("doc_id", "chunk")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return hot_join(found, first, "h", "doc_id", total, ["body"]).where(F.struct("doc_id", "chunk") != F.col("first")).select("doc_id", "chunk", "h")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without repeated chunks, with ``n_chunks_removed`` and ``n_lines_removed``.

    ``text`` is what is left, and ``n_chars``, where there is one, its length.
    """
    id_, gone_, left_ = (unused(docs, n) for n in ("_id", "_gone", "_left"))
    found = cut(repeats(docs))
    gone = found.groupBy(F.col("doc_id").alias(id_)).agg(F.collect_set(F.struct("chunk", "h")).alias(gone_))
    if found.limit(MARKS + 1).count() <= MARKS:  # each is some bytes: the table has a bound and texts need not move
        gone = F.broadcast(gone)
    rows = docs.withColumn("text", F.col("text").cast("string")).join(gone, F.col("doc_id").cast("long") == F.col(id_), "left")
    # the hash tells rows that share an id apart
    stays = f"filter(cs, (c, k) -> not array_contains({gone_}, named_struct('chunk', k, 'h', xxhash64(array_join(c, '\n')))))"
    counts = "'chunks', cast(size(cs) - size(ks) as bigint), 'lines', cast(size(flatten(cs)) - size(flatten(ks)) as bigint)"
    left = let("cs", CHUNKS, let("ks", stays, f"named_struct('text', if(size(cs) = 0, text, array_join(flatten(ks), '\n')), {counts})"))
    out = rows.withColumn(left_, F.expr(f"case when {gone_} is not null then {left} end"))
    out = out.withColumns(
        {
            "text": F.expr(f"if({gone_} is null, text, {left_}.text)"),
            "n_chunks_removed": F.coalesce(F.col(f"{left_}.chunks"), F.lit(0)).cast("long"),
            "n_lines_removed": F.coalesce(F.col(f"{left_}.lines"), F.lit(0)).cast("long"),
        }
    )
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.expr(f"if({gone_} is null, n_chars, char_length(text))").cast(docs.schema["n_chars"].dataType))
    added = ("n_chunks_removed", "n_lines_removed")
    return out.select(*(c for c in docs.columns if c not in added), *added)


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without multi-line chunks that stand elsewhere before."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chunks_removed", "n_lines_removed")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), f AS (
  SELECT *, list_filter(range(1, len(lines) + 1), lambda i: regexp_matches(lines[i], '[^ \t\v\f\r]')) AS nb FROM l
), h AS (
  SELECT *, list_transform(nb, lambda i: ('0x' || substr(md5(lines[i]), 1, 8))::BIGINT) AS hs FROM f WHERE len(nb) > 1
), o AS (
  SELECT *, list_transform(range(1, len(hs) + 1), lambda k: (hs[k] * 31 + coalesce(CASE WHEN k > 1 THEN hs[k - 1] END, 0)) % 1048573) AS rs FROM h
), s AS (
  SELECT *, list_transform(list_filter(range(1, len(rs) + 1), lambda k: k = 1 OR (k > 2 AND k < len(rs) AND (
    (rs[k] < rs[k - 1] AND rs[k] <= rs[k + 1]) OR (k % 2 = 1 AND rs[k] = rs[k - 1] AND rs[k] = rs[k - 2] AND rs[k] = rs[k + 1])))),
    lambda k: CASE WHEN k = 1 THEN 1 ELSE nb[k] END) AS starts FROM o
), c AS (
  SELECT doc_id, lines, starts, unnest(range(1, len(starts) + 1)) AS k FROM s
), b AS (
  SELECT doc_id, k, lines[starts[k]:coalesce(starts[k + 1], len(lines) + 1) - 1] AS own FROM c
), t AS (
  SELECT *, array_to_string(own, chr(10)) AS body FROM b
), r AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, k) > 1 AS gone FROM t
), a AS (
  SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text,
    count(*) FILTER (gone) AS n_chunks_removed, coalesce(sum(len(own)) FILTER (gone), 0)::BIGINT AS n_lines_removed FROM r GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN a.doc_id IS NULL THEN d.text ELSE a.text END AS text, coalesce(n_chunks_removed, 0)::BIGINT AS n_chunks_removed, coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed
FROM documents d LEFT JOIN a USING (doc_id)
"""
