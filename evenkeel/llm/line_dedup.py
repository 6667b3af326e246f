"""Lines that many documents share, found by hash ranges and given back as keep bitmaps per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.llm.common import query, table
from evenkeel.session import cut_lineage

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Stripped of ASCII blanks, A-Z lowered. A line of single bytes takes the fast path; both give the same."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10,
                 keep: str = "none") -> DataFrame:
    """(doc, t1, t2, dropped): for each document that loses a line, the sparse bitmap of its dropped lines.

    A document is a distinct (doc_id, text); t1 and t2 are two hashes of the text, so repeated rows, NULL ids and
    clashing column names do no harm. `dropped` is a sorted array of (word, bits): bit p % 64 of word p div 64 is
    set where line p goes; words without a dropped line are left out, which is the compression. A key is a line
    without outer blanks, A-Z lowered; empty keys never count. keep='none' drops every line whose key stands in at
    least min_docs documents; keep='first' spares the first occurrence (in order of id, hashes and position).

    Occurrences are dealt into ranges of (hash, document, position), so a line that a third of all documents hold
    is spread over many ranges, and each range is read in order; one row per range and key leaves for the count.
    A NULL text has one empty line and so no bitmap; a very long text costs time in proportion to its lines.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    # the text's hashes are taken below the explosion, once a document, and the lines' hashes are written once: dealing
    # them into ranges reads them twice, and that must not split and hash the texts again
    doc = (docs.select(F.col(doc_id).alias("doc"), F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(11), t).alias("t2"), t.alias("whole"))
           .select("doc", "t1", "t2", F.posexplode(lines_of(F.col("whole"))).alias("pos", "line")))
    marks = (doc.select("doc", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).where("key <> ''")
             .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc", "t1", "t2", "pos"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["h1", "h2", "doc", "t1", "t2", "pos"]
    ranged = cut_lineage(marks).repartitionByRange(parts, *place).sortWithinPartitions(*place)
    ranged = cut_lineage(ranged.groupBy(*place).agg(F.count("*").alias("copies")).drop("copies"))

    once = ranged.groupBy("h1", "h2", "doc", "t1", "t2").agg(F.min("pos").alias("first"))
    keys = (once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"),
                                         F.min(F.struct("doc", "t1", "t2", "first")).alias("spared"))
            .where(F.col("n_docs") >= min_docs))
    keys = cut_lineage(keys)                      # a plain table on this side lets the planner split a hot key's lines
    hits = ranged.join(keys, ["h1", "h2"])
    if keep == "first":
        hits = hits.where(F.struct("doc", "t1", "t2", "pos") != F.col("spared"))
    bits = (hits.groupBy("doc", "t1", "t2", F.floor(F.col("pos") / 64).cast("int").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits")))
    return bits.groupBy("doc", "t1", "t2").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def dropped_lines(dropped: Column) -> Column:
    """The positions in a bitmap, in order; NULL for a NULL bitmap."""
    def of_word(w: Column) -> Column:
        bits = F.sequence(F.lit(0), F.lit(63))
        marked = F.filter(bits, lambda b: F.call_function("shiftright", w["bits"], b).bitwiseAND(F.lit(1)) == 1)
        return F.transform(marked, lambda b: w["word"] * 64 + b)
    return F.flatten(F.transform(dropped, of_word))


def kept_lines(lines: Column, dropped: Column) -> Column:
    """The lines that a bitmap leaves, in order, in time proportional to the lines.

    Both arrays are bound to a lambda's variable, so that they are made once a document and not once a line.
    """
    both = F.array(F.struct(lines.alias("lines"), dropped_lines(dropped).alias("gone")))
    left = F.transform(both, lambda s: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"]), lambda p: F.get(s["lines"], p)))
    return F.when(dropped.isNull(), lines).otherwise(F.element_at(left, 1))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, dropped): every row of docs as a struct, with its bitmap or NULL (no line dropped, as for NULL and empty
    texts). Input columns can't clash; repeated rows each get the bitmap; texts are hashed, not compared."""
    t = F.coalesce(F.col(text), F.lit(""))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("k0"),
                       F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(11), t).alias("k2"))
    on = F.col("k0").eqNullSafe(F.col("doc")) & (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2"))
    return left.join(bitmaps, on, "left").select("row", "dropped")


def drop_shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10,
                      keep: str = "none", n_chars: str | None = None) -> DataFrame:
    """The documents with shared lines taken out of the text: the same rows and columns, n_chars counted anew.

    A NULL text stays NULL; a document that loses all its lines has an empty text.
    """
    found = with_bitmaps(docs, keep_bitmaps(docs, doc_id, text, min_docs, keep), doc_id, text)
    lines = lines_of(F.col("row").getField(text))
    new = F.when(F.col("dropped").isNull(), F.col("row").getField(text)).otherwise(
        F.array_join(kept_lines(lines, F.col("dropped")), "\n"))
    full = found.select("row", new.alias("new"))
    return full.select(*[F.col("new").alias(c) if c == text
                         else F.coalesce(F.length("new").cast(docs.schema[c].dataType), F.col("row").getField(c)).alias(c)
                         if c == n_chars else F.col("row").getField(c).alias(c) for c in docs.columns])


CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINE_SQL = f"""
WITH split AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
marks AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos, lines FROM split),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, {CHARS}), '{UPPER}', '{LOWER}') AS k FROM marks),
often AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(often.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN often.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM keyed LEFT JOIN often ON keyed.k = often.k GROUP BY doc_id"""


@query("op7_line_dedup", LINE_SQL)
def op7_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = lines_of(F.col("row.text"))
    found = with_bitmaps(docs, keep_bitmaps(docs, min_docs=10))
    n = F.aggregate("dropped", F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w["bits"]))
    return found.select(F.col("row.doc_id").alias("doc_id"), F.size(lines).cast("long").alias("n_lines"),
                        F.coalesce(n, F.lit(0).cast("long")).alias("n_dropped"),
                        F.sha2(F.array_join(kept_lines(lines, F.col("dropped")), "\n"), 256).alias("kept_sha256"))
