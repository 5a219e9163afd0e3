"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves, in DataFrame functions only.

Sections are parted by blank lines, paragraphs by line ends, and a paragraph's leaves
are runs of up to ``LEAF_WORDS`` words that also end with a sentence. A paragraph's
digest covers its text, a section's digest its paragraphs' digests, and the root the
sections' digests. Equal roots mean equal texts; differing branches locate an edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a leaf at most, and hexadecimal digits kept of a leaf's or section's digest.
LEAF_WORDS, DIGITS = 4, 8
#: A leaf: words of one line up to the end of a sentence or the word limit.
LEAF = rf"(?:[^\x09-\x0D ]*[^\x09-\x0D .!?][\x09\x0B-\x0D ]+){{0,{LEAF_WORDS - 1}}}[^\x09-\x0D ]+"
#: Where a section ends.
BLANK_LINE = r"\n[ \x09]*\n"
#: Ids of one block, when each document looks for the next one in order of doc_id.
BLOCK = 1024


def section_digests(text: Column) -> Column:
    """One digest a section, over the digests of its paragraphs."""
    return F.transform(F.split(text, BLANK_LINE), lambda s: F.md5(F.array_join(F.transform(F.split(s, "\n"), lambda p: F.md5(p)), "/")))


def leaves(text: Column) -> Column:
    """The leaves' short digests in order; none for a text without words."""
    return F.transform(F.regexp_extract_all(text, F.lit(LEAF), F.lit(0)), lambda leaf: F.substring(F.md5(leaf), 1, DIGITS))


def root(text: Column, sections: Column) -> Column:
    """The digest at the top. The text's own digest is a branch of it, so that separators count too."""
    return F.sha2(F.concat_ws("|", F.sha2(text, 256), F.array_join(sections, ",")), 256)


def tree(text: Column) -> Column:
    """The tree as a struct (root, sections, leaves)."""
    sections = section_digests(text)
    return F.struct(root(text, sections).alias("root"), F.transform(sections, lambda d: F.substring(d, 1, DIGITS)).alias("sections"),
                    leaves(text).alias("leaves"))


def as_string(t: Column) -> Column:
    """``root:sections:leaves``, digests of sections parted by commas."""
    return F.concat_ws(":", t["root"], F.array_join(t["sections"], ","), F.array_join(t["leaves"], ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the distinct leaves that two trees share over those of both; 1 for equal roots, 0 without any leaf."""
    x, y = F.array_distinct(a["leaves"]), F.array_distinct(b["leaves"])
    return (F.when(a["root"] == b["root"], F.lit(1.0))
            .otherwise(F.coalesce(F.lit(2.0) * F.size(F.array_intersect(x, y)) / F.nullif(F.size(x) + F.size(y), F.lit(0)), F.lit(0.0))))


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers, from 0, of the sections of ``a`` that are not those of ``b`` at the same place."""
    numbers = F.sequence(F.lit(0), F.size(a["sections"]) - 1)
    return F.filter(numbers, lambda i: ~F.get(a["sections"], i).eqNullSafe(F.get(b["sections"], i)))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, next_text): ``next_text`` belongs to the next larger doc_id, for the largest to the smallest.

    A window orders the ids of one block of ``BLOCK`` ids, so rows spread over tasks
    whatever their number. A block's largest id takes the first text of the next block
    in use, which is found the same way among the blocks' first rows. Rows of one
    doc_id are one document here, with its smallest text; a null doc_id comes first.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = base.withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("block", F.floor(F.col("at") / BLOCK))
    falling = Window.partitionBy("block").orderBy(F.desc("at"), F.desc("text"))
    placed = (base.withColumn("above", F.when(F.lag("at").over(falling) > F.col("at"), F.lag("text").over(falling)))
              .withColumn("above", F.last("above", ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, 0))))
    heads = (base.withColumn("nth", F.row_number().over(Window.partitionBy("block").orderBy("at", "text"))).where("nth = 1")
             .select("block", F.col("text").alias("head"), F.floor(F.col("block") / BLOCK).alias("upper")))
    upward = Window.partitionBy("upper").orderBy("block")
    heads = heads.withColumn("follows", F.lead("head").over(upward)).withColumn("nth", F.row_number().over(upward))
    # one row for each BLOCK * BLOCK ids: the only window over all rows
    everything = Window.orderBy("upper")
    uppers = (heads.where("nth = 1").select("upper", "head").withColumn("next_upper", F.lead("head").over(everything))
              .withColumn("next_upper", F.coalesce("next_upper", F.first("head").over(everything))).select("upper", "next_upper"))
    follows = heads.join(uppers, "upper").select("block", F.coalesce("follows", "next_upper").alias("follows"))
    return placed.join(follows, "block").select("doc_id", "text", F.coalesce("above", "follows").alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its tree and that of its edited text, and their likeness.

    The edited text has the last quarter of the code points replaced by the first as
    many of the next document. Null and empty texts have one empty section and no leaf;
    repeated rows are returned each; other columns are ignored.
    """
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - quarter), F.substr(F.col("next_text"), F.lit(1), quarter))
    texts = with_next(docs).select("doc_id", "text", "next_text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    trees = texts.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text")).alias("own"),
                         tree(F.col("edited")).alias("changed"), tree(F.col("next_text")).alias("after"))
    own, changed, after = F.col("own"), F.col("changed"), F.col("after")
    return trees.select("doc_id", "n_chars", "edited_sha256", as_string(own).alias("fingerprint"), as_string(changed).alias("edited_fingerprint"),
                        likeness(own, changed).alias("near_edited"), likeness(own, after).alias("near_next"))


#: The same rows in DuckDB.
ORACLE_SQL = rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ids AS (SELECT doc_id, min(text) AS text FROM base GROUP BY doc_id),
nexts AS (SELECT doc_id, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST), first_value(text) OVER (ORDER BY doc_id NULLS FIRST)) AS next_text FROM ids),
texts AS (SELECT b.doc_id, b.text, n.next_text, length(b.text) AS n_chars,
    substr(b.text, 1, length(b.text) - length(b.text) // 4) || substr(n.next_text, 1, length(b.text) // 4) AS edited
  FROM base b JOIN nexts n ON b.doc_id IS NOT DISTINCT FROM n.doc_id),
parts AS (SELECT doc_id, n_chars, text, edited, next_text,
    list_transform([text, edited, next_text], lambda t: list_transform(regexp_split_to_array(t, '{BLANK_LINE}'),
      lambda s: md5(array_to_string(list_transform(string_split(s, chr(10)), lambda p: md5(p)), '/')))) AS sections,
    list_transform([text, edited, next_text], lambda t: list_transform(regexp_extract_all(t, '{LEAF}'), lambda f: md5(f)[1:{DIGITS}])) AS leaves
  FROM texts),
roots AS (SELECT *, sha256(sha256(text) || '|' || array_to_string(sections[1], ',')) AS r1, sha256(sha256(edited) || '|' || array_to_string(sections[2], ',')) AS r2,
    sha256(sha256(next_text) || '|' || array_to_string(sections[3], ',')) AS r3, list_transform(leaves, lambda l: list_distinct(l)) AS d FROM parts)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256,
  r1 || ':' || array_to_string(list_transform(sections[1], lambda s: s[1:{DIGITS}]), ',') || ':' || array_to_string(leaves[1], '') AS fingerprint,
  r2 || ':' || array_to_string(list_transform(sections[2], lambda s: s[1:{DIGITS}]), ',') || ':' || array_to_string(leaves[2], '') AS edited_fingerprint,
  CASE WHEN r1 = r2 THEN 1.0::DOUBLE ELSE coalesce(2.0::DOUBLE * len(list_intersect(d[1], d[2])) / nullif(len(d[1]) + len(d[2]), 0), 0.0::DOUBLE) END AS near_edited,
  CASE WHEN r1 = r3 THEN 1.0::DOUBLE ELSE coalesce(2.0::DOUBLE * len(list_intersect(d[1], d[3])) / nullif(len(d[1]) + len(d[3]), 0), 0.0::DOUBLE) END AS near_next
FROM roots"""
