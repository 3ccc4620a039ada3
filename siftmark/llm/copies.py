"""Problem 2: records that differ in formatting or field order only.

Method: progressive partition refinement. Records are first split by invariants that any copy shares
and that cost little (mark, letters and digits in all, number of words and of fields), then by the
histogram of their characters, and only what still shares a class with another record is put in
canonical form. Each step counts its classes with partial aggregation and hands on the records of
classes with several members.

A class may hold a third of all rows: no step gathers a class. The members of a class are spread over
``SALTS`` parts, each part is reduced to one row, and the parts, not the records, meet to find the
class's smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import PY_SPACE, word_text
from siftmark.runtime import Scratch

SALTS = 64


# Fixed value: any space, as in PY_SPACE, in a regular expression class.
_SP = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in PY_SPACE) + "]*"
_MARK = f"(?i)^{_SP}(query|document){_SP}:"


def mark_of(c: Column) -> Column:
    """``query``, ``document`` or the empty string."""
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), _MARK, 1))


def body_of(c: Column) -> Column:
    """What follows the mark, or the whole input. Null gives an empty string."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), _MARK, "")


def fields_of_input(c: Column) -> Column:
    """The word sequences of an input's fields; those without words are left out."""
    return F.filter(F.transform(F.split(body_of(c), r"[|;\n\r]"), word_text), lambda x: x != "")


def fields_of_list(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), word_text), lambda x: x != "")


def several(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs more than once, and ``first``, the smallest id of that key."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    part = salted.groupBy(key, "salt").agg(F.min("id").alias("lo"), F.count("*").alias("n"))
    whole = part.groupBy(key).agg(F.min("lo").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n")
    return salted.join(part.select(key, "salt").join(whole, key), [key, "salt"]).drop("salt")


def copies(rows: DataFrame, id_col: str, mark: Column, fields: Column) -> DataFrame:
    """(keep_id, copy_id): every record but the first of its class of copies, with the first one's id.

    Records are copies if they have the same mark and the same fields (word sequences) equally often in
    any order. Null, empty and wordless records are in no class. A row repeated with its id is one
    record. Columns other than the id and those in the expressions are not read.
    """
    scratch = Scratch(rows.sparkSession, "copies")
    r = rows.select(F.col(id_col).alias("id"), mark.alias("mark"), fields.alias("fields")).where(F.size("fields") > 0)
    text = F.concat_ws(" ", "fields")
    letters = F.replace(text, F.lit(" "), F.lit(""))
    cheap = F.xxhash64("mark", F.length(letters), F.length(text), F.size("fields"), F.length(F.regexp_replace(letters, "[aeiou]", "")))
    r = scratch.keep(r.withColumn("k1", cheap), "fields")
    one = several(r.select("id", "k1"), "k1").select("id")
    r2 = r.join(one, "id")
    histogram = F.xxhash64("k1", F.concat_ws("", F.sort_array(F.split(letters, ""))))
    r2 = scratch.keep(r2.withColumn("k2", histogram).drop("k1"), "histogram")
    two = several(r2.select("id", "k2"), "k2").select("id")
    canonical = F.sha2(F.concat_ws("\n", "mark", F.concat_ws("\n", F.sort_array("fields"))), 256)
    r3 = r2.join(two, "id").select("id", canonical.alias("k3"))
    same = several(r3, "k3")
    return same.where("id > first").select(F.col("first").alias("keep_id"), F.col("id").alias("copy_id")).distinct()


def input_copies(train: DataFrame) -> DataFrame:
    return copies(train, "sample_id", mark_of(F.col("input")), fields_of_input(F.col("input")))


def list_copies(pseudo: DataFrame) -> DataFrame:
    return copies(pseudo, "doc_idx", F.lit(""), fields_of_list(F.col("pseudo_queries")))


def kept(rows: DataFrame, id_col: str, found: DataFrame) -> DataFrame:
    """(keep_id, n_copies): one row per content, with the number of its records; wordless records, which
    are never copies, come out one by one."""
    n = found.groupBy("keep_id").agg(F.count("*").alias("n"))
    ids = rows.select(F.col(id_col).alias("keep_id")).distinct()
    gone = found.select(F.col("copy_id").alias("keep_id"))
    return ids.join(gone, "keep_id", "left_anti").join(n, "keep_id", "left").select("keep_id", (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("n_copies"))
