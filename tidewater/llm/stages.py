"""Operators as steps on a table of documents: every function returns the columns it was given, whatever
their names; an empty table stays empty. Which rows stay, and what a null or odd text counts as:

* ``drop_low_quality``: a null, empty or short text goes (under 50 words); equal rows share their fate,
  and so does any text with itself, however long.
* ``drop_near_duplicates``: of a group the smallest id stays. Texts without words, and rows with a null
  id, are in no group and stay. Rows that share an id are one document: they stay or go together, but
  of rows that share id and text one stays.
* ``cut_repeats``: a null text stays null, a text that repeats as a whole (equal rows too) becomes empty
  and its row stays; texts shorter than the windows are left alone.
* ``drop_contaminated``: texts without words, and rows with a null id, stay; rows that share an id go
  together; a document that has exactly the share asked for goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .decontaminate import contaminated
from .minhash import near_duplicates
from .quality import accepted
from .repeats import remove_repeats


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_low_quality(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Documents that the quality rules keep."""
    return accepted(docs, text_col=text_col)


def drop_near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates."""
    found = near_duplicates(docs, k=k, percent=percent, id_col=id_col, text_col=text_col)
    keep = found.filter(F.col("kept") & F.col(id_col).isNotNull()).select(id_col).distinct()
    with_id = docs.filter(F.col(id_col).isNotNull()).join(keep, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return with_id.unionByName(docs.filter(F.col(id_col).isNull())).select(*_columns(docs))


def cut_repeats(docs: DataFrame, *, length: int = 400, words: int = 51, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Texts without the bytes of repeated passages, those of ``length`` bytes or of ``words`` words;
    ``chars_col``, if there, follows."""
    cut = remove_repeats(docs, length=length, words=words, id_col=id_col, text_col=text_col)
    return cut.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else cut


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that contain no benchmark item."""
    bad = contaminated(docs, items, id_col=id_col, text_col=text_col).select(id_col).distinct()
    return docs.join(bad, id_col, "left_anti").select(*_columns(docs))
