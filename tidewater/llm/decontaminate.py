"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions.

Short test items are looked for inside documents of any length. Resemblance of an item to a whole
document says nothing (it shrinks as the document grows), so only items are sketched. Items are
partitioned by the size of their shingle set, in powers of two. In a partition whose largest item may
have ``u`` shingles an item's sketch is its ``u - ceil(t * u) + HITS`` smallest hashes: its MinHash
values. A document that contains a share ``t`` of an item lacks at most ``n - ceil(t * n)`` of its
``n`` shingles, so all but that many of the sketch are found in it. A document that has fewer of them
isn't a candidate, and no match is lost.

1. Documents are read once for each block of sketches; each of their shingles is looked up among
   MinHash values, and only there. Tables of partitions are dealt by value into blocks of about
   ``BLOCK_VALUES``, each of which is broadcast; an item of any size spreads over blocks.
2. Hits are counted for each document and item; those with enough of them are candidates.
3. Candidates alone are confirmed: the whole shingle set of the document against that of the item,
   words against words.

Words are as in the quality rules, in lower case; a shingle is ``k`` words, and an item with fewer
words has its whole word sequence as its only shingle, to be found anywhere in a document.

Edge cases: null texts and texts without words match nothing; rows that share an item id, or a
document id, count as one item or document with the shingles of all of them; rows with a null id are
left out; equal hashes of different shingles can only make a candidate; an empty table gives no rows;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import storage
from .quality import words_of

#: MinHash values that are broadcast at once, about 40 MB.
BLOCK_VALUES = 500_000
#: Values of a sketch that a document has to share.
HITS = 3


def _hashes(words: Column, k: int) -> Column:
    n = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))
    return F.when(n >= k, F.transform(starts, lambda i: F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _shingles(words: Column, k: int) -> Column:
    """Words joined by a space, which no word has."""
    n = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))
    return F.when(n >= k, F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<string>"))


def _worded(frame: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    return frame.select(F.col(f"`{id_col}`").cast("long").alias(name), words_of(F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("_words")).filter(F.col(name).isNotNull())


def item_shingles(items: DataFrame, *, k: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, sizes (words of a shingle; one value but for mixed items), shingles (distinct), n."""
    words = F.col("_words")
    whole = reduce(lambda rest, n: F.when(F.size(words) == n, _shingles(words, n)).otherwise(rest), range(1, k), _shingles(words, k))
    rows = _worded(items, id_col, text_col, "item_id").filter(F.size("_words") > 0)
    sets = rows.select("item_id", F.least(F.size(words), F.lit(k)).alias("size"), whole.alias("shingles")).groupBy("item_id")
    found = sets.agg(F.collect_set("size").alias("sizes"), F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("shingles"))
    return found.withColumn("n", F.size("shingles").cast("long"))


def _hash_of(shingle: Column) -> Column:
    """The hash that a document has for this shingle."""
    words = F.split(shingle, " ")
    return F.xxhash64(F.size(words), words)


def sketches(shingled: DataFrame, percent: int) -> DataFrame:
    """item_id, upper (of its size partition), needed (values that a match shares), value: one row for
    each MinHash value."""
    n = F.col("n")
    upper = F.pow(F.lit(2), F.ceil(F.log2(n))).cast("long")
    keep = F.least(n, upper - F.ceil(F.lit(percent) * upper / F.lit(100)) + HITS)
    needed = keep - n + F.ceil(F.lit(percent) * n / F.lit(100))
    values = F.array_sort(F.array_distinct(F.transform("shingles", _hash_of)))
    # two shingles of one hash leave a value less to be shared
    rows = shingled.select("item_id", upper.alias("upper"), keep.alias("keep"), (needed - n + F.size(values)).alias("needed"), values.alias("values"))
    return rows.select("item_id", "upper", F.greatest("needed", F.lit(1)).cast("long").alias("needed"), F.explode(F.slice("values", F.lit(1), F.col("keep").cast("int"))).alias("value"))


def candidates(docs: DataFrame, values: DataFrame, sizes: list[int], *, id_col: str, text_col: str, block_values: int = BLOCK_VALUES) -> DataFrame:
    """_id, item_id of the pairs that share enough MinHash values. ``values``: sketches; ``sizes``: words
    of a shingle that items have."""
    blocks = max(1, -(-values.count() // block_values))
    everything = reduce(lambda a, b: F.concat(a, b), [_hashes(F.col("_words"), s) for s in sizes], F.array().cast("array<bigint>"))
    looked_up = _worded(docs, id_col, text_col, "_id").select("_id", F.explode(everything).alias("value"))
    hits = [looked_up.join(F.broadcast(values.filter(F.pmod("value", F.lit(blocks)) == b)), "value") for b in range(blocks)]
    shared = reduce(DataFrame.unionByName, hits).groupBy("_id", "item_id", "needed", "value").agg(F.lit(1).alias("one")).groupBy("_id", "item_id", "needed").agg(F.count("*").alias("shared"))
    return shared.filter("shared >= needed").select("_id", "item_id")


def contaminated(docs: DataFrame, items: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_values: int = BLOCK_VALUES) -> DataFrame:
    """``id_col``, item_id, item_shingles, shared_shingles for every pair with
    100 * shared >= percent * item's shingles."""
    with storage.scratch(docs.sparkSession) as keep:
        shingled = storage.materialize(item_shingles(items, k=k), "contamination-items")
        values = storage.materialize(sketches(shingled, percent), "contamination-sketches", "upper")
        sizes = sorted(r.s for r in shingled.select(F.explode("sizes").alias("s")).distinct().collect())  # at most k values
        pairs = storage.materialize(candidates(docs, values, sizes, id_col=id_col, text_col=text_col, block_values=block_values), "contamination-candidates")
        # the texts of candidates leave the documents once, whatever the number of their items
        mates = storage.materialize(pairs.select("_id").distinct(), "contamination-mates")
        texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(mates, "_id", "left_semi")
        everything = reduce(lambda a, b: F.concat(a, b), [_shingles(F.col("_words"), s) for s in sizes], F.array().cast("array<string>"))
        sets = storage.materialize(_worded(texts, "_id", "_text", "_id").select("_id", F.array_distinct(everything).alias("_mine")), "contamination-texts")
        held = pairs.join(sets, "_id").join(shingled.select("item_id", "n", "shingles"), "item_id")
        found = held.select("_id", "item_id", "n", F.array_intersect("shingles", "_mine").alias("found")).filter(F.size("found") > 0)
        # rows that share an id add up what they have of an item
        counted = found.groupBy("_id", "item_id", "n").agg(F.size(F.array_distinct(F.flatten(F.collect_set("found")))).cast("long").alias("shared"))
        confirmed = counted.filter(F.lit(100) * F.col("shared") >= F.lit(percent) * F.col("n"))
        out = confirmed.select(F.col("_id").alias(id_col), "item_id", F.col("n").alias("item_shingles"), F.col("shared").alias("shared_shingles"))
        return keep(out, "contamination")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP5_SQL = r"""
WITH dw AS (SELECT doc_id AS id, k, unnest(words) AS w, generate_subscripts(words, 1) AS i
            FROM (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS words FROM documents)),
bw AS (SELECT item_id AS id, k, len(words) AS nw, unnest(words) AS w, generate_subscripts(words, 1) AS i
       FROM (SELECT item_id, row_number() OVER () AS k, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS words FROM benchmark)),
ds AS (SELECT DISTINCT id, a, b, c, d, e FROM (SELECT id, w AS a, lead(w, 1) OVER p AS b, lead(w, 2) OVER p AS c, lead(w, 3) OVER p AS d, lead(w, 4) OVER p AS e
       FROM dw WINDOW p AS (PARTITION BY k ORDER BY i)) WHERE e IS NOT NULL),
bs AS (SELECT DISTINCT id, a, b, c, d, e FROM (SELECT id, w AS a, lead(w, 1) OVER p AS b, lead(w, 2) OVER p AS c, lead(w, 3) OVER p AS d, lead(w, 4) OVER p AS e
       FROM bw WINDOW p AS (PARTITION BY k ORDER BY i)) WHERE e IS NOT NULL),
n AS (SELECT id, count(*) AS n FROM bs GROUP BY id)
SELECT ds.id AS doc_id, bs.id AS item_id, n.n AS item_shingles, count(*) AS shared_shingles
FROM ds JOIN bs USING (a, b, c, d, e) JOIN n ON n.id = bs.id
GROUP BY ds.id, bs.id, n.n HAVING 100 * count(*) >= 80 * n.n
"""
