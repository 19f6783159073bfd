"""Near-duplicate detection: one-permutation MinHash with optimal densification, banded buckets,
star-shaped candidate edges, exact confirmation and connected components.

1. One pass over the texts hashes each distinct shingle once, keeps the smallest hash of each of
   ``bands * rows`` bins, fills empty bins from a bin that a fixed random order of that bin names
   first, and hashes ``rows`` bins at a time to bucket keys.
2. Texts with equal shingle sets are one class; only its smallest id goes on.
3. A bucket proposes edges from ``_ORDERS`` centres (its first members in as many orders) to each
   other member, never all pairs. Sizes of sets that can't reach the threshold rule an edge out.
4. Edges are confirmed on full shingle sets; components follow from confirmed edges.
5. A star can miss two members that resemble each other but none of its centres. Buckets whose
   members are still in several components therefore go on: those of up to ``_SMALL`` members test
   all pairs between components, larger ones a star over one member of each component, drawn anew in
   each of at most ``_ROUNDS`` rounds.
6. The rounds only lessen what is left. Large buckets that are mixed after them form families (texts
   reachable over such buckets), and all pairs between components of a family are counted on full
   shingle sets. A family is dealt into blocks of at most ``_BLOCK`` members and ``_BLOCK_SHINGLES``
   shingles on average; a task counts two blocks against each other, so only texts travel, once for
   each block they are held against, and only edges that join components come back. Components that
   fill half a block have blocks of their own, which aren't held against each other. The work grows
   with the square of what the rounds left of a family; no pair that shares a bucket is left out.

Two texts at the threshold share no bucket with a probability under ``_MISS``.

Edge cases: a null text, or one without words, has no shingles and is linked with nothing; a text
with fewer than ``k`` words has one shingle; rows that share an id count as one document; a row with
a null id is linked with nothing and kept; an empty table gives no rows; further columns of the
input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import storage
from .components import connected_components
from .shingles import mix64, shingle_sets

_U = np.uint64
_BINS = 144
_MISS = 1e-6
_ORDERS = 3
_SMALL = 12
_ROUNDS = 2
_BLOCK = 512
_BLOCK_SHINGLES = 1 << 19
_COLUMNS = 4096
_SIGNED = "id long, n_shingles long, set_hash_1 long, set_hash_2 long, keys array<long>"
_CONFIRMED = "a long, b long, shared long, linked boolean"


def band_shape(threshold: float, bins: int = _BINS, miss: float = _MISS) -> tuple[int, int]:
    """(bands, rows): the most rows a band may have while a pair at the threshold is missed with a
    probability of at most ``miss``."""
    for rows in range(bins, 1, -1):
        if (1 - threshold**rows) ** (bins // rows) <= miss:
            return bins // rows, rows
    return bins, 1


def _orders(bins: int) -> np.ndarray:
    """For each bin the order in which an empty one looks at the others."""
    rng = np.random.default_rng(977)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def signature(shingles: np.ndarray, bins: int, orders: np.ndarray) -> np.ndarray:
    """``shingles``: sorted distinct hashes, not empty. The bin of a hash is a monotone function of
    it, so the first of each bin is its minimum."""
    where = (((shingles >> _U(32)) * _U(bins)) >> _U(32)).astype(np.int64)
    heads = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    out, full = np.zeros(bins, dtype=np.uint64), np.zeros(bins, dtype=bool)
    out[where[heads]] = shingles[heads]
    full[where[heads]] = True
    if len(heads) < bins:
        empty = np.flatnonzero(~full)
        order = orders[empty]
        out[empty] = out[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    weights = (np.arange(rows, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
    folded = (mix64(sig[: bands * rows]).reshape(bands, rows) * mix64(weights)).sum(axis=1, dtype=np.uint64)
    return mix64(folded + mix64(np.arange(bands, dtype=np.uint64)))


def sign(docs: DataFrame, *, k: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set_hash_1, set_hash_2 (of the shingle set), keys (of its buckets; none for an
    empty set)."""

    def run(batches):
        import pyarrow as pa

        bins = bands * rows
        orders = _orders(bins)
        for whole in batches:
            for batch in storage.batch_slices(whole, "text", 1 << 20):
                n, h1, h2, keys, ends = [], [], [], [], [0]
                for s in shingle_sets(batch.column(1), k):
                    n.append(len(s))
                    h1.append(s.sum(dtype=np.uint64))
                    h2.append(mix64(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                    if len(s):
                        keys.append(band_keys(signature(s, bins, orders), bands, rows))
                    ends.append(ends[-1] + (bands if len(s) else 0))
                flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    names=["id", "n_shingles", "set_hash_1", "set_hash_2", "keys"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _SIGNED)


def confirm(pairs: DataFrame, texts: DataFrame, *, k: int, percent: int) -> DataFrame:
    """a, b, shared, linked: ``pairs`` (a, b) held against the full shingle sets of both ``texts``
    (id, text).

    Texts travel, not sets: a shingle hash is longer than its share of the text. Rows arrive sorted
    by ``a``, the centre of a star, whose set is then computed once."""

    def run(batches):
        import pyarrow as pa

        held_text, held = None, np.zeros(0, np.uint64)
        for whole in batches:
            for batch in storage.batch_slices(whole, "text_b", 1 << 20):
                shared, linked = [], []
                for text_a, b in zip(batch.column(2), shingle_sets(batch.column(3), k), strict=True):
                    if held_text is None or not text_a.equals(held_text):
                        held_text, held = text_a, next(shingle_sets(pa.array([text_a.as_py()], pa.string()), k))
                    both = np.concatenate((held, b))
                    both.sort()
                    inter = int((both[1:] == both[:-1]).sum())
                    shared.append(inter)
                    linked.append(inter > 0 and 100 * inter >= percent * (len(held) + len(b) - inter))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "shared", "linked"])

    with_b = pairs.hint("merge").join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")
    both = with_b.hint("merge").join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, _CONFIRMED)


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, component_id (smallest id reachable over pairs of texts with
    100 * shared >= percent * union) and kept (id = component_id), one row for each row of ``docs``."""
    with storage.scratch(docs.sparkSession) as keep:
        bands, rows = band_shape(percent / 100)
        settings = {"k": k, "percent": percent}
        signed = storage.materialize(sign(docs, k=k, bands=bands, rows=rows, id_col=id_col, text_col=text_col), "minhash-signed")
        real = signed.filter("id IS NOT NULL AND n_shingles > 0")
        same = ["set_hash_1", "set_hash_2", "n_shingles"]
        classes = storage.materialize(real.groupBy(same).agg(F.min("id").alias("rep")), "minhash-classes")
        members = real.join(classes, same).select("id", "rep", "n_shingles", "keys")
        reps = storage.materialize(members.filter("id = rep").select("id", "n_shingles", "keys"), "minhash-reps")
        buckets = reps.select("id", "n_shingles", F.explode("keys").alias("key"))
        orders = [F.min("id").alias("c0")] + [F.min_by("id", F.xxhash64("id", F.lit(o))).alias(f"c{o}") for o in range(1, _ORDERS)]
        centres = storage.materialize(buckets.groupBy("key").agg(F.count("*").alias("n"), *orders).filter("n > 1"), "minhash-centres")
        shared = storage.materialize(buckets.join(centres, "key"), "minhash-buckets")
        sizes = reps.select("id", "n_shingles")
        stars = shared.select(F.col("id").alias("b"), "n_shingles", F.explode(F.array_distinct(F.array(*[f"c{o}" for o in range(_ORDERS)]))).alias("a"))
        pairs = storage.materialize(_possible(stars, sizes, percent), "minhash-pairs")
        # the texts of bucket mates, the only ones that any round needs, leave the documents once; their
        # share of the input doesn't depend on its size, so neither does the way they are joined
        mates = storage.materialize(shared.select("id").distinct(), "minhash-mates")
        all_texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        texts = storage.materialize(all_texts.join(mates.hint("merge"), "id", "left_semi"), "minhash-texts")
        tested = storage.materialize(confirm(pairs, texts, **settings), "minhash-confirmed")
        found = connected_components(tested.filter("linked"), "a", "b", "minhash-components")
        crowded = shared.filter("n > 2").select("id").distinct()
        crowd = storage.materialize(reps.join(crowded, "id", "left_semi"), "minhash-crowd")
        found, large = _between_components(crowd, sizes, found, tested, texts, settings)
        if large.limit(1).count():
            found = _joined(found, storage.materialize(_between_blocks(large, sizes, texts, settings), "minhash-confirmed"))
        if real.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
            # rows that share an id hold their classes together
            inner = members.filter("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
            found = _joined(found, inner)
        labels = classes.join(found, classes.rep == found.node, "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
        out = signed.drop("keys").join(labels, same, "left")
        out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
        out = out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
        return keep(out, "minhash")


def _possible(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b), a < b, of ``pairs`` (a, b, n_shingles of b) whose sizes allow the threshold."""
    both = pairs.filter("a != b").distinct().join(sizes.withColumnsRenamed({"id": "a", "n_shingles": "n_a"}), "a")
    near = both.filter(100 * F.least("n_a", "n_shingles") >= percent * F.greatest("n_a", "n_shingles"))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components ``found`` (node, component), joined by further ``links`` (a, b). A component stands for all
    links that made it, so each of its nodes brings one edge."""
    held = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return connected_components(links.select("a", "b").unionByName(held), "a", "b", "minhash-components")


def _between_components(crowd: DataFrame, sizes: DataFrame, found: DataFrame, tested: DataFrame, texts: DataFrame, settings: dict) -> tuple[DataFrame, DataFrame]:
    """Step 5 of the module's description: components after it, and the members
    (id, component, key) of large buckets that are still mixed. ``crowd``: id, n_shingles, keys of
    the texts in buckets of more than two."""
    def mixed() -> DataFrame:
        labelled = crowd.join(found, crowd.id == found.node, "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"), F.explode("keys").alias("key"))
        keys = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low != high").select("key", "n")
        # written on its own, so that the join can split a key with very many members
        return storage.materialize(labelled.join(storage.materialize(keys, "minhash-mixed-keys"), "key"), "minhash-mixed")

    buckets = mixed()
    for turn in range(_ROUNDS):
        small, large = buckets.filter(F.col("n") <= _SMALL), buckets.filter(F.col("n") > _SMALL)
        mine = storage.materialize(large.groupBy("key", "component").agg(F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("id")), "minhash-drawn")
        centre = storage.materialize(mine.groupBy("key").agg(F.min_by("id", F.xxhash64("component", F.lit(turn))).alias("a")), "minhash-drawn-centres")
        star = mine.join(centre, "key").join(sizes, "id").select(F.col("id").alias("b"), "n_shingles", "a")
        if not turn:
            other = small.select("key", F.col("id").alias("a"), F.col("component").alias("component_a"))
            crossing = small.join(other, "key").filter("a < id AND component != component_a")
            star = star.unionByName(crossing.select(F.col("id").alias("b"), "n_shingles", "a"))
        pairs = storage.materialize(_possible(star, sizes, settings["percent"]).join(tested.select("a", "b"), ["a", "b"], "left_anti"), "minhash-pairs")
        if not pairs.limit(1).count():
            break
        more = storage.materialize(confirm(pairs, texts, **settings), "minhash-confirmed")
        tested = tested.unionByName(more)
        if not more.filter("linked").limit(1).count():
            break
        found = _joined(found, more.filter("linked"))
        buckets = mixed()
    return found, buckets.filter(F.col("n") > _SMALL).select("id", "component", "key")


def _shared(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``one`` with each of ``other``; sets are sorted and
    distinct. Only shingles that both sides have are counted, some columns at a time."""
    columns = np.intersect1d(np.concatenate(one), np.concatenate(other))

    def cells(sets):
        flat = np.concatenate(sets)
        at = np.searchsorted(columns, flat)
        there = at < len(columns)
        there[there] = columns[at[there]] == flat[there]
        at, row = at[there], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[there]
        order = np.argsort(at, kind="stable")
        return at[order], row[order]

    sides, total = [(len(s), *cells(s)) for s in (one, other)], np.zeros((len(one), len(other)))
    for first in range(0, len(columns), _COLUMNS):
        dense = []
        for n, at, row in sides:
            a, b = np.searchsorted(at, [first, first + _COLUMNS])
            held = np.zeros((n, min(_COLUMNS, len(columns) - first)), np.float32)
            held[row[a:b], at[a:b] - first] = 1
            dense.append(held)
        total += dense[0] @ dense[1].T
    return total.astype(np.int64)


def _joining(one: tuple, other: tuple, percent: int) -> list[tuple[int, int, int]]:
    """(a, b, shared) of linked pairs of the sides (ids, components, sets): a forest over components,
    which is all that their union needs."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    shared = _shared(one[2], other[2])
    n, m = (np.array([len(s) for s in side[2]]) for side in (one, other))
    hits = (shared > 0) & (100 * shared >= percent * (n[:, None] + m[None, :] - shared)) & (one[1][:, None] != other[1][None, :])
    rows, cols = np.nonzero(hits)
    _, at = np.unique(np.stack((one[1][rows], other[1][cols])), axis=1, return_index=True)
    out = []
    for i, j in zip(rows[at].tolist(), cols[at].tolist(), strict=True):
        x, y = root(int(one[1][i])), root(int(other[1][j]))
        if x != y:
            parent[x] = y
            a, b = sorted((int(one[0][i]), int(other[0][j])))
            out.append((a, b, int(shared[i, j])))
    return out


def _between_blocks(large: DataFrame, sizes: DataFrame, texts: DataFrame, settings: dict) -> DataFrame:
    """Step 6 of the module's description: a, b, shared, linked of pairs that join components."""
    k, percent = settings["k"], settings["percent"]
    hubs = storage.materialize(large.groupBy("key").agg(F.min("id").alias("hub")), "minhash-hubs")
    families = connected_components(large.join(hubs, "key").select("id", "hub").distinct(), "id", "hub", "minhash-families")
    members = large.select("id", "component").distinct().join(families.select(F.col("node").alias("id"), F.col("component").alias("family")), "id").join(sizes, "id")
    members = storage.materialize(members, "minhash-members")
    need = lambda: F.greatest(F.count("*") / _BLOCK, F.sum("n_shingles") / _BLOCK_SHINGLES)
    pools = members.groupBy("family", "component").agg(need().alias("need")).select("family", "component", F.when(F.col("need") >= 0.5, F.col("component").cast("string")).otherwise("rest").alias("pool"))
    pooled = members.join(pools, ["family", "component"])
    blocks = pooled.groupBy("family", "pool").agg(F.ceil(need()).alias("n"))
    dealt = pooled.join(blocks, ["family", "pool"]).withColumn("block", F.concat_ws(":", "pool", F.pmod(F.xxhash64("id"), F.col("n"))))
    dealt = storage.materialize(dealt.select("id", "component", "family", "pool", "block"), "minhash-blocks")
    mine = dealt.select("family", "pool", "block").distinct()
    other = mine.withColumnsRenamed({"pool": "pool_2", "block": "block_2"})
    units = mine.join(other, "family").filter("block <= block_2 AND (pool = 'rest' OR pool != pool_2)")
    units = units.select("family", F.concat_ws("/", "family", "block", "block_2").alias("unit"), F.inline(F.array(F.struct(F.col("block"), F.lit(0).alias("side")), F.struct(F.col("block_2").alias("block"), F.lit(1).alias("side")))))
    # a block against itself is sent once
    units = units.groupBy("family", "unit", "block").agg(F.min("side").alias("side"))

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        sides = []
        for side in (0, 1):
            part = table.filter(pc.equal(table["side"], side))
            sets = [s for chunk in part["text"].chunks for s in shingle_sets(chunk, k)]
            sides.append((part["id"].to_numpy(), part["component"].to_numpy(), sets))
        out = _joining(sides[0], sides[1] if sides[1][2] else sides[0], percent) if sides[0][2] else []
        a, b, shared = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(shared, pa.int64()), pa.array([True] * len(out), pa.bool_())], names=["a", "b", "shared", "linked"])

    rows = dealt.select("id", "component", "family", "block").join(texts, "id").join(units, ["family", "block"])
    return rows.select("unit", "side", "id", "component", "text").groupBy("unit").applyInArrow(run, _CONFIRMED)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)
