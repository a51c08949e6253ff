"""MinHash near-duplicates by tensored banding.

Two small collections of minhash groups are kept, and every pair of a left and a right group keys one
table: GROUPS**2 tables from 2 * GROUPS groups of ROWS minhashes. Keys are formed of those groups alone that a class shares with another one. Texts with equal shingle sets form one class.
Classes that meet in a table are compared with the table's least class first; where a bucket still holds several
components, its members outside the largest one are compared with all the others, in blocks of sets that
give only links, so that a group of thousands of copies never yields all its pairs. Links are confirmed on
whole shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import scratch, small_side
from .components import components
from .scan import SPACED, Texts, Words, longs, map_blocks, mix, nested, seeded

#: Words of a shingle.
SHINGLE = 5
#: Link at 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Groups of each of the two collections, and minhashes of a group. A pair at the threshold is missed
#: by all tables with a probability of about 2 * (1 - 0.75**ROWS)**GROUPS, 0.0005.
GROUPS, ROWS = 10, 2
HASHES = 2 * GROUPS * ROWS
#: Equal minhashes that a pair needs before its sets are compared; at the threshold 30 are expected, and fewer than 18 have a chance of about 1e-5.
LEAST_EQUAL = 18
#: Sets of a block in the comparison of what the first round left apart.
BLOCK = 512

_U = np.uint64
_XOR, _ODD = seeded(101, HASHES), seeded(202, HASHES) | _U(1)


def shingle_sets(texts: Texts, lo: int, hi: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; texts of fewer words have one shingle, empty texts none."""
    w = Words(texts, lo, hi, SPACED)
    at, grams = w.grams(SHINGLE)
    first = np.searchsorted(w.rows[at], np.arange(hi - lo + 1))
    out = []
    for i, n in enumerate(w.counts.tolist()):
        if n >= SHINGLE:
            out.append(np.unique(grams[first[i] : first[i + 1]]))
        else:
            acc = np.full(min(n, 1), n, _U)
            for h in w.hashes[w.first[i] : w.first[i] + n]:
                acc = acc * _U(0xC2B2AE3D27D4EB4F) + h
            out.append(mix(acc))
    return out


def _sketch(texts: Texts, lo: int, hi: int) -> dict[str, pa.Array]:
    sets = shingle_sets(texts, lo, hi)
    size = np.array([len(s) for s in sets])
    some = np.flatnonzero(size)
    mins = np.zeros((len(sets), HASHES), np.uint32)
    one, two = np.zeros(len(sets), _U), np.zeros(len(sets), _U)
    if len(some):
        flat = np.concatenate(sets)
        cuts = np.concatenate([[0], np.cumsum(size[some])[:-1]])
        one[some], two[some] = np.add.reduceat(mix(flat), cuts), np.add.reduceat(mix(flat ^ _U(0x5851F42D4C957F2D)), cuts)
        for j in range(HASHES):
            mins[some, j] = np.minimum.reduceat((((flat ^ _XOR[j]) * _ODD[j]) >> _U(32)).astype(np.uint32), cuts)
    return {
        "n_shingles": pa.array(size.astype(np.int64)), "set_one": longs(one), "set_two": longs(two),
        "mins": nested(pa.array(mins.view(np.int32).ravel()), np.full(len(sets), HASHES)),
    }


def _grams(texts: Texts, lo: int, hi: int) -> dict[str, pa.Array]:
    sets = shingle_sets(texts, lo, hi)
    return {"grams": nested(longs(np.concatenate(sets)), np.array([len(s) for s in sets]))}


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    where = scratch(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def sets_of(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, grams) of the named classes. Up to BROADCAST_ROWS ids go to the texts, so that no text is shuffled for a few sets."""
    chosen = stored(classes, "chosen")
    return stored(map_blocks(texts.join(small_side(chosen, chosen.count()), "cls", "left_semi"), "text_", ["cls"], "grams array<long>", _grams), "sets")


def confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of classes (a, b) whose sets reach the threshold, compared on all shingles."""
    sketch = classes.select("cls", "mins", "n_shingles")
    side = lambda c: sketch.select(F.col("cls").alias(c), F.col("mins").alias(f"mins_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    equal = F.aggregate(F.zip_with("mins_a", "mins_b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where((equal >= LEAST_EQUAL) & (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")))
    likely = stored(likely.select("a", "b", "n_a", "n_b"), "likely")
    grams = sets_of(texts, likely.select(F.col("a").alias("cls")).union(likely.select("b")).distinct())
    both = small_side(likely, likely.count()).join(grams.select(F.col("cls").alias("a"), F.col("grams").alias("g_a")), "a").join(grams.select(F.col("cls").alias("b"), F.col("grams").alias("g_b")), "b")
    common = F.size(F.array_intersect("g_a", "g_b"))
    return both.where(100 * common >= PERCENT * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def _block_links(others: pa.Table, members: pa.Table) -> pa.Table:
    """Links between two blocks of sets, found through an index of the second block's shingles.

    Of the links found those are returned that connect something new, at most one for each set.
    """
    a, b = others.column("cls").to_numpy(), members.column("cls_").to_numpy()
    links: list[tuple[int, int]] = []
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    if len(a) and len(b):
        lists = members.column("grams_").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        gram, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(b)), size)
        order = np.argsort(gram, kind="stable")
        gram, owner = gram[order], owner[order]
        for cls, own in zip(a.tolist(), others.column("grams").combine_chunks()):
            own = own.values.to_numpy()
            lo, hi = np.searchsorted(gram, own, "left"), np.searchsorted(gram, own, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(b))
            near = np.flatnonzero(100 * common >= PERCENT * (len(own) + size - common))
            for x in b[near].tolist():
                one, two = top(cls), top(x)
                if one != two:
                    above[one] = two
                    links.append((cls, x))
    cols = list(zip(*links)) or [()] * 2
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def block_links(mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the classes outside and all classes of each group; ``mixed`` has (main, cls, outside) once each.

    Blocks are dealt by a hash of the class; their number follows the group's counted classes.
    """
    sizes = mixed.groupBy("main").agg(F.ceil(F.sum(F.col("outside").cast("int")) / BLOCK).cast("int").alias("n_out"), F.ceil(F.count("*") / BLOCK).cast("int").alias("n_all"))
    dealt = mixed.join(sizes, "main").join(sets_of(texts, mixed.select("cls").distinct()), "cls")
    block = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("outside").select("main", block("n_out").alias("i"), every("n_all").alias("j"), "cls", "grams")
    right = dealt.select(F.col("main").alias("main_"), every("n_out").alias("i_"), block("n_all").alias("j_"), F.col("cls").alias("cls_"), F.col("grams").alias("grams_"))
    return left.groupBy("main", "i", "j").cogroup(right.groupBy("main_", "i_", "j_")).applyInArrow(_block_links, "a long, b long")


def link(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: components of near-duplicate texts.

    component_id is the smallest id reachable over links, and kept says whether that is the row's own. Null
    and empty texts have no shingles and no links. Rows without an id are linked with nothing, have a null
    component and are not kept. Rows that share an id count as one document for what is reachable. An
    empty table gives no rows. Only the two named columns are read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text_"))
    rows = stored(map_blocks(base, "text_", ["doc_id"], "n_shingles long, set_one long, set_two long, mins array<int>", _sketch), "sketches")
    named = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    sets = ["n_shingles", "set_one", "set_two"]
    classes = stored(named.groupBy(*sets).agg(F.min("doc_id").alias("cls"), F.first("mins").alias("mins")), "classes")
    texts = base.withColumnRenamed("doc_id", "cls")

    # a table can match only where its left and its right group both meet another class, so groups are counted first
    groups = F.expr(f"explode(transform(sequence(0, {2 * GROUPS - 1}), g -> struct(g, xxhash64(g, slice(mins, g * {ROWS} + 1, {ROWS})) as value)))")
    grouped = classes.select("cls", groups.alias("group")).select("cls", "group.g", "group.value")
    shared = stored(grouped.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value"), "shared")
    side = lambda left: F.collect_list(F.when((F.col("g") < GROUPS) == F.lit(left), F.col("value")))
    alive = grouped.join(shared, "value").groupBy("cls").agg(side(True).alias("left"), side(False).alias("right"))
    alive = stored(alive, "alive")
    # combined before the shuffle, and written, so that the join can split a large bucket
    spots = F.explode(F.flatten(F.transform("left", lambda x: F.transform("right", lambda y: F.xxhash64(x, y)))))
    keyed = alive.select(spots.alias("spot"), "cls")
    heads = stored(keyed.groupBy("spot").agg(F.min("cls").alias("head"), F.count("*").alias("n")).where("n > 1"), "heads")
    members = stored(keyed.join(heads, "spot").select("spot", "cls", "head", "n"), "members")
    stars = members.where("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b")).distinct()
    links = stored(confirmed(stars, classes, texts), "links")

    found = components(links)
    rooted = members.where("n > 2").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    sizes = found.groupBy("root").count()
    rooted = stored(rooted.join(sizes, "root", "left").select("spot", "cls", "head", "root", F.coalesce("count", F.lit(0)).alias("size")), "rooted")
    main = rooted.groupBy("spot").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("spot", "main")
    mixed = rooted.join(stored(main, "mains"), "spot").groupBy("main", "cls").agg(F.max(F.col("root") != F.col("main")).alias("outside"))
    more = block_links(stored(mixed, "mixed"), texts)
    found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    roots = classes.select(*sets, "cls").join(found.withColumnRenamed("node", "cls"), "cls", "left").select(*sets, F.coalesce("root", "cls").alias("component_id"))
    alone = rows.where(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = named.select("doc_id", *sets).join(roots, sets).select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
