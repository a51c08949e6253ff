"""I-Match document fingerprints from built-in functions alone.

A term is a run of letters, digits and bytes above ASCII, lower-cased, held as the first 48 bits of its MD5. The
lexicon keeps the slots (leading 20 bits) whose inverse document frequency lies in a band. A text's
distinct lexicon terms are sorted, and each of several random subsets of the lexicon gives one hash of the
sorted terms that lie in it. Subsets are drawn at four rates, so that both short and long texts have subsets
with few enough terms to outlast an edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading bits of a term that select its slot of the lexicon.
SLOT_BITS = 20
TERM_BITS = 48
#: (lowest bit, bits) of the term that choose its subset at each rate, 2**-bits.
LEVELS = [(0, 3), (3, 5), (8, 7), (15, 9)]
PER_LEVEL = 8
#: Band of the inverse document frequency, as shares of the documents that hold a term: at least and at most one in so many.
RARE, COMMON = 1000, 5

NOT_TERM = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def terms(text: str) -> Column:
    """Distinct terms of a text column as sorted 48-bit numbers; null and empty texts have none."""
    return F.expr(
        f"array_sort(transform(filter(array_distinct(split(lower(coalesce({text}, '')), '{NOT_TERM}')), w -> w <> ''), "
        f"w -> cast(conv(substring(md5(cast(w as binary)), 1, {TERM_BITS // 4}), 16, 10) as bigint)))"
    )


def lexicon(docs: DataFrame) -> bytearray:
    """A bit for each slot, six to an ASCII character above 63: set if the slot's document frequency lies in the band.

    Counts cover all documents (column ``terms_``). There are 2**SLOT_BITS slots, which bounds what is
    shuffled, what reaches the driver and what the plan carries.
    """
    slots = docs.select(F.explode(F.expr(f"array_distinct(transform(terms_, t -> shiftright(t, {TERM_BITS - SLOT_BITS})))")).alias("slot"))
    n = docs.count()
    kept = slots.groupBy("slot").agg(F.count("*").alias("df")).where((F.col("df") * RARE >= n) & (F.col("df") * COMMON <= n))
    marks = bytearray(b"@" * ((1 << SLOT_BITS) // 6 + 1))
    for row in kept.select("slot").collect():
        marks[row.slot // 6] |= 1 << row.slot % 6
    return marks


def in_lexicon(terms_col: str, marks: bytearray) -> Column:
    """The terms whose slot is marked. The marks are a constant of the plan: as a column they would be copied for each row."""
    slot = lambda t: F.shiftright(t, TERM_BITS - SLOT_BITS).cast("int")
    cell = lambda t: F.ascii(F.substring(F.lit(marks), F.floor(slot(t) / 6).cast("int") + 1, F.lit(1)).cast("string"))
    bit = lambda t: F.call_function("shiftright", cell(t), slot(t) % 6).bitwiseAND(F.lit(1))
    return F.filter(terms_col, lambda t: bit(t) == 1)


def subset_hashes(terms_col: str, kept: str) -> Column:
    """Array of one hash for each lexicon subset of the ``kept`` terms, '-' where there is no term of the subset.

    A text without any lexicon term has the hash of all its terms in the last place instead.
    """
    shift = ", ".join(str(low) for low, _ in LEVELS for _ in range(PER_LEVEL))
    mask = ", ".join(str((1 << bits) - 1) for _, bits in LEVELS for _ in range(PER_LEVEL))
    digest = lambda x: f"substring(md5(cast(array_join(transform({x}, t -> cast(t as string)), ',') as binary)), 1, 12)"
    subset = f"filter({kept}, t -> (shiftright(t, array({shift})[i]) & array({mask})[i]) = i % {PER_LEVEL})"
    n = len(LEVELS) * PER_LEVEL
    return F.expr(
        f"if(size({kept}) = 0, array_append(array_repeat('-', {n - 1}), {digest(terms_col)}), "
        f"transform(sequence(0, {n - 1}), i -> transform(array({subset}), s -> if(size(s) = 0, '-', {digest('s')}))[0]))"
    )


def likeness(a: str, b: str) -> Column:
    """Share of equal hashes among the subsets that are not empty for both texts; 1 if all are."""
    return F.expr(
        f"transform(array(zip_with({a}, {b}, (x, y) -> if(x = '-' and y = '-', null, if(x = y, 1, 0)))), "
        "z -> if(size(array_compact(z)) = 0, 1e0, cast(aggregate(array_compact(z), 0, (s, v) -> s + v) as double) / size(array_compact(z))))[0]"
    )


def with_next(docs: DataFrame, order: str, tie: str, columns: list[str]) -> DataFrame:
    """Add ``next_`` columns of the following row by ascending ``order`` (nulls last, then ``tie``); after the last, the first.

    Rows are dealt into ranges at quantiles of ``order``, as many as shuffle partitions; the first row of
    each range also visits the range before as a guest, so each row meets its successor in one shuffle.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, least = docs.agg(
        F.percentile_approx(order, [i / parts for i in range(1, parts)] or [0.5], 10 * parts + 1000), F.min(order)
    ).first()
    cuts = sorted({c for c in cuts or [] if c > least})
    bounds = ", ".join(f"{c}L" for c in cuts)
    part = F.expr(f"if({order} is null, {len(cuts)}, size(filter(array({bounds}), b -> b <= {order})))") if cuts else F.lit(0)
    first = F.expr(f"{order} in ({bounds})") if cuts else F.lit(False)
    visit = lambda p, guest, wrap: F.struct(p.alias("part_"), F.lit(guest).alias("guest_"), F.lit(wrap).alias("wrap_"))
    visits = F.array_compact(F.array(
        visit(part, False, False),
        F.when(first, visit(part - 1, True, False)),
        F.when(F.col(order).eqNullSafe(F.lit(least)), visit(F.lit(len(cuts)), True, True)),
    ))
    w = Window.partitionBy("part_").orderBy("wrap_", F.col(order).asc_nulls_last(), F.col(tie).asc_nulls_first())
    rows = docs.withColumn("visit_", F.explode(visits)).select(*docs.columns, "visit_.*")
    led = rows.select(*docs.columns, "guest_", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return led.where(~F.col("guest_")).drop("guest_")


def fingerprint_pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited form, and how alike they and the next text's are.

    The edited text has its last quarter (rounded down) replaced by as many first code points of the next
    document, or all of them if fewer. Null texts count as empty; equal texts have equal fingerprints.
    Null ids come last, rows with equal ids in the order of their texts. An empty table gives no rows.
    Only the two named columns are read.
    """
    base = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_")).withColumn("terms_", terms("text_"))
    marks = lexicon(base)
    own = base.withColumn("kept_", in_lexicon("terms_", marks)).select("id_", "text_", subset_hashes("terms_", "kept_").alias("print_"))
    led = with_next(own, "id_", "text_", ["text_", "print_"])
    n = F.char_length("text_")
    edited = F.expr("substring(text_, 1, cast(char_length(text_) - char_length(text_) div 4 as int)) || substring(next_text_, 1, cast(char_length(text_) div 4 as int))")
    led = led.select("id_", n.cast("long").alias("n_chars"), "print_", "next_print_", edited.alias("edited_"))
    led = led.withColumn("terms_", terms("edited_")).withColumn("kept_", in_lexicon("terms_", marks))
    led = led.withColumn("edited_print_", subset_hashes("terms_", "kept_"))
    return led.select(
        F.col("id_").alias("doc_id"), "n_chars", F.sha2("edited_", 256).alias("edited_sha256"),
        F.array_join("print_", ":").alias("fingerprint"), F.array_join("edited_print_", ":").alias("edited_fingerprint"),
        likeness("print_", "edited_print_").alias("near_edited"), likeness("print_", "next_print_").alias("near_next"),
    )
