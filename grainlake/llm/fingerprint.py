"""Document fingerprints by invertible Bloom lookup sketches.

A text's paragraphs hash to 64-bit digests. A sketch is three rows of cells; a digest falls into one cell of each row,
which counts it and XORs it and a check of it in. A fingerprint is a text's sketch of the base size. Two fingerprints
subtract cell by cell, so what both texts have cancels, and peeling recovers the rest: a cell that holds one digest
gives it away and lets it be taken out of its other cells. Where digests are left that no cell gives away, the pair is
tried again with larger sketches of both texts.

Only DataFrame functions. Fingerprints are arrays of cells in their document's row, where they are subtracted and peeled.
Larger sketches have their cells as rows, aggregated where their document lies, so that a round of peeling is an
explode and two hash aggregations without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Cells in each of the three rows of a fingerprint.
WIDTH = 16
#: Rounds of peeling before a pair counts as failed, and sizes that are tried after the fingerprints'.
ROUNDS, ATTEMPTS = 8, 8
#: Cells of larger sketches that a task aggregates, about, and buckets of neighbouring ids at most.
CELLS_AT_ONCE, BUCKETS = 400_000, 1 << 16
_CHECK = 97
_CELL = "struct<n:int,keys:bigint,checks:bigint>"


def paragraphs(text: Column) -> Column:
    """Lines, cut further behind the ends of sentences, without those that are blank."""
    return F.filter(F.split(text, r"\n+|(?<=[.!?])\x20+"), lambda x: F.length(x) > 0)


def digests(text: Column) -> Column:
    """The set of digests of a text's paragraphs. 0 marks a cell's own row, so it counts as 1."""
    hashed = F.transform(paragraphs(text), lambda x: F.xxhash64(x))
    return F.array_distinct(F.transform(hashed, lambda h: F.when(h == 0, F.lit(1)).otherwise(h)))


def _cell(key: Column, row: int, width: Column | int, seed: int) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    return (F.pmod(F.xxhash64(key, F.lit(seed * 3 + row)), width) + width * row).cast("int")


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(_CHECK))


def _placed(keys: Column, width: int) -> Column:
    """Digests with their checks and their cells."""
    return F.transform(keys, lambda k: F.struct(k.alias("k"), _check(k).alias("check"), *(_cell(k, r, width, 0).alias(f"c{r}") for r in range(3))))


def _cells(placed: Column, width: int) -> Column:
    """The sketch of ``_placed`` digests, an array of cells. It is read once a cell, so it should be a column."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("keys"), F.lit(0).cast("long").alias("checks"))
    put = lambda cell, p: F.struct((cell["n"] + 1).alias("n"), cell["keys"].bitwiseXOR(p["k"]).alias("keys"), cell["checks"].bitwiseXOR(p["check"]).alias("checks"))

    def line(r: int) -> Column:
        numbers = F.sequence(F.lit(r * width), F.lit((r + 1) * width - 1))
        return F.transform(numbers, lambda c: F.aggregate(F.filter(placed, lambda p: p[f"c{r}"] == c), empty, put))

    return F.concat(*map(line, range(3)))


def sketched(df: DataFrame, sets: dict[str, str], width: int = WIDTH) -> DataFrame:
    """``df`` with a sketch of the base size for each set of digests; ``sets`` names both columns."""
    placed = df.withColumns({f"_{cells}": _placed(F.col(keys), width) for keys, cells in sets.items()})
    return placed.withColumns({cells: _cells(F.col(f"_{cells}"), width) for cells in sets.values()}).drop(*(f"_{c}" for c in sets.values()))


def fingerprint(cells: Column, size: Column, width: int = WIDTH) -> Column:
    """A sketch as text: how many digests it holds, and of each cell that isn't empty its number, count, digests and
    checks; equal sets, so equal texts, have equal fingerprints."""
    shown = F.transform(cells, lambda c, k: F.when(c["n"] > 0, F.concat_ws(":", k.cast("string"), c["n"].cast("string"), F.lower(F.hex(c["keys"])), F.lower(F.hex(c["checks"])))))
    return F.concat(F.lit(f"iblt3x{width}/"), size.cast("string"), F.lit("/"), F.array_join(shown, ","))


def decoded(a: Column, b: Column, width: int = WIDTH, rounds: int = ROUNDS) -> Column:
    """How many digests peeling recovers from the difference of two sketches of the base size; null if some are left."""
    less = F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["keys"].bitwiseXOR(y["keys"]).alias("keys"), x["checks"].bitwiseXOR(y["checks"]).alias("checks")))

    def gives_away(c: Column, k: Column) -> Column:
        return (F.abs(c["n"]) == 1) & (_check(c["keys"]) == c["checks"]) & k.isin(*(_cell(c["keys"], r, width, 0) for r in range(3)))

    def peeled(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], gives_away)
        once = F.array_distinct(F.transform(pure, lambda c: F.struct(c["n"].alias("n"), c["keys"].alias("keys"), c["checks"].alias("checks"), *(_cell(c["keys"], r, width, 0).alias(f"c{r}") for r in range(3)))))
        out = lambda c, p: F.struct((c["n"] - p["n"]).alias("n"), c["keys"].bitwiseXOR(p["keys"]).alias("keys"), c["checks"].bitwiseXOR(p["checks"]).alias("checks"))
        # An array of one element, so that what it holds is worked out once and not for each cell.
        after = F.transform(F.array(once), lambda found: F.struct(F.transform(state["cells"], lambda c, k: F.aggregate(F.filter(found, lambda p: (p["c0"] == k) | (p["c1"] == k) | (p["c2"] == k)), c, out)).alias("cells"), (state["found"] + F.size(found)).alias("found")))
        return F.when(F.size(pure) == 0, state).otherwise(F.element_at(after, 1))

    begin = F.struct(less.cast(f"array<{_CELL}>").alias("cells"), F.lit(0).alias("found"))
    left = lambda s: F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["keys"] != 0) | (c["checks"] != 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, peeled, lambda s: F.when(~left(s), s["found"]))


def subtract(pairs: DataFrame, keep: list[str], attempt: int) -> DataFrame:
    """Cells of the difference of two larger sketches: ``keep, width, cell, n, keys, checks`` of ``pairs(keep, a, b)``.

    Both sketches have three rows as wide as the pair's digests need (half of their number, and more with each
    attempt), and as counting and XOR are linear, adding one side and subtracting the other is one aggregation.
    """
    width = ((F.size("a") + F.size("b") + 16) / 2 * (1 << attempt)).cast("int")
    signed = F.concat(F.transform("a", lambda k: F.struct(k.alias("key"), F.lit(1).alias("n"))), F.transform("b", lambda k: F.struct(k.alias("key"), F.lit(-1).alias("n"))))
    rows = pairs.withColumn("width", width).select(*keep, "width", F.explode(signed).alias("x"))
    rows = rows.select(*keep, "width", "x.key", "x.n", F.explode(F.array(*(_cell(F.col("x.key"), r, F.col("width"), attempt + 1) for r in range(3)))).alias("cell"))
    return _summed(rows.withColumnsRenamed({"key": "keys"}).withColumn("checks", _check(F.col("keys"))), keep)


def _summed(rows: DataFrame, keep: list[str]) -> DataFrame:
    cells = rows.groupBy(*keep, "width", "cell").agg(F.sum("n").alias("n"), F.bit_xor("keys").alias("keys"), F.bit_xor("checks").alias("checks"))
    return cells.where((F.col("n") != 0) | (F.col("keys") != 0) | (F.col("checks") != 0))


def peel(cells: DataFrame, keep: list[str], attempt: int, rounds: int = ROUNDS) -> DataFrame:
    """``keep, differing, failed``: how many digests peeling recovered, and whether some are left.

    Cell -1 counts those recovered. A digest that several cells give away in one round is taken out once: rows
    that take a digest out of a cell are alike, and the first aggregation makes one of them.
    """
    long = lambda x: F.lit(x).cast("long")
    for _ in range(rounds):
        at = [_cell(F.col("keys"), r, F.col("width"), attempt + 1) for r in range(3)]
        pure = (F.col("cell") >= 0) & (F.abs("n") == 1) & (_check(F.col("keys")) == F.col("checks")) & F.col("cell").isin(*at)
        row = lambda cell, n, keys, checks, key: F.struct(cell.alias("cell"), n.cast("long").alias("n"), keys.alias("keys"), checks.alias("checks"), key.alias("key"))
        own = row(F.col("cell"), F.col("n"), F.col("keys"), F.col("checks"), long(0))
        out = [row(c, -F.col("n"), F.col("keys"), F.col("checks"), F.col("keys")) for c in at]
        mark = row(F.lit(-1), long(1), long(0), long(0), F.col("keys"))
        rows = cells.select(*keep, "width", F.explode(F.when(pure, F.array(own, *out, mark)).otherwise(F.array(own))).alias("x")).select(*keep, "width", "x.*")
        once = rows.groupBy(*keep, "width", "cell", "key").agg(*(F.max(c).alias(c) for c in ("n", "keys", "checks")))
        cells = _summed(once, keep)
    found, left = F.when(F.col("cell") < 0, F.col("n")).otherwise(0), F.when(F.col("cell") >= 0, 1).otherwise(0)
    return cells.groupBy(*keep).agg(F.sum(found).alias("differing"), (F.sum(left) > 0).alias("failed"))


def differing(pairs: DataFrame, keep: list[str], attempt: int) -> DataFrame:
    """``keep, differing, failed`` of every pair that differs; pairs of equal sets have no row."""
    return peel(subtract(pairs, keep, attempt), keep, attempt)


def likeness(a: Column, b: Column, differ: Column) -> Column:
    """What two sets have in common as a share of what they have together, from their sizes and difference; 1 for
    two empty ones."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise((a + b - differ) / (a + b + differ))


def _boundaries(ids: DataFrame, per_bucket: int) -> list:
    """Ids that begin buckets of about ``per_bucket`` rows, the smallest first: where Spark's own ranges begin."""
    n = min(BUCKETS, max(1, -(-ids.count() // per_bucket)))
    ranges = ids.where("doc_id is not null").repartitionByRange(n, "doc_id").withColumn("range", F.spark_partition_id())
    return sorted(r[0] for r in ranges.groupBy("range").agg(F.min("doc_id").alias("first")).select("first").collect())


def _bucket(key: Column, first: list, kind: str) -> Column:
    """How many boundaries aren't above the key, found in two steps; 1 at least, for null keys and where there are none."""
    if not first:
        return F.lit(1)
    step = max(1, int(len(first) ** 0.5))
    heads, groups = first[::step], [first[k : k + step] for k in range(0, len(first), step)]
    upper = F.greatest(F.size(F.filter(F.lit(heads).cast(f"array<{kind}>"), lambda b: b <= key)), F.lit(1))
    within = F.size(F.filter(F.element_at(F.lit(groups).cast(f"array<array<{kind}>>"), upper), lambda b: b <= key))
    return F.greatest((upper - 1) * step + within, F.lit(1))


def with_next(df: DataFrame, id_col: str, text_col: str, per_bucket: int = 2000) -> DataFrame:
    """``bucket, at, doc_id, text, next_text`` of every row, where ``next`` is the row with the next larger id, of the
    last the first.

    Buckets of neighbouring ids are windows. The first rows of a bucket also go to the bucket before it, as what
    comes after its last row; so texts are shuffled once. Ids may be of any type that has an order. Null ids come
    first; rows that share an id follow one another by a hash of their texts. Null texts are empty.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    first = _boundaries(rows.select("doc_id"), per_bucket)
    n = max(1, len(first))
    place = lambda bucket, late: F.struct(bucket.cast("int").alias("bucket"), F.lit(late).alias("late"))
    before = F.when(F.col("_own") > 1, F.col("_own") - 1).otherwise(n)
    begins = F.col("doc_id").isNull()
    if first:
        begins = begins | (F.col("doc_id") == F.element_at(F.lit(first).cast(f"array<{kind}>"), F.col("_own")))
    places = F.when(begins, F.array(place(F.col("_own"), 0), place(before, 1))).otherwise(F.array(place(F.col("_own"), 0)))
    dealt = rows.withColumn("_own", _bucket(F.col("doc_id"), first, kind).cast("int")).select("doc_id", "text", F.inline(places)).repartition(n, "bucket")
    order = Window.partitionBy("bucket").orderBy("late", "doc_id", F.xxhash64("text"), "text")
    placed = dealt.withColumns({"at": F.row_number().over(order), "next_text": F.lead("text").over(order)})
    return placed.where("late = 0").select("bucket", "at", "doc_id", "text", "next_text")


def compare_versions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    ``edited`` is the SHA-256 of the text whose last half (rounded down, in code points) gave way to as many code
    points from the start of the next row's. ``near_*`` is the likeness to the edited and to the next text, from the
    digests that differ, which peeling recovers from the difference of the fingerprints or, where these are too small
    for it, of larger sketches of the same texts.

    Null texts are empty and have no paragraphs. Ids of other types than numbers, null and repeated ids: see
    ``with_next``. No rows, no rows. Other columns are ignored, whatever their names.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(df, id_col, text_col).withColumn("edited", edited)
    # Texts end here; what goes on are digests, eight bytes for each paragraph.
    sets = rows.select("bucket", "at", "doc_id", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("edited"), digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("new"), digests(F.col("next_text")).alias("other"))
    based = sketched(sets, {"own": "own_cells", "new": "new_cells", "other": "other_cells"})
    # Sets that differ by more digests in number than there are cells can't be decoded.
    fits = lambda b: F.abs(F.size("own") - F.size(b)) <= 3 * WIDTH
    based = based.withColumns({f"base_{k}": F.when(fits(b), decoded(F.col("own_cells"), F.col(f"{b}_cells"))) for k, b in enumerate(("new", "other"))})
    sets = materialise(based.withColumn("n_other", F.size("other")).withColumn("other", F.when(F.col("base_1").isNull(), F.col("other"))).drop("own_cells", "new_cells", "other_cells"), "paragraph-digests")
    key, keep = ["bucket", "at"], ["bucket", "at", "pair"]
    failed = F.col("base_0").isNull() | F.col("base_1").isNull()
    pair = lambda k, b: F.when(F.col(f"base_{k}").isNull(), F.struct(F.lit(k).alias("pair"), F.col("own").alias("a"), F.col(b).alias("b")))
    of = lambda name, k: F.max(F.when(F.col("pair") == k, F.col(name))).alias(f"{name}_{k}")
    # Pairs of equal sets have no row; they differ in nothing.
    found = lambda k: F.coalesce(f"base_{k}", F.when(~F.coalesce(f"failed_{k}", F.lit(False)), F.coalesce(f"differing_{k}", F.lit(0)).cast("int")))
    done, left = sets.where(~failed), sets.where(failed)
    for attempt in range(ATTEMPTS):
        # Digests are dealt out by row; cells and peeling stay where their row is. As many parts as keep what a task
        # aggregates, however large the table is.
        cells = left.select(F.inline(F.array_compact(F.array(pair(0, "new"), pair(1, "other"))))).agg(F.sum(F.size("a") + F.size("b"))).first()[0]
        if not cells:
            break
        dealt = left.repartition(-(-3 * cells // CELLS_AT_ONCE), *key)
        pairs = dealt.select(*key, F.inline(F.array_compact(F.array(pair(0, "new"), pair(1, "other")))))
        measured = differing(pairs, keep, attempt).groupBy(*key).agg(*(of(name, k) for name in ("differing", "failed") for k in (0, 1)))
        tried = materialise(dealt.join(measured, key, "left").withColumns({f"base_{k}": found(k) for k in (0, 1)}).select(sets.columns), "paragraph-digests")
        done, left = done.unionByName(tried.where(~failed)), tried.where(failed)
    else:
        if not left.isEmpty():
            raise ValueError(f"some sketches can't be decoded after {ATTEMPTS} attempts")
    near = lambda k, size: likeness(F.size("own"), size, F.col(f"base_{k}"))
    shown = sketched(done, {"own": "own_cells", "new": "new_cells"})
    return shown.select("doc_id", "n_chars", F.lower(F.hex("edited")).alias("edited"), fingerprint(F.col("own_cells"), F.size("own")).alias("fingerprint"), fingerprint(F.col("new_cells"), F.size("new")).alias("edited_fingerprint"), near(0, F.size("new")).alias("near_edited"), near(1, F.col("n_other")).alias("near_next"))
