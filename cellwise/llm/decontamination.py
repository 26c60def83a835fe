"""Removing benchmark passages: a hash set of the items' word n-grams, sought in every window of every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.llm.common import BROADCAST_ROWS, LOWER, UPPER, ascii_lower, broadcast_if_small, durable, row_key

#: Fixed value: what separates words (ASCII that is neither letter nor digit).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in order; none if it is null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


#: words() of the column t in SQL.
WORDS_OF_T = f"array_remove(split(translate(coalesce(t, ''), '{UPPER}', '{LOWER}'), r'{SEPARATORS}'), '')"


def benchmark_grams(benchmark: DataFrame, n: int, item_id: str, text: str) -> DataFrame:
    """One row for each different window: gram (its words), size, h (its hash) and items (the ids of those that hold it, null ids aside).

    A window has n words; an item of fewer words, but not none, is one window.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0")
    grams = items.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(size(w) - {n - 1}, 1)), i -> slice(w, i, {n}))")).alias("gram"))
    return grams.groupBy("gram").agg(F.collect_set("item").alias("items")).select("gram", F.size("gram").alias("size"), F.xxhash64("gram").alias("h"), "items")


def _bitmap(grams: DataFrame, total: int) -> tuple[DataFrame, int]:
    """One row `bits`, an array of longs in which the bit of each hash is set, and the number of bits: 64 for each hash, 16 MB at most."""
    size = min(1 << 27, max(1 << 12, 1 << (64 * total - 1).bit_length()))
    place = F.pmod("h", F.lit(size))
    own = grams.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(h, {size}) % 64 AS INT))")).alias("long"))
    every = grams.sparkSession.range(size // 64).withColumnRenamed("id", "slot")
    dense = every.join(own, F.col("slot") == F.col("at"), "left").select("slot", F.coalesce("long", F.lit(0).cast("long")).alias("long"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "long"))), lambda x: x["long"]).alias("bits")), size


def _windows_that(test: dict[int, str]) -> Column:
    """(pos, gram) of each window of the text `t` whose hash h passes the test for its size. The text is cut into words once."""
    none = "CAST(array() AS array<struct<pos:int,gram:array<string>>>)"
    parts = [
        f"CASE WHEN size(w) >= {size} THEN transform(filter(sequence(1, size(w) - {size - 1}), i -> {passes.replace('{h}', f'xxhash64(slice(w, i, {size}))')}), i -> struct(i AS pos, slice(w, i, {size}) AS gram)) ELSE {none} END"
        for size, passes in sorted(test.items())
    ]
    return F.expr(f"element_at(transform(array({WORDS_OF_T}), w -> concat({', '.join(parts)})), 1)" if parts else none)


def _hits(docs: DataFrame, benchmark: DataFrame, n: int, item_id: str, item_text: str, set_bound: int) -> DataFrame:
    """(k, hit, items) of the rows (k, t) of docs that have hits, each k once."""
    grams = benchmark_grams(benchmark, n, item_id, item_text)
    sizes = grams.groupBy("size").agg(F.count("*").alias("n"), F.sum(F.greatest(F.size("items"), F.lit(1))).alias("pairs")).collect()  # n rows at most
    total, pairs = sum(r["n"] for r in sizes), sum(r["pairs"] for r in sizes)
    if total <= set_bound:
        hashes: dict[int, list[int]] = {r["size"]: [] for r in sizes}
        for r in grams.select("size", "h").collect():  # set_bound rows at most
            hashes[r["size"]].append(r["h"])
        found = docs.withColumn("found", _windows_that({size: f"{{h}} IN ({', '.join(f'{h}L' for h in values)})" for size, values in hashes.items()}))
    else:
        bits, size = _bitmap(grams, total)
        test = f"getbit(bits[CAST(shiftright(pmod({{h}}, {size}), 6) AS INT)], CAST(pmod({{h}}, {size}) % 64 AS INT)) = 1"
        found = docs.join(F.broadcast(bits)).withColumn("found", _windows_that({r["size"]: test for r in sizes}))
    each = found.select("k", F.explode_outer("found").alias("f")).where("f IS NOT NULL")  # a filter before it would search twice
    known = broadcast_if_small(grams.select(F.col("gram").alias("known"), "items"), pairs, set_bound)
    verified = each.select("k", "f.pos", F.col("f.gram").alias("gram"), F.size("f.gram").alias("size")).join(known, F.col("gram") == F.col("known"))
    return verified.groupBy("k").agg(F.collect_set(F.struct("pos", "size")).alias("at"), F.collect_set("items").alias("lists")).select(
        "k",
        F.expr("array_sort(array_distinct(flatten(transform(at, x -> sequence(x.pos, x.pos + x.size - 1)))))").alias("hit"),
        F.expr("array_sort(array_distinct(flatten(lists)))").alias("items"),
    )


def with_overlaps(docs: DataFrame, benchmark: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", set_bound: int = BROADCAST_ROWS) -> DataFrame:
    """(row, n_words, hit, items) of each row of docs: the row itself as a struct, the positions of hit words from 1, sorted, and the items, sorted.

    The windows' hashes go into a set in the plan, if there are at most `set_bound` of them (they are counted first);
    otherwise into a bitmap that every task holds, and what passes is shuffled to the windows. Either way a hit is
    verified word by word. Texts are hashed once; only rows with hits are shuffled, and their table is joined back.
    Repeated rows stay; null ids are ids like any other. Null or empty texts have no words and no hits; with no items at
    all, nothing is hit. An item without an id hits words, but is not listed. Columns of docs may have any names.
    """
    key = row_key(doc_id, text)
    hits = durable(_hits(docs.select(key.alias("k"), F.col(text).alias("t")), benchmark, n, item_id, item_text, set_bound))
    whole = docs.select(F.struct("*").alias("row"), key.alias("k"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    joined = whole.join(broadcast_if_small(hits.withColumnRenamed("k", "_k"), hits.count()), F.col("k") == F.col("_k"), "left")
    return joined.select("row", "n_words", F.coalesce("hit", F.array().cast("array<int>")).alias("hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def overlap_report(docs: DataFrame, benchmark: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs; cases as in with_overlaps."""
    return with_overlaps(docs.select(doc_id, text), benchmark, n, doc_id, text, **names).select(
        F.col("row").getField(doc_id).alias("doc_id"),
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_hit_share: float = 0.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs of whose words at most `max_hit_share` are hit, with all their columns.

    Every row is judged by its own text, whatever its id; a row without words is kept.
    """
    judged = with_overlaps(docs, benchmark, n, doc_id, text)
    return judged.where(F.size("hit") <= F.lit(max_hit_share) * F.col("n_words")).select("row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the hit words cut out of the texts; what stands between words stays. Null texts stay null."""
    judged = with_overlaps(docs, benchmark, n, doc_id, text).withColumn("t", F.col("row").getField(text))
    judged = judged.withColumn("w", F.array_remove(F.split("t", SEPARATORS_ANY_CASE), "")).withColumn("s", F.split("t", r"[0-9A-Za-z\u0080-\x{10FFFF}]+"))
    cut = F.expr("array_join(transform(s, (x, i) -> concat(x, CASE WHEN i >= size(w) OR array_contains(hit, i + 1) THEN '' ELSE w[i] END)), '')")
    kept = F.when(F.size("hit") == 0, F.col("t")).otherwise(cut)
    return judged.select(*(kept.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))
