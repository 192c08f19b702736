"""Benchmark decontamination, DataFrame functions only.

The benchmark's normalised 10-word windows form a small table that is broadcast as a hash relation while its size
allows (an equi-join on the same keys serves beyond it). Training texts are cut into words once. A bitmap of the
windows' first words, a bounded literal in the plan, tells which positions of a text can begin a window; only these
leave the row, are looked up in the windows and verified word by word. Spans of hit words are then merged per document.

Defined cases: a null or empty text has no words and is never hit; a null `item_id` still marks words as hit but is
not listed; rows that repeat a (doc_id, text) pair each get the same answer; rows with a null doc_id are judged by
their text; an empty benchmark hits nothing; only the named columns of either table are read, others may be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molgrid.llm.common import text_key

#: The characters that words are made of, without and with ASCII capitals.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between the words of a text in lower case.
BETWEEN = "[^0-9a-z\\x{80}-\\x{10FFFF}]+"

#: A position first looks up this many words, or the whole window where that is shorter.
PREFIX = 3
#: Bits of the bitmap, as powers of two.
LEAST_BITS, MOST_BITS = 12, 22


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; `lower` does just that where all characters are ASCII, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _prefix_key(hashes: Column, at: Column, n: int) -> Column:
    """Key of the n words from `at` on, of which `hashes` has the hashes."""
    return F.xxhash64(F.lit(n), *[F.get(hashes, at + k) for k in range(n)])


def _low_bits(hashes: Column, at: Column, n: int, bits: int) -> Column:
    """Place in the bitmap of the n words from `at` on; null where the text ends before."""
    mixed = F.get(hashes, at)
    for k in range(1, n):
        mixed = mixed.bitwiseXOR(F.shiftrightunsigned(F.get(hashes, at + k), 20 * k))
    return mixed.bitwiseAND((1 << bits) - 1).cast("int")


def benchmark_windows(items: DataFrame, n: int = 10) -> DataFrame:
    """Distinct windows: gram (words joined by a space), length, prefix, key, hashes (of the prefix), item_ids (sorted strings)."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    grams = w.where(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("g"))
    led = grams.select("item", "g", F.transform(F.slice("g", 1, PREFIX), lambda x: F.xxhash64(x)).alias("h"))
    key = F.when(F.size("h") == 1, _prefix_key(F.col("h"), F.lit(0), 1))
    for p in range(2, PREFIX):
        key = key.when(F.size("h") == p, _prefix_key(F.col("h"), F.lit(0), p))
    key = key.otherwise(_prefix_key(F.col("h"), F.lit(0), PREFIX))
    return (
        led.select("item", F.array_join("g", " ").alias("gram"), F.size("g").alias("length"), key.alias("key"), F.col("h").alias("hashes"))
        .groupBy("gram", "length", "key", "hashes")
        .agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
        .withColumn("prefix", F.least("length", F.lit(PREFIX)))
    )


def _bitmap(windows: DataFrame, n: int, prefixes: list[int]) -> tuple[Column, int]:
    """The windows' places in a bitmap, as an array of longs, and how many bits a place has: 16 places for each of n
    windows, within bounds."""
    bits = min(max(LEAST_BITS, (16 * n).bit_length()), MOST_BITS)
    place = F.coalesce(*[F.when(F.col("prefix") == p, _low_bits(F.col("hashes"), F.lit(0), p, bits)) for p in prefixes])
    own = windows.select(place.alias("bit"))
    rows = own.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("word"))
    found = [0] * (1 << (bits - 6))
    for r in rows.collect():  # at most 65,536
        found[r["at"]] = r["word"]
    return F.expr(f"cast(split('{','.join(map(str, found))}', ',') as array<bigint>)"), bits


def _looked_up(docs: DataFrame, items: DataFrame, n: int, broadcast_bytes: int) -> DataFrame:
    """doc_id, text_key, n_words, start, length, item_ids: a row with start -1 for each row of `docs`, and one for each
    window found (start: word index from 0)."""
    windows = benchmark_windows(items, n)
    size = windows.agg(
        F.coalesce(F.sum(F.octet_length("gram") + 64 + 16 * F.size("item_ids")), F.lit(0)).alias("bytes"),
        F.count("*").alias("n"),
        F.sort_array(F.collect_set("prefix")).alias("prefixes"),
    ).first()
    prefixes = size["prefixes"] or [PREFIX]
    bitmap, bits = _bitmap(windows, size["n"], prefixes)
    cut = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.split(ascii_lower(F.coalesce("text", F.lit(""))), BETWEEN).alias("w"))
    # what stands before the first and behind the last separator may be empty
    lead = (F.get("w", F.lit(0)) == "").cast("int")
    tail = ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")
    base = cut.select(
        "*", lead.alias("lead"), (F.size("w") - lead - tail).cast("long").alias("n_words"), F.transform("w", lambda x: F.xxhash64(x)).alias("h")
    )
    every = F.sequence(F.lit(0), F.size("w") - 1)

    def low_bits(p: int) -> Column:
        return F.transform(every, lambda i: _low_bits(F.col("h"), i, p, bits)).alias(f"low_{p}")

    base = base.select("*", *map(low_bits, prefixes))

    def may_begin(at: Column) -> Column:
        found = F.lit(False)
        for p in prefixes:
            low = F.get(f"low_{p}", at)
            word = F.get(bitmap, F.shiftright(low, 6))
            found = found | (F.call_function("shiftright", word, low.bitwiseAND(63)).bitwiseAND(1) == 1)
        return found

    places = F.filter(every, may_begin)
    sown = base.select("doc_id", "text_key", "lead", "n_words", "w", "h", F.explode(F.concat(F.array(F.lit(-1)), places)).alias("at"))
    ahead = F.concat(F.array_join(F.slice("w", F.col("at") + 1, n), " "), F.lit(" "))
    own_keys = [_prefix_key(F.col("h"), F.col("at"), p) for p in prefixes]
    # the rows that stand for their documents find no key, and are spread by their own
    keys = F.explode(F.when(F.col("at") < 0, F.array(F.xxhash64("doc_id", "text_key"))).otherwise(F.array(*own_keys)))
    looked = sown.select("doc_id", "text_key", "lead", "n_words", "at", F.when(F.col("at") >= 0, ahead).alias("ahead"), keys.alias("own_key"))
    if size["bytes"] <= broadcast_bytes:
        windows = F.broadcast(windows)
    same = (F.col("own_key") == F.col("key")) & (F.col("at") >= 0) & F.col("ahead").startswith(F.concat("gram", F.lit(" ")))
    found = looked.join(windows, same, "left").where("at < 0 or gram is not null")
    start = F.when(F.col("at") < 0, F.col("at")).otherwise(F.col("at") - F.col("lead"))
    return found.select("doc_id", "text_key", "n_words", start.alias("start"), "length", "item_ids")


def merged(spans: Column) -> Column:
    """Overlapping or touching [start, end) spans, sorted by start, as the fewest spans."""
    return F.aggregate(
        spans,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def covered(spans: Column) -> Column:
    """Positions inside any of the sorted [start, end) spans."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            (acc["n"] + F.greatest(s["end"] - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("n"),
        ),
    )
    return done["n"]


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, broadcast_bytes: int = 256 << 20) -> DataFrame:
    """One row for each row of `docs`: doc_id, text_key, n_words, n_hit, spans, items (sorted ids of the items found)."""
    hit = F.when(F.col("start") >= 0, F.struct("start", (F.col("start") + F.col("length")).alias("end")))
    of = (
        _looked_up(docs, items, n, broadcast_bytes)
        .groupBy("doc_id", "text_key")
        .agg(
            F.max("n_words").alias("n_words"),
            F.count_if(F.col("start") < 0).cast("int").alias("times"),
            F.sort_array(F.collect_set(hit)).alias("spans"),
            # windows of one item share one id array, so this set holds few arrays however many windows were hit
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"),
        )
    )
    each = of.select("doc_id", "text_key", "n_words", "spans", "items", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("nth"))
    return each.select("doc_id", "text_key", "n_words", covered(F.col("spans")).alias("n_hit"), "spans", "items")


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "documents", n: int = 10) -> DataFrame:
    """`docs` without what the benchmark holds, all columns kept.

    mode "documents" drops every row with a hit; "spans" cuts the hit words (and what stands behind each, up to the
    next word) out of `text`.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode must be documents or spans, not {mode!r}")
    found = contamination(docs, items, n).where("n_hit > 0").select(
        F.col("doc_id").alias("__hit_id"), F.col("text_key").alias("__hit_key"), merged(F.col("spans")).alias("__spans")
    ).dropDuplicates(["__hit_id", "__hit_key"])
    on = docs["doc_id"].eqNullSafe(found["__hit_id"]) & (text_key(docs["text"]) == found["__hit_key"])
    if mode == "documents":
        return docs.join(found, on, "left_anti")
    own = F.regexp_extract_all("text", F.lit(WORD_ANY_CASE), F.lit(0))
    between = F.split("text", WORD_ANY_CASE)
    kept = F.transform(
        own,
        lambda w, i: F.when(F.exists("__spans", lambda s: (i >= s["start"]) & (i < s["end"])), F.lit("")).otherwise(
            F.concat(w, F.get(between, i + 1))
        ),
    )
    cut = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(
        F.concat(F.get(between, F.lit(0)), F.array_join(kept, ""))
    )
    return docs.join(found, on, "left").withColumn("text", cut).select(*docs.columns)


def report(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The digest that the query returns."""
    return contamination(docs, items, n).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The same rows by brute force, for DuckDB.
ORACLE_SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item, list_slice(w, CAST(s AS BIGINT), CAST(s AS BIGINT) + 9) AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
positions AS (
  SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM doc_words), (SELECT DISTINCT len(g) AS n FROM grams)
  WHERE s + n - 1 <= len(w)),
hits AS (SELECT doc_id, s, n, item FROM positions JOIN grams USING (g)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN hit_items i ON i.doc_id = d.doc_id
"""
