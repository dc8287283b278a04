"""Benchmark decontamination by template windows.  DataFrame functions only.

A text becomes a sequence of lower-case tokens in which a capitalised word
inside a sentence (a name), a number, and a unit after a number are replaced
by typed placeholders; the values they replace are the slots.  Windows of
five tokens are hashed and joined with the benchmark's windows.  Matches of a
document with an item are grouped by alignment (the difference of their
positions).  An alignment is consistent if equal slot values of the item meet
equal values in the document and different ones differ, so a re-parameterised
question with one value swapped throughout still counts, and a chance
template with jumbled values does not.  A document is contaminated by an item
if its consistent alignments cover at least 80 per cent of the item's
windows.

A window needs at least two tokens that are no placeholders.  Windows travel
as 64-bit hashes, so a false match needs hash collisions over most of an
item.  The benchmark's windows are broadcast only if their number, which is
counted, is within ``BROADCAST_WINDOWS``; otherwise Spark joins by shuffle.

An item without such a window (below five tokens, or too many placeholders in
each) is found as a verbatim run of its tokens, placeholders' values and all:
the whole item is one window, and documents' windows of its length are joined
with it.

Edge cases: null texts and texts without a token have no windows, on either
side; repeated benchmark items each give their row; repeated
documents with one doc_id are one document, whose windows count together;
empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

WINDOW, COVERAGE, MIN_LITERALS = 5, 0.8, 2
#: 24 bytes each and a few more for slots: tens of MB at most.
BROADCAST_WINDOWS = 1_000_000

# The signs that mark slots, and the units that may follow a number.
NAME, NUMBER, UNIT = "\x02", "\x03", "\x04"
UNITS = ("km|cm|mm|kg|mg|ml|kb|mb|gb|tb|hz|khz|mhz|ghz|m|g|l|s|h|miles|mile|meters|metres|feet|inches|inch|yards|"
         "hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|"
         "dollars|euros|pounds|cents|percent|degrees|grams|kilograms|liters|litres|tons")
#: A capitalised word inside a sentence, and a unit after a number.
NAME_PATTERN = r"(?<=[\p{Ll}0-9,;][ \t])(\p{Lu}\p{Ll})"
UNIT_PATTERN = rf"([0-9][ ]?)((?i:{UNITS})\b)"
BREAKS = r"[^\p{L}0-9\x02\x04]+"


def tokens(text: Column) -> Column:
    """Lower-case tokens: runs of letters and digits; names and units begin with their sign."""
    marked = F.regexp_replace(text, F.lit(NAME_PATTERN), F.lit(NAME + "$1"))
    marked = F.regexp_replace(marked, F.lit(UNIT_PATTERN), F.lit("$1 " + UNIT + "$2"))
    return F.array_remove(F.split(F.lower(marked), BREAKS), "")


def is_slot(t: Column) -> Column:
    return (t < F.lit("\x05")) | t.between("0", ":")


def kind(t: Column) -> Column:
    """The token, or the sign of its type."""
    return F.when(t < F.lit("\x05"), F.substring(t, 1, 1)).when(t.between("0", ":"), F.lit(NUMBER)).otherwise(t)


def windows(df: DataFrame, key: str) -> DataFrame:
    """(key, pos, h): the hash of each window of tokens.  Only longs are generated, so a text's tokens are not copied."""
    base = df.select(key, tokens(F.coalesce("text", F.lit(""))).alias("ts"))
    hashed = base.select(key, F.transform("ts", lambda t: F.xxhash64(kind(t))).alias("hs"))

    def window(h: Column, i: Column) -> Column:
        rest = [F.get("hs", i + k) for k in range(1, WINDOW)]
        return F.when(rest[-1].isNotNull(), F.xxhash64(h, *rest))

    return hashed.select(key, F.posexplode(F.transform("hs", window)).alias("pos", "h")).where("h is not null")


def slots(df: DataFrame, key: str) -> DataFrame:
    """(key, pos, value): the tokens that are names, numbers or units."""
    return (df.select(key, F.posexplode(tokens(F.coalesce("text", F.lit("")))).alias("pos", "value"))
            .where(is_slot(F.col("value"))))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, bpos, h, bslots) with enough literal tokens; bslots: (offset in the window, value) of its slots, or null.

    An item's first word may stand inside a sentence of a document, so the
    first window is also given with that word as a name.
    """
    b = benchmark.select("item_id", "text").dropna(subset=["item_id"])
    inside = b.select("item_id", F.concat(F.lit(", "), F.col("text")).alias("text"))

    def both(texts: DataFrame) -> DataFrame:
        w = windows(texts, "item_id").withColumnRenamed("pos", "bpos")
        at = (slots(texts, "item_id").select("item_id", "pos", "value", F.explode(F.sequence(F.lit(0), F.lit(WINDOW - 1))).alias("off"))
              .withColumn("bpos", F.col("pos") - F.col("off"))
              .groupBy("item_id", "bpos").agg(F.sort_array(F.collect_set(F.struct("off", "value"))).alias("bslots")))
        return w.join(at, ["item_id", "bpos"], "left")

    return (both(b).union(both(inside).where("bpos = 0")).distinct()
            .where(F.coalesce(F.size("bslots"), F.lit(0)) <= WINDOW - MIN_LITERALS))


def plain_hashes(df: DataFrame, key: str) -> DataFrame:
    """(key, hs): the hash of each token as written, without the signs of names and units."""
    ts = tokens(F.coalesce("text", F.lit("")))
    return df.select(key, F.transform(ts, lambda t: F.xxhash64(F.regexp_replace(t, f"^[{NAME}{UNIT}]", ""))).alias("hs"))


def verbatim(docs: DataFrame, benchmark: DataFrame, windowed: DataFrame) -> DataFrame | None:
    """(doc_id, item_id) where a document holds all tokens of an item that has none of ``windowed``'s rows; None without such items."""
    items = plain_hashes(benchmark.select("item_id", "text").dropna(subset=["item_id"]), "item_id").where("size(hs) > 0")
    items = items.join(windowed.select("item_id").distinct(), "item_id", "left_anti").select("item_id", F.size("hs").alias("len"), F.xxhash64("hs").alias("h"))
    items = staged(items.distinct(), "short-items")
    lengths = sorted(r["len"] for r in items.select("len").distinct().collect())  # few: the items are short or all placeholders
    if not lengths:
        return None
    if items.count() <= BROADCAST_WINDOWS:
        items = F.broadcast(items)
    size = F.array(*(F.lit(n) for n in lengths))
    runs = (plain_hashes(docs, "doc_id").select("doc_id", "hs", F.explode(size).alias("len")).where("size(hs) >= len")
            .select("doc_id", "len", F.explode(F.expr("transform(sequence(1, size(hs) - len + 1), i -> xxhash64(slice(hs, i, len)))")).alias("h")))
    return runs.join(items, ["len", "h"]).select("doc_id", "item_id").where("doc_id is not null").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, n_slots, coverage) for each contaminated pair."""
    b = staged(item_windows(benchmark), "benchmark-windows")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = verbatim(d, benchmark, b)
    total = b.groupBy("item_id").agg(F.countDistinct("bpos").alias("n_windows"))
    if b.count() <= BROADCAST_WINDOWS:
        b, total = F.broadcast(b), F.broadcast(total)
    hit = staged(windows(d, "doc_id").join(b, "h").select(
        "doc_id", "item_id", "pos", (F.col("pos") - F.col("bpos")).alias("shift"), "bpos", "bslots"), "template-hits")
    at = ["doc_id", "item_id", "shift"]
    # an alignment holds at most the item's windows
    lined = hit.groupBy(*at).agg(F.collect_set("bpos").alias("at"))
    # slot values of the few documents whose matched windows have slots
    asked = hit.where("bslots is not null").select(*at, "pos", F.explode("bslots").alias("b"))
    asked = asked.select(*at, (F.col("pos") + F.col("b.off")).alias("pos"), F.col("b.value").alias("bv")).distinct()
    ids = asked.select("doc_id").distinct()
    if ids.count() <= BROADCAST_WINDOWS:
        ids = F.broadcast(ids)
    pairs = asked.join(slots(d.join(ids, "doc_id", "left_semi"), "doc_id"), ["doc_id", "pos"]).select(*at, "bv", "value").distinct()
    check = pairs.groupBy(*at).agg(F.count("*").alias("n_slots"), F.countDistinct("bv").alias("n_b"),
                                   F.countDistinct("value").alias("n_d"))
    found = (lined.join(check, at, "left").fillna(0, ["n_slots", "n_b", "n_d"])
             .where("n_b = n_slots and n_d = n_slots").groupBy("doc_id", "item_id")
             .agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_matched"),
                  F.max("n_slots").alias("n_slots")))
    found = (found.join(total, "item_id")
            .withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
            .where(F.col("coverage") >= coverage)
            .select("doc_id", "item_id", "n_windows", "n_matched", "n_slots", "coverage"))
    if short is None:
        return found
    one = F.lit(1).cast("long")
    return found.union(short.select("doc_id", "item_id", one, one, F.lit(0).cast("long"), F.lit(1.0)))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["_bad"], "left_anti")


def op3_query(spark, sf_dir: str) -> DataFrame:
    from assetpulse.sources.tables import read_table
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: DuckDB SQL with the rows of op3_query.  RE2 has no look-behind, so names are marked in two passes.
OP3_SQL = rf"""
WITH src AS (SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text, false AS inside FROM documents
             UNION ALL SELECT 'b', item_id, coalesce(text, ''), false FROM benchmark WHERE item_id IS NOT NULL
             UNION ALL SELECT 'b', item_id, ', ' || text, true FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
m AS (SELECT side, id, inside, regexp_replace(regexp_replace(text,
        '([\p{{Ll}}0-9,;][ \t])(\p{{Lu}}\p{{Ll}})', '\1' || chr(2) || '\2', 'g'),
        '([\p{{Ll}}0-9,;][ \t])(\p{{Lu}}\p{{Ll}})', '\1' || chr(2) || '\2', 'g') AS text FROM src),
u AS (SELECT side, id, inside, lower(regexp_replace(text, '([0-9][ ]?)((?i:{UNITS})\b)', '\1 ' || chr(4) || '\2', 'g')) AS text FROM m),
t AS (SELECT side, id, inside, list_filter(regexp_split_to_array(text, '[^\p{{L}}0-9\x02\x04]+'), lambda x: x <> '') AS ts FROM u),
w AS (SELECT side, id, inside, ts, unnest(range(0, len(ts) - {WINDOW - 1})) AS pos FROM t),
x AS (SELECT side, id, inside, pos, ts[pos + 1:pos + {WINDOW}] AS part FROM w WHERE NOT inside OR pos = 0),
k AS (SELECT side, id, pos,
        list_transform(part, lambda x: CASE WHEN ord(x) < 5 THEN x[1] WHEN x[1] BETWEEN '0' AND '9' THEN chr(3) ELSE x END) AS tpl,
        list_filter(part, lambda x: ord(x) < 5 OR x[1] BETWEEN '0' AND '9') AS slots FROM x),
b AS (SELECT DISTINCT id AS item_id, pos AS bpos, tpl, slots AS bslots FROM k
      WHERE side = 'b' AND len(slots) <= {WINDOW - MIN_LITERALS}),
n AS (SELECT item_id, count(DISTINCT bpos) AS n_windows FROM b GROUP BY item_id),
h AS (SELECT k.id AS doc_id, b.item_id, k.pos - b.bpos AS shift, b.bpos, b.bslots, k.slots
      FROM k JOIN b ON k.tpl = b.tpl WHERE k.side = 'd'),
p AS (SELECT doc_id, item_id, shift, unnest(bslots) AS bv, unnest(slots) AS dv FROM h),
bad AS (SELECT DISTINCT doc_id, item_id, shift FROM (
          SELECT doc_id, item_id, shift FROM p GROUP BY doc_id, item_id, shift, bv HAVING count(DISTINCT dv) > 1
          UNION ALL SELECT doc_id, item_id, shift FROM p GROUP BY doc_id, item_id, shift, dv HAVING count(DISTINCT bv) > 1)),
s AS (SELECT doc_id, item_id, shift, count(DISTINCT (bv, dv)) AS n_slots FROM p GROUP BY ALL),
g AS (SELECT h.doc_id, h.item_id, count(DISTINCT h.bpos) AS n_matched, max(coalesce(s.n_slots, 0)) AS n_slots
      FROM h ANTI JOIN bad USING (doc_id, item_id, shift) LEFT JOIN s ON
        s.doc_id = h.doc_id AND s.item_id = h.item_id AND s.shift = h.shift GROUP BY h.doc_id, h.item_id)
SELECT doc_id, item_id, n_windows, n_matched, n_slots, n_matched / n_windows AS coverage
FROM g JOIN n USING (item_id) WHERE n_matched / n_windows >= {COVERAGE}
"""
