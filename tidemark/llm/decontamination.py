"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question whose figures or names were
changed still has the template of the original.  Windows of WINDOW template tokens are hashed and
joined with the windows of the benchmark items; matches that lie on neighbouring diagonals (nearly the same shift between
document and item, as after a word put in) are counted together, and a pair is reported if they cover enough of the item and
the slots are consistent: every value of the item stands for one value of the document throughout.

Texts are read in two forms, each searched by itself.  In the plain form names are words, so a copy in other case is found.  In the
named form every run of capitalised words is one placeholder, at the start of a sentence too, where nothing tells a
name from another word; only names inside sentences are held to be consistent.

All documents are searched for windows alone; those that hold enough of an item's are read once more for their slots.

A window of placeholders only tells nothing and isn't searched for.  An item without a window that can be searched for, such as one of
fewer than WINDOW tokens, is found where a line of a document is the whole item (in its template, or word for word if it has no word).

SQL functions only.  What is shuffled are matches, not windows, as long as
the benchmark's windows are few enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop_rows, few_files, stash, text_of

WINDOW = 5
#: Share of an item's windows that have to match on neighbouring diagonals.
COVERAGE = 0.5
#: Matches whose shifts differ by less than half of this are always counted together, by this or more never.
NEIGHBOURS = 8
#: Up to so many window hashes of the benchmark (some 100 MB in memory) are broadcast; more are joined by shuffling.
BROADCAST_WINDOWS = 1_000_000
#: Up to so many rows to drop, or documents to look at again, are broadcast.
BROADCAST_DROPS = 500_000

#: An item: a hash of its id and text, and its id.
_ITEM = ["item", "item_id"]

# Units of measure and money.
UNITS = (
    "mm cm dm m km inch inches foot feet ft yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "mg g kg gram grams kilogram kilograms ton tons tonne tonnes pound pounds lb lbs ounce ounces oz ml cl l litre litres liter liters "
    "gallon gallons second seconds sec minute minutes min hour hours hr hrs day days week weeks month months year years mph kmh "
    "percent percentage degree degrees celsius fahrenheit kelvin dollar dollars cent cents euro euros pence usd eur gbp watt watts kw volt volts amp amps joule joules "
    "newton newtons byte bytes kb mb gb tb hz khz mhz ghz"
).split()

#: Marks a capitalised word inside a sentence; the placeholders are words that no text can hold.
_NAME = "\x01"
_IN_SENTENCE = r"(?<=[\p{L}\p{N},;:)\]'’-][ \t\n\r]{1,3})(?=\p{Lu})"
# repeats of groups are bounded: Java's matcher recurses on them
_TOKEN = r"\x01?[\p{L}\p{M}]+(?:['’]\p{L}+){0,4}|\p{N}+(?:[.,:/]\p{N}+){0,20}"
#: A run of names among tokens; more names make a further run.
_RUN = r"\x01?\p{Lu}[^ ]*(?: \x01?\p{Lu}[^ ]*){0,20}"
_NUMBER = r"(?<= |^)\p{N}[^ ]*"
#: A unit is a unit where it follows a number.
_UNIT = r"(?<=\x02number )(?:" + "|".join(UNITS) + r")(?= |$)"


def _from(array: Column, start: int) -> Column:
    return F.slice(array, start + 1, F.size(array))


def _fold(hashes: Column) -> Column:
    """Hashes of all windows of WINDOW tokens: by joining windows of half the size, in a few steps."""
    made, size = {1: hashes}, 1
    while 2 * size <= WINDOW:
        made[2 * size] = F.zip_with(made[size], _from(made[size], size), lambda a, b: F.xxhash64(a, b))
        size *= 2
    out, done = made[size], size
    for k in sorted(made, reverse=True):
        while done + k <= WINDOW:
            out = F.zip_with(out, _from(made[k], done), lambda a, b: F.xxhash64(a, b))
            done += k
    return F.slice(out, F.lit(1), F.greatest(F.lit(0), F.size(hashes) - WINDOW + 1))


def _placeholders(low: Column) -> Column:
    """A column with a line of tokens in lower case; figures and units are replaced."""
    put = F.regexp_replace(F.regexp_replace(low, _NUMBER, "\x02number"), _UNIT, "\x02unit")
    return F.when(low.rlike(r"\p{N}"), put).otherwise(low)


def _tokens(rows: DataFrame, keys: list[str], body: str, marks: bool) -> DataFrame:
    """keys, line: the tokens of a text as written, a blank between two; with marks, names inside sentences are marked."""
    own = F.col(body).contains(_NAME) | F.col(body).contains("\x02")
    clean = F.when(own, F.translate(body, _NAME + "\x02", "  ")).otherwise(F.col(body))
    marked = F.regexp_replace(clean, _IN_SENTENCE, _NAME) if marks else clean
    return rows.select(*keys, F.array_join(F.regexp_extract_all(marked, F.lit(_TOKEN), F.lit(0)), " ").alias("line"))


def _windows(rows: DataFrame, keys: list[str], body: str, slots: bool = False, of_items: bool = False) -> DataFrame:
    """keys, form, pos, key: a row for each window of both forms.  With slots also first and last, the values of its edge slots.  Those of
    items have a word each, and windows, their number in that form.

    The placeholders are put in by patterns over whole texts; only hashing goes word by word.
    """
    read = _tokens(rows, keys, body, slots)
    bare = F.translate("line", _NAME, "") if slots else F.col("line")
    # columns of their own for all that is looked at several times
    read = read.withColumn("low", F.lower(bare)).withColumn("runs", F.lower(F.when(bare.rlike(r"\p{Lu}"), F.regexp_replace("line", _RUN, "\x02name")).otherwise(bare)))
    read = read.withColumn("plain", F.split(_placeholders(F.col("low")), " ")).withColumn("named", F.split(_placeholders(F.col("runs")), " "))
    number = lambda t: t.startswith("\x02")
    if slots:  # what stands for a placeholder: figures and units as written, of names those inside a sentence
        read = read.withColumn("plain_slots", F.zip_with("plain", F.split(bare, " "), lambda c, t: F.when(number(c), F.lower(t))))
        said = F.regexp_extract_all("line", F.lit(_RUN + "|[^ ]+"), F.lit(0))
        inside = lambda t: F.nullif(F.lower(F.translate(F.array_join(F.regexp_extract_all(t, F.lit(r"\x01[^ ]+"), F.lit(0)), " "), _NAME, "")), F.lit(""))
        read = read.withColumn("named_slots", F.zip_with("named", said, lambda c, t: F.when(c == "\x02name", inside(t)).when(number(c), F.lower(t))))

    for name in ("plain", "named"):
        read = read.withColumn(f"{name}_hashes", F.transform(name, lambda t: F.xxhash64(t)))

    def form(name: str) -> Column:
        parts = [F.lit(name).alias("form"), _fold(F.col(f"{name}_hashes")).alias("keys")]
        if slots:
            parts.append(F.col(f"{name}_slots").alias("slots"))
        if of_items:
            parts.append(F.transform(F.col(name), lambda t, i: F.exists(F.slice(F.col(name), i + 1, WINDOW), lambda x: ~number(x))).alias("worded"))
        return F.struct(*parts)

    wide = read.select(*keys, F.explode(F.array(form("plain"), form("named"))).alias("f")).select(*keys, "f.*")
    # the outer form: for the other, Spark puts a filter on the array's size below, and with it a second computation of the array
    wide = wide.select(*keys, "form", *(["slots"] if slots else []), *(["worded"] if of_items else []), F.posexplode_outer("keys").alias("pos", "key")).where("pos is not null")
    if of_items:
        wide = wide.where(F.get("worded", "pos")).withColumn("windows", F.count(F.lit(1)).over(Window.partitionBy(*keys, "form")))
    edges = [F.get("slots", "pos").alias("first"), F.get("slots", F.col("pos") + WINDOW - 1).alias("last")] if slots else []
    return wide.select(*keys, "form", *(["windows"] if of_items else []), "pos", "key", *edges)


def _whole_lines(given: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, item, item_id, start, matched, windows, exact: lines of documents that are a whole item, for items without windows."""

    def canonical(rows: DataFrame, names: list[str], body: str) -> DataFrame:
        read = _tokens(rows, names, body, False).where(F.col("line") != "")
        read = read.withColumn("literal", F.lower("line")).withColumn("template", _placeholders(F.col("literal")))
        template, literal = F.col("template"), F.col("literal")
        worded = F.exists(F.split(template, " "), lambda t: ~t.startswith("\x02"))
        return read.select(*names, "literal", F.when(worded, template).otherwise(literal).alias("canon"))

    wanted = canonical(items, _ITEM, "body").withColumnRenamed("literal", "said")
    if wanted.count() <= BROADCAST_WINDOWS:
        wanted = F.broadcast(wanted)
    lines = canonical(given.select(*keys, F.posexplode(F.split("body", "\n")).alias("at", "line_text")), [*keys, "at"], "line_text")
    met = lines.join(wanted, "canon").groupBy(*keys, *_ITEM).agg(F.min("at").alias("at"), F.max((F.col("literal") == F.col("said")).cast("int")).alias("same"))
    return met.select(*keys, *_ITEM, F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("matched"), F.lit(1).cast("long").alias("windows"), (F.col("same") == 1).alias("exact"))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """One row per document and benchmark item that it holds: k1, k2 (keys of the row), doc_id, item_id, start
    (token of the document at which the item would begin; in the named form a run of names counts as one), matched and windows (of the
    item), exact (no slot value differs).

    Null texts and texts without tokens give no rows, as documents and as items;
    repeated rows of a document give one, and so do repeated items.  Items are told apart by id and text: texts that share an id, a null one
    too, are searched for each by itself, and a document that holds several has a row for each.  Other columns are ignored.  Of several places in a document the best is given.  An item
    that has no window, found as a whole line, has start 0 and one window.
    """
    keys = ["k1", "k2", "doc_id"]
    id_, body = F.col(doc_id).cast("long"), text_of(text)
    given = docs.select(F.xxhash64(id_, body).alias("k1"), F.xxhash64(body, id_, F.lit(7)).alias("k2"), id_.alias("doc_id"), body.alias("body"))
    items = benchmark.select(F.col(item_id).alias("item_id"), text_of(item_text).alias("body")).distinct()
    items = items.select(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("item_id").isNull(), "body").alias("item"), "item_id", "body")
    wanted = _windows(items, _ITEM, "body", True, True).select(*_ITEM, "form", "windows", F.col("pos").alias("at"), "key", F.col("first").alias("item_first"), F.col("last").alias("item_last"))
    wanted = stash(few_files(wanted), "benchmark")
    without = stash(few_files(items.join(wanted.select("item").distinct(), "item", "left_anti")), "short-items")
    if wanted.count() <= BROADCAST_WINDOWS:
        wanted = F.broadcast(wanted)

    def meet(some: DataFrame, *slots: str) -> DataFrame:
        met = _windows(some, keys, "body", bool(slots)).join(wanted, ["form", "key"])
        return met.select(*keys, *_ITEM, "form", "windows", (F.col("pos") - F.col("at")).alias("start"), "at", *slots)

    # how much of an item's windows neighbouring diagonals hold, before anything is asked about slots
    half = NEIGHBOURS // 2
    buckets = F.explode(F.array(F.struct(F.lit(0), F.floor(F.col("start") / NEIGHBOURS)), F.struct(F.lit(1), F.floor((F.col("start") + half) / NEIGHBOURS))))
    enough = F.col("matched") >= coverage * F.col("windows")
    held = meet(given).groupBy(*keys, *_ITEM, "form", "windows", "start").agg(F.collect_set("at").alias("places")).withColumn("bucket", buckets)
    held = held.groupBy(*keys, *_ITEM, "form", "windows", "bucket").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("matched")).where(enough)
    again = stash(few_files(held.select("k1", "k2").distinct()), "candidates")
    if again.count() <= BROADCAST_DROPS:
        again = F.broadcast(again)
    met = meet(given.join(again, ["k1", "k2"], "left_semi"), "first", "last", "item_first", "item_last")
    pair = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.col(a).alias("a"), F.col(b).alias("b")))
    # an item is short, so what is collected for one diagonal is too
    lines = met.groupBy(*keys, *_ITEM, "form", "windows", "start").agg(
        F.collect_set("at").alias("places"),
        F.array_union(F.collect_set(pair("item_first", "first")), F.collect_set(pair("item_last", "last"))).alias("slots"),
    )
    # two overlapping rows of buckets; the strongest diagonal of a bucket speaks for the slots
    near = lines.withColumn("bucket", buckets)
    near = near.groupBy(*keys, *_ITEM, "form", "windows", "bucket").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("matched"), F.max(F.struct(F.size("places").alias("n"), (-F.col("start")).alias("back"), "slots")).alias("main")
    )
    slots = F.col("main.slots")
    steady = F.size(slots) == F.size(F.array_distinct(F.transform(slots, lambda s: s["a"])))
    found = near.where(enough & steady)
    best = found.groupBy(*keys, *_ITEM).agg(
        F.max(F.struct("matched", "main.back", "windows", F.forall(slots, lambda s: s["a"] == s["b"]).alias("exact"))).alias("best"), F.max(F.when(F.col("form") == "plain", F.forall(slots, lambda s: s["a"] == s["b"]).cast("int"))).alias("plain_exact")
    )
    best = best.select(
        *keys, *_ITEM, (-F.col("best.back")).cast("long").alias("start"), F.col("best.matched").cast("long").alias("matched"),
        F.col("best.windows").cast("long").alias("windows"), (F.coalesce(F.col("plain_exact") == 1, F.lit(False)) & F.col("best.exact")).alias("exact"),
    )
    return (best if without.isEmpty() else best.unionByName(_whole_lines(given, without, keys))).drop("item")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    leaks = stash(few_files(find_leaks(docs, benchmark, coverage, text, doc_id).select("k1", "k2").distinct()), "leaks")
    if leaks.count() <= BROADCAST_DROPS:
        leaks = F.broadcast(leaks)
    return drop_rows(docs, leaks, text, doc_id)
