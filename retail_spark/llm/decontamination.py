"""Benchmark decontamination by template canonicalisation (built-in functions only).

A text becomes a template: numbers, names and units turn into typed
placeholders, the rest is lower-cased and loses its punctuation.  Windows of
five template words are hashed, and the windows of the documents meet those of
the benchmark in a hash join.  A document is contaminated by an item when it
holds at least ``min_share`` of the item's distinct windows and its slots are
consistent: along one alignment that holds that many windows, equal values of
the item's slots always stand for equal values in the document.  So a question
with other numbers and names is still found, also with a word more or less, and
a text that merely has the same frame is not.

Windows that consist of placeholders only say nothing and do not count.  Each
document sends every window once, whatever its length; the benchmark side is
broadcast when its measured size allows it and is joined by a shuffle otherwise.
Matches are counted per (document, item) with map-side combining.

Names are capitalised words inside a sentence, with hyphens, apostrophes and
inner capitals; sentences begin at the start of a text or line and after
. ! ? : ; …  As names can open sentences, stand in capitals and have several
words, both sides are read a second time: a capitalised word that opens a
sentence and a word all in capitals are names as well, and a run of one
placeholder is one slot.  A pair counts if it holds in one of the two readings.

Items without a window that counts in the second reading (fewer than five
template words, or numbers and names only, such as 12 + 7 = 19) are also found
word for word: all their words, three at least, in a row.

Edge cases: null and empty texts have no template and stay; items of fewer
than three words (null and empty ones too) give no evidence and match nothing; items that share an id count as one item; very long texts are compared
whole; repeated rows get equal verdicts; null ids are kept apart by their text;
empty tables give empty or clean results; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.llm.text_udf import fresh, quoted
from retail_spark.session import cut_lineage

WINDOW = 5
SHARE_PCT = 80
EXACT = 3                      # words that an item without windows must have
BROADCAST_ROWS = 1_000_000     # benchmark windows (two numbers each) that may be broadcast
#: Fixed word lists.
NUMBERS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
           "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion").split()
UNITS = ("mm cm km meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches feet foot yard yards "
         "mg kg gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml liter liters litre litres gallon gallons "
         "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents "
         "usd eur percent degree degrees mph kmh kph").split()
BLANKS = "\t\x0b\x0c\r"
PLAIN, OPEN = 0, 1             # the two readings of a text
PLACEHOLDERS = ("‹num›", "‹name›", "‹unit›")
#: Literal replacements, then patterns with $n groups, in this order.  A line end closes a sentence (¶).
MARKS = (("‹", ""), ("›", ""), ("\x01", ""), ("\n", "¶ "), *((c, " ") for c in BLANKS))
NAMES = ((r"[-'’](\p{Lu})", "$1"), (r"([.!?:;…¶][\")”’]* +)(\p{Lu})", "$1\x01$2"), (r" \p{Lu}+\p{Ll}[\p{L}\p{M}]*", " ‹name›"))
OPEN_NAMES = ("([\x01 ]\\p{Lu}[\\p{L}\\p{M}]+)", "$1\x02")
REST = ((r"[0-9]+([.,][0-9]+)*", "‹num›"), (r"[^\p{L}\p{M}\p{N}‹› ]+", ""))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def template(text: Column) -> Column:
    """The template words of a text (array of strings; empty for null)."""
    t = F.coalesce(text, F.lit(""))
    for old, new in MARKS:
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.concat(F.lit("¶ "), t)
    for pattern, new in NAMES:
        t = F.regexp_replace(t, pattern, new)
    t = F.lower(t)
    for pattern, new in REST:
        t = F.regexp_replace(t, pattern, new)
    return F.transform(_words(t), lambda w: F.when(w.isin(NUMBERS), "‹num›").when(w.isin(UNITS), "‹unit›").otherwise(w))


def _step(a: Column, f) -> Column:
    """``f`` of ``a``, bound to a name by a one-element array, so that it is worked out once."""
    return F.get(F.transform(F.array(a), f), 0)


def _marked(text: Column) -> Column:
    """Template words before word lists: a capital that opens a sentence is marked \x01, and the end of a name that only the open
    reading takes for one (it opens a sentence, or is all in capitals) \x02."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\x02"), F.lit("\x03"))   # both go with the punctuation
    for old, new in MARKS:
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.concat(F.lit("¶ "), t)
    for pattern, new in (*NAMES, OPEN_NAMES):
        t = F.regexp_replace(t, pattern, new)
    t = F.lower(t)
    for pattern, new in (REST[0], (r"[^\p{L}\p{M}\p{N}‹›" + "\x01\x02 ]+", "")):
        t = F.regexp_replace(t, pattern, new)
    return _words(t)


def _plain(marked: Column) -> Column:
    """The plain reading, equal to ``template``: names that open a sentence or are all in capitals stay words."""
    listed = lambda w: F.when(w.isin(NUMBERS), "‹num›").when(w.isin(UNITS), "‹unit›").otherwise(w)
    return F.transform(marked, lambda w: F.when(
        w.startswith("\x01") | w.contains("\x02"), _step(F.translate(w, "\x01\x02", ""), listed)).otherwise(listed(w)))


def _name(marked: Column) -> Column:
    return F.concat(F.lit("‹name›"), F.substring_index(marked, "\x02", -1))


def read(frame: DataFrame, reading: int, text_col: str = "text") -> DataFrame:
    """``frame`` with the template ``words`` of a reading and, one for one, the words behind them (``raw``); the text goes.

    In the open reading names may open sentences, and a run of one placeholder is one, unless a sentence opens in it."""
    text = F.col(text_col)
    t = frame.withColumn("raw", values(text)).withColumn("reading", F.lit(reading))
    if reading == PLAIN:
        return t.withColumn("words", template(text)).drop(text_col)
    t = t.withColumn("marked", _marked(text)).withColumn("plain", _plain(F.col("marked")))
    t = t.withColumn("words", F.zip_with("marked", "plain", lambda w, p: F.when(
        w.contains("\x02") & ~p.isin(*PLACEHOLDERS), _name(w)).otherwise(p)))
    starts = F.transform("words", lambda w, i: F.when(
        ~w.eqNullSafe(F.get("words", i - 1)) | ~w.isin(*PLACEHOLDERS) | F.get("marked", i).startswith("\x01"), i))
    t = t.withColumn("starts", F.filter(starts, lambda i: i.isNotNull()))
    run = F.transform("starts", lambda i, k: F.array_join(F.slice("raw", i + 1, F.coalesce(F.get("starts", k + 1), F.size("raw")) - i), " "))
    return t.withColumn("raw", run).withColumn("words", F.transform("starts", lambda i: F.get("words", i))).drop("marked", "plain", "starts", text_col)


def values(text: Column) -> Column:
    """The words behind ``template(text)``, one for one: lower case, without punctuation."""
    t = F.coalesce(text, F.lit(""))
    for old, new in MARKS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return _words(F.regexp_replace(F.lower(t), REST[-1][0], ""))


def _windows(words: Column, reading: int = PLAIN) -> Column:
    """Hashes of all windows of five words, in order (empty for fewer): neighbours are hashed in pairs, pairs of pairs, and one more."""
    return _chained(F.transform(words, lambda w: F.xxhash64(w)), F.size(words), reading)


def _chained(one: Column, size: Column, reading: int) -> Column:
    """Hashes of the windows over the word hashes ``one``."""
    last = (lambda x, y: F.xxhash64(x, y, F.lit(reading))) if reading else (lambda x, y: F.xxhash64(x, y))
    ahead = lambda a, k: F.slice(a, k + 1, F.greatest(F.lit(0), size - k))
    both = lambda x, y: F.xxhash64(x, y)
    pairs = lambda a: F.zip_with(a, ahead(a, 1), both)
    fours = lambda a: F.zip_with(a, ahead(a, 2), both)
    five = _step(one, lambda h: _step(pairs(h), lambda h2: F.zip_with(fours(h2), ahead(h, 4), last)))
    return F.slice(five, 1, F.greatest(F.lit(0), size - (WINDOW - 1)))


def _item_windows(items: DataFrame) -> DataFrame:
    """(item, reading, h) of each window of ``items`` (item, reading, words) that has a literal word."""
    h = F.when(F.col("reading") == PLAIN, _windows(F.col("words"))).otherwise(_windows(F.col("words"), OPEN))
    return (items.select("item", "reading", "words", F.posexplode(h).alias("pos", "h"))
            .filter(F.exists(F.slice("words", F.col("pos") + 1, WINDOW), lambda w: ~w.startswith("‹"))).select("item", "reading", "h").distinct())


def _sent(text: Column) -> Column:
    """Window hashes of both readings of a text; the open one (see ``read``) is made from the word hashes of the plain one."""
    def placeholder(x: Column) -> Column:
        num, name, unit = (F.xxhash64(F.lit(w)) for w in PLACEHOLDERS)
        return (x == num) | (x == name) | (x == unit)

    def runs(m: Column, h: Column) -> Column:
        return F.filter(h, lambda x, i: ~x.eqNullSafe(F.get(h, i - 1)) | ~placeholder(x) | F.get(m, i).startswith("\x01"))

    def sent(m: Column, h: Column) -> Column:
        names = F.zip_with(m, h, lambda w, x: F.when(w.contains("\x02") & ~placeholder(x), F.xxhash64(_name(w))).otherwise(x))
        return F.concat(_chained(h, F.size(h), PLAIN), _step(_step(names, lambda n: runs(m, n)), lambda o: _chained(o, F.size(o), OPEN)))

    return _step(_marked(text), lambda m: _step(F.transform(_plain(m), lambda w: F.xxhash64(w)), lambda h: sent(m, h)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", min_share_pct: int = SHARE_PCT) -> DataFrame:
    """One row for each contaminated (document, item): id, text_hash, item, matched, windows."""
    text = F.col(quoted(text_col))
    given = benchmark.select(F.col(quoted(item_col)).alias("item"), F.col(quoted(item_text_col)).alias("text")).filter("item IS NOT NULL")
    items = cut_lineage(read(given, PLAIN).unionByName(read(given, OPEN)))
    windows = cut_lineage(_item_windows(items))
    small = windows.count() <= BROADCAST_ROWS
    # the benchmark's windows are broadcast only when they were counted to be few enough
    held = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    need = windows.groupBy("item", "reading").agg(F.count(F.lit(1)).alias("windows"))
    sent = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("text_hash"), F.explode(_sent(text)).alias("h"))
    found = (sent.join(held(windows), "h").groupBy("id", "text_hash", "item", "reading").agg(F.count_distinct("h").alias("matched"))
             .join(held(need), ["item", "reading"]).filter(F.col("matched") * 100 >= F.col("windows") * min_share_pct))
    found = cut_lineage(found.select("id", "text_hash", "item", "reading", "matched", "windows"))
    slotted = items.filter(F.exists("words", lambda w: w.startswith("‹"))).select("item", "reading").distinct()
    sure = found.join(slotted, ["item", "reading"], "left_anti").select(found.columns)
    known = sure.select(F.col("id").alias("sure_id"), F.col("text_hash").alias("sure_hash"), F.col("item").alias("sure_item")).distinct()
    unsure = found.join(slotted, ["item", "reading"], "left_semi").select(found.columns)
    unsure = unsure.join(known, F.col("id").eqNullSafe(F.col("sure_id")) & (F.col("text_hash") == F.col("sure_hash")) & (F.col("item") == F.col("sure_item")),
                         "left_anti")
    either = sure.unionByName(_consistent(docs, unsure, items, id_col, text_col, min_share_pct).drop("runs"))
    bare = given.join(windows.filter(F.col("reading") == OPEN).select("item").distinct(), "item", "left_anti")
    bare = cut_lineage(bare.select("item", _exact_words(F.col("text")).alias("words")).filter(F.size("words") >= EXACT).distinct())
    levels = [r.level for r in bare.select(_level(F.size("words")).alias("level")).distinct().collect()]
    if levels:
        either = either.unionByName(_verbatim(docs, bare, sorted(levels), id_col, text_col))
    first = F.min_by(F.struct("matched", "windows"), "reading").alias("first")
    return either.groupBy("id", "text_hash", "item").agg(first).select("id", "text_hash", "item", "first.matched", "first.windows")


def _exact_words(text: Column) -> Column:
    """The words of a text in lower case without punctuation; signs such as + and = are words."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([\p{S}*/%-])", " $1 ")
    t = F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}\p{S}*/%\s-]+", "")
    return _words(F.regexp_replace(t, r"\s+", " "))


def _level(size: Column) -> Column:
    """The largest j with 2^j <= size."""
    return (F.length(F.bin(size)) - 1).cast("int")


def _verbatim(docs: DataFrame, bare: DataFrame, levels: list[int], id_col: str, text_col: str) -> DataFrame:
    """Documents that hold all words of a ``bare`` item (item, words) in a row.

    A window's hash is made from those of its halves, so spans of 1, 2, 4, … words cost one step each.  An item of n words is its
    first and its last span of 2^j words, the largest j that fits; both must be met at places n - 2^j apart.  ``levels`` are the
    j of the items, at most one for each doubling of the longest."""
    def spans(t: DataFrame, keep: list[str]) -> DataFrame:
        t = t.select(*keep, F.col("words"), F.transform("words", lambda w: F.xxhash64(w)).alias("s0"))
        for j in range(levels[-1]):
            ahead = F.slice(f"s{j}", 2 ** j + 1, F.greatest(F.lit(0), F.size(f"s{j}") - 2 ** j))
            both = F.zip_with(f"s{j}", ahead, lambda x, y: F.xxhash64(x, y))
            t = t.withColumn(f"s{j + 1}", F.slice(both, 1, F.greatest(F.lit(0), F.size(f"s{j}") - 2 ** j)))
        return t

    item = spans(bare, ["item"]).withColumn("level", _level(F.size("words"))).withColumn("apart", F.size("words") - F.pow(F.lit(2), F.col("level")).cast("int"))
    own = F.coalesce(*[F.when(F.col("level") == j, F.col(f"s{j}")) for j in levels])
    name = F.xxhash64(F.array_join("words", " "))
    ends = item.select("item", name.alias("wording"), "level", F.explode(F.array(
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("back"), F.get(own, 0).alias("h")),
        F.struct(F.lit(1).alias("end"), F.col("apart").alias("back"), F.get(own, F.col("apart")).alias("h")))).alias("e")).select("item", "wording", "level", "e.*")
    ends = cut_lineage(ends)
    held = F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends
    text = F.col(quoted(text_col))
    d = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("text_hash"), _exact_words(text).alias("words"))
    d = spans(d, ["id", "text_hash"])
    at = lambda j: F.transform(f"s{j}", lambda h, i: F.struct(F.lit(j).alias("level"), i.alias("p"), h.alias("h")))
    placed = F.flatten(F.array(*map(at, levels)))
    met = d.select("id", "text_hash", F.explode(placed).alias("x")).select("id", "text_hash", "x.*").join(held, ["level", "h"])
    whole = (met.groupBy("id", "text_hash", "item", "wording", (F.col("p") - F.col("back")).alias("start"))
             .agg(F.count_distinct("end").alias("ends")).filter("ends = 2"))
    return whole.select("id", "text_hash", "item").distinct().select(
        "id", "text_hash", "item", F.lit(PLAIN).alias("reading"), F.lit(1).cast("long").alias("matched"), F.lit(1).cast("long").alias("windows"))


def _placed(words: Column, raw: Column) -> Column:
    """Each window of a text: its place, hash, template words and the values behind them."""
    return F.transform(_windows(words), lambda h, i: F.struct(
        i.alias("pos"), h.alias("h"), F.slice(words, i + 1, WINDOW).alias("kinds"), F.slice(raw, i + 1, WINDOW).alias("behind")))


def _consistent(docs: DataFrame, pairs: DataFrame, items: DataFrame, id_col: str, text_col: str, min_share_pct: int) -> DataFrame:
    """Pairs (document, item with slots) of which an alignment holds enough windows and gives every item value one document value.

    Only slots inside a matched window are read.  A window's shift is its place in the document less that in the item; an alignment
    is a run of shifts that are next to each other among those met, because a word put in or left out moves all later windows.
    Such a change costs four windows at least, which bounds how many shifts one copy can have; two more are allowed.  Windows that
    the item repeats also meet at foreign shifts: a hit is left out when its place in the item and its place in the document both
    belong to longer blocks (windows in a row at one shift)."""
    text = F.col(quoted(text_col))
    d = docs.select(F.col(quoted(id_col)).alias("doc"), F.xxhash64(text).alias("doc_hash"), text.alias("text"))
    held = pairs.join(d, F.col("id").eqNullSafe(F.col("doc")) & (F.col("text_hash") == F.col("doc_hash"))).dropDuplicates(["id", "text_hash", "item", "reading"])
    held = cut_lineage(held.select(*pairs.columns, "text"))
    both = [read(held.filter(F.col("reading") == r), r).select(*pairs.columns, "words", "raw") for r in (PLAIN, OPEN)]
    held = cut_lineage(both[0].unionByName(both[1]))
    one = held.select(*pairs.columns, F.explode(_placed(F.col("words"), F.col("raw"))).alias("x")).select(
        *pairs.columns, F.col("x.pos").alias("p"), F.col("x.h").alias("h"), F.col("x.behind").alias("value"))
    other = items.select("item", "reading", F.explode(_placed(F.col("words"), F.col("raw"))).alias("y")).select(
        "item", "reading", F.col("y.pos").alias("q"), F.col("y.h").alias("h"), F.col("y.kinds").alias("kinds"), F.col("y.behind").alias("item_value"))
    literal = F.exists("kinds", lambda w: ~w.startswith("‹"))
    slots = F.filter(F.transform("kinds", lambda w, i: F.when(w.startswith("‹"), i)), lambda i: i.isNotNull())
    hits = one.join(other, ["item", "reading", "h"]).withColumn("shift", F.col("p") - F.col("q")).repartition(*pairs.columns)
    along = lambda *by: Window.partitionBy(*pairs.columns, *by)
    hits = hits.withColumn("block", F.col("q") - F.row_number().over(along("shift").orderBy("q")))
    hits = hits.withColumn("n", F.count(F.lit(1)).over(along("shift", "block")))
    foreign = (F.col("n") < F.max("n").over(along("q"))) & (F.col("n") < F.max("n").over(along("p")))
    shifts = (hits.withColumn("foreign", foreign).filter(~F.col("foreign")).withColumn("slots", slots)
              .groupBy(*pairs.columns, "shift").agg(
                  F.collect_set(F.when(literal, F.col("h"))).alias("hashes"),
                  F.flatten(F.collect_set(F.transform("slots", lambda i: F.xxhash64(F.get("item_value", i))))).alias("from"),
                  F.flatten(F.collect_set(F.transform("slots", lambda i: F.xxhash64(F.get("item_value", i), F.get("value", i))))).alias("to"))
              .filter(F.size("hashes") > 0))
    runs = shifts.groupBy(*pairs.columns).agg(F.sort_array(F.collect_list(F.struct("shift", "hashes", "from", "to"))).alias("runs"))
    most = F.floor(F.col("windows") * (100 - min_share_pct) / (100 * (WINDOW - 1))).cast("int") + 3
    kinds = lambda part, name: F.size(F.array_distinct(F.flatten(F.transform(part, lambda r: r[name]))))
    holds = lambda part: (kinds(part, "hashes") * 100 >= F.col("windows") * min_share_pct) & (kinds(part, "from") == kinds(part, "to"))
    return runs.filter(F.exists(F.sequence(F.lit(1), F.size("runs")), lambda k: F.exists(
        F.sequence(F.lit(1), F.least(most, F.size("runs") - k + 1)), lambda n: holds(F.slice("runs", k, n)))))


def mark(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, items) for every row of ``docs``; items: ids of the items found in it, ascending, null for none."""
    own = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(F.col(quoted(text_col))).alias("text_hash"))
    hits = found.groupBy(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    return own.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left").select("id", "text_hash", "items")


def clean(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) in which no item was found."""
    i, h = fresh(docs, "hit_id"), fresh(docs, "hit_hash")
    bad = cut_lineage(found.select(F.col("id").alias(i), F.col("text_hash").alias(h)).distinct())
    return docs.join(bad, F.col(quoted(id_col)).eqNullSafe(F.col(i)) & (F.xxhash64(F.col(quoted(text_col))) == F.col(h)), "left_anti")


# ---- registered query -------------------------------------------------------

def query(spark, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items found in it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return mark(docs, found).select(
        F.col("id").alias("doc_id"), F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("int").alias("n_items"), F.coalesce(F.array_join("items", ","), F.lit("")).alias("items"))


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\x01", "' || chr(1) || '") + "'"


def _duck_marks(t: str) -> str:
    t = f"coalesce({t}, '')"
    for old, new in MARKS:
        old = f"chr({ord(old)})" if ord(old) < 32 else _lit(old)
        t = f"replace({t}, {old}, {_lit(new)})"
    return t


def _duck_replace(t: str, pattern: str, new: str) -> str:
    return f"regexp_replace({t}, {_lit(pattern)}, {_lit(new.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"


def _duck_words(t: str) -> str:
    return f"list_filter(string_split({t}, ' '), lambda w: w <> '')"


def _duck_template(t: str) -> str:
    t = f"'¶ ' || {_duck_marks(t)}"
    for pattern, new in NAMES:
        t = _duck_replace(t, pattern, new)
    t = f"lower({t})"
    for pattern, new in REST:
        t = _duck_replace(t, pattern, new)
    listed = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
    return f"list_transform({_duck_words(t)}, lambda w: CASE WHEN w IN {listed(NUMBERS)} THEN '‹num›' WHEN w IN {listed(UNITS)} THEN '‹unit›' ELSE w END)"


_RAW = _duck_words(_duck_replace(f"lower({_duck_marks('text')})", REST[-1][0], ""))
SQL = f"""
WITH it AS (SELECT item_id AS item, {_duck_template('text')} AS w, {_RAW} AS raw FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT item, unnest(list_transform(range(1, len(w) - {WINDOW} + 2), lambda i: {{'p': i, 'g': w[i:i+{WINDOW - 1}]}})) AS x FROM it WHERE len(w) >= {WINDOW}),
iwin AS (SELECT item, x.p AS p, array_to_string(x.g, ' ') AS g FROM iw WHERE len(list_filter(x.g, lambda s: NOT starts_with(s, '‹'))) > 0),
need AS (SELECT item, count(DISTINCT g) AS n FROM iwin GROUP BY item),
dt AS (SELECT doc_id, text, {_duck_template('text')} AS w, {_RAW} AS raw FROM documents),
dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {WINDOW} + 2), lambda i: {{'p': i, 'g': w[i:i+{WINDOW - 1}]}})) AS x FROM dt WHERE len(w) >= {WINDOW}),
dwin AS (SELECT doc_id, x.p AS p, array_to_string(x.g, ' ') AS g FROM dw),
hit AS (SELECT d.doc_id, i.item, count(DISTINCT i.g) AS matched FROM (SELECT DISTINCT doc_id, g FROM dwin) d JOIN iwin i USING (g) GROUP BY ALL),
pair AS (SELECT doc_id, item FROM hit JOIN need USING (item) WHERE matched * 100 >= n * {SHARE_PCT}),
shift AS (SELECT doc_id, item, d.p - i.p AS s, count(*) AS n FROM pair JOIN iwin i USING (item) JOIN dwin d USING (doc_id, g) GROUP BY ALL),
best AS (SELECT doc_id, item, s FROM shift QUALIFY row_number() OVER (PARTITION BY doc_id, item ORDER BY n DESC, s) = 1),
slot AS (SELECT item, raw, unnest(list_filter(range(1, len(w) + 1), lambda i: starts_with(w[i], '‹'))) AS k FROM it),
bad AS (SELECT doc_id, item FROM best JOIN slot USING (item) JOIN dt USING (doc_id) WHERE dt.raw[s + k] IS NOT NULL
        GROUP BY doc_id, item, slot.raw[k] HAVING count(DISTINCT dt.raw[s + k]) > 1),
fin AS (SELECT doc_id, item FROM pair ANTI JOIN bad USING (doc_id, item)),
agg AS (SELECT doc_id, count(DISTINCT item) AS n, list_sort(list(DISTINCT item)) AS l FROM fin GROUP BY doc_id)
SELECT documents.doc_id, agg.n IS NOT NULL AS contaminated, coalesce(agg.n, 0)::INTEGER AS n_items, coalesce(array_to_string(agg.l, ','), '') AS items
FROM documents LEFT JOIN agg USING (doc_id)
"""
