"""Benchmark decontamination by canonical templates; DataFrame expressions only.

Words are runs of letters, and numbers. A number becomes a number placeholder, a capitalised word after a
lower-case letter, digit, comma or semicolon a name placeholder, a unit after a number a unit placeholder (the first word of an item counts both ways); other
words are lower-cased. Windows of ``WINDOW`` canonical words (shorter items: their own length) are hashed, and
documents' windows are equi-joined with those of the benchmark. Two bit maps of bounded size thin them out before any row
is made of them, in one pass over the documents for items of all lengths: a window is hashed only where those of its pairs of
neighbouring words that are tested (one in ``PAIR_STEP``) occur in the benchmark, and passes only if its hash does; if the benchmark outgrows the maps, more
windows pass and the join still decides.

A run of names is one canonical word ("Mary Ann" stands for "Anna"); numbers next to each other stay apart.

Matches of a document and an item with the same distance between their places belong together. Their slots -
places with a placeholder - must be consistent: wherever the item repeats a value, the document repeats the value
that stands for it. Distances that differ by up to ``DRIFT`` words (a word put in or left out, a longer name) are
joined where their slots are consistent with each other; the item's words that their windows cover are counted. A document is contaminated
by an item if consistent matches cover ``COVERED`` of its words, or the share ``SHARE`` of them.

Case marks the names, so every window is also hashed with its names as lower-cased words: a copy in lower case,
upper case or title case matches by these.

Windows with more than half of their words in placeholders (sums, tables, lists of names) say too little as
templates: they match only where all their words agree, so an exact copy always matches. Items under ``SHORTEST`` words
say too little anywhere in a text: they match the documents that consist of their words alone.

Null and empty texts and items match nothing, and so does an empty table. Items without an id contaminate, but are not
listed. Rows with a null id are told apart by their text. Repeated rows get equal results, and several items that
cover a document equally are all listed. Of the documents ``mark`` reads id and text only; ``clean`` passes on all
columns, of any name but ``text_hash__``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .native import let, long_array

WINDOW, SHORTEST = 8, 4
COVERED, SHARE = 13, 0.8
#: Words by which the parts of one copy may be shifted against each other.
DRIFT = 8
#: Bits of a map: 16 an entry, between 2^13 and 2^20.
BITS_AN_ENTRY, LEAST_BITS, MOST_BITS = 16, 1 << 13, 1 << 20
#: Bytes of the benchmark's windows up to which they are broadcast; beyond, both sides are dealt out by hash and ``SALT``.
BROADCAST_BYTES, SALT = 64 << 20, 16
#: One pair of neighbouring words in so many is tested; the shortest window holds SHORTEST - 1 pairs.
PAIR_STEP = 3
A_NAME = "\x01name"
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa bar k c f "
    "meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms ton tons tonne tonnes percent pct degree degrees usd eur gbp dollar dollars "
    "euro euros cent cents b kb mb gb tb byte bytes bit bits mph kmh rpm"
).split()


def raw_words(text: Column) -> Column:
    """Words and numbers; a name comes with the white space before it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:(?<=[\p{Ll}\p{N},;])\s+(?=\p{Lu}\p{Ll}))?[\p{L}\p{M}]+|\p{N}+(?:[.,:]\p{N}+)*"), F.lit(0))


def marked_start(text: Column) -> Column:
    """The text with its first word a name, if it is capitalised: so it looks where it stands inside a sentence."""
    return F.regexp_replace(text, r"^\s*(?=\p{Lu}\p{Ll})", ", ")


def is_name(word: Column) -> Column:
    return word < "!"


def is_number(word: Column) -> Column:
    """Numerals of any script."""
    return F.when(word < "\x80", (word >= "0") & (word < ":")).otherwise(word.rlike(r"^\p{N}"))


def plain(word: Column) -> Column:
    return F.lower(F.when(is_name(word), F.regexp_replace(word, r"^\s+", "")).otherwise(word))


def kinds_of(words: Column, plains: Column) -> Column:
    """The placeholder of each word; null where it is none."""

    def kind(word: Column, i: Column) -> Column:
        unit = F.coalesce(is_number(F.get(words, i - 1)), F.lit(False)) & F.get(plains, i).isin(UNITS)
        return F.when(is_number(word), F.lit("\x01number")).when(unit, F.lit("\x01unit")).when(is_name(word), F.lit(A_NAME))

    return F.transform(words, kind)


def template_places(kinds: Column) -> Column:
    """0-based places of the words that begin a canonical word: a run of names is one."""

    def goes_on(i: Column) -> Column:
        return F.coalesce((F.get(kinds, i) == A_NAME) & (F.get(kinds, i - 1) == A_NAME), F.lit(False))

    return F.filter(F.transform(kinds, lambda k, i: i), lambda i: ~goes_on(i))


def bit_test(bit_map: Column):
    mask = F.size(bit_map) * 64 - 1

    def bit(h: Column) -> Column:
        place = h.bitwiseAND(mask.cast("long"))
        return F.getbit(F.get(bit_map, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1

    return bit


def pair_hash(hashes: Column, i: Column) -> Column:
    """Of the words at the 1-based places i and i + 1."""
    return F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i))


def places_from_1(hashes: Column, less: int = 0) -> Column:
    n = F.size(hashes) - less
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def candidates(hashes: Column, maps: tuple[Column, Column] | None):
    """Of a size: array of (at, hash) of the windows of so many words, 1-based; with maps, of those only whose pairs and hash are in them."""

    def hashed(starts: Column, size: Column) -> Column:
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(hashes, i, size)).alias("hash")))

    if maps is None:
        return lambda size: hashed(F.filter(places_from_1(hashes), lambda i: i + size - 1 <= F.size(hashes)), size), None
    pairs, whole = map(bit_test, maps)
    tested = F.when(F.size(hashes) > 1, F.sequence(F.lit(1), F.size(hashes) - 1, F.lit(PAIR_STEP))).otherwise(F.array().cast("array<int>"))
    hits = F.filter(tested, lambda i: pairs(pair_hash(hashes, i)))

    def of_size(found: Column, size: Column) -> Column:
        def after(r: int) -> Column:
            """Starts of the windows whose first tested pair is ``r`` words on, and all of whose tested pairs are hits."""
            more = F.floor((size - 2 - r) / PAIR_STEP).cast("int")
            in_a_row = F.filter(found, lambda p, k: (p > r) & F.coalesce(F.get(found, k + more) == p + more * PAIR_STEP, F.lit(False)))
            return F.filter(F.transform(in_a_row, lambda p: p - r), lambda i: i + size - 1 <= F.size(hashes))

        return F.filter(hashed(F.concat(*map(after, range(PAIR_STEP))), size), lambda w: whole(w["hash"]))

    return of_size, hits


def matches_of(text: Column, sizes: list[int], maps: tuple[Column, Column] | None = None) -> Column:
    """Array of (size, at, end, hash, words, slots) of a text's windows, places from 1, both ends included.

    Windows are hashed with placeholders, a run of names being one word, and again with names as words, unless
    placeholders are more than half of them; where a text has that many numbers and units, also with all words as they stand.
    """
    all_sizes = F.array(*map(F.lit, sizes))

    def each_size(hashes: Column, full) -> Column:
        """``full(size, windows)`` of all sizes in a row."""

        def of(h: Column) -> Column:
            make, hits = candidates(h, maps)
            if hits is None:
                return F.flatten(F.transform(all_sizes, lambda size: full(size, make(size))))
            none = full(F.lit(0), F.array().cast("array<struct<at:int,hash:bigint>>"))
            return let(hits, lambda found: F.when(F.size(found) == 0, none).otherwise(F.flatten(F.transform(all_sizes, lambda size: full(size, make(found, size))))))

        return let(hashes, of)

    def of_text(words: Column, plains: Column, kinds: Column) -> Column:
        def as_words(size: Column, every: Column) -> Column:
            return F.transform(
                every,
                lambda w: F.struct(
                    size.alias("size"), w["at"].alias("at"), (w["at"] + size - 1).alias("end"), w["hash"].alias("hash"), F.slice(plains, w["at"], size).alias("words"),
                    F.transform(F.slice(kinds, w["at"], size), lambda k: k.isNotNull()).alias("slots"),
                ),
            )

        def by_template(places: Column) -> Column:
            def next_place(k: Column) -> Column:
                return F.coalesce(F.get(places, k + 1), F.size(words))

            def value(k: Column) -> Column:
                return F.array_join(F.slice(plains, F.get(places, k) + 1, next_place(k) - F.get(places, k)), " ")

            def full(size: Column, every: Column) -> Column:
                made = F.transform(
                    every,
                    lambda w: F.struct(
                        size.alias("size"), (F.get(places, w["at"] - 1) + 1).alias("at"), next_place(w["at"] + size - 2).alias("end"), w["hash"].alias("hash"),
                        F.transform(F.sequence(w["at"] - 1, w["at"] + size - 2), value).alias("words"),
                        F.transform(F.slice(places, w["at"], size), lambda i: F.get(kinds, i).isNotNull()).alias("slots"),
                    ),
                )
                return F.filter(made, lambda w: F.size(F.filter(w["slots"], lambda x: x)) * 2 <= size)

            return each_size(F.transform(places, lambda i: F.xxhash64(F.coalesce(F.get(kinds, i), F.get(plains, i)))), full)

        def light(size: Column, every: Column) -> Column:
            few = F.filter(every, lambda w: F.size(F.filter(F.slice(kinds, w["at"], size), lambda k: k != A_NAME)) * 2 <= size)
            return as_words(size, few)

        names_as_words = each_size(F.transform(plains, lambda w, i: F.xxhash64(F.coalesce(F.nullif(F.get(kinds, i), F.lit(A_NAME)), w))), light)
        as_they_stand = each_size(F.transform(plains, lambda w: F.xxhash64(w)), as_words)
        out = F.when(F.array_contains(kinds, A_NAME), F.array_union(let(template_places(kinds), by_template), names_as_words)).otherwise(names_as_words)
        # numbers and units that stand so close that they may be more than half of a window
        numbers = F.filter(F.transform(kinds, lambda k, i: F.when(k != A_NAME, i)), lambda i: i.isNotNull())
        close = let(numbers, lambda p: F.exists(F.transform(p, lambda i, k: F.get(p, k + min(sizes) // 2) - i < WINDOW), lambda x: F.coalesce(x, F.lit(False))))
        return F.when(close, F.array_union(out, as_they_stand)).otherwise(out)

    return let(raw_words(text), lambda words: let(F.transform(words, plain), lambda plains: let(kinds_of(words, plains), lambda kinds: of_text(words, plains, kinds))))


def joined_lines(lines: Column) -> Column:
    """Item places covered by the lines of one neighbourhood: from the longest on, each that contradicts no earlier one is added."""

    def added(held: Column, line: Column) -> Column:
        pairs = F.array_union(held["pairs"], line["pairs"])
        return F.when(agree(pairs), F.struct(F.array_union(held["places"], line["places"]).alias("places"), pairs.alias("pairs"))).otherwise(held)

    none = F.struct(F.array().cast("array<int>").alias("places"), F.array().cast("array<struct<item:string,doc:string>>").alias("pairs"))
    return F.size(F.aggregate(F.sort_array(lines, asc=False), none, added, lambda held: held["places"]))


def agree(pairs: Column) -> Column:
    return F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["item"])))


def bit_map(hashes: DataFrame) -> Column:
    """A constant array of longs: the bits of the column ``hash``. At most MOST_BITS bits, and a row a word of 64, come to the driver."""
    n = hashes.select("hash").distinct().count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n * BITS_AN_ENTRY - 1).bit_length() if n else 0))
    place = F.expr(f"hash & {bits - 1}")
    words = [0] * (bits // 64)
    for r in hashes.select(F.shiftright(place, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        words[r["w"]] = r["b"]
    return long_array(words)


def pairs_in(text: Column) -> Column:
    """Hashes of the pairs of neighbouring words of a text, by every way of hashing them."""

    def of_text(plains: Column, kinds: Column) -> Column:
        def pairs(hashes: Column) -> Column:
            return let(hashes, lambda h: F.transform(places_from_1(h, 1), lambda i: pair_hash(h, i)))

        by_template = let(template_places(kinds), lambda places: pairs(F.transform(places, lambda i: F.xxhash64(F.coalesce(F.get(kinds, i), F.get(plains, i))))))
        names_as_words = pairs(F.transform(plains, lambda w, i: F.xxhash64(F.coalesce(F.nullif(F.get(kinds, i), F.lit(A_NAME)), w))))
        return F.concat(by_template, names_as_words, pairs(F.transform(plains, lambda w: F.xxhash64(w))))

    return let(raw_words(text), lambda words: let(F.transform(words, plain), lambda plains: let(kinds_of(words, plains), lambda kinds: of_text(plains, kinds))))


def joined(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Equi-join by hash. Windows that very many documents share meet in no single task: the other side is broadcast if it is
    measured to be small, or else repeated ``SALT`` times, and ours are dealt out by a salt of their own."""
    size = theirs.agg(F.sum(F.octet_length(F.array_join("item_text", " ")) + 128)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return ours.join(F.broadcast(theirs), "hash")
    salted = ours.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash", "at"), F.lit(SALT)).cast("int"))
    return salted.join(theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["hash", "salt"]).drop("salt")


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item, item_id, covered, item_words) of every document and item that contaminates it; ``item`` tells items without an id apart."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    first = let(raw_words(marked_start(F.col("text"))), lambda words: let(F.transform(words, plain), lambda plains: let(kinds_of(words, plains), lambda k: F.size(template_places(k)))))
    counted = benchmark.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text", F.size(raw_words(F.col("text"))).alias("item_words"), first.alias("template_words"))
    long_enough = F.when(F.col("template_words") >= SHORTEST, F.col("template_words")).otherwise(F.col("item_words"))
    counted = counted.withColumn("n", F.least(long_enough, F.lit(WINDOW)))
    items, short = counted.filter(F.col("item_words") >= SHORTEST), counted.filter(F.col("item_words").between(1, SHORTEST - 1))
    sizes = [r[0] for r in items.select("n").distinct().orderBy("n").collect()]  # WINDOW values at most
    # items of few words: whole texts of as few
    alone = F.transform(raw_words(F.col("text")), plain)
    few = docs.filter(F.length("text") < 1 << 10).select("doc_id", "text_hash", alone.alias("w")).filter(F.size("w").between(1, SHORTEST - 1))
    same = few.join(short.select("item", "item_id", "item_words", alone.alias("w")), "w")
    found = same.select("doc_id", "text_hash", "item", "item_id", F.col("item_words").alias("covered"), "item_words").distinct()
    if not sizes:
        return found
    # every item in the windows of its own size only; with its first word as a name, or as a unit after a number of the
    # text around it, in those that begin with that word
    form = lambda t, first, before: F.struct(t.alias("t"), F.lit(first).alias("first"), F.lit(before).alias("before"))
    unit_first = F.lower(F.regexp_extract("text", r"[\p{L}\p{M}\p{N}]+", 0)).isin(UNITS)
    forms = F.array(form(F.col("text"), 0, 0), form(marked_start(F.col("text")), 1, 0), F.when(unit_first, form(F.concat(F.lit("0 "), "text"), 2, 1)))
    formed = items.select("item", "item_id", "item_words", "n", F.explode(forms).alias("f")).filter(F.col("f").isNotNull()).select("item", "item_id", "item_words", "n", "f.t", "f.first", "f.before")
    theirs = formed.select("item", "item_id", "item_words", "n", "first", "before", F.explode_outer(matches_of(F.col("t"), sizes)).alias("m")).filter((F.col("m.size") == F.col("n")) & ((F.col("first") == 0) | (F.col("m.at") == F.col("first"))))
    theirs = theirs.select("item", "item_id", "item_words", "m.size", (F.col("m.at") - F.col("before")).alias("item_at"), (F.col("m.end") - F.col("before")).alias("item_end"), F.col("m.hash").alias("hash"), F.col("m.words").alias("item_text"), F.col("m.slots").alias("item_slots")).distinct()
    theirs = written(docs.sparkSession, theirs, "benchmark-windows")
    pairs = written(docs.sparkSession, formed.select(F.explode_outer(pairs_in(F.col("t"))).alias("hash")).filter(F.col("hash").isNotNull()).distinct(), "benchmark-pairs")
    maps = (bit_map(pairs), bit_map(theirs))
    # explode_outer: for explode Spark first filters by the array's size, and so makes the array twice
    ours = docs.select("doc_id", "text_hash", F.explode_outer(matches_of(F.col("text"), sizes, maps)).alias("m")).filter(F.col("m").isNotNull()).select("doc_id", "text_hash", F.col("m.at").alias("at"), F.col("m.hash").alias("hash"), F.col("m.words").alias("words"), F.col("m.slots").alias("slots"))
    both = joined(ours, theirs).filter(F.size("words") == F.col("size"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.struct(F.get("item_text", k).alias("item"), F.get("words", k).alias("doc"), (F.get("slots", k) | F.get("item_slots", k)).alias("slot")))
    values = F.transform(F.filter(pairs, lambda p: p["slot"]), lambda p: F.struct(p["item"].alias("item"), p["doc"].alias("doc")))
    one = ("doc_id", "text_hash", "item", "item_id", "item_words")
    lined = both.groupBy(*one, (F.col("at") - F.col("item_at")).alias("line")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("item_at", "item_end")), lambda x: F.sequence(x["item_at"], x["item_end"]))))).alias("places"),
        F.array_distinct(F.flatten(F.collect_set(values))).alias("pairs"),
    )
    line = F.struct(F.size("places").alias("n"), F.col("line"), F.col("places"), F.col("pairs"))
    near = F.floor(F.col("line") / F.lit(DRIFT))
    parts = lined.filter(agree(F.col("pairs"))).select(*one, F.explode(F.array(near - 1, near)).alias("near"), line.alias("l")).groupBy(*one, "near").agg(joined_lines(F.collect_list("l")).alias("covered"))  # 2 * DRIFT lines at most
    bad = (F.col("covered") >= COVERED) | (F.col("covered") >= SHARE * F.col("item_words"))
    best = parts.filter(bad).groupBy("doc_id", "text_hash", "item").agg(F.first("item_id").alias("item_id"), F.max("covered").alias("covered"), F.first("item_words").alias("item_words"))
    return best.unionByName(found)


def same_rows(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def mark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, items (ids, ascending) and most_covered (words of one item) of every document."""
    per_doc = contaminations(docs, benchmark).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("covered").cast("long").alias("most_covered"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    return rows.join(per_doc, same_rows(rows, per_doc), "left").select(
        rows["doc_id"], F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("most_covered", F.lit(0).cast("long")).alias("most_covered")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    bad = contaminations(docs, benchmark).select("doc_id", "text_hash").distinct()
    rows = docs.withColumn("text_hash__", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(bad["doc_id"]) & (rows["text_hash__"] == bad["text_hash"])
    return rows.join(bad, same, "left_anti").drop("text_hash__")


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
