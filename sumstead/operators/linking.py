"""Which product of the catalog a question names.

A name is named by any substring of its normal form (two characters or more)
that no other name has.  From each position of a name these are the parts longer
than the longest that another name shares, so the index keeps one number for
each position instead of the parts themselves, of which a name of n characters
has n * n / 2.  To find names in questions it is enough to look for the shortest
such parts: each longer one contains one of them, and no two of them start at
one place.  Parts of questions meet these in an equality join behind two filters
of fixed size, so no question is compared with every name and little more than
what matches is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumstead.functions.text import entity_key
from sumstead.model import Workspace
from sumstead.operators.skew import fits_broadcast, join_one
from sumstead.session import cut_lineage

#: Lengths of the first window of shared parts, and how much longer each next one reaches.
FIRST_WINDOW = 12
WINDOW_GROWTH = 4
#: Beginnings of two characters are told apart by 16 bits; a word of the filter has a bit for each alias length, the last for all from 63.
BEGINNINGS = 1 << 16
#: Bits of the filter of whole aliases: FILTER_BITS for each, up to FILTER_WORDS words of 64.
FILTER_BITS = 16
FILTER_WORDS = 1 << 17


def product_catalog(workspace: Workspace) -> DataFrame:
    """Distinct names of products that have sales, with their normal form."""
    model = workspace.model
    relation = model.relation("product")
    sold = workspace.facts.select(F.col(relation.fact_key).alias("_key")).distinct()
    names = workspace.tables["product"].select(
        F.col(relation.table_key).alias("_key"), F.col(model.dimension("product").column).alias("product")
    )
    return names.join(sold, "_key", "left_semi").select("product").distinct().withColumn(
        "product_key", entity_key(F.col("product"))
    )


def shared_lengths(catalog: DataFrame) -> DataFrame:
    """Adds ``_shared``: for each position of a name the longest part from there that another name has too.

    Lengths grow in windows, each WINDOW_GROWTH times as long as all before it.
    A position takes part in the next window only if the whole last one was
    shared there and at the position behind it, so a name deals some rows for
    each character of its shared parts and none for its own.  Parts travel as
    hashes (96 bits and the length); a part is shared if the least and the
    largest name that have it differ, which is combined before it is shuffled.
    """
    size = F.char_length("product_key")
    state = cut_lineage(catalog.withColumn("_name", F.monotonically_increasing_id()).withColumn(
        "_shared", F.when(size > 0, F.array_repeat(F.lit(1), size)).otherwise(F.array().cast("array<int>"))), "names")
    low, high = 2, FIRST_WINDOW
    while True:
        goes_on = _goes_on(low)
        if low > 2 and state.where(F.exists(F.sequence(F.lit(1), size), goes_on)).isEmpty():
            return state
        starts = state.where(size >= low).select(
            "_name", "product_key", F.explode(F.filter(F.sequence(F.lit(1), size - low + 1), goes_on)).alias("_start"))
        last = F.least(F.lit(high), size - F.col("_start") + 1)
        sized = starts.select("*", F.explode(F.sequence(F.lit(low), last)).alias("_length"))
        part = F.substr("product_key", F.col("_start"), F.col("_length"))
        parts = sized.select("_name", "_start", "_length", F.struct("_length", F.xxhash64(part).alias("a"), F.hash(part).alias("b")).alias("_part"))
        owners = parts.groupBy("_part").agg(F.min("_name").alias("_least"), F.max("_name").alias("_most"))
        shared = cut_lineage(owners.where("_least < _most").select("_part"), "shared")
        longest = join_one(parts, shared, "_part", "inner", ["_name", "_start"]).groupBy("_name", "_start").agg(F.max("_length").alias("_length"))
        by_name = longest.groupBy("_name").agg(F.map_from_entries(F.collect_list(F.struct("_start", "_length"))).alias("_grown"))
        grown = F.transform("_shared", lambda known, i: F.coalesce(F.try_element_at("_grown", i + 1), known))
        state = cut_lineage(state.join(by_name, "_name", "left").withColumn("_shared", grown).drop("_grown"), "names")
        low, high = high + 1, high * WINDOW_GROWTH


def _goes_on(low: int):
    """Whether a part of ``low`` characters from a position can be shared: both parts one shorter are."""
    def test(i: Column) -> Column:
        room = i + low - 1 <= F.char_length("product_key")
        return room & (F.get("_shared", i - 1) >= low - 1) & (F.get("_shared", i) >= low - 1)

    return test


def _from_positions(positions: DataFrame, lengths: Column) -> DataFrame:
    """(alias, product) for the lengths at each ``_start``; a part is taken where it is in its name first."""
    size = F.char_length("product_key")
    starts = positions.where(size >= 2).select("product", "product_key", "_shared", F.explode(F.sequence(F.lit(1), size - 1)).alias("_start"))
    alias = F.substr("product_key", F.col("_start"), F.col("_length"))
    parts = starts.select("*", F.explode(lengths).alias("_length")).select("product", "product_key", "_start", alias.alias("alias"))
    return parts.where(F.instr("product_key", F.col("alias")) == F.col("_start")).select("alias", "product")


def unique_aliases(positions: DataFrame) -> DataFrame:
    """(alias, product) where exactly one name has the substring: each shared part made longer, up to the name's end."""
    first, last = F.get("_shared", F.col("_start") - 1) + 1, F.char_length("product_key") - F.col("_start") + 1
    return _from_positions(positions, F.when(first <= last, F.sequence(first, last)))


def shortest_aliases(positions: DataFrame) -> DataFrame:
    """Aliases that contain no shorter alias: one character more than what is shared, if what is behind its first is shared too."""
    shared, behind = F.get("_shared", F.col("_start") - 1), F.get("_shared", F.col("_start"))
    fits = F.col("_start") + shared <= F.char_length("product_key")
    return _from_positions(positions, F.when(fits & (behind >= shared), F.array(shared + 1)))


def _whole_names(catalog: DataFrame) -> DataFrame:
    """Normal forms that one name has."""
    owners = catalog.groupBy("product_key").agg(F.count(F.lit(1)).alias("_owners"), F.min("product").alias("product"))
    return owners.where("_owners = 1").select("product_key", "product")


def _words_of_bits(table: DataFrame, index: Column, bit: Column, size: int) -> Column:
    """``size`` words of 64 bits with the bit of each row set, as one value."""
    set_bits = table.select(index.cast("bigint").alias("id"), bit.cast("int").alias("_bit"))
    words = set_bits.groupBy("id").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("word"))
    dense = table.sparkSession.range(size).join(words, "id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0)).alias("word"))))
    return dense.agg(F.transform(ordered, lambda w: w["word"]).alias("words")).scalar()


def _has_bit(words: Column, index: Column, bit: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.get(words, index.cast("int")), bit.cast("int")).bitwiseAND(F.lit(1)) == 1


def alias_parts(texts: DataFrame, key: str, shortest: DataFrame, filtered: bool = True) -> DataFrame:
    """Parts of each distinct text that can be an alias: ``key`` and ``alias``.

    A part has a length that an alias of the same two first characters has and,
    if ``filtered``, passes a Bloom filter of all aliases.  Both filters have a
    fixed largest size and never drop an alias.
    """
    stats = shortest.agg(F.collect_set(F.char_length("alias")).alias("lengths"), F.count(F.lit(1)).alias("n")).first()
    texts = texts.select(key).where(F.char_length(key) >= 2).distinct()
    if not stats["n"]:
        return texts.where("false").select(key, F.col(key).alias("alias"))
    begins = F.pmod(F.xxhash64(F.substr("alias", F.lit(1), F.lit(2))), F.lit(BEGINNINGS))
    size = F.char_length(key)
    starts = texts.select(key, F.explode(F.sequence(F.lit(1), size - 1)).alias("_start"))
    lengths = F.array(*[F.lit(n) for n in sorted(stats["lengths"])])
    if filtered:
        known = _words_of_bits(shortest, begins, F.least(F.char_length("alias"), F.lit(63)), BEGINNINGS)
        own = F.pmod(F.xxhash64(F.substr(key, F.col("_start"), F.lit(2))), F.lit(BEGINNINGS))
        starts = starts.withColumn("_lengths", F.get(known, own.cast("int"))).where("_lengths <> 0")
        lengths = F.filter(lengths, lambda n: F.call_function(
            "shiftrightunsigned", F.col("_lengths"), F.least(n, F.lit(63))).bitwiseAND(F.lit(1)) == 1)
    fit = F.filter(lengths, lambda n: F.col("_start") + n - 1 <= F.char_length(key))
    parts = starts.select(key, "_start", F.explode(fit).alias("_length")).select(
        key, F.substr(F.col(key), F.col("_start"), F.col("_length")).alias("alias"))
    if filtered:
        words = 1
        while words < FILTER_WORDS and 64 * words < FILTER_BITS * stats["n"]:
            words *= 2
        at = F.pmod(F.xxhash64("alias"), F.lit(64 * words))
        parts = parts.where(_has_bit(_words_of_bits(shortest, F.floor(at / 64), at % 64, words), F.floor(at / 64), at % 64))
    return parts


def named_products(texts: DataFrame, key: str, shortest: DataFrame, bound: int | None = None) -> DataFrame:
    """Distinct (``key``, ``product``) of texts and the names they name; ``shortest`` is a stored table."""
    filtered = not fits_broadcast(shortest, bound)
    found = join_one(alias_parts(texts, key, shortest, filtered), shortest, "alias", "inner", [key], bound=bound)
    return found.select(key, "product").distinct()


def question_matches(questions: DataFrame, key: str, shortest: DataFrame, bound: int | None = None) -> DataFrame:
    """Per distinct question, how many names it names, and the only one.

    ``shortest`` comes from a stored table, whose size decides how it is joined.
    """
    return named_products(questions, key, shortest, bound).groupBy(key).agg(
        F.count(F.lit(1)).alias("match_count"), F.min("product").alias("matched"))


def phrase_products(phrases: DataFrame, key: str, positions: DataFrame, shortest: DataFrame, bound: int | None = None) -> DataFrame:
    """(``key``, ``_by_phrase``): the one name that a whole phrase is, else the one that it is a part of.

    A phrase that only one name contains holds one of its shortest parts, so
    few names have to be looked at.
    """
    own = phrases.select(key).where(F.col(key).isNotNull()).distinct()
    keys = positions.select("product", F.col("product_key"))
    held = join_one(named_products(own, key, shortest, bound), keys, "product", "inner", [key], bound=bound)
    parts = held.where(F.contains("product_key", F.col(key))).select(key, "product")
    whole = join_one(own.withColumn("product_key", F.col(key)), cut_lineage(_whole_names(positions), "whole"), "product_key", "inner", [key], bound=bound)
    return whole.select(key, "product").unionByName(parts).groupBy(key).agg(F.min("product").alias("_by_phrase"))


def link_texts(texts: DataFrame, workspace: Workspace, bound: int | None = None) -> DataFrame:
    """Adds ``match_count``, ``matched`` and ``own_product``.

    ``texts`` is a stored table with one row per ``text`` and a ``phrase``.  One
    match is the product, several are refused, none falls back to the phrase.
    """
    # Each is used several times below; what is stored has its real size.
    positions = shared_lengths(product_catalog(workspace))
    shortest = cut_lineage(shortest_aliases(positions), "aliases")
    keyed = texts.withColumn("_question", entity_key(F.col("text"))).withColumn("_phrase", entity_key(F.col("phrase")))
    matches = question_matches(keyed, "_question", shortest, bound)
    matched = join_one(keyed, matches, "_question", "left", ["text"], bound=bound)
    index = phrase_products(keyed, "_phrase", positions, shortest, bound)
    with_phrase = join_one(matched, index, "_phrase", "left", ["text"], bound=bound, sketched=keyed)
    count = F.coalesce("match_count", F.lit(0))
    return with_phrase.select(
        *texts.columns,
        count.cast("bigint").alias("match_count"),
        F.when(count == 1, F.col("matched")).alias("matched"),
        F.when(count == 1, F.col("matched")).when(count == 0, F.col("_by_phrase")).alias("own_product"),
    )
