"""Document fingerprints by winnowing, in DataFrame functions only.

A text is a row of elements: its words, but a word of more than 32 characters or with a
character of a script without spaces is one element per character.  Elements are hashed to
numbers below a prime, ``gram`` consecutive ones are one polynomial hash, and of every
``window`` consecutive grams the smallest is kept, the rightmost of equal ones.  Two texts that
share ``gram + window - 1`` elements in a row share a fingerprint.  A shared passage can lose
up to 32 characters at either end, where its words go on differently, and 10 words hold at most
320 characters, so with words by 4 and 8 any passage of 385 characters (white space not
counted) shares one.  Both steps go by doubling: a hash of 2n elements is made of two hashes of
n elements, a minimum over 2n grams of two minima over n, so a text of any length is a few
passes over arrays.

Texts too short for that (``SHORT``) can be told apart by characters, on a scale chosen by the
text; what it is compared with is then put on the same scale.

A gram is one number, its hash in the high and its counted-down position in the low 31 bits.
The smaller number is the smaller hash and, of equal hashes, the one further to the right.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwright.llm.common import broadcast_if_small, stage, texts

GRAM, WINDOW = 4, 8
#: Below so many elements, half a text may be too short for a shared fingerprint.
SHORT = 2 * (GRAM + WINDOW)
#: Gram and window over characters: for short texts, and for those of under ``TINY`` characters.
SHORT_SCALE, TINY_SCALE, TINY = (4, 4), (2, 1), 14
#: A prime below 2^31, so that products of two hashes stay below 2^62; and the base.
PRIME, BASE = 2_147_483_647, 1_000_003
_POSITIONS = (1 << 31) - 1


_SPACE = r"\x20\x09-\x0D"
#: Thai, Lao, Tibetan, Myanmar, Khmer, Han, kana.
_UNSPACED = r"\u0E00-\u109F\u1780-\u17FF\u2E80-\u2FFF\u3005-\u3007\u3040-\u312F\u3400-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}"
CHARACTER = f"[^{_SPACE}]"
ELEMENT = rf"(?:\A|(?<=[{_SPACE}]))[^{_SPACE}{_UNSPACED}]{{1,32}}(?=[{_SPACE}]|\z)|{CHARACTER}"


def elements(text: Column, element: str = ELEMENT) -> Column:
    return F.regexp_extract_all(text, F.lit(element), F.lit(0))


def _has(text: Column, n: int, element: str) -> Column:
    """Whether ``text`` has ``n`` elements; reads no further and never goes back."""
    return text.rlike(rf"\A(?>[{_SPACE}]*+(?>{element})){{{n}}}")


def scale_of(text: Column, short: int = SHORT) -> Column:
    """0: words; 1: short, by characters; 2: under ``TINY`` characters.  Without ``short`` always 0."""
    if not short:
        return F.lit(0)
    return F.when(_has(text, short, ELEMENT), 0).when(_has(text, TINY, CHARACTER), 1).otherwise(2)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _shifted(values: Column, by: int) -> Column:
    """The array from its element ``by`` on."""
    return F.slice(values, F.lit(by + 1), F.greatest(F.size(values), F.lit(1)))


def _gram_hashes(hashes: Column, gram: int) -> Column:
    """Polynomial hashes of ``gram`` consecutive elements; ``gram`` is a power of two."""

    def doubled(values: Column, width: int) -> Column:
        if width == gram:
            return values
        power = F.lit(pow(BASE, width, PRIME))
        return _once(F.zip_with(values, _shifted(values, width), lambda a, b: (a * power + b) % F.lit(PRIME)),
                     lambda wider: doubled(wider, 2 * width))

    return doubled(hashes, 1)


def _window_minima(keys: Column, window: int) -> Column:
    """Minimum of each ``window`` consecutive elements; windows at the end are shorter."""

    def widened(values: Column, width: int) -> Column:
        if width == window:
            return values
        step = min(width, window - width)
        return _once(F.zip_with(values, _shifted(values, step), lambda a, b: F.least(a, b)),
                     lambda wider: widened(wider, width + step))

    return widened(keys, 1)


def fingerprint_entries(text: Column, gram: int = GRAM, window: int = WINDOW, element: str = ELEMENT) -> Column:
    """Array of the kept grams, in text order: ``hash * 2^31 + (2^31 - 1 - position)``.

    A text of fewer elements than a gram is one gram; without elements the array is empty.
    """
    if gram & (gram - 1):
        raise ValueError("gram must be a power of two")

    def grams(hashes: Column) -> Column:
        short = F.transform(F.slice(hashes, 1, 1), lambda _: F.pmod(F.xxhash64(hashes), F.lit(PRIME)))
        whole = F.slice(_gram_hashes(hashes, gram), F.lit(1), F.greatest(F.size(hashes) - (gram - 1), F.lit(0)))
        return F.when(F.size(hashes) >= gram, whole).otherwise(short)

    def minima(keys: Column) -> Column:
        windows = F.greatest(F.size(keys) - (window - 1), F.least(F.size(keys), F.lit(1)))
        return F.array_distinct(F.slice(_window_minima(keys, window), F.lit(1), windows))

    hashes = F.transform(elements(text, element), lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))
    keys = F.transform(_once(hashes, grams), lambda h, at: F.shiftleft(h, 31) + (F.lit(_POSITIONS) - at))
    return _once(keys, minima)


def scaled_entries(text: Column, scale: Column, gram: int = GRAM, window: int = WINDOW, short: int = SHORT) -> Column:
    """``fingerprint_entries`` on the scale that ``scale_of`` gave."""
    on_words = fingerprint_entries(text, gram, window)
    if not short:
        return on_words
    return (F.when(scale == 0, on_words).when(scale == 1, fingerprint_entries(text, *SHORT_SCALE, CHARACTER))
            .otherwise(fingerprint_entries(text, *TINY_SCALE, CHARACTER)))


def entry_hashes(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.shiftright(e, 31).cast("int"))


def entry_positions(entries: Column) -> Column:
    """Number of the element at which a kept gram begins, from 0."""
    return F.transform(entries, lambda e: (F.lit(_POSITIONS) - e.bitwiseAND(_POSITIONS)).cast("int"))


def entries_text(entries: Column) -> Column:
    """``hash:position`` for each kept gram, comma-joined; hash in hexadecimal."""
    return F.array_join(F.transform(entries, lambda e: F.concat(
        F.hex(F.shiftright(e, 31)), F.lit(":"), (F.lit(_POSITIONS) - e.bitwiseAND(_POSITIONS)).cast("string"))), ",")


def likeness(left: Column, right: Column) -> Column:
    """Shared over all different hashes; 1 for two empty fingerprints."""
    both = F.struct(F.array_distinct(left).alias("l"), F.array_distinct(right).alias("r"))
    sizes = _once(both, lambda s: F.struct(
        F.size(F.array_intersect(s.l, s.r)).alias("shared"), (F.size(s.l) + F.size(s.r)).alias("total")))
    return _once(sizes, lambda s: F.when(s.total == 0, F.lit(1.0)).otherwise(s.shared / (s.total - s.shared)))


def fingerprints(df: DataFrame, gram: int = GRAM, window: int = WINDOW, short: int = 0) -> DataFrame:
    """(doc_id, hashes, positions) of every text; a null text counts as empty, equal texts have
    equal fingerprints, repeated rows give a row each, other columns are ignored.  Texts of fewer
    than ``short`` elements go by characters."""
    kept = texts(df).select("doc_id", scaled_entries(F.col("text"), scale_of(F.col("text"), short), gram, window, short).alias("entries"))
    return kept.select("doc_id", entry_hashes(F.col("entries")).alias("hashes"), entry_positions(F.col("entries")).alias("positions"))


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, half, scales, next_id) for each different id: the following one, after the last
    the first.

    Ids are cut into ranges; a row looks ahead inside its range, and one row per range tells
    where the next range begins.
    """
    ids = docs.groupBy("doc_id").agg(F.max("half").alias("half"), F.sort_array(F.collect_set("scale")).alias("scales"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stage(ids.repartitionByRange(parts, "doc_id").withColumn("range", F.spark_partition_id()), "next-ids")
    heads = ranged.groupBy("range").agg(F.min(F.struct("doc_id")).alias("head"))
    around = W.orderBy("range")  # one row per range
    following = heads.select("range", F.coalesce(
        F.lead("head").over(around), F.first("head").over(around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("following"))
    inside = W.partitionBy("range").orderBy("doc_id")
    return (ranged.withColumn("next", F.lead(F.struct("doc_id")).over(inside))
            .join(broadcast_if_small(following, "range-heads"), "range")
            .select("doc_id", "half", "scales", F.coalesce("next", "following").getField("doc_id").alias("next_id")))


def edited_fingerprints(df: DataFrame, gram: int = GRAM, window: int = WINDOW, short: int = 0) -> DataFrame:
    """Fingerprint of each text and of its edit, in which the last half of the code points is
    replaced by the first as many (or all) of the next document's text, by ascending id.

    Rows that share an id each give a row; their successor is the next different id, and where
    that id has several texts the smallest head stands for it.  A null id comes first.  Texts of
    fewer than ``short`` elements go by characters, and so do their edit and successor beside them.
    """
    def entries(text: Column, scale: Column) -> Column:
        return scaled_entries(text, scale, gram, window, short)

    # A struct, so that a null id joins; no further column, so that both joins read one exchange.
    docs, scale = texts(df).select(F.struct("doc_id").alias("key"), "text"), scale_of(F.col("text"), short).alias("scale")
    half = F.floor(F.char_length("text") / 2).cast("int")
    wanted = next_ids(docs.select("key.doc_id", half.alias("half"), scale)).select(
        "half", "scales", F.struct("doc_id").alias("for_key"), F.struct(F.col("next_id").alias("doc_id")).alias("next_key"))
    heads = (docs.join(wanted, F.col("key") == F.col("next_key"))
             .select("for_key", F.struct(F.substring("text", F.lit(1), F.col("half")).alias("head"),
                                        F.transform("scales", lambda scale: entry_hashes(entries(F.col("text"), scale))).alias("hashes"),
                                        "scales").alias("next"))
             .groupBy("for_key").agg(F.min("next").alias("next")))
    n = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.head"), F.lit(1), half))
    joined = (docs.join(heads, F.col("key") == F.col("for_key"))
              .select("key.doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), scale, "next.hashes", "next.scales"))
    made = joined.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
                         F.element_at("hashes", F.array_position("scales", F.col("scale")).cast("int")).alias("next_hashes"),
                         entries(F.col("text"), F.col("scale")).alias("own"), entries(F.col("edited"), F.col("scale")).alias("other"))
    return made.select("doc_id", "n_chars", "edited_sha256", entries_text(F.col("own")).alias("fingerprint"),
                       entries_text(F.col("other")).alias("edited_fingerprint"),
                       likeness(entry_hashes(F.col("own")), entry_hashes(F.col("other"))).alias("near_edited"),
                       likeness(entry_hashes(F.col("own")), F.col("next_hashes")).alias("near_next"))
