"""Problem 5: free-entered values mapped to a canonical list, with at most two slips.

A slip is a letter or digit missing, added, replaced or swapped with its neighbour. Pigeonhole: a
listed form is cut into three segments; two slips spoil at most two of them, so the third stands
unchanged in the typed form, moved by at most two places. Only a swap across a cut can spoil two
segments at once, so each form is cut in three ways whose cuts are all at different places: two slips
touch at most two places, hence at least one way of cutting has no slip across a cut. The segments are
joined by equality on (length of the typed form, place, segment), verified with levenshtein, and
what has no match is reported through an anti-join. All of it is SQL expressions, but for the texts
that one_form leaves to Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.forms import caseless, one_form
from millrace.session import ensure_checkpoints

#: Most index rows that are broadcast; a longer list is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: (difference in length, shift of a whole segment) that two slips allow.
MOVES = [(d, s) for d in range(-2, 3) for s in range(-2, 3) if abs(s) + abs(d - s) <= 2]


def letters(form: Column) -> Column:
    """Letters and digits only, without regard to case."""
    return F.regexp_replace(caseless(form), r"[^\p{L}\p{Nd}]+", "")


def listed_forms(listed: DataFrame, key: str, entry: str) -> DataFrame:
    """(key, form): each entry by its letters and digits; entries of two words in both orders."""
    whole = listed.select(F.col(key).alias("key"), F.col(entry).alias("entry")).filter("key is not null and entry is not null").distinct().select("key", one_form(F.col("entry")).alias("whole"))
    words = F.split("whole", " +")
    turned = F.when(F.size(words) == 2, letters(F.concat(words[1], words[0])))
    return whole.select("key", F.explode(F.array_distinct(F.array_compact(F.array(letters(F.col("whole")), turned)))).alias("form")).filter("form <> ''").distinct()


def segment_index(forms: DataFrame, least: int) -> DataFrame:
    """(key, form, size, place, piece): where each segment may stand (from 0) in a typed form of `size` characters, for forms of `least` characters or more."""
    n = F.length("form")
    first, second = (F.floor((F.col("n") + 1) / 3) + F.col("o")).cast("int"), (F.floor((2 * F.col("n") + 2) / 3) + F.col("o")).cast("int")
    segment = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    cut = forms.filter(n >= least).select("key", "form", n.alias("n"), F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("o"))
    cut = cut.select("key", "form", "n", F.explode(F.array(segment(F.lit(0), first), segment(first, second), segment(second, F.col("n")))).alias("s"))
    moves = F.explode(F.array(*[F.struct(F.lit(d).alias("longer"), F.lit(m).alias("shift")) for d, m in MOVES]))
    placed = cut.select("key", "form", (F.col("n")).alias("n"), "s.*", moves.alias("m")).select("*", "m.*").filter("start + shift >= 0 and end + shift <= n + longer")
    parts = placed.select("key", "form", (F.col("n") + F.col("longer")).alias("size"), (F.col("start") + F.col("shift")).alias("place"), F.col("form").substr(F.col("start") + 1, F.col("end") - F.col("start")).alias("piece"))
    return parts.distinct()


def typed_pieces(values: DataFrame, index: DataFrame) -> DataFrame:
    """(typed, size, place, piece): the pieces of each typed form at the places where the index has any for its size.

    Sizes that no entry can have after two slips have no places and give nothing.
    """
    places = index.groupBy("size").agg(F.collect_set(F.struct("place", F.length("piece").alias("width"))).alias("places"))
    spread = values.select("typed", F.length("typed").alias("size")).join(places, "size").select("typed", "size", F.explode("places").alias("p"))
    return spread.select("typed", "size", F.col("p.place").alias("place"), F.col("typed").substr(F.col("p.place") + 1, F.col("p.width")).alias("piece"))


def _swaps(s: Column) -> Column:
    """Every text that one swap of neighbours makes of s."""
    return F.when(
        F.length(s) > 1,
        F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.lit(1)), s.substr(i, F.lit(1)), s.substr(i + 2, F.length(s)))),
    ).otherwise(F.array().cast("array<string>"))


def slips(a: Column, b: Column) -> Column:
    """0, 1 or 2 slips between two texts, null for more: levenshtein plus swaps of neighbours."""
    distance = F.levenshtein(a, b, 4)
    near = lambda x, y: F.exists(_swaps(x), lambda s: F.levenshtein(s, y, 1) >= 0)
    return (
        F.when(distance < 0, None)
        .when(distance <= 1, distance)
        .when(distance == 2, F.when((F.length(a) == F.length(b)) & F.array_contains(_swaps(a), b), 1).otherwise(2))
        .when((distance == 3) & (near(a, b) | near(b, a)), 2)
        .when((F.length(a) == F.length(b)) & F.arrays_overlap(_swaps(a), _swaps(b)), 2)
    )


def map_to_list(df: DataFrame, listed: DataFrame, id: str, text: str, key: str, entry: str, least: int = 8) -> DataFrame:
    """(id, key): the entry each typed value stands for, -1 for none.

    Values that are null, blank or an entry character for character are left out, as are rows with a
    null id; repeated rows give one. Values are compared in one form, by letters and digits, without
    regard to case and to the order of an entry's two words; entries with fewer than `least` letters
    and digits must be met exactly. Of several entries the one with the fewest slips counts, then the
    least key. With an empty list every value is reported with -1.
    """
    spark = df.sparkSession
    ensure_checkpoints(spark)
    rows = df.select(F.col(id).alias("_id"), F.col(text).alias("_text")).filter("_id is not null and _text is not null")
    entries = listed.select(F.col(entry).alias("_text")).filter("_text is not null").distinct()
    # texts are typed again and again: everything is done once per distinct text, and once per distinct run of letters
    odd = rows.select("_text").distinct().join(entries, "_text", "left_anti")
    formed = odd.select("_text", one_form(F.col("_text")).alias("_form")).select("_text", "_form", letters(F.col("_form")).alias("typed"))
    # filtered behind the checkpoint, or the filter would be pushed below distinct and form every row
    texts = formed.checkpoint().filter("_form <> ''").select("_text", "typed")
    # as many tasks as the session says, however few bytes there are: what follows is work per value
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = texts.select("typed").repartition(tasks, "typed").distinct()

    forms = listed_forms(listed, key, entry).checkpoint()
    index = segment_index(forms, least)
    index_rows = forms.count() * 9 * len(MOVES)  # at most
    beside = F.broadcast if index_rows <= BROADCAST_ROWS else lambda df: df
    whole = values.join(beside(forms.groupBy("form").agg(F.min("key").alias("key"))), F.col("typed") == F.col("form")).select("typed", "key")
    slipped = values.join(beside(forms.select("form").distinct()), F.col("typed") == F.col("form"), "left_anti")
    met = typed_pieces(slipped, beside(index)).join(beside(index), ["size", "place", "piece"]).select("typed", "key", "form")
    # a pair can share several pieces and is verified once; with a broadcast index no shuffle is needed for that
    pairs = met.repartition(tasks, "typed").distinct()
    verified = pairs.select("typed", "key", slips(F.col("typed"), F.col("form")).alias("slips")).filter("slips is not null")
    near = verified.groupBy("typed").agg(F.min(F.struct("slips", "key")).alias("m")).select("typed", F.col("m.key").alias("key"))
    meant = whole.unionByName(near).checkpoint()  # read by both joins below
    none = F.lit(-1).cast(dict(listed.dtypes)[key])
    unmatched = texts.join(meant, "typed", "left_anti").select("_text", none.alias("key"))
    named = texts.join(meant, "typed").select("_text", "key").unionByName(unmatched)
    return rows.join(named, "_text").select(F.col("_id").alias(id), F.col("key").alias(key)).distinct()
