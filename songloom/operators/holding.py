"""Which texts hold which terms as a substring, by way of the pieces of a text that can hold a term.

Words are what blanks separate. A term of one word lies inside a word of the text, a term of two words inside two neighbouring
words, the end of the first and the beginning of the second. Words and neighbours are few against texts, and a text that
repeats them adds nothing, so terms are looked up among the different ones. A word is looked up by the rarest character
sequence of the term, counted over all words; neighbours by the last characters of the one and the first of the other. A longer
term holds its inner words whole, and texts are looked up by the rarest of them. Whatever is met is tested on the whole term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.operators.equijoin import splittable_join
from songloom.session import stored

#: Lengths of the character sequences that words are looked up by; a term has those of the greatest length that fits it.
LENGTHS = (1, 2, 3, 6)
#: Numbers of characters at the seam of two neighbouring words.
SEAMS = (0, 1, 2, 4)

# Kinds of pieces.
WORD, NEIGHBOURS, BLANKS, WHOLE = range(4)


def _tokens(column: str) -> Column:
    return F.split(column, " ")


def _fitting(lengths: tuple[int, ...], size: Column) -> Column:
    """The greatest of ``lengths`` that is not above ``size``."""
    return F.array_max(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= size))


def _sequences(text: Column, length: Column) -> Column:
    """Different character sequences of that length."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - length + 1))
    return F.array_distinct(F.filter(F.transform(places, lambda i: F.substring(text, i, length)), lambda g: F.length(g) == length))


def pieces(texts: DataFrame) -> DataFrame:
    """All columns with a row per piece of ``text``: ``kind, piece``."""
    tokens = _tokens("text")
    beside = F.when(
        F.size(tokens) > 1,
        F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat(F.get(tokens, i - 1), F.lit(" "), F.get(tokens, i))),
    ).otherwise(F.array().cast("array<string>"))
    runs = F.regexp_extract_all("text", F.lit("( +)"), F.lit(1))
    blanks = F.sequence(F.lit(0), F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)))
    of_kind = lambda kind, parts: F.transform(F.array_distinct(parts), lambda p: F.struct(F.lit(kind).alias("kind"), p.cast("string").alias("piece")))
    held = F.concat(of_kind(WORD, tokens), of_kind(NEIGHBOURS, beside), of_kind(BLANKS, blanks), of_kind(WHOLE, F.array("text")))
    return texts.select("*", F.explode(held).alias("_piece")).select(*texts.columns, "_piece.kind", "_piece.piece")


def _by_rarest_sequence(terms: DataFrame, words: DataFrame) -> DataFrame:
    """Words that hold a term of one word. A term with a sequence that no word has is in none."""
    every = F.flatten(F.array(*[_sequences(F.col("piece"), F.lit(n)) for n in LENGTHS]))
    offered = words.select("piece", F.explode(every).alias("sequence"))
    frequency = offered.groupBy("sequence").agg(F.count("*").alias("n"))
    asked = terms.select("term", F.explode(_sequences(F.col("term"), _fitting(LENGTHS, F.length("term")))).alias("sequence"))
    counted = splittable_join(asked, frequency, ["sequence"], "left")
    rarest = counted.groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sequence")).alias("least"))
    rarest = rarest.where("least.n > 0").select("term", F.col("least.sequence").alias("sequence"))
    return splittable_join(offered, rarest, ["sequence"]).where(F.contains("piece", "term")).select("term", "piece")


def _by_seam(terms: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Neighbours that hold a term of two words, by the characters on both sides of the blank."""
    end, begin = F.get(_tokens("term"), F.lit(0)), F.get(_tokens("term"), F.lit(1))
    seam = lambda left, right, i, j: F.concat(F.right(left, i), F.lit(" "), F.left(right, j))
    asked = terms.select("term", seam(end, begin, _fitting(SEAMS, F.length(end)), _fitting(SEAMS, F.length(begin))).alias("seam"))
    first, second = F.get(_tokens("piece"), F.lit(0)), F.get(_tokens("piece"), F.lit(1))
    seams = F.array_distinct(F.array(*[seam(first, second, F.lit(i), F.lit(j)) for i in SEAMS for j in SEAMS]))
    offered = neighbours.select("piece", F.explode(seams).alias("seam"))
    return splittable_join(offered, asked, ["seam"]).where(F.contains("piece", "term")).select("term", "piece")


def _by_inner_word(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts that hold a term of three words or more, by the rarest of its inner words."""
    inner = terms.select("term", F.explode(F.array_distinct(F.slice(_tokens("term"), 2, F.size(_tokens("term")) - 2))).alias("word"))
    offered = texts.select("piece", F.explode(F.array_distinct(_tokens("piece"))).alias("word"))
    frequency = offered.groupBy("word").agg(F.count("*").alias("n"))
    counted = splittable_join(inner, frequency, ["word"], "left")
    rarest = counted.groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("least"))
    rarest = rarest.where("least.n > 0").select("term", F.col("least.word").alias("word"))
    return splittable_join(offered, rarest, ["word"]).where(F.contains("piece", "term")).select("term", "piece")


def met(terms: DataFrame, held: DataFrame) -> DataFrame:
    """Which pieces show which different non-null ``term``: ``kind, piece, term``.

    A text holds the term if and only if it has one of the term's pieces. A term without any character is in
    every text, one of blanks alone in the texts with as many in a row.
    """
    of_kind = lambda kind: held.where(F.col("kind") == kind).select("piece").distinct()
    spoken, count = F.trim("term") != "", F.size(_tokens("term"))
    found = {
        WORD: _by_rarest_sequence(terms.where(spoken & (count == 1)), of_kind(WORD)),
        NEIGHBOURS: _by_seam(terms.where(spoken & (count == 2)), of_kind(NEIGHBOURS)),
        BLANKS: terms.where(~spoken).select("term", F.length("term").cast("string").alias("piece")),
        WHOLE: _by_inner_word(terms.where(spoken & (count > 2)), of_kind(WHOLE)),
    }
    out = None
    for kind, pairs in found.items():
        rows = pairs.select(F.lit(kind).alias("kind"), "piece", "term")
        out = rows if out is None else out.unionByName(rows)
    return out


def holders(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``term, text`` with the term in the text, for different non-null ``term`` and ``text``."""
    held = stored(pieces(texts.select("text")), "pieces")
    return splittable_join(held, met(terms, held), ["kind", "piece"]).select("term", "text").distinct()


def first_holders(terms: DataFrame, rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """``term``, ``keys`` and the least ``place`` of the rows whose ``text`` holds the term.

    Rows are combined per piece before they meet terms: a term that most texts hold meets each different piece once, and
    never the texts. Equal texts are one before that, and shuffled for it, so that taking texts apart is never left to the few tasks of a
    small scan.
    """
    different = rows.where("text is not null").groupBy("text", *keys).agg(F.min(place).alias(place))
    held = pieces(different).groupBy("kind", "piece", *keys).agg(F.min(place).alias(place))
    held = stored(held, "pieces")
    found = splittable_join(held, met(terms, held), ["kind", "piece"])
    return found.groupBy("term", *keys).agg(F.min(place).alias(place))
