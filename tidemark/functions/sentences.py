"""Sentences by what the corpus itself says of its abbreviations.

The published unsupervised method (Kiss and Strunk, 2006): a word is an
abbreviation if it comes with a period far more often than chance allows, is
short, has periods inside, and hardly ever comes without; two words on both
sides of a period that belong together, and words that often begin sentences,
are told by log-likelihood ratios. All counts are sums over the whole corpus.
The tables that come of them hold all entries: short ones go into the splitting
expression, and where one is longer the ends of sentences meet them by joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.storage import spread, written

# Fixed values of the published method.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Entries of a table that go into an expression at most.
MOST = 5000
_END = r"[.!?]+[\"'”’)\]]*$"
#: Whatever may come between the sign and the end of a token, line separators that aren't white space included.
_MAY_END = r"[.!?][\"'”’)\],;:\x85\u2028\u2029]*$"
_MAY_BREAK = r"([.!?][\"'”’)\]\x85\u2028\u2029]*\s+)(?=\S)"
_MARK = "\u0001"


@dataclass
class Tables:
    """What a ``Model`` lists, as tables: (word), (word, next), (next)."""

    abbreviations: DataFrame
    collocations: DataFrame
    starters: DataFrame


@dataclass
class Model:
    """Abbreviations without their last period, pairs about a period, and words that begin sentences; all in lower case.

    Where there are too many for lists, these are empty and ``tables`` has all.
    """

    abbreviations: list[str] = field(default_factory=list)
    collocations: list[tuple[str, str]] = field(default_factory=list)
    starters: list[str] = field(default_factory=list)
    tables: Tables | None = None


def bare(token: Column) -> Column:
    """A token in lower case without quotes and brackets; a number is one for all."""
    plain = F.regexp_replace(F.lower(F.trim(token)), r"^[\"'“‘(\[]+|[\"'”’)\],;:]+$", "")
    return F.when(plain.rlike(r"^-?[.,]?\d[\d.,-]*$"), F.when(plain.endswith("."), "#number.").otherwise("#number")).otherwise(plain)


def pieces(text: Column) -> Column:
    """Tokens with the white space after them."""
    return F.split(text, r"(?<=\s)(?=\S)")


def _tokens(docs: DataFrame, column: str) -> DataFrame:
    """(token, next): all tokens as they stand, and what follows those that may end a sentence; null after others."""
    parts = F.filter(F.split(F.col(column), r"\s+"), lambda t: t != "")
    rows = docs.where(F.col(column).isNotNull()).select(parts.alias("t"))
    # side by side rather than looked up from inside: an array would be made anew for each token
    pair = F.arrays_zip(F.col("t").alias("token"), F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))).alias("next"))
    each = rows.select(F.explode(pair).alias("p")).select("p.token", "p.next")
    return each.select("token", F.when(F.col("token").rlike(_MAY_END), F.col("next")).alias("next"))


def _surprise(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of k of n at a rate, 0 where a term has no weight."""
    part = lambda times, rate: F.when(times > 0, times * F.ln(F.greatest(rate, F.lit(1e-300)))).otherwise(0.0)
    return part(k, p) + part(n - k, 1 - p)


def ratio(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Twice the log-likelihood ratio of two words together; 0 unless they are together more often than apart."""
    p, p1, p2 = second / total, both / first, F.try_divide(second - both, total - first)
    found = -2 * (_surprise(both, first, p) + _surprise(second - both, total - first, p) - _surprise(both, first, p1) - _surprise(second - both, total - first, p2))
    return F.when(p1 > F.coalesce(p2, F.lit(1.0)), found).otherwise(0.0)


def pair_counts(docs: DataFrame, column: str) -> DataFrame:
    """(token, next, n) over the whole corpus, in bare forms: all that the tables need.

    ``next`` is null after tokens that can't end a sentence, so rows are as many
    as different words and pairs about an end, and only these are made bare.
    """
    raw = _tokens(spread(docs.select(column)), column).groupBy("token", "next").agg(F.count("*").alias("n"))
    plain = raw.select(bare(F.col("token")).alias("token"), bare(F.col("next")).alias("next"), "n").where("token <> ''")
    return written(plain.groupBy("token", "next").agg(F.sum("n").alias("n")))


def word_counts(pairs: DataFrame) -> DataFrame:
    """(word, with_period, without_period, tokens, periods) for words that come with a period; the last two are of the corpus."""
    period = F.col("token").endswith(".") & ~F.col("token").rlike(r"^\.+$")
    words = pairs.select(F.when(period, F.expr("substring(token, 1, length(token) - 1)")).otherwise(F.col("token")).alias("word"), period.alias("p"), "n")
    each = words.groupBy("word").agg(F.sum(F.when(F.col("p"), F.col("n")).otherwise(0)).alias("with_period"), F.sum(F.when(F.col("p"), 0).otherwise(F.col("n"))).alias("without_period"))
    totals = words.agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("p"), F.col("n")).otherwise(0)).alias("periods"))
    return each.where("with_period > 0").join(F.broadcast(totals))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """``counts`` with the score of each word that has a letter; from ``ABBREVIATION`` on it is an abbreviation."""
    k, n = F.col("with_period"), F.col("with_period") + F.col("without_period")
    rate = F.col("periods") / F.col("tokens")
    chance = -2 * (_surprise(k, n, rate) - _surprise(k, n, F.lit(0.99)))
    inside = F.length(F.regexp_replace("word", r"[^.]", ""))
    letters = F.length("word") - inside
    score = chance * F.exp(-letters.cast("double")) * (inside + 1) * F.pow(letters.cast("double"), -F.col("without_period").cast("double"))
    return counts.where(F.col("word").rlike(r"\p{L}")).withColumn("score", score)


def fit(docs: DataFrame, column: str, most: int = MOST) -> Model:
    """All entries of a corpus: as lists if none has over ``most``, else as tables. A corpus without texts gives empty lists."""
    pairs = pair_counts(docs, column)
    abbreviations = written(abbreviation_scores(word_counts(pairs)).where(F.col("score") >= ABBREVIATION).select("word"))
    short = abbreviations.select(F.concat("word", F.lit(".")).alias("token"))
    total = pairs.agg(F.sum("n").alias("total"))
    # what may stand before a period that ends nothing
    initial = F.col("token").rlike(r"^\p{L}\.$") | (F.col("token") == "#number.")
    about = pairs.where(F.col("token").endswith(".") & F.col("next").isNotNull())
    weak = about.join(short.withColumn("_short", F.lit(True)), "token", "left").withColumn("weak", initial | F.coalesce("_short", F.lit(False))).drop("_short")
    firsts = pairs.groupBy("token").agg(F.sum("n").alias("first"))
    plain = lambda c: F.regexp_replace(c, r"[.!?]+$", "")
    seconds = pairs.groupBy(plain(F.col("token")).alias("next")).agg(F.sum("n").alias("second"))
    joined = weak.where("weak").groupBy("token", plain(F.col("next")).alias("next")).agg(F.sum("n").alias("n")).join(firsts, "token").join(seconds, "next").join(F.broadcast(total))
    bound = joined.where("n > 1").withColumn("score", ratio(F.col("n"), F.col("first"), F.col("second"), F.col("total"))).where(F.col("score") >= COLLOCATION)
    together = written(bound.select(F.expr("substring(token, 1, length(token) - 1)").alias("word"), "next"))
    ends = weak.where("not weak").select("next", "n").unionByName(pairs.where(F.col("token").rlike(r"[!?]$") & F.col("next").isNotNull()).select("next", "n"))
    starts = ends.groupBy(plain(F.col("next")).alias("next")).agg(F.sum("n").alias("n")).join(seconds, "next").join(F.broadcast(ends.agg(F.sum("n").alias("first")))).join(F.broadcast(total))
    known = starts.where(F.col("next").rlike(r"^\p{L}")).withColumn("score", ratio(F.col("n"), F.col("first"), F.col("second"), F.col("total"))).where(F.col("score") >= STARTER)
    starters = written(known.select("next"))
    found = [table.limit(most + 1).collect() for table in (abbreviations, together, starters)]
    if any(len(rows) > most for rows in found):
        return Model(tables=Tables(abbreviations, together, starters))
    return Model([r["word"] for r in found[0]], [(r["word"], r["next"]) for r in found[1]], [r["next"] for r in found[2]])


_bound = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  # evaluated once, however often it is used


def _parts(text: Column) -> Column:
    """A text cut wherever a sentence may end: what is judged are these ends, not all tokens."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), _MARK, " ")
    return F.split(F.regexp_replace(whole, _MAY_BREAK, f"$1{_MARK}"), _MARK)


def _ends(text: Column) -> Column:
    """For each part of a text: ``part``, whether its end ``may`` be one and is a ``period``, the ``word`` before it, the ``next`` word and whether that is ``small``."""
    trimmed = lambda c: F.regexp_replace(c, r"\s+$", "")

    def about(pair: Column) -> Column:
        """A part with the token at its end and what follows it."""
        after = F.split(F.coalesce(pair["after"], F.lit("")), r"(?<=\s)(?=\S)", 2)[0]
        return F.struct(pair["part"].alias("part"), trimmed(F.element_at(pieces(pair["part"]), -1)).alias("token"), trimmed(after).alias("after"))

    def words(row: Column) -> Column:
        open_ = F.regexp_replace(row["token"], r"[\"'”’)\]]+$", "")
        return F.struct(
            row["part"].alias("part"),
            row["token"].rlike(_END).alias("may"),
            open_.endswith(".").alias("period"),
            F.regexp_replace(bare(open_), r"\.$", "").alias("word"),
            F.regexp_replace(bare(row["after"]), r"[.!?]+$", "").alias("next"),
            row["after"].rlike(r"^[\"'(\[“‘]*\p{Ll}").alias("small"),
        )

    both = _bound(_parts(text), lambda p: F.arrays_zip(p.alias("part"), F.slice(p, 2, F.greatest(F.size(p), F.lit(1))).alias("after")))
    return F.transform(F.transform(both, about), words)


def _is_end(row: Column, short: Column, together: Column, starter: Column) -> Column:
    """Whether a sentence ends, by what the tables say of the end."""
    word, small = row["word"], row["small"]
    begins = starter & ~small
    held = (short | word.rlike(r"^\p{L}$")) & ~begins
    held = held | (together & ~begins) | ((word.rlike(r"\.$|^$") | (word == "#number")) & small)
    return row["may"] & F.when(row["period"], ~held).otherwise(True)


def _cut(marked: Column, min_length: int, most: int) -> Column:
    """Parts, some of them with a mark at their end, as sentences."""
    found = F.transform(F.split(F.array_join(marked, ""), _MARK), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.slice(F.filter(found, lambda s: F.length(s) >= min_length), 1, most)


def split(text: Column, model: Model, min_length: int = 20, most: int = 400) -> Column:
    """The sentences of a text, trimmed; short ones go, and only the first ``most`` stay. A null text has none.

    A period after an abbreviation, an initial, or between words that belong
    together ends nothing, unless a word follows that begins sentences; nor
    does one after a number, or several, before a small letter.
    """
    if model.tables:
        raise ValueError("the tables are too long for an expression: use with_sentences")
    in_ = lambda c, table: c.isin(table) if table else F.lit(False)
    pairs = [f"{a} {b}" for a, b in model.collocations]

    def marked(row: Column) -> Column:
        word, after = row["word"], row["next"]
        ends = _is_end(row, in_(word, model.abbreviations), in_(F.concat(word, F.lit(" "), after), pairs), in_(after, model.starters))
        return F.when(ends, F.concat(row["part"], F.lit(_MARK))).otherwise(row["part"])

    return _cut(F.transform(_ends(text), marked), min_length, most)


def with_sentences(docs: DataFrame, column: str, model: Model, min_length: int = 20, most: int = 400) -> DataFrame:
    """``docs`` with ``sentences``, as ``split`` gives them, whatever the size of the tables.

    Long tables are joined to the periods that may be ends, without the texts;
    a document's verdicts then go back to it by a number that it is given.
    """
    if not model.tables:
        return docs.withColumn("sentences", split(F.col(column), model, min_length, most))
    numbered = written(docs.withColumn("_row", F.monotonically_increasing_id()))
    ends = numbered.select("_row", F.posexplode(_ends(F.col(column))).alias("_at", "_e")).select("_row", "_at", *[f"_e.{c}" for c in ("may", "period", "word", "next", "small")])
    known = lambda table, name: table.withColumn(name, F.lit(True))
    open_ = ends.where("may and period").join(known(model.tables.abbreviations, "_short"), "word", "left")
    open_ = open_.join(known(model.tables.collocations, "_both"), ["word", "next"], "left").join(known(model.tables.starters, "_starts"), "next", "left")
    told = [F.coalesce(c, F.lit(False)) for c in ("_short", "_both", "_starts")]
    row = F.struct("may", "period", "word", "next", "small")
    judged = open_.select("_row", "_at", _is_end(row, *told).alias("_end")).unionByName(ends.where("not (may and period)").select("_row", "_at", F.col("may").alias("_end")))
    verdicts = judged.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "_end"))).alias("_verdicts"))
    each = F.arrays_zip(_parts(F.col(column)).alias("part"), F.col("_verdicts").alias("verdict"))
    marked = F.transform(each, lambda e: F.when(e["verdict"]["_end"], F.concat(e["part"], F.lit(_MARK))).otherwise(e["part"]))
    return numbered.join(verdicts, "_row").withColumn("sentences", _cut(marked, min_length, most)).drop("_row", "_verdicts")
