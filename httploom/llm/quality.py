"""Quality rules by weak supervision, in DataFrame expressions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of the vote patterns
estimates how reliable each rule is; a document is kept by its posterior probability of being good.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from httploom.functions.text import let
from httploom.session import scratch

WINDOW = 5
GOOD, BAD, ABSTAIN = 1, -1, 0
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, given the hash of the window at each word."""
    by_hash = F.array_sort(F.transform(windows, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))

    def starts(order: Column) -> Column:
        def repeated(entry: Column, k: Column) -> Column:
            same = [F.coalesce(F.get(order, k + step)["h"] == entry["h"], F.lit(False)) for step in (-1, 1)]
            return F.when(same[0] | same[1], entry["at"])

        return F.array_sort(F.filter(F.transform(order, repeated), lambda at: at.isNotNull()))

    def total(at: Column) -> Column:
        new = F.transform(at, lambda a, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - a, F.lit(WINDOW))))
        return F.aggregate(new, F.lit(0), lambda done, n: done + n)

    return let(let(by_hash, starts), total)


def _repeat_words(words: Column) -> Column:
    def windows(hashes: Column) -> Column:
        count = F.size(hashes) - (WINDOW - 1)
        at_each = F.transform(
            F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
        )
        return F.when(count > 1, at_each)

    def count(found: Column) -> Column:
        unique = found.isNull() | (F.size(F.array_distinct(found)) == F.size(found))
        return F.when(unique, F.lit(0)).otherwise(_covered(found))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count)


def measures(text: Column) -> Column:
    """Struct of the counts that the rules judge; null text has none of anything.

    Windows are compared by a 64-bit hash of their words within one document.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, _SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    unspaced = F.length(F.translate(text, " \t\n\x0b\f\r", ""))
    symbols = F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))

    def of_words(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"),
            _repeat_words(ws).cast("long").alias("n_repeat_words"),
        )

    def of_lines(ls: Column) -> Column:
        return F.struct(
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        )

    return F.struct(
        let(words, of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        unspaced.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_calls"),
    )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_calls"]


def measured(docs: DataFrame, text_col: str, into: str) -> DataFrame:
    """Rows of ``docs`` with the struct column ``into`` of all ``MEASURES``."""
    raw = f"{into}_raw"
    flat = F.struct(
        *[
            F.col(f"{raw}.{group}{name}").alias(name)
            for name in MEASURES
            for group in ["w." if name in ("n_words", "n_distinct", "n_repeat_words") else "l." if name in ("n_lines", "n_dup_lines") else ""]
        ]
    )
    return docs.withColumn(raw, measures(F.col(text_col))).withColumn(into, flat).drop(raw)


# The rules are made so that they call at most this share of good documents bad. Without such a bound two classes of
# equal standing would be fitted, and the rarer kinds of junk would fall to the class of the good documents.
FALSE_ALARMS = 0.001


def rules(m: Callable[[str], Column]) -> dict[str, Column]:
    """Vote of each rule on the measures ``m(name)``; documents without words get no vote but ``length``'s."""
    n = m("n_words")

    def vote(good: Column, bad: Column) -> Column:
        return F.when((n > 0) & bad, F.lit(BAD)).when((n > 0) & good, F.lit(GOOD)).otherwise(F.lit(ABSTAIN))

    def by_share(name: str, of: str, good: float, bad: float) -> Column:
        """Good up to one share of ``of``, bad beyond another; products, so that nothing is divided by 0."""
        return vote(m(name) <= good * m(of), m(name) > bad * m(of))

    return {
        "length": F.when(n < 10, F.lit(BAD)).when(n >= 50, F.lit(GOOD)).otherwise(F.lit(ABSTAIN)),
        "word_length": vote((m("word_chars") >= 3 * n) & (m("word_chars") <= 10 * n), (m("word_chars") < 2 * n) | (m("word_chars") > 15 * n)),
        "symbols": by_share("n_symbols", "n_words", 0.02, 0.1),
        "dup_lines": by_share("n_dup_lines", "n_lines", 0.0, 0.5),
        "repeats": by_share("n_repeat_words", "n_words", 0.02, 0.2),
        "capitals": by_share("n_capitals", "word_chars", 0.1, 0.3),
        "calls": by_share("n_calls", "n_words", 0.02, 0.1),
        "variety": vote(m("n_distinct") >= 4 * F.sqrt(n), m("n_distinct") <= 1.5 * F.sqrt(n)),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], steps: int = 100, false_alarms: float = FALSE_ALARMS) -> tuple[float, list[tuple[float, float]]]:
    """Share of good documents and, per rule, its chances to vote good on good and bad on bad documents if it votes.

    ``false_alarms`` bounds the chance of a bad vote on a good document. Otherwise plain
    expectation-maximisation over pattern counts (at most 3 ** rules of them, whatever the corpus); abstentions say nothing. Counts of one on either side keep the chances off 0 and 1.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    # Junk is of many kinds, so each rule is first taken to see a minor part of it.
    prior, chances = 0.9, [(1 - false_alarms, 0.3)] * n_rules
    for _ in range(steps):
        right = [[1.0, 1.0] for _ in range(n_rules)]
        voted = [[2.0, 2.0] for _ in range(n_rules)]
        good_mass = total = 0.0
        for votes, count in patterns:
            good = posterior(votes, prior, chances) * count
            good_mass += good
            total += count
            for r, vote in enumerate(votes):
                if vote != ABSTAIN:
                    right[r][0] += good if vote == GOOD else 0.0
                    right[r][1] += count - good if vote == BAD else 0.0
                    voted[r][0] += good
                    voted[r][1] += count - good
        prior = (good_mass + 1) / (total + 2)
        chances = [(max(right[r][0] / voted[r][0], 1 - false_alarms), right[r][1] / voted[r][1]) for r in range(n_rules)]
    return prior, chances


def posterior(votes: tuple[int, ...], prior: float, chances: list[tuple[float, float]]) -> float:
    odds = math.log(prior) - math.log1p(-prior)
    for vote, weights in zip(votes, vote_weights(chances)):
        odds += weights[0] if vote == GOOD else weights[1] if vote == BAD else 0.0
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def vote_weights(chances: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Log odds that a good vote and a bad vote of each rule add."""
    return [(math.log(g) - math.log1p(-b), math.log1p(-g) - math.log(b)) for g, b in chances]


def with_verdicts(measured_rows: DataFrame, threshold: float, into: str) -> DataFrame:
    """Fit the rules on the struct ``into`` of all rows and add ``base_failed``, ``p_good`` and ``kept`` to it."""

    def m(name: str) -> Column:
        return F.col(f"{into}.{name}")

    votes = rules(m)
    code = reduce(lambda code, vote: code * 3 + vote + 1, votes.values(), F.lit(0))
    counts = measured_rows.select(code.alias("code")).groupBy("code").count().collect()
    digits = lambda code: tuple(code // 3 ** (len(votes) - 1 - r) % 3 - 1 for r in range(len(votes)))
    prior, chances = estimate(sorted((digits(row["code"]), row["count"]) for row in counts))
    odds = F.lit(math.log(prior) - math.log1p(-prior))
    for vote, (good, bad) in zip(votes.values(), vote_weights(chances)):
        odds = odds + F.when(vote == GOOD, F.lit(good)).when(vote == BAD, F.lit(bad)).otherwise(F.lit(0.0))
    failed = (m("n_words") < 10) | (100 * m("n_repeat_words") > 20 * m("n_words"))
    scored = F.col(into).withField("base_failed", failed).withField("p_good", 1 / (1 + F.exp(-odds)))
    kept = ~m("base_failed") & (m("p_good") >= threshold)
    return measured_rows.withColumn(into, scored).withColumn(into, F.col(into).withField("kept", kept))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def judged(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, into: str = "_quality") -> DataFrame:
    """Rows of ``docs`` with a struct column ``into``: measures, ``base_failed``, ``p_good`` and ``kept``.

    ``base_failed``: under 10 words, or over 20 % of the words in repeated windows. ``p_good`` is the posterior of
    the rule votes, ``kept`` is false for failed documents and ``p_good >= threshold`` for others.

    Rows and measures are written once to a table below the shared root, so that filters on the verdict read measures
    and do not compute them; nothing is shuffled but one row per vote pattern and task. Null text counts as empty and
    fails; repeated rows are judged alike; an empty table gives no rows; a column of ``docs`` named like ``into`` or
    ``into`` + ``_raw`` is replaced.
    """
    return with_verdicts(_stored(measured(docs, text_col, into), "judged"), threshold, into)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``(id, measures ..., base_failed, p_good, kept)`` per document row, as ``judged`` gives them; only ids and
    measures are written in between. Null ids stay; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    narrow = _stored(measured(rows, "text", "m").select("id", "m"), "measures")
    return with_verdicts(narrow, threshold, "m").select(F.col("id").alias(id_col), "m.*")
