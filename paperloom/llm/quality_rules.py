"""Quality rules as weak supervision: rules vote or abstain, and expectation-maximisation weighs what they do.

Every document gets its counts, and each rule votes good (1), bad (-1) or abstains (0) on them. Rules are noisy: one alone is
often wrong. No label is used: the documents are counted by vote pattern, and expectation-maximisation over these patterns
estimates how often each rule does each of the three on good and on bad documents; abstaining is an outcome like the
others. The estimates are those of the largest posterior density, with weak beliefs that tell the two classes apart, so
that density rises in every round, and the rounds end when it no longer does. There are at most 3 to the number of rules
patterns (177147; some hundreds in fact), however many documents there are, so all rounds run over them in one row of one
expression. A document is kept if its posterior probability of being good is at least a half and no base rule fails: a
bad vote can be outvoted, and silence can speak against a document. All of it is DataFrame operations.

Defined results: a null or empty text has no words, fails the base rules and is not kept; very long texts are counted
whole; repeated rows get the same verdict each; a posterior of exactly a half keeps; an empty table gives no rows;
further columns, whatever their names and types, play no part and are kept by keep_good().
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import SPACES, materialise

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital_runs", "n_digit_runs", "n_enders", "n_distinct", "n_symbol_runs", "n_shouts", "n_bars")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rules() -> dict[str, tuple[Column, Column]]:
    """name: (votes good, votes bad); a document of which neither holds gets no vote."""
    n = F.col("n_words")
    per_word = lambda part: _share(part, "n_words")
    symbols, enders, length, variety, copies = _share("n_symbols", "word_chars"), per_word("n_enders"), per_word("word_chars"), per_word("n_distinct"), _share("n_dup_lines", "n_lines")
    return {
        "sentences": (enders.between(0.04, 0.25), (enders < 0.02) | (enders > 0.35)),
        "word_length": (length.between(4.4, 6.2), (length < 4.2) | (length > 7.0)),
        "variety": (variety >= 0.62, (n >= 80) & (variety < 0.52)),
        "symbols": (symbols < 0.005, symbols > 0.04),
        "symbol_runs": (F.col("n_symbol_runs") == 0, per_word("n_symbol_runs") > 0.08),
        "bars": (F.col("n_bars") == 0, per_word("n_bars") > 0.05),
        "shouts": (F.col("n_shouts") == 0, per_word("n_shouts") > 0.08),
        "capitals": (F.col("n_capital_runs") == 0, per_word("n_capital_runs") > 0.02),
        "digits": (per_word("n_digit_runs") < 0.01, per_word("n_digit_runs") > 0.05),
        "repeats": (per_word("n_repeat_words") < 0.01, per_word("n_repeat_words") > 0.05),
        "lines": (F.col("n_dup_lines") == 0, copies > 0.10),
    }


def count_text(docs: DataFrame) -> DataFrame:
    """Add the counts of COUNTS to every row, from its whole text."""
    text = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    words = text.withColumn("_words", F.array_remove(F.split("_text", SPACES), "")).withColumn(
        "_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    some = F.size("_words") >= 3
    hashes = F.when(some, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))))
    windows = words.withColumn("_windows", F.coalesce(hashes, F.array().cast("array<bigint>")))
    # a text in which no window comes twice (most) needs no sort
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = windows.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    again = F.filter("_sorted", lambda x, i: (F.get("_sorted", i - 1)["h"] == x["h"]) | (F.get("_sorted", i + 1)["h"] == x["h"]))
    at = ordered.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["p"])))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("_at", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.regexp_count("_text", F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("_lines"),
        "n_capital_runs": F.regexp_count("_text", F.lit(r"\p{Lu}{3,}")),
        "n_digit_runs": F.regexp_count("_text", F.lit(r"[0-9]+")),
        "n_enders": F.regexp_count("_text", F.lit(r"[.!?](?=\s|$)")),
        "n_distinct": F.size(F.array_distinct("_words")),
        "n_symbol_runs": F.regexp_count("_text", F.lit(r"[#*$%&<>=_~^]{2,}")),
        "n_shouts": F.regexp_count("_text", F.lit(r"[!?]{2,}")),
        "n_bars": F.length("_text") - F.length(F.replace("_text", F.lit("|"))),
    }
    return at.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("_text", "_words", "_lines", "_windows", "_sorted", "_at")


def votes() -> list[Column]:
    return [F.when(bad, -1).when(good, 1).otherwise(0).cast("byte").alias(f"_v_{name}") for name, (good, bad) in rules().items()]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class VoteModel:
    """The share of good documents, how often each rule does what by (rule, vote, class), the log density and the rounds that it took."""

    prior: float
    rates: dict[tuple[str, int, str], float]
    density: float
    rounds: int

    def posterior(self) -> Column:
        """The probability of a good document, from its vote columns; a rule that abstains says something as well."""
        odds = F.lit(log(self.prior) - log(1 - self.prior))
        for name in dict.fromkeys(rule for rule, _, _ in self.rates):
            says = {v: log(self.rates[name, v, "good"]) - log(self.rates[name, v, "bad"]) for v in VOTES}
            odds = odds + F.when(F.col(f"_v_{name}") == 1, says[1]).when(F.col(f"_v_{name}") == -1, says[-1]).otherwise(says[0])
        return 1 / (1 + F.exp(-odds))


VOTES, CLASSES = (1, 0, -1), ("good", "bad")
#: What is believed before any document is seen: the share of good documents, and how often a rule does what on good and on
#: bad ones. A bad document is bad in some way, not in every way.
PRIOR = 0.85
START = {(1, "good"): 0.80, (0, "good"): 0.15, (-1, "good"): 0.05, (1, "bad"): 0.40, (0, "bad"): 0.25, (-1, "bad"): 0.35}
#: Documents that the beliefs count as in each estimate, as a share of all documents and at least; most rounds, and the relative rise of the log density that ends them.
WEIGHT, LEAST_WEIGHT, ROUNDS, RISE = 0.01, 4.0, 300, 1e-10
_NAMES = {way: f"{('none', 'up', 'down')[way[0]]}_{way[1]}" for way in START}


def fit(patterns: DataFrame, names: Sequence[str] | None = None, rounds: int = ROUNDS) -> VoteModel:
    """Expectation-maximisation over counted vote patterns (column ``n`` and a vote column for each name).

    Each round shares every pattern's documents out between the classes by the posterior of all three outcomes, and estimates
    the rates from the shares and the beliefs. A rule that does the same on both classes loses its weight, whatever it was
    thought to be worth. The patterns become one array, and every round is a step of one fold; after the last rise of the
    density the steps leave everything as it is.
    """
    names = list(names or rules())
    cast = F.array(*(F.col(f"_v_{k}").cast("int") for k in names))
    counted = patterns.agg(F.array_sort(F.collect_list(F.struct(cast.alias("votes"), F.col("n").cast("double").alias("n")))).alias("seen"))
    total = F.aggregate("seen", F.lit(0.0), lambda s, x: s + x["n"])
    counted = counted.withColumn("total", total).withColumn("weight", F.greatest(F.lit(LEAST_WEIGHT), F.lit(WEIGHT) * F.col("total")))
    belief = F.struct(*(F.lit(p).alias(_NAMES[way]) for way, p in START.items()))
    start = F.struct(F.lit(PRIOR).alias("prior"), F.array(*[belief] * len(names)).alias("rates"), F.lit(float("-inf")).alias("density"), F.lit(0).alias("rounds"), F.lit(False).alias("done"))
    state = f"struct<prior:double,rates:array<struct<{','.join(f'{n}:double' for n in _NAMES.values())}>>,density:double,rounds:int,done:boolean>"
    share = {"good": F.lit(PRIOR), "bad": F.lit(1 - PRIOR)}

    def likelihood(acc: Column, votes: Column, kind: str) -> Column:
        said = F.zip_with(votes, acc["rates"], lambda v, r: F.log(F.when(v == 1, r[_NAMES[1, kind]]).when(v == -1, r[_NAMES[-1, kind]]).otherwise(r[_NAMES[0, kind]])))
        return F.aggregate(said, F.log(acc["prior"] if kind == "good" else 1 - acc["prior"]), lambda s, x: s + x)

    def named(value: Column, use) -> Column:  # noqa: ANN001
        """use(value), with value computed once: an array of one entry gives it a name."""
        return F.get(F.transform(F.array(value), use), 0)

    def density(acc: Column, shares: Column) -> Column:
        seen = F.aggregate(shares, F.lit(0.0), lambda s, x: s + x["n"] * x["both"])
        believed = F.aggregate(acc["rates"], F.lit(0.0), lambda s, r: s + sum((F.lit(p) * F.log(r[_NAMES[way]]) for way, p in START.items()), F.lit(0.0)))
        return seen + F.col("weight") * (believed + share["good"] * F.log(acc["prior"]) + share["bad"] * F.log(1 - acc["prior"]))

    def estimate(acc: Column, shares: Column) -> Column:
        def sums(kept: Column) -> Column:
            whole = lambda kind: F.aggregate(kept, F.lit(0.0), lambda s, x: s + x[kind])
            of = {kind: whole(kind) for kind in CLASSES}

            def rate(rule: Column, vote: int, kind: str) -> Column:
                did = F.aggregate(kept, F.lit(0.0), lambda s, x: s + F.when(F.get(x["votes"], rule) == vote, x[kind]).otherwise(0.0))
                return (did + F.col("weight") * START[vote, kind]) / (of[kind] + F.col("weight"))

            rates = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.struct(*(rate(k, *way).alias(name) for way, name in _NAMES.items())))
            prior = (of["good"] + F.col("weight") * PRIOR) / (F.col("total") + F.col("weight"))
            now = density(acc, kept)
            over = (acc["rounds"] > 0) & (now - acc["density"] <= RISE * F.abs(now))
            moved = F.struct(prior.alias("prior"), rates.alias("rates"), now.alias("density"), (acc["rounds"] + 1).alias("rounds"), F.lit(False).alias("done"))
            return F.when(over, F.struct(acc["prior"].alias("prior"), acc["rates"].alias("rates"), now.alias("density"), acc["rounds"].alias("rounds"), F.lit(True).alias("done"))).otherwise(moved)

        return named(shares, sums)

    def step(acc: Column, _: Column) -> Column:
        each = F.transform("seen", lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), likelihood(acc, x["votes"], "good").alias("g"), likelihood(acc, x["votes"], "bad").alias("b")))
        both = F.transform(each, lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), x["g"].alias("g"), (F.greatest(x["g"], x["b"]) + F.log1p(F.exp(-F.abs(x["g"] - x["b"])))).alias("both")))
        shares = F.transform(both, lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), x["both"].alias("both"), (x["n"] * F.exp(x["g"] - x["both"])).alias("good"), (x["n"] * -F.expm1(x["g"] - x["both"])).alias("bad")))
        return F.when(acc["done"], acc).otherwise(estimate(acc, shares)).cast(state)

    fitted = counted.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start.cast(state), step).alias("m")).select("m.*").first()
    return VoteModel(fitted["prior"], {(k, *way): r[name] for k, r in zip(names, fitted["rates"]) for way, name in _NAMES.items()}, fitted["density"], fitted["rounds"])


def _patterns(counted: DataFrame) -> DataFrame:
    voted = counted.select(*votes())
    return materialise(voted.groupBy(*voted.columns).agg(F.count("*").alias("n")), "votes")


def quality_digest(docs: DataFrame) -> DataFrame:
    """The counts and the verdict on every document; texts are read once and not shuffled."""
    slim = docs.select("doc_id", "text")
    counted = materialise(count_text(slim).drop("text"), "counts")
    model = fit(_patterns(counted))
    judged = counted.withColumn("base_failed", base_failed()).select("*", *votes()).withColumn("quality", model.posterior())
    kept = ~F.col("base_failed") & (F.col("quality") >= 0.5)
    return judged.select("doc_id", *COUNTS[:5], "base_failed", kept.alias("kept"), "quality")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns. Rows are written once with their votes, so texts are counted once."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    judged = materialise(count_text(rows).withColumn("failed", base_failed()).select("row", "failed", *votes()), "judged")
    names = [f"_v_{k}" for k in rules()]
    model = fit(materialise(judged.groupBy(*names).agg(F.count("*").alias("n")), "votes"))
    return judged.where(~F.col("failed") & (model.posterior() >= 0.5)).select("row.*")
