"""Quality rules by weak supervision.

Each rule votes good, bad or abstains on a document. Expectation-maximisation over the counts of vote patterns
estimates how each rule votes on good and on bad documents and how common good ones are; a document is kept when its
posterior probability of being good is at least one half. Everything is DataFrame operations: the text is read once,
inside one row, without a shuffle; the vote patterns (at most 3 to the number of rules) are counted over all
documents, and each round of the estimation is one small aggregation over them.

Null, empty or word-less texts have no words, fail the base rules and are not kept. Repeated rows are separate
documents and get the same verdict. Texts of any length are measured whole. An empty table gives an empty result. Other
columns are ignored by ``judge``, and carried by ``keep_good`` whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.llm.common import SPACE_CHARS, UPPER, bound, computed, words_of
from shopgrain.session import materialize

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

GOOD, BAD, ABSTAIN = 1, -1, 0


@dataclass(frozen=True)
class Rule:
    """Votes on ``top / bottom``: good and bad are conditions on that ratio in SQL, abstaining between them."""

    name: str
    ratio: str
    good: str
    bad: str

    def sql(self) -> str:
        return (
            f"case when {self.good.format(x=self.ratio)} then {GOOD} when {self.bad.format(x=self.ratio)} then {BAD} "
            f"else {ABSTAIN} end"
        )


# Common short words of English, French, German and Spanish.
FUNCTION_WORDS = tuple(
    "a and as be by der des die du el en et for from in is it la las le les los of on para por que se the to un und "
    "une von was with y zu".split()
)
NEVER = "{x} < 0"

# Ratios are of counts that every document has; the text is standard SQL, so the twin query shares it. Most rules only
# know junk and abstain otherwise.
RULES = (
    Rule("symbols", "(n_symbols * 1e0 / greatest(word_chars, 1))", NEVER, "{x} >= 0.05"),
    Rule("exclamations", "(n_exclamations * 1e0 / greatest(n_words, 1))", NEVER, "{x} >= 0.3"),
    Rule("capitals", "(n_capitals * 1e0 / greatest(word_chars, 1))", NEVER, "{x} >= 0.4"),
    Rule("variety", "(n_distinct * 1e0 / greatest(n_words, 1))", NEVER, "{x} <= 0.3"),
    Rule("lines", "(n_dup_lines * 1e0 / greatest(n_lines, 1))", NEVER, "{x} >= 0.5"),
    Rule("windows", "(n_repeat_words * 1e0 / greatest(n_words, 1))", NEVER, "{x} >= 0.2"),
    Rule("word_length", "(word_chars * 1e0 / greatest(n_words, 1))", NEVER, "{x} < 2 or {x} > 15"),
    Rule("function_words", "(n_function_words * 1e0 / greatest(n_words, 1))", "{x} >= 0.04", "{x} <= 0.004 and n_words >= 40"),
)


def repeated_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs at least twice, from the hashes of all windows in order."""

    def covered(ordered: Column) -> Column:
        last = F.size(ordered)
        starts = F.transform(ordered, lambda x, k: F.when(
            (F.get(ordered, k - 1)["h"] == x["h"]) | ((k + 1 < last) & (F.get(ordered, k + 1)["h"] == x["h"])), x["i"]
        ))
        return F.aggregate(
            F.sort_array(F.filter(starts, lambda i: i.isNotNull())),
            F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n")),
            lambda acc, i: F.struct(
                (i + WINDOW - 1).alias("end"),
                (acc["n"] + F.least(F.lit(WINDOW), i + WINDOW - 1 - acc["end"])).alias("n"),
            ),
            lambda acc: acc["n"],
        )

    paired = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    # Most texts repeat no window; only the others are sorted.
    return (
        F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0))
        .otherwise(bound(F.sort_array(paired), covered))
    )


def window_hashes(words: Column) -> Column:
    """A hash of each window of eight words, by three doublings: of two, of four and of eight."""

    def doubled(hashes: Column, width: int) -> Column:
        return F.zip_with(hashes, F.slice(hashes, width + 1, F.size(hashes)), lambda x, y: F.xxhash64(x, y))

    single = F.transform(words, lambda w: F.xxhash64(w))
    windows = bound(single, lambda x: bound(doubled(x, 1), lambda y: bound(doubled(y, 2), lambda z: doubled(z, 4))))
    whole = F.size(words) - WINDOW + 1
    return F.when(whole > 1, F.slice(windows, 1, whole)).otherwise(F.array().cast("array<bigint>"))


def without(text: Column, characters: str) -> Column:
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def number_of(characters: str) -> Column:
    return F.length("text") - F.length(without(F.col("text"), characters))


def measure(documents: DataFrame) -> DataFrame:
    """The counts that the rules read, and the document itself in ``row``."""
    df = documents.select(F.struct(*documents.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    df = computed(df, words=words_of(F.col("text")))
    df = computed(
        df,
        lines=F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        hashes=window_hashes(F.col("words")),
    )
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(without(F.col("text"), SPACE_CHARS)),
        "n_symbols": number_of(SYMBOLS),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_words(F.col("hashes")),
        "n_lines": F.size("lines"),
        "n_distinct": F.size(F.array_distinct("words")),
        "n_exclamations": number_of("!"),
        "n_capitals": number_of(UPPER),
        "n_function_words": F.size(F.filter("words", lambda w: w.isin(*FUNCTION_WORDS))),
    }
    measured = computed(df, **{name: count.cast("long") for name, count in counts.items()})
    return measured.select("row", *counts)


def vote(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return measured.withColumns({
        "base_failed": failed, **{f"v_{rule.name}": F.expr(rule.sql()) for rule in rules},
    })


@dataclass
class VoteModel:
    """Share of good documents, and for each rule the probability of each vote on good and on bad documents."""

    good_share: float
    votes: dict[str, dict[int, tuple[float, float]]]

    def log_odds(self) -> Column:
        """The weights stand in one array, so that the generated code is the same in every round."""
        weights = [math.log(self.good_share) - math.log(1 - self.good_share)]
        for table in self.votes.values():
            weights += [math.log(table[v][0]) - math.log(table[v][1]) for v in (BAD, ABSTAIN, GOOD)]
        array = F.array(*map(F.lit, weights))
        total = F.get(array, F.lit(0))
        for k, name in enumerate(self.votes):
            total = total + F.get(array, F.col(f"v_{name}") + 3 * k + 2)
        return total

    def posterior(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))


def first_model(rules: tuple[Rule, ...], accuracy: float = 0.8, good_share: float = 0.7) -> VoteModel:
    """Rules are right more often than wrong, which fixes what good means; abstaining says nothing."""
    right, wrong = accuracy * 2 / 3, (1 - accuracy) * 2 / 3
    return VoteModel(good_share, {
        rule.name: {GOOD: (right, wrong), BAD: (wrong, right), ABSTAIN: (1 / 3, 1 / 3)} for rule in rules
    })


def fit(votes: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = 12, smoothing: float = 1.0) -> VoteModel:
    """Expectation-maximisation over counted vote patterns, for a fixed number of rounds.

    ``smoothing`` is added to each count, so that no vote gets probability 0; with no documents the first model stays.
    """
    names = [f"v_{rule.name}" for rule in rules]
    patterns = materialize(votes.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "votes")
    sums_of = [F.expr("sum(n) as n"), F.expr("sum(good) as good")] + [
        F.expr(f"sum(case when v_{r.name} = {v} then {what} else 0 end) as {what}_{r.name}_{v + 1}")
        for r in rules for v in (GOOD, BAD, ABSTAIN) for what in ("good", "n")
    ]
    model = first_model(rules)
    for _ in range(rounds):
        sums = computed(patterns, good=F.col("n") * model.posterior()).agg(*sums_of).first()
        if not sums["n"]:
            break
        bad_total = sums["n"] - sums["good"]
        model = VoteModel(
            (sums["good"] + smoothing) / (sums["n"] + 2 * smoothing),
            {
                r.name: {
                    v: (
                        (sums[f"good_{r.name}_{v + 1}"] + smoothing) / (sums["good"] + 3 * smoothing),
                        (sums[f"n_{r.name}_{v + 1}"] - sums[f"good_{r.name}_{v + 1}"] + smoothing)
                        / (bad_total + 3 * smoothing),
                    )
                    for v in (GOOD, BAD, ABSTAIN)
                }
                for r in rules
            },
        )
    return model


def judge(documents: DataFrame, rules: tuple[Rule, ...] = RULES, least_posterior: float = 0.5) -> DataFrame:
    """Counts, votes, posterior probability of quality and verdict, one row per document.

    The counts and votes are written once to the shared folder, without the texts.
    """
    measured = measure(documents.select("doc_id", "text")).withColumn("doc_id", F.col("row.doc_id")).drop("row")
    votes = materialize(vote(measured, rules), "quality")
    return with_verdict(votes, fit(votes, rules), least_posterior)


def with_verdict(votes: DataFrame, model: VoteModel, least_posterior: float = 0.5) -> DataFrame:
    return (
        votes.withColumn("posterior", model.posterior())
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least_posterior))
    )


def keep_good(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that are kept, with all their columns.

    Each text is measured once: documents and votes are written together, the model is fitted to the votes, and the
    written rows are filtered.
    """
    voted = materialize(vote(measure(documents), rules), "voted")
    return with_verdict(voted, fit(voted, rules), 0.5).where("kept").select("row.*")
