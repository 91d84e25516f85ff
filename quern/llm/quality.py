"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (0) or abstain (2) on each text. Expectation
maximisation over the counts of vote patterns estimates the share of good documents and each
labeller's rates of votes on good and on bad ones; each pattern then has a posterior.
A linear scorer over hashed word shapes (single and adjacent ones, as shares of the text's
shapes) is trained on the posteriors by logistic regression, and scores every document.

Scale: votes are counted by pattern on the executors, at most 3 ** 9 rows reach the driver. The
scorer is fitted on about ``max_train_docs`` distinct texts, chosen by a hash at a rate that follows
the (approximate, distributed) number of distinct texts, as hashed counts of at most ``SLOTS`` each. Votes, shapes and scores are column expressions in one narrow
pass, with no shuffle.

Defined cases: null, empty and blank texts have score 0 and are not kept; all else is scored,
one-word texts included. Without any training text nothing is learned and every text that is
not blank has score 0.5 and is kept. Extra columns are not read; repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut_lineage

GOOD, BAD, ABSTAIN = 1, 0, 2
SLOTS = 4096
SEED = 7
#: Added to the number of slots that a text's counts are divided by: short texts stay near the bias.
PRIOR_SLOTS = 40

#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "are", "by", "this", "be", "from", "at", "an", "or",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "pour", "dans", "par", "sur", "au", "avec", "est",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "für",
    "el", "los", "las", "y", "del", "se", "por", "con", "no", "una", "para", "su", "al", "lo", "como",
]


LABELLERS = ("symbols", "capitals", "exclamations", "bars", "repeats", "variety", "adjacent_variety", "clean_words", "function_words")


def has_text(text: Column) -> Column:
    """Whether there is anything but white space."""
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def with_votes(rows: DataFrame, text_col: str, out: str = "votes") -> DataFrame:
    """``rows`` and the labellers' votes, as one number in base 3, first labeller least.

    Each known defect (symbols in words, shouting, tables, repetition) is seen by several
    labellers. What they measure is computed once, in projections of its own.
    """
    text, names = F.col(text_col), rows.columns
    rows = rows.select("*", F.split(F.trim(text), r"\s+").alias("__q_tokens"), F.regexp_replace(text, r"[^!|#*$%&@^~{}<>=\\]+", "").alias("__q_marks"))
    tokens = F.col("__q_tokens")
    bare = F.filter(F.regexp_extract_all(text, F.lit(r"(?<!\S)(\p{L}\p{Ll}*|\p{N}+)[.,;:?]?(?!\S)"), F.lit(1)), lambda w: w != "")
    measured = {
        "words": F.size(tokens),
        "letters": F.length(F.regexp_replace(text, r"[^\p{L}]+", "")),
        "capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")),
        "repeats": F.regexp_count(text, F.lit(r"(?<!\S)(\S+)(?=\s+\1(?!\S))")),
        "distinct": F.size(F.array_distinct(tokens)),
        "distinct_pairs": F.size(F.array_distinct(F.zip_with(tokens, F.slice(tokens, 2, F.size(tokens)), lambda a, b: F.xxhash64(a, b)))),
        "bare": bare,
    }
    rows = rows.select(*names, "__q_marks", *[v.alias(f"__q_{k}") for k, v in measured.items()])
    m = {k: F.col(f"__q_{k}") for k in (*measured, "marks")}
    words = F.greatest(m["words"], F.lit(1))
    known = F.size(F.filter(m["bare"], lambda w: w.isin([*FUNCTION_WORDS, *(w.capitalize() for w in FUNCTION_WORDS)])))
    exclamations, bars = (F.length(m["marks"]) - F.length(F.replace(m["marks"], F.lit(c), F.lit(""))) for c in "!|")

    def vote(share: Column, bad: float, good: float | None = None, least: int = 3) -> Column:
        """Bad beyond ``bad``; good on the other side of ``good``, if there is such a vote."""
        low = good is not None and bad < good
        out = F.when(m["words"] < least, ABSTAIN).when(share <= bad if low else share >= bad, BAD)
        return (out if good is None else out.when(share >= good if low else share <= good, GOOD)).otherwise(ABSTAIN)

    repeats = m["repeats"] / words
    running = lambda v: F.when(repeats >= 0.1, ABSTAIN).otherwise(v)  # noqa: E731  a text that repeats itself says nothing here
    votes = (
        vote((F.length(m["marks"]) - exclamations - bars) / words, 0.1),
        vote(m["capitals"] / F.greatest(m["letters"], F.lit(1)), 0.2, None, 8),
        vote(exclamations / words, 0.1),
        vote(bars / words, 0.05),
        vote(repeats, 0.1, None, 8),
        vote(m["distinct"] / F.sqrt(words), 2.5, 3.5, 20),
        vote(m["distinct_pairs"] / words, 0.4, 0.7, 12),
        running(vote(F.size(m["bare"]) / words, 0.7, 0.95, 8)),
        running(vote(known / words, 0.08, 0.18, 12)),
    )
    number = F.lit(0)
    for i, v in enumerate(votes):
        number = number + v * 3**i
    names = rows.columns
    return rows.select(*names, number.cast("int").alias(out))


@dataclass
class LabelModel:
    names: list[str]
    prior: float  # share of good documents
    rates: np.ndarray  # (2 classes, labellers, 3 votes): P(vote | class)

    def accuracies(self) -> dict[str, float]:
        """Of each labeller, how often its votes are right, where it votes."""
        share = np.array([1 - self.prior, self.prior])
        right = share[0] * self.rates[0, :, BAD] + share[1] * self.rates[1, :, GOOD]
        return dict(zip(self.names, right / (share @ (self.rates[:, :, BAD] + self.rates[:, :, GOOD])), strict=True))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good) of each row of votes."""
        likelihood = np.log(self.rates[:, np.arange(len(self.names)), votes]).sum(axis=2)
        odds = np.log(self.prior) - np.log1p(-self.prior) + likelihood[1] - likelihood[0]
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, names: list[str], rounds: int = 200) -> LabelModel:
    """Fits a label model to distinct rows of votes and how often each occurs.

    It starts from the balance of the votes; two bad ones outweigh all others, as each labeller
    knows some defects only. All rates are smoothed.
    """
    good = np.array([0.95, 0.6, 0.1])[np.minimum((votes == BAD).sum(axis=1), 2)]
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        hits = np.stack([weight @ (votes == v) for v in (BAD, GOOD, ABSTAIN)], axis=2)
        model = LabelModel(names, float(np.clip(weight[1].sum() / max(counts.sum(), 1e-9), 0.01, 0.99)), (hits + 0.5) / (hits.sum(axis=2, keepdims=True) + 1.5))
        before, good = good, model.posterior(votes)
        if np.abs(good - before).max(initial=0) < 1e-6:
            break
    return model


def votes_of(patterns: np.ndarray, k: int) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(k)) % 3


def fit_labels(docs: DataFrame, text_col: str = "text") -> tuple[LabelModel, int]:
    """The label model of all texts that are not blank, and their number."""
    text = docs.select(F.col(text_col).alias("text")).where(has_text(F.col("text")))
    rows = with_votes(text, "text").groupBy("votes").count().collect()
    patterns = np.array([r["votes"] for r in rows], dtype=np.int64)
    counts = np.array([r["count"] for r in rows], dtype=float)
    return expectation_maximisation(votes_of(patterns, len(LABELLERS)), counts, list(LABELLERS)), int(counts.sum())


def _literal(values: np.ndarray) -> Column:
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def with_slots(rows: DataFrame, text_col: str, out: str = "slots") -> DataFrame:
    """``rows`` and the hashed slots of a text's word shapes and of adjacent pairs of them.

    A shape has A for a run of capitals, a for a run of other letters, 0 for digits; a word that
    repeats the one before it has a shape of its own.
    """
    names, text = rows.columns, F.trim(F.col(text_col))
    shaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Lu}+", "A"), r"[\p{L}&&[^\p{Lu}]]+", "a"), r"\p{N}+", "0")
    rows = rows.select("*", F.split(shaped, r"\s+").alias("__q_shapes"), F.split(text, r"\s+").alias("__q_tokens"))
    again = F.zip_with("__q_tokens", F.concat(F.array(F.lit(None).cast("string")), F.slice("__q_tokens", 1, F.size("__q_tokens") - 1)), lambda a, b: a.eqNullSafe(b))
    rows = rows.select(*names, F.zip_with("__q_shapes", again, lambda w, same: F.when(same, 0).otherwise(F.hash(w))).alias("__q_hashed"))
    hashed = F.col("__q_hashed")
    single = F.transform(hashed, lambda h: F.pmod(h, F.lit(SLOTS)))
    pairs = F.zip_with(hashed, F.slice(hashed, 2, F.size(hashed)), lambda a, b: F.pmod(F.hash(a, b), F.lit(SLOTS)))
    return rows.select(*names, F.concat(single, pairs).alias(out))


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    labels: LabelModel
    threshold: float = 0.5

    def add_score(self, rows: DataFrame, text_col: str, out: str = "quality_score") -> DataFrame:
        """``rows`` and P(good); 0 for null and blank texts."""
        names, table, text = rows.columns, _literal(self.weights), F.col(f"`{text_col}`")
        # Always true, but not deterministic for the planner: else a filter on the score is pushed
        # down to the scan, where it computes the slots anew for each place that uses them.
        here = F.monotonically_increasing_id() >= 0
        total = F.aggregate("__q_slots", F.lit(0.0), lambda s, i: s + F.get(table, i))
        score = 1 / (1 + F.exp(-(total / (F.size("__q_slots") + PRIOR_SLOTS) + self.bias)))
        return with_slots(rows, text_col, "__q_slots").select(*names, F.when(here & has_text(text), score).otherwise(0.0).alias(out))


def logistic(x: np.ndarray, y: np.ndarray, bias: float, rounds: int = 400, l2: float = 1e-3) -> np.ndarray:
    """Weights by accelerated full-batch gradient descent, for targets in [0, 1] and a fixed bias."""
    scale = np.sqrt((x**2).mean(axis=0)) + 0.02  # rare shapes count for less
    z = x / scale
    step = 4.0 / (np.einsum("ij,ij->i", z, z).mean() + 1)
    w, velocity = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(rounds):
        look = w + t / (t + 3) * velocity
        error = 1 / (1 + np.exp(-np.clip(z @ look + bias, -50, 50))) - y
        new = look - step * (z.T @ error / len(y) + l2 * look)
        velocity, w = new - w, new
    return w / scale


def fit(docs: DataFrame, text_col: str = "text", max_train_docs: int = 3000, threshold: float = 0.5) -> Scorer:
    labels, total = fit_labels(docs, text_col)
    if not total:
        return Scorer(np.zeros(SLOTS), 0.0, labels, threshold)
    k = len(labels.names)
    posteriors = _literal(labels.posterior(votes_of(np.arange(3**k), k)))
    bias = float(np.log(labels.prior) - np.log1p(-labels.prior))  # without evidence the prior decides
    distinct = docs.select(F.approx_count_distinct(F.xxhash64(text_col)).alias("n")).first()["n"]
    whole = 1 << 48
    share = min(whole, max_train_docs * whole // max(1, distinct) + 1)
    rows = docs.select(F.col(text_col).alias("text")).where(has_text(F.col("text"))).withColumn("key", F.xxhash64("text"))
    # Written down first: else the planner computes the slots of every row to test their size.
    # Copies count once, so that a text with very many of them can't swell the sample.
    sample = cut_lineage(rows.where(F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(whole)) < share).dropDuplicates(["key"]))
    slots = with_slots(with_votes(sample, "text"), "text").select("key", F.get(posteriors, F.col("votes")).alias("y"), F.explode("slots").alias("slot"))
    found = slots.groupBy("key", "slot").agg(F.count("*").alias("n"), F.first("y").alias("y")).toPandas()
    if not len(found):
        return Scorer(np.zeros(SLOTS), bias, labels, threshold)
    keys, row = np.unique(found["key"].to_numpy(), return_inverse=True)
    used, column = np.unique(found["slot"].to_numpy(), return_inverse=True)
    x = np.zeros((len(keys), len(used)))
    x[row, column] = found["n"].to_numpy()
    x /= x.sum(axis=1, keepdims=True) + PRIOR_SLOTS
    y = np.zeros(len(keys))
    y[row] = found["y"].to_numpy()
    weights = np.zeros(SLOTS)
    weights[used] = logistic(x, y, bias)
    return Scorer(weights, bias, labels, threshold)


def classify(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """All columns and quality_score, quality_keep (columns of these names are replaced)."""
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("quality_score", "quality_keep")])
    scored = scorer.add_score(rest, text_col)
    keep = (F.col("quality_score") >= scorer.threshold) & has_text(F.col(f"`{text_col}`"))
    return scored.withColumn("quality_keep", keep)
